"""DuckDB formulations of the same stages, as named CTEs.

Each oracle query is ``WITH <needed CTEs> <body>``; the CTE text is written
independently of the Spark code (SQL, not DataFrame calls), so the check is a
real cross-engine comparison.  Fixture views are shared text
(``tavola.fixtures``).
"""

from __future__ import annotations

from tavola import fixtures


def _clean(c: str) -> str:
    s = f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
    return f"CASE WHEN {s} IN ('nan', 'none') THEN NULL ELSE regexp_replace({s}, '\\s+', ' ', 'g') END AS {c}"


def _r2(e: str) -> str:
    return f"round_even(round({e}, 9) * 100, 0) / 100"


# name -> (sql, dependencies)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


cte("fx_items", fixtures.FX_ITEMS_SQL)
cte("fx_log", fixtures.FX_LOG_SQL)
cte("fx_scored", fixtures.FX_SCORED_SQL)
cte("fx_items_raw", fixtures.FX_ITEMS_RAW_SQL, "fx_items")
cte("items_dedup", "SELECT DISTINCT * FROM fx_items", "fx_items")
cte("items_text", "SELECT " + ", ".join(_clean(c) for c in
    ("state", "city", "restaurant_name", "location", "category", "dish_name"))
    + ", price, rating, rating_count FROM items_dedup", "items_dedup")
cte("price_bounds", """
SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM items_text)
""", "items_text")
cte("items_clean", """
SELECT state, city, restaurant_name, location, category, dish_name,
       CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END AS price,
       rating, rating_count, ln(1 + rating_count) AS rating_count_log
FROM items_text, price_bounds
""", "items_text", "price_bounds")
cte("entities_raw", f"""
SELECT restaurant_name, city, location,
       {_r2('avg(price)')} AS avg_price,
       count(price) AS dish_count,
       {_r2('stddev_samp(price)')} AS price_std,
       {_r2('avg(rating)')} AS avg_rating,
       {_r2('quantile_cont(rating, 0.5)')} AS median_rating,
       {_r2('stddev_samp(rating)')} AS rating_std,
       CAST(coalesce(sum(rating_count), 0) AS BIGINT) AS total_rating_count,
       {_r2('avg(rating_count)')} AS avg_rating_count,
       max(rating_count) AS max_rating_count,
       string_agg(DISTINCT coalesce(category, 'unknown'), ', ' ORDER BY coalesce(category, 'unknown')) AS categories,
       count(dish_name) AS total_dishes
FROM items_clean
WHERE restaurant_name IS NOT NULL AND city IS NOT NULL AND location IS NOT NULL
GROUP BY restaurant_name, city, location
""", "items_clean")
cte("entities", """
SELECT *, avg_price AS price_per_dish,
       avg_rating * ln(1 + total_rating_count) AS popularity_score,
       coalesce(CAST(avg_rating >= CAST(4.2 AS DOUBLE) AS INT), 0) AS is_high_rated,
       coalesce(CAST(total_rating_count >= 100 AS INT), 0) AS is_popular,
       coalesce(CAST(avg_price >= (SELECT quantile_cont(avg_price, 0.8) FROM entities_raw) AS INT), 0) AS is_premium
FROM entities_raw
""", "entities_raw")


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in CTES[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def build(body: str, *ctes: str, round_cols=(), digits: int = 6) -> str:
    """``WITH`` the needed CTEs (dependencies first), then ``body``.

    ``round_cols`` are double columns rounded to ``digits`` on both engines.
    """
    parts = [f"{n} AS (\n{CTES[n][0].strip()}\n)" for n in _order(ctes)]
    body = body.strip()
    if round_cols:
        # Same operation as the Spark side: rint(round(x, 9) * 10^d) / 10^d.
        scale = f"1e{digits}"
        rep = ", ".join(f"round_even(round({c}, 9) * {scale}, 0) / {scale} AS {c}" for c in round_cols)
        body = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS _q"
    if body[:5].upper() == "WITH " and parts:
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    return head + body
