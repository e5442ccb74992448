"""Registered queries: validation and profiling of the raw item table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.operators import profile as P
from tavola.plans import venue
from tavola.plans.catalog import register

ITEM_COLS = ("state", "city", "restaurant_name", "location", "category", "dish_name",
             "price", "rating", "rating_count")
TEXT_COLS = ITEM_COLS[:6]
NUM_COLS = ("price", "rating", "rating_count")
ENTITY_NUM = ("avg_price", "dish_count", "price_std", "avg_rating", "median_rating", "rating_std",
              "total_rating_count", "avg_rating_count", "max_rating_count", "total_dishes",
              "popularity_score")


def _nulls_sql(cols):
    return ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in cols)


@register("profile_missing", f"""
SELECT column_name, missing, CAST(missing AS DOUBLE) * 100 / n AS missing_pct
FROM (UNPIVOT (SELECT count(*) AS n, {_nulls_sql(ITEM_COLS)} FROM fx_items)
      ON {", ".join(ITEM_COLS)} INTO NAME column_name VALUE missing)
WHERE missing > 0
""", ("fx_items",), dbl=("missing_pct",))
def q_profile_missing(spark, sf):
    return P.profile_missing(venue.raw_items(spark, sf))


@register("profile_duplicates", """
SELECT rows, duplicates, CAST(duplicates AS DOUBLE) * 100 / rows AS duplicate_pct
FROM (SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_items)) AS duplicates
      FROM fx_items)
""", ("fx_items",), dbl=("duplicate_pct",))
def q_profile_duplicates(spark, sf):
    return P.profile_duplicates(venue.raw_items(spark, sf))


_SCHEMA_ROWS = ", ".join(
    f"({i}, '{c}', '{t}', {n})" for i, (c, t, n) in enumerate(
        [(c, "string", 6) for c in TEXT_COLS] + [("price", "double", 2), ("rating", "double", 2),
                                                  ("rating_count", "int", 1)]))


@register("profile_schema", f"""
SELECT t.*, (SELECT count(*) FROM fx_items) AS n_rows, 9 AS n_columns
FROM (VALUES {_SCHEMA_ROWS}) AS t(position, column_name, dtype, dtype_count)
""", ("fx_items",))
def q_profile_schema(spark, sf):
    return P.profile_schema(venue.raw_items(spark, sf))


@register("check_types", """
SELECT column_name, expected, actual FROM (VALUES ('rating_count', 'bigint', 'int')) AS t(column_name, expected, actual)
WHERE (SELECT count(*) FROM fx_items) >= 0
""", ("fx_items",))
def q_check_types(spark, sf):
    # The reference's validator expectations (another data set's columns) are
    # an argument; with them 'rating'/'city'/... are checked against our types.
    expected = {"restaurant_name": "string", "location": "string", "city": "string",
                "rating": "double", "votes": "bigint", "rating_count": "bigint"}
    return P.check_types(venue.raw_items(spark, sf), expected)


@register("check_ranges", """
SELECT 'rating' AS column_name, CAST(min(rating) AS DOUBLE) AS min, CAST(max(rating) AS DOUBLE) AS max,
       CAST(0 AS DOUBLE) AS valid_low, CAST(5 AS DOUBLE) AS valid_high,
       count(*) FILTER (WHERE rating < 0) AS n_below, count(*) FILTER (WHERE rating > 5) AS n_above
FROM fx_items
UNION ALL
SELECT 'price', min(price), max(price), 0, 10000,
       count(*) FILTER (WHERE price < 0), count(*) FILTER (WHERE price > 10000)
FROM fx_items
""", ("fx_items",), dbl=("min", "max", "valid_low", "valid_high"))
def q_check_ranges(spark, sf):
    return P.check_ranges(venue.raw_items(spark, sf))


_pct_sum = " + ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100 / count(*)" for c in ITEM_COLS)
_cells = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ITEM_COLS)


@register("validation_report", f"""
SELECT *, greatest(CAST(0 AS DOUBLE), 100 - least(missing_pct_sum * 0.5, 30) - least(duplicate_pct * 2, 20)
                   - least(CAST(type_issues AS DOUBLE) * 5, 20)) AS quality_score
FROM (
  SELECT n_rows, missing_cells, missing_pct_sum, rating_min, rating_max, price_min, price_max,
         9 AS n_columns, duplicates, CAST(duplicates AS DOUBLE) * 100 / n_rows AS duplicate_pct, 1 AS type_issues,
         nulls, ranges, 'rating_count:bigint:int' AS type_issue_rows
  FROM (SELECT concat_ws('; ', {", ".join(f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN '{c}=' || count(*) FILTER (WHERE {c} IS NULL) END" for c in ITEM_COLS)}) AS nulls,
               'rating:' || count(*) FILTER (WHERE rating < 0) || ':' || count(*) FILTER (WHERE rating > 5) || '; price:'
                 || count(*) FILTER (WHERE price < 0) || ':' || count(*) FILTER (WHERE price > 10000) AS ranges, count(*) AS n_rows, CAST({_cells} AS BIGINT) AS missing_cells, {_pct_sum} AS missing_pct_sum,
               CAST(min(rating) AS DOUBLE) AS rating_min, CAST(max(rating) AS DOUBLE) AS rating_max,
               CAST(min(price) AS DOUBLE) AS price_min, CAST(max(price) AS DOUBLE) AS price_max,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_items)) AS duplicates
        FROM fx_items))
""", ("fx_items",), dbl=("missing_pct_sum", "rating_min", "rating_max", "price_min", "price_max",
                         "duplicate_pct", "quality_score"))
def q_validation_report(spark, sf):
    r = P.validation_report(venue.raw_items(spark, sf), {"rating": "double", "rating_count": "bigint"})
    shown = {"nulls": lambda s: F.concat(s["column_name"], F.lit("="), s["missing"].cast("string")),
             "ranges": lambda s: F.concat_ws(":", s["column_name"], s["n_below"].cast("string"), s["n_above"].cast("string")),
             "type_issue_rows": lambda s: F.concat_ws(":", s["column_name"], s["expected"], s["actual"])}
    return r.withColumns({c: F.array_join(F.transform(c, f), "; ") for c, f in shown.items()})


def _hist_sql(src: str, cols, bins: int) -> str:
    stats = ", ".join(f"CAST(min({c}) AS DOUBLE) AS mn{i}, CAST(max({c}) AS DOUBLE) AS mx{i}"
                      for i, c in enumerate(cols))
    parts = []
    for i, c in enumerate(cols):
        lo = f"CASE WHEN mn{i} = mx{i} THEN mn{i} - 0.5 ELSE mn{i} END"
        hi = f"CASE WHEN mn{i} = mx{i} THEN mx{i} + 0.5 ELSE mx{i} END"
        parts.append(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x, {lo} AS lo, {hi} AS hi FROM {src}, st")
    long = " UNION ALL ".join(parts)
    return f"""
SELECT column_name, bin, lo + bin * ((hi - lo) / {bins}.0) AS bin_lo, lo + (bin + 1) * ((hi - lo) / {bins}.0) AS bin_hi,
       count(*) AS count
FROM (SELECT column_name, lo, hi, CAST(CASE WHEN floor((x - lo) / (hi - lo) * {float(bins)}) > {bins - 1} THEN {bins - 1}
                   ELSE floor((x - lo) / (hi - lo) * {float(bins)}) END AS INTEGER) AS bin
      FROM (WITH st AS (SELECT {stats} FROM {src}) {long}) WHERE x IS NOT NULL)
GROUP BY column_name, bin, lo, hi
"""


@register("numeric_histogram", _hist_sql("fx_items", NUM_COLS, 30), ("fx_items",), dbl=("bin_lo", "bin_hi"))
def q_numeric_histogram(spark, sf):
    return P.numeric_histogram(venue.raw_items(spark, sf), list(NUM_COLS), 30)


@register("entity_histogram", _hist_sql("entities", ("dish_count", "avg_price"), 50), ("entities",),
          dbl=("bin_lo", "bin_hi"))
def q_entity_histogram(spark, sf):
    return P.numeric_histogram(venue.entities(spark, sf), ["dish_count", "avg_price"], 50)


_vc_long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM fx_items" for c in TEXT_COLS)


@register("value_counts", f"""
SELECT * FROM (
  SELECT column_name, value, count, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank
  FROM (SELECT column_name, value, count(*) AS count FROM ({_vc_long}) WHERE value IS NOT NULL GROUP BY column_name, value))
WHERE rank <= 15
""", ("fx_items",))
def q_value_counts(spark, sf):
    return P.value_counts(venue.raw_items(spark, sf), list(TEXT_COLS), 15)


def _corr_sql(src: str, cols) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c{i}" for i, (a, b) in enumerate(pairs))
    rows = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
                              f"CASE WHEN isnan(c{i}) THEN NULL ELSE c{i} END AS r FROM w"
                              for i, (a, b) in enumerate(pairs))
    return f"WITH w AS (SELECT {aggs} FROM {src}) {rows}"


@register("correlation_matrix", _corr_sql("entities", ENTITY_NUM), ("entities",), dbl=("r",))
def q_correlation_matrix(spark, sf):
    return P.correlation_matrix(venue.entities(spark, sf), list(ENTITY_NUM))


@register("quality_score", f"""
SELECT greatest(CAST(0 AS DOUBLE), 100 - least(missing_pct_sum * 0.5, 30) - least(duplicate_pct * 2, 20)
                - least(CAST(0 AS DOUBLE) * 5, 20)) AS quality_score
FROM (SELECT {_pct_sum} AS missing_pct_sum,
             CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_items)) AS DOUBLE) * 100 / count(*) AS duplicate_pct
      FROM fx_items)
""", ("fx_items",), dbl=("quality_score",))
def q_quality_score(spark, sf):
    return P.validation_report(venue.raw_items(spark, sf)).select("quality_score")
