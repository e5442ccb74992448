"""Registered queries: exploratory aggregates, sorts, top-k."""

from __future__ import annotations

from tavola.operators import eda
from tavola.plans import venue
from tavola.plans.catalog import register

_TOPCAT = """top_cat AS (SELECT category FROM items_clean WHERE category IS NOT NULL GROUP BY category
                      ORDER BY count(*) DESC, category LIMIT 15)"""


@register("price_by_category", f"""
WITH {_TOPCAT},
k AS (SELECT category, price FROM items_clean WHERE category IN (SELECT category FROM top_cat) AND price IS NOT NULL),
s AS (SELECT category, count(*) AS n, min(price) AS min, max(price) AS max,
             quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3
      FROM k GROUP BY category)
SELECT s.*, (SELECT min(price) FROM k WHERE k.category = s.category AND price >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
            (SELECT max(price) FROM k WHERE k.category = s.category AND price <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM s
""", ("items_clean",), dbl=("min", "max", "q1", "median", "q3", "whisker_low", "whisker_high"))
def q_price_by_category(spark, sf):
    return eda.price_by_category(venue.clean(spark, sf))


@register("avg_price_by_category", f"""
WITH {_TOPCAT}
SELECT category, avg(price) AS avg_price FROM items_clean
WHERE category IN (SELECT category FROM top_cat) GROUP BY category ORDER BY avg_price DESC, category LIMIT 15
""", ("items_clean",), dbl=("avg_price",))
def q_avg_price_by_category(spark, sf):
    return eda.avg_price_by_category(venue.clean(spark, sf))


@register("top_items_by_count", """
SELECT dish_name, category, rating, rating_count, price FROM items_clean WHERE rating_count IS NOT NULL
ORDER BY rating_count DESC, dish_name NULLS LAST, category NULLS LAST, rating NULLS LAST, price NULLS LAST LIMIT 20
""", ("items_clean",), dbl=("rating", "price"))
def q_top_items_by_count(spark, sf):
    return eda.top_items_by_count(venue.clean(spark, sf))


@register("top_items_by_rating", """
SELECT dish_name, category, rating, rating_count, price FROM items_clean
WHERE rating_count >= 50 AND rating IS NOT NULL
ORDER BY rating DESC, dish_name NULLS LAST, category NULLS LAST, rating_count NULLS LAST, price NULLS LAST LIMIT 15
""", ("items_clean",), dbl=("rating", "price"))
def q_top_items_by_rating(spark, sf):
    return eda.top_items_by_rating(venue.clean(spark, sf))


@register("entities_by_city", """
SELECT city, count(*) AS entities FROM entities GROUP BY city ORDER BY entities DESC, city LIMIT 15
""", ("entities",))
def q_entities_by_city(spark, sf):
    return eda.entities_by_city(venue.entities(spark, sf))


@register("avg_rating_by_city", """
SELECT city, avg(avg_rating) AS mean_avg_rating FROM entities GROUP BY city
HAVING avg(avg_rating) IS NOT NULL ORDER BY mean_avg_rating DESC, city LIMIT 15
""", ("entities",), dbl=("mean_avg_rating",))
def q_avg_rating_by_city(spark, sf):
    return eda.avg_rating_by_city(venue.entities(spark, sf))


def _scatter_sql(src, x, y, bins, value=None):
    def b(c, mn, mx):
        lo = f"(CASE WHEN {mn} = {mx} THEN {mn} - 0.5 ELSE {mn} END)"
        hi = f"(CASE WHEN {mn} = {mx} THEN {mx} + 0.5 ELSE {mx} END)"
        raw = f"floor((CAST({c} AS DOUBLE) - {lo}) / ({hi} - {lo}) * {float(bins)})"
        return f"CAST(CASE WHEN {raw} > {bins - 1} THEN {bins - 1} ELSE {raw} END AS INTEGER)"
    v = f", avg(CAST({value} AS DOUBLE)) AS mean_{value}" if value else ""
    vv = f", {value}" if value else ""
    return f"""
WITH st AS (SELECT CAST(min({x}) AS DOUBLE) AS x_mn, CAST(max({x}) AS DOUBLE) AS x_mx,
                   CAST(min({y}) AS DOUBLE) AS y_mn, CAST(max({y}) AS DOUBLE) AS y_mx FROM {src}),
d AS (SELECT {b(x, 'x_mn', 'x_mx')} AS x_bin, {b(y, 'y_mn', 'y_mx')} AS y_bin{vv} FROM {src}, st)
SELECT x_bin, y_bin, count(*) AS count{v} FROM d WHERE x_bin IS NOT NULL AND y_bin IS NOT NULL GROUP BY x_bin, y_bin
"""


@register("scatter_rating_price", _scatter_sql("items_clean", "rating", "price", 20), ("items_clean",))
def q_scatter_rating_price(spark, sf):
    return eda.scatter_binned(venue.clean(spark, sf), "rating", "price", 20)


@register("scatter_entity_price_rating",
          _scatter_sql("entities", "avg_price", "avg_rating", 20, "total_rating_count"), ("entities",),
          dbl=("mean_total_rating_count",))
def q_scatter_entity(spark, sf):
    return eda.scatter_binned(venue.entities(spark, sf), "avg_price", "avg_rating", 20, "total_rating_count")


@register("scatter_price_count", _scatter_sql("items_clean", "price", "rating_count", 20), ("items_clean",))
def q_scatter_price_count(spark, sf):
    return eda.scatter_binned(venue.clean(spark, sf), "price", "rating_count", 20)
