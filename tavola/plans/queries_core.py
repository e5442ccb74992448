"""Registered queries: sources, profiling, cleaning, roll-up, EDA."""

from __future__ import annotations

from tavola.operators import eda
from tavola.operators.clean import clean_items
from tavola.plans import venue
from tavola.plans.catalog import register

ENTITY_DBL = ("avg_price", "price_std", "avg_rating", "median_rating", "rating_std",
              "avg_rating_count", "price_per_dish", "popularity_score")


@register("clean_items", "SELECT * FROM items_clean", ("items_clean",),
          dbl=("price", "rating", "rating_count_log"))
def q_clean_items(spark, sf):
    return clean_items(venue.raw_items(spark, sf))


@register("entity_table", "SELECT * FROM entities", ("entities",), dbl=ENTITY_DBL)
def q_entity_table(spark, sf):
    return venue.entities(spark, sf)


@register("target_balance", """
SELECT target, CAST(sum(label) AS BIGINT) AS positives, count(*) FILTER (WHERE label = 0) AS negatives,
       avg(label) * 100 AS pct_positive
FROM (UNPIVOT (SELECT is_high_rated, is_popular, is_premium FROM entities)
      ON is_high_rated, is_popular, is_premium INTO NAME target VALUE label)
GROUP BY target
""", ("entities",), dbl=("pct_positive",))
def q_target_balance(spark, sf):
    return eda.target_balance(venue.entities(spark, sf))


# --- individual cleaning stages ------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from tavola import fixtures  # noqa: E402
from tavola.functions.stats import quantiles  # noqa: E402
from tavola.operators import clean as C  # noqa: E402
from tavola.operators import rollup as R  # noqa: E402


@register("standardize_columns", "SELECT * FROM fx_items", ("fx_items",), dbl=("price", "rating"))
def q_standardize_columns(spark, sf):
    return C.standardize_columns(fixtures.fx_items_raw(spark, sf))


@register("drop_exact_duplicates", "SELECT * FROM items_dedup", ("items_dedup",), dbl=("price", "rating"))
def q_drop_exact_duplicates(spark, sf):
    return C.drop_exact_duplicates(venue.raw_items(spark, sf))


@register("clean_text", "SELECT * FROM items_text", ("items_text",), dbl=("price", "rating"))
def q_clean_text(spark, sf):
    return C.clean_text(C.drop_exact_duplicates(venue.raw_items(spark, sf)))


@register("cap_outliers_iqr", """
SELECT CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END AS price, lo AS lower_bound, hi AS upper_bound
FROM items_text, price_bounds
""", ("items_text", "price_bounds"), dbl=("price", "lower_bound", "upper_bound"))
def q_cap_outliers_iqr(spark, sf):
    t = venue.items_text(spark, sf)  # renamed, de-duplicated, cleaned: written once, and only its prices are read here
    capped = C.cap_outliers_iqr(t, "price")
    q = quantiles(t, "price", [0.25, 0.75])
    b = F.struct((q[0] - 1.5 * (q[1] - q[0])).alias("lower_bound"), (q[1] + 1.5 * (q[1] - q[0])).alias("upper_bound"))
    return capped.select("price").withColumn("_b", b).select("price", "_b.lower_bound", "_b.upper_bound")


@register("log_transform", "SELECT rating_count, ln(1 + rating_count) AS rating_count_log FROM items_text",
          ("items_text",), dbl=("rating_count_log",))
def q_log_transform(spark, sf):
    return C.log_transform(venue.raw_items(spark, sf).transform(C.drop_exact_duplicates), "rating_count") \
        .select("rating_count", "rating_count_log")


@register("validate_cleaning", """
SELECT rows, (SELECT count(*) FROM entities) AS entities, CAST(rows AS DOUBLE) / (SELECT count(*) FROM entities) AS items_per_entity,
       missing_cells, rows - (SELECT count(*) FROM (SELECT DISTINCT * FROM items_clean)) AS duplicates
FROM (SELECT count(*) AS rows, CAST(""" + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in ("state", "city", "restaurant_name", "location", "category",
                                                     "dish_name", "price", "rating", "rating_count",
                                                     "rating_count_log")) + """ AS BIGINT) AS missing_cells
      FROM items_clean)
""", ("items_clean", "entities"), dbl=("items_per_entity",))
def q_validate_cleaning(spark, sf):
    return C.validate_cleaning(venue.clean(spark, sf), venue.entities(spark, sf))


@register("rollup_entities", "SELECT * FROM entities_raw", ("entities_raw",),
          dbl=("avg_price", "price_std", "avg_rating", "median_rating", "rating_std", "avg_rating_count"))
def q_rollup_entities(spark, sf):
    return R.rollup_entities(venue.clean(spark, sf))


@register("entity_labels", """
SELECT restaurant_name, city, location, price_per_dish, popularity_score, is_high_rated, is_popular, is_premium
FROM entities
""", ("entities",), dbl=("price_per_dish", "popularity_score"))
def q_entity_labels(spark, sf):
    e = R.rollup_entities(venue.clean(spark, sf))
    e = e.transform(R.entity_scores).transform(R.label_high_rated).transform(R.label_popular) \
        .transform(R.label_premium)
    return e.select(*R.ENTITY_KEYS, "price_per_dish", "popularity_score", *R.TARGETS)
