"""Item -> entity roll-up and the three binary targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions.exprs import rint_round
from tavola.functions.stats import quantiles

# Default entity key and target thresholds.
ENTITY_KEYS = ("restaurant_name", "city", "location")
RATING_THRESHOLD = 4.2
POPULARITY_THRESHOLD = 100
PRICE_THRESHOLD_PERCENTILE = 0.8
TARGETS = ("is_high_rated", "is_popular", "is_premium")


def rollup_entities(items: DataFrame, keys: Sequence[str] = ENTITY_KEYS, price: str = "price",
                    rating: str = "rating", rating_count: str = "rating_count",
                    category: str = "category", item_name: str = "dish_name",
                    median_method: str = "auto") -> DataFrame:
    """One row per entity; rows with a null key are dropped.

    Averages, counts (non-null), sample standard deviations, the exact median
    rating, rating-count sum/mean/max, the sorted distinct categories joined
    by ', ' (null -> 'unknown') and the item count.  Numbers are rounded to 2
    decimals half-to-even, as numpy.

    One hash aggregate keyed on the entity: avg/count/stddev/sum/max combine
    map-side; the median and the category set keep one entry per *distinct*
    rating / category of the entity, so even an entity holding a third of all
    rows needs only a small buffer.  That bound is checked (``auto``): if the
    median column has more distinct values than the exact-quantile limit,
    the medians come from ``exact_group_medians`` (range-partitioned running
    counts) and are joined on the key instead.
    """
    from tavola.functions.distributed_quantile import exact_group_medians, number
    from tavola.functions.stats import choose_methods

    keys = list(keys)
    r2 = rint_round
    base = items.dropna(subset=keys)
    if median_method == "auto":
        median_method = choose_methods(base, [rating])[rating]
    if median_method == "exact":
        median = r2(F.percentile(number(F.col(rating)), F.lit(0.5))).alias("median_rating")
    else:
        median = F.lit(None).cast("double").alias("median_rating")
    g = (base
         .groupBy(*keys)
         .agg(r2(F.avg(price)).alias("avg_price"),
              F.count(price).alias("dish_count"),
              r2(F.stddev_samp(price)).alias("price_std"),
              r2(F.avg(rating)).alias("avg_rating"),
              median,
              r2(F.stddev_samp(rating)).alias("rating_std"),
              F.coalesce(F.sum(rating_count), F.lit(0)).alias("total_rating_count"),
              r2(F.avg(rating_count)).alias("avg_rating_count"),
              F.max(rating_count).alias("max_rating_count"),
              F.array_join(F.array_sort(F.collect_set(F.coalesce(F.col(category), F.lit("unknown")))),
                           ", ").alias("categories"),
              F.count(item_name).alias("total_dishes")))
    if median_method != "exact":
        med = exact_group_medians(base, keys, rating, "_med")
        cols = g.columns
        g = (g.drop("median_rating").join(med, on=keys, how="left")
             .withColumn("median_rating", r2(F.col("_med"))).select(*cols))
    return g


def entity_scores(e: DataFrame) -> DataFrame:
    """price_per_dish = avg_price; popularity_score = avg_rating * ln(1 + total_rating_count)."""
    return e.withColumns({
        "price_per_dish": F.col("avg_price"),
        "popularity_score": F.col("avg_rating") * F.log1p(F.col("total_rating_count").cast("double")),
    })


def _flag(cond) -> F.Column:
    return F.coalesce(cond.cast("int"), F.lit(0))


def label_high_rated(e: DataFrame, threshold: float = RATING_THRESHOLD, column: str = "avg_rating",
                     out: str = "is_high_rated") -> DataFrame:
    return e.withColumn(out, _flag(F.col(column) >= F.lit(threshold)))


def label_popular(e: DataFrame, threshold: float = POPULARITY_THRESHOLD,
                  column: str = "total_rating_count", out: str = "is_popular") -> DataFrame:
    return e.withColumn(out, _flag(F.col(column) >= F.lit(threshold)))


def label_premium(e: DataFrame, percentile: float = PRICE_THRESHOLD_PERCENTILE,
                  column: str = "avg_price", out: str = "is_premium", method: str = "auto") -> DataFrame:
    """avg_price >= the given linear percentile of avg_price over all entities."""
    t = quantiles(e, column, [percentile], method=method).getItem(0)
    return e.withColumn(out, _flag(F.col(column) >= t))


def entity_table(items_clean: DataFrame, keys: Sequence[str] = ENTITY_KEYS) -> DataFrame:
    """Roll-up + scores + the three targets (the reference's entity table)."""
    return (rollup_entities(items_clean, keys)
            .transform(entity_scores)
            .transform(label_high_rated)
            .transform(label_popular)
            .transform(label_premium))
