"""Exploratory aggregates, sorts and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.operators.rollup import TARGETS


def target_balance(e: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Per target: positives, negatives and % positive (one pass, unpivoted)."""
    long = e.unpivot([], list(targets), "target", "label")
    return (long.groupBy("target")
            .agg(F.sum("label").cast("long").alias("positives"),
                 F.count_if(F.col("label") == 0).alias("negatives"),
                 (F.avg("label") * 100).alias("pct_positive")))


def _top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent non-null values of ``column`` (ties by value),
    one row each; a global TakeOrdered over the distinct-value counts."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
            .orderBy(F.desc("_n"), F.asc(column)).limit(k).select(column))


def price_by_category(items: DataFrame, top: int = 15, category: str = "category",
                      price: str = "price") -> DataFrame:
    """Box statistics of ``price`` for the ``top`` most frequent categories:
    n, min, Q1, median, Q3, max and the 1.5*IQR whiskers clipped to the data.

    Counts come first: of the items of the ``top`` categories, told by a join with
    that many rows, one (category, price) count table is computed, and the exact
    quartiles (from its running counts) and the whiskers come from it.  A category that
    holds a third of the items is pre-aggregated before the shuffle, and its prices are
    spread over tasks.
    """
    from tavola.functions.windows import prefix_sums

    names = (items.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("_n"), F.count(price).alias("n"))
             .orderBy(F.desc("_n"), F.asc(category)).limit(top).select(category, "n"))
    every = (items.join(F.broadcast(names.select(category)), category, "left_semi").where(F.col(price).isNotNull())
             .groupBy(category, price).agg(F.count("*").alias("_f")))
    cum = prefix_sums(every, [category], price, ["_f"], descending=True)
    freq = cum.join(F.broadcast(names), category)  # ``top`` rows
    # rank r from below is rank n - 1 - r from above
    aggs, parts = [], []
    for i, p in enumerate((0.25, 0.5, 0.75)):
        pos = (F.col("n") - 1) * F.lit(p)
        for k, r in enumerate((F.floor(pos), F.least(F.floor(pos) + 1, F.col("n") - 1))):
            top_rank = F.col("n") - 1 - r
            aggs.append(F.max(F.when((F.col("cum__f") - F.col("_f") <= top_rank) & (top_rank < F.col("cum__f")), F.col(price))).alias(f"_v{i}{k}"))
        parts.append(F.col(f"_v{i}0") + (F.col(f"_v{i}1") - F.col(f"_v{i}0")) * (pos - F.floor(pos)))
    qs = (freq.groupBy(category, "n").agg(F.min(price).alias("min"), F.max(price).alias("max"), *aggs)
          .select(category, "n", "min", "max", *[c.alias(n) for c, n in zip(parts, ("q1", "median", "q3"))]))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    # Whiskers: the most extreme data points inside the fences (second pass
    # over the per-price counts joined with one row per category).
    whisk = (freq.join(F.broadcast(qs.select(category, lo.alias("_lo"), hi.alias("_hi"))), on=category)
             .groupBy(category)
             .agg(F.min(F.when(F.col(price) >= F.col("_lo"), F.col(price))).alias("whisker_low"),
                  F.max(F.when(F.col(price) <= F.col("_hi"), F.col(price))).alias("whisker_high")))
    return qs.join(whisk, on=category)


def avg_price_by_category(items: DataFrame, top: int = 15, category: str = "category",
                          price: str = "price") -> DataFrame:
    """Mean price of the ``top`` most frequent categories, descending."""
    keep = items.join(F.broadcast(_top_values(items, category, top)), on=category, how="left_semi")
    return (keep.groupBy(category).agg(F.avg(price).alias("avg_price"))
            .orderBy(F.desc("avg_price"), category).limit(top))


ITEM_REPORT_COLS = ("dish_name", "category", "rating", "rating_count", "price")


def top_items_by_count(items: DataFrame, n: int = 20, count_col: str = "rating_count",
                       cols: Sequence[str] = ITEM_REPORT_COLS) -> DataFrame:
    """Items with the largest ``count_col`` (nulls excluded); ties broken by
    the remaining report columns so the result is deterministic."""
    cols = list(cols)
    rest = [c for c in cols if c != count_col]
    return (items.where(F.col(count_col).isNotNull()).select(*cols)
            .orderBy(F.desc(count_col), *[F.asc_nulls_last(c) for c in rest]).limit(n))


def top_items_by_rating(items: DataFrame, n: int = 15, min_count: int = 50, rating: str = "rating",
                        count_col: str = "rating_count", cols: Sequence[str] = ITEM_REPORT_COLS) -> DataFrame:
    """Items with ``count_col >= min_count``, highest ``rating`` first."""
    cols = list(cols)
    rest = [c for c in cols if c != rating]
    return (items.where((F.col(count_col) >= min_count) & F.col(rating).isNotNull()).select(*cols)
            .orderBy(F.desc(rating), *[F.asc_nulls_last(c) for c in rest]).limit(n))


def entities_by_city(e: DataFrame, top: int = 15, city: str = "city") -> DataFrame:
    return (e.groupBy(city).agg(F.count("*").alias("entities"))
            .orderBy(F.desc("entities"), city).limit(top))


def avg_rating_by_city(e: DataFrame, top: int = 15, city: str = "city",
                       rating: str = "avg_rating") -> DataFrame:
    return (e.groupBy(city).agg(F.avg(rating).alias("mean_avg_rating"))
            .where(F.col("mean_avg_rating").isNotNull())
            .orderBy(F.desc("mean_avg_rating"), city).limit(top))


def scatter_binned(df: DataFrame, x: str, y: str, bins: int = 20, value: str | None = None) -> DataFrame:
    """The data behind a scatter plot as a 2-D histogram: equal-width bins on
    both axes over [min, max], (x_bin, y_bin, count[, mean of value]).  The
    ranges are one scalar subquery; each row computes two bin numbers."""
    from tavola.operators.profile import _range_stats, equal_width_bin

    st = _range_stats(df, [x, y])
    d = df.select(st.alias("_st"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                  *([F.col(value).cast("double").alias("_v")] if value else []))
    d = d.select(equal_width_bin(F.col("_x"), F.col("_st.lo0"), F.col("_st.w0"), bins).alias("x_bin"),
                 equal_width_bin(F.col("_y"), F.col("_st.lo1"), F.col("_st.w1"), bins).alias("y_bin"),
                 *(["_v"] if value else []))
    d = d.where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
    aggs = [F.count("*").alias("count")] + ([F.avg("_v").alias(f"mean_{value}")] if value else [])
    return d.groupBy("x_bin", "y_bin").agg(*aggs)
