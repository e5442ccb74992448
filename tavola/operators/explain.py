"""Interpretation of scored tables: feature/prediction correlations,
prediction statistics and the per-task insight report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.exprs import q


def prediction_correlations(scored: DataFrame, features: Sequence[str], p: str = "p",
                            group: str = "task") -> DataFrame:
    """Pearson r of each feature with the predicted probability, per group;
    one aggregate, unpivoted."""
    feats = list(features)
    g = scored.groupBy(group).agg(*[F.corr(F.col(q(f)).cast("double"), F.col(p)).alias(f"c{i}")
                                    for i, f in enumerate(feats)])
    rows = [F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f"c{i}"), F.lit(None).cast("double")).alias("r"))
            for i, f in enumerate(feats)]
    return g.select(group, F.inline(F.array(*rows)))


def prediction_stats(scored: DataFrame, p: str = "p", y: str = "y", pred: str = "prediction", group: str = "task") -> DataFrame:
    """Mean and population std of the probability; ``positive_rate`` is the mean
    of the label, ``predicted_rate`` the share of positive predictions."""
    return scored.groupBy(group).agg(F.avg(p).alias("mean_probability"),
                                     F.stddev_pop(p).alias("std_probability"),
                                     F.avg(F.col(y).cast("double")).alias("positive_rate"),
                                     F.avg(F.col(pred).cast("double")).alias("predicted_rate"))


def insight_report(corrs: DataFrame, group: str = "task", shown: int = 8, saved: int = 5) -> DataFrame:
    """Per group: features ranked by |r| (ties by name), direction
    (r > 0 increases the probability), strength stars (> 0.3 ***, > 0.2 **,
    else *); rank <= ``shown`` kept, ``saved`` marks the top ``saved``.
    One row per (group, feature): the window holds the feature list."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(F.abs("r")), "feature")
    a = F.abs("r")
    r = (corrs.where(F.col("r").isNotNull())
         .withColumn("rank", F.row_number().over(w))
         .withColumn("direction", F.when(F.col("r") > 0, "increases").otherwise("decreases"))
         .withColumn("strength", F.when(a > 0.3, "***").when(a > 0.2, "**").otherwise("*")))
    return r.where(F.col("rank") <= shown).withColumn("saved", F.col("rank") <= saved)
