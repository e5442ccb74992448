"""Evaluation of a scored table (group keys, label y, probability p).

Every metric is exact.  Curves and areas aggregate to one row per distinct
score of a group first (scores are rounded to 4 decimals by the scoring
operators, so a group has at most 10,001 of them), then use running sums
over those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "balanced_accuracy",
           "positive_rate", "n_positive", "n_negative")


def classify(df: DataFrame, p: str = "p", threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(p) >= F.lit(threshold)).cast("int"))


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y",
                     pred: str = "prediction") -> DataFrame:
    yy, pp = F.col(y), F.col(pred)
    return scored.groupBy(*group_cols).agg(
        F.count_if((yy == 1) & (pp == 1)).alias("tp"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
        F.count_if((yy == 0) & (pp == 0)).alias("tn"), F.count_if((yy == 1) & (pp == 0)).alias("fn"))


def classification_metrics(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y",
                           pred: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, F1 (0 on a zero denominator), balanced
    accuracy, positive rate and class counts in one aggregate."""
    c = confusion_counts(scored, group_cols, y, pred)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    spec = _div0(tn, tn + fp)
    return c.select(*group_cols,
                    _div0(tp + tn, n).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                    _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    ((rec + spec) / 2).alias("balanced_accuracy"),
                    _div0(tp + fn, n).alias("positive_rate"),
                    (tp + fn).alias("n_positive"), (tn + fp).alias("n_negative"))


def balanced_accuracy(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y",
                      pred: str = "prediction") -> DataFrame:
    return classification_metrics(scored, group_cols, y, pred).select(*group_cols, "balanced_accuracy")


def class_distribution(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y") -> DataFrame:
    return (scored.groupBy(*group_cols)
            .agg(F.avg(F.col(y).cast("double")).alias("positive_rate"),
                 F.count_if(F.col(y) == 1).alias("n_positive"), F.count_if(F.col(y) == 0).alias("n_negative")))


# Distinct scores per group up to which a plain window (one task per group)
# is used; beyond it the running sums are range-partitioned.
WINDOW_ROWS_LIMIT = 200_000


def _cumulative(scored: DataFrame, group_cols: Sequence[str], y: str, p: str) -> DataFrame:
    """One row per (group, distinct score), highest score first, with running
    true/false positive counts and the group totals.

    Scores rounded to 4 decimals give at most 10,001 rows per group and a
    window per group is used; the size is checked, and raw model scores with
    more distinct values per group use range-partitioned prefix sums
    (``functions.windows.prefix_sums``) so no task holds a whole group."""
    from tavola.functions.windows import prefix_sums

    group_cols = list(group_cols)
    d = (scored.where(F.col(p).isNotNull() & F.col(y).isNotNull())
         .groupBy(*group_cols, p)
         .agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")))
    widest = d.groupBy(*group_cols).count().agg(F.max("count")).first()[0] or 0
    if widest <= WINDOW_ROWS_LIMIT:
        w = Window.partitionBy(*group_cols).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
        g = Window.partitionBy(*group_cols)
        # running sums and group totals share one partitioning: no join
        return (d.withColumn("tps", F.sum("_pos").over(w)).withColumn("fps", F.sum("_neg").over(w))
                .withColumn("tot_pos", F.sum("_pos").over(g)).withColumn("tot_neg", F.sum("_neg").over(g)))
    else:
        d = prefix_sums(d, group_cols, p, ["_pos", "_neg"], descending=True).withColumnsRenamed(
            {"cum__pos": "tps", "cum__neg": "fps"})
    tot = d.groupBy(*group_cols).agg(F.sum("_pos").alias("tot_pos"), F.sum("_neg").alias("tot_neg"))
    return d.join(tot, on=group_cols) if group_cols else d.withColumn(
        "_t", tot.select(F.struct("tot_pos", "tot_neg")).scalar()).select("*", "_t.tot_pos", "_t.tot_neg").drop("_t")


def roc_curve(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score plus the (0, 0) start
    point (threshold null).  Collinear points are kept."""
    c = _cumulative(scored, group_cols, y, p)
    pts = c.select(*group_cols, F.col(p).cast("double").alias("threshold"),
                   _div0(F.col("fps"), F.col("tot_neg")).alias("fpr"), _div0(F.col("tps"), F.col("tot_pos")).alias("tpr"))
    start = c.select(*group_cols).distinct().select(*group_cols, F.lit(None).cast("double").alias("threshold"),
                                                    F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def pr_curve(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, recall, precision) at every distinct score plus the end
    point (recall 0, precision 1, threshold null); ``baseline`` is the
    positive rate."""
    c = _cumulative(scored, group_cols, y, p)
    base = _div0(F.col("tot_pos"), F.col("tot_pos") + F.col("tot_neg"))
    pts = c.select(*group_cols, F.col(p).cast("double").alias("threshold"),
                   _div0(F.col("tps"), F.col("tot_pos")).alias("recall"),
                   _div0(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"), base.alias("baseline"))
    end = (c.select(*group_cols, base.alias("baseline")).distinct()
           .select(*group_cols, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
                   F.lit(1.0).alias("precision"), "baseline"))
    return end.unionByName(pts)


def _areas(c: DataFrame, group_cols: Sequence[str], p: str, which=("roc", "pr")) -> DataFrame:
    """Trapezoid areas from the cumulative frame: ROC (start (0, 0)) and
    precision-recall (start (recall 0, precision 1)), one aggregate.  The
    previous point comes from the running sums minus this score's own counts,
    so no extra window is needed."""
    prev_tps = F.col("tps") - F.col("_pos")
    prev_fps = F.col("fps") - F.col("_neg")
    fpr, tpr = _div0(F.col("fps"), F.col("tot_neg")), _div0(F.col("tps"), F.col("tot_pos"))
    fpr0, tpr0 = _div0(prev_fps, F.col("tot_neg")), _div0(prev_tps, F.col("tot_pos"))
    prec = _div0(F.col("tps"), F.col("tps") + F.col("fps"))
    prec0 = F.when(prev_tps + prev_fps == 0, F.lit(1.0)).otherwise(_div0(prev_tps, prev_tps + prev_fps))
    aggs = []
    if "roc" in which:
        aggs.append(F.sum((fpr - fpr0) * (tpr + tpr0) / 2).alias("roc_auc"))
    if "pr" in which:
        aggs.append(F.sum((tpr - tpr0) * (prec + prec0) / 2).alias("pr_auc"))
    return c.groupBy(*group_cols).agg(*aggs)


def roc_auc(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Exact ROC-AUC (trapezoids over distinct scores = ties averaged)."""
    return _areas(_cumulative(scored, group_cols, y, p), group_cols, p, ("roc",))


def pr_auc(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Trapezoid area under precision-recall, starting at (recall 0,
    precision 1)."""
    return _areas(_cumulative(scored, group_cols, y, p), group_cols, p, ("pr",))


def evaluate(scored: DataFrame, group_cols: Sequence[str] = (), y: str = "y", p: str = "p",
             threshold: float = 0.5) -> DataFrame:
    """All metrics of one (task, model) per row."""
    cl = classify(scored, p, threshold)
    m = classification_metrics(cl, group_cols, y)
    areas = _areas(_cumulative(scored, group_cols, y, p), group_cols, p)
    if group_cols:
        # one row per (task, model) on both sides: a small equi-join
        return m.join(areas, on=list(group_cols))
    a = areas.select(F.struct("roc_auc", "pr_auc")).scalar()
    return m.withColumns({"roc_auc": a.getField("roc_auc"), "pr_auc": a.getField("pr_auc")})


def metrics_long(metrics: DataFrame, group_cols: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    names = [n for n in names if n in metrics.columns]
    return metrics.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def metrics_report(long: DataFrame, group_cols: Sequence[str] = ("task", "model"),
                   names: Sequence[str] = METRICS, digits: int = 3) -> DataFrame:
    """Wide report: one row per (task, model), one column per metric rounded
    to ``digits`` (explicit pivot values, so no extra distinct job)."""
    return (long.groupBy(*group_cols).pivot("metric", list(names))
            .agg(F.first("value")).select(*group_cols, *[F.round(F.col(n), digits).alias(n) for n in names]))


def select_best(metrics: DataFrame, metric: str = "roc_auc", task: str = "task", model: str = "model") -> DataFrame:
    """Per task the model with the highest ``metric`` (ties: smallest model
    name).  The metrics table has one row per (task, model)."""
    w = Window.partitionBy(task).orderBy(F.desc_nulls_last(metric), model)
    return (metrics.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(task, F.col(model).alias("best_model"), F.col(metric).alias(metric)))
