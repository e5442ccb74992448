"""Registered queries: source/sink round trips over data derived from the
driver's tables (files go to the shared checkpoint folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tavola import fixtures
from tavola.operators.clean import standardize_columns
from tavola.operators.features import TASK_FEATURES, one_hot_topk_other
from tavola.operators import evaluate as EV
from tavola.plans import queries_eval, queries_monitor  # noqa: F401  (CTEs)
from tavola.plans import venue
from tavola.plans.catalog import register
from tavola.session import scratch_path
from tavola.sources import io

ITEM_COLS = ("state", "city", "restaurant_name", "location", "category", "dish_name", "price", "rating",
             "rating_count")
_NA = ", ".join("'" + t + "'" for t in io.NA_TOKENS)


def _tmp(spark, name):
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex[:12]}")


@register("read_items", "SELECT " + ", ".join(
    f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END AS {c}" if c not in ("price", "rating", "rating_count")
    else c for c in ITEM_COLS) + " FROM fx_items", ("fx_items",), dbl=("price", "rating"))
def q_read_items(spark, sf):
    """Columns in another order, a column too many, counts as 5.0, NaN cells."""
    path = _tmp(spark, "items_csv")
    raw = fixtures.fx_items_raw(spark, sf)
    raw = (raw.withColumn("Rating Count", F.col("Rating Count").cast("double"))
           .withColumn("Rating", F.coalesce(F.col("Rating").cast("string"), F.lit("NaN"))).withColumn("Extra", F.lit("x")))
    io.write_table(raw.select(*[f"`{c}`" for c in reversed(raw.columns)]), path, "csv")
    return standardize_columns(io.read_items(spark, path))


@register("table_round_trip", "SELECT * FROM entities", ("entities",),
          dbl=("avg_price", "price_std", "avg_rating", "median_rating", "rating_std", "avg_rating_count",
               "price_per_dish", "popularity_score"))
def q_table_round_trip(spark, sf):
    path = _tmp(spark, "entities")
    io.write_table(venue.entities(spark, sf), path)
    return io.read_table(spark, path)


@register("feature_metadata", " UNION ALL ".join(
    [f"SELECT '{t}' AS task, {i} AS position, '{f}' AS feature" for t, fs in TASK_FEATURES.items()
     for i, f in enumerate(fs)]
    + [f"""SELECT '{t}', {len(fs)} + r, 'city_' || city FROM (
         SELECT city, CAST(row_number() OVER (ORDER BY count(*) DESC, city) - 1 AS INTEGER) AS r
         FROM entities GROUP BY city ORDER BY count(*) DESC, city LIMIT 10)
       UNION ALL SELECT '{t}', {len(fs) + 10}, 'city_other'""" for t, fs in TASK_FEATURES.items()]),
    ("entities",))
def q_feature_metadata(spark, sf):
    _d, names = one_hot_topk_other(venue.entities(spark, sf), "city", 10)
    sets = {t: list(fs) + names for t, fs in TASK_FEATURES.items()}
    path = _tmp(spark, "feature_metadata")
    io.save_feature_metadata(io.feature_metadata(spark, sets), path)
    back = io.read_feature_metadata(spark, path)
    assert back == sets
    return spark.read.parquet(path)


@register("write_report_csv", "SELECT * FROM eval_metrics", ("eval_metrics",),
          dbl=("accuracy", "precision", "recall", "f1", "balanced_accuracy", "positive_rate", "roc_auc", "pr_auc"))
def q_write_report_csv(spark, sf):
    m = EV.evaluate(venue.eval_scored(spark, sf), ["task", "model"], "y", "p")
    path = _tmp(spark, "metrics_csv")
    io.write_report(m, path, "csv")
    return io.read_table(spark, path, "csv", schema=m.schema)


@register("write_report_json", "SELECT * FROM log_metrics", ("log_metrics",),
          dbl=("success_rate", "avg_response_time", "p95_response_time"))
def q_write_report_json(spark, sf):
    from tavola.operators.monitor import log_metrics
    m = log_metrics(fixtures.fx_log(spark, sf)).drop("as_of")
    path = _tmp(spark, "monitor_json")
    io.write_report(m, path, "json")
    return io.read_table(spark, path, "json", schema=m.schema)


@register("prediction_log_round_trip", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, model, response_time, success, 2 AS feature_count,
       CAST(log_id AS DOUBLE) AS f_log_id
FROM fx_log
""", ("fx_log",), dbl=("response_time", "f_log_id"))
def q_prediction_log_round_trip(spark, sf):
    log = fixtures.fx_log(spark, sf)
    recs = log.select(F.col("ts").alias("timestamp"), "model",
                      F.create_map(F.lit("log_id"), F.col("log_id").cast("double"),
                                   F.lit("user_bucket"), F.lit(0.0)).alias("features"),
                      F.struct(F.lit(1).alias("prediction"), F.lit(0.5).alias("probability"),
                               F.lit("low").alias("confidence")).alias("prediction"),
                      "response_time", "success")
    path = _tmp(spark, "prediction_log")
    io.append_prediction_log(recs, path)
    back = io.read_prediction_log(spark, path)
    return back.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "model", "response_time",
                       "success", "feature_count", F.col("features")["log_id"].alias("f_log_id"))


@register("prediction_log_stream", """
SELECT model, count(*) AS records, count(*) FILTER (WHERE success) AS successes, avg(response_time) AS avg_response_time,
       CAST(sum(2) AS BIGINT) AS feature_total
FROM fx_log GROUP BY model
""", ("fx_log",), dbl=("avg_response_time",))
def q_prediction_log_stream(spark, sf):
    """The JSON log appended twice, read back as a stream into a per-model
    aggregate (update mode, versioned sink)."""
    from tavola.streaming.jobs import run_to_table
    log = fixtures.fx_log(spark, sf)
    recs = log.select(F.col("ts").alias("timestamp"), "model",
                      F.create_map(F.lit("log_id"), F.col("log_id").cast("double"),
                                   F.lit("user_bucket"), F.lit(0.0)).alias("features"),
                      F.struct(F.lit(1).alias("prediction"), F.lit(0.5).alias("probability"),
                               F.lit("low").alias("confidence")).alias("prediction"),
                      "response_time", "success", F.col("log_id"))
    path = _tmp(spark, "prediction_log_stream")
    # two appends (successful and failed calls); together they hold every record
    io.append_prediction_log(recs.where(F.col("success")).drop("log_id"), path)
    io.append_prediction_log(recs.where(~F.col("success")).drop("log_id"), path)
    stream = io.read_prediction_log_stream(spark, path, max_files_per_trigger=4)
    agg = stream.groupBy("model").agg(F.count("*").alias("records"), F.count_if("success").alias("successes"),
                                      F.avg("response_time").alias("avg_response_time"),
                                      F.sum("feature_count").cast("long").alias("feature_total"))
    return run_to_table(agg, spark, "log-json", "update", ("model",))
