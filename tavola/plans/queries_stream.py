"""Registered queries: Structured Streaming jobs (run with availableNow)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tavola.operators.rollup import ENTITY_KEYS
from tavola.operators.serving import prediction_records
from tavola.plans import queries_eval  # noqa: F401  (registers requests / rule_scores CTEs)
from tavola.plans import venue
from tavola.plans.catalog import register
from tavola.session import scratch_path
from tavola.sources import io
from tavola.streaming import jobs as J

K = list(ENTITY_KEYS)
KS = ", ".join(K)
_FMT = "'%Y-%m-%d %H:%M:%S'"


@register("stream_hourly_metrics", f"""
SELECT strftime(date_trunc('hour', ts), {_FMT}) AS window_start,
       strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, {_FMT}) AS window_end, model,
       count(*) AS total, avg(CAST(success AS DOUBLE)) AS success_rate, avg(response_time) AS avg_response_time
FROM fx_log GROUP BY ALL
""", ("fx_log",), dbl=("success_rate", "avg_response_time"))
def q_stream_hourly_metrics(spark, sf):
    res = J.run_to_table(J.stream_hourly_metrics(J.log_stream(spark, sf)), spark, "hourly", "update",
                         ("window", "model"))
    return res.select(*J._window_cols(), "model", "total", "success_rate", "avg_response_time")


@register("stream_trailing_metrics", f"""
SELECT strftime(ws, {_FMT}) AS window_start, strftime(ws + INTERVAL 24 HOUR, {_FMT}) AS window_end,
       count(*) AS total, avg(CAST(success AS DOUBLE)) AS success_rate, avg(response_time) AS avg_response_time
FROM (SELECT *, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS ws FROM fx_log, range(24) AS r(k))
GROUP BY ws
""", ("fx_log",), dbl=("success_rate", "avg_response_time"))
def q_stream_trailing_metrics(spark, sf):
    """All windows, from the hourly sums that the stream keeps."""
    totals = J.run_to_table(J.stream_totals(J.log_stream(spark, sf)), spark, "totals", "update")
    return J.trailing_metrics(totals).select(*J._window_cols(), "total", "success_rate", "avg_response_time")


@register("stream_trailing_closed", f"""
SELECT strftime(ws, {_FMT}) AS window_start, strftime(ws + INTERVAL 24 HOUR, {_FMT}) AS window_end,
       count(*) AS total, avg(CAST(success AS DOUBLE)) AS success_rate, avg(response_time) AS avg_response_time
FROM (SELECT *, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS ws FROM fx_log, range(24) AS r(k))
WHERE ws + INTERVAL 24 HOUR <= (SELECT max(ts) FROM fx_log) - INTERVAL 10 MINUTE
GROUP BY ws
""", ("fx_log",), dbl=("success_rate", "avg_response_time"))
def q_stream_trailing_closed(spark, sf):
    """The chain of hourly and 24-hour aggregations; windows the watermark has closed."""
    res = J.run_to_table(J.stream_trailing_metrics(J.log_stream(spark, sf)), spark, "trailing", "append")
    return res.select(*J._window_cols(), "total", "success_rate", "avg_response_time")


@register("stream_alerts", f"""
SELECT strftime(w, {_FMT}) AS window_start, strftime(w + INTERVAL 1 HOUR, {_FMT}) AS window_end,
       'high' AS level, 'success_rate' AS metric, sr AS value
FROM (SELECT date_trunc('hour', ts) AS w, avg(CAST(success AS DOUBLE)) AS sr FROM fx_log GROUP BY w)
WHERE sr < 0.9 AND w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM fx_log) - INTERVAL 10 MINUTE
""", ("fx_log",), dbl=("value",))
def q_stream_alerts(spark, sf):
    """Closed windows only (append mode); the success-rate alerts are exact
    and compared with SQL, the p95 alerts use a sketch (see stream_alerts_p95)."""
    res = J.run_to_table(J.stream_alert_windows(J.log_stream(spark, sf)), spark, "alerts", "append")
    return J.alerts_from_windows(res).where(F.col("level") == "high")


@register("stream_alerts_p95")
def q_stream_alerts_p95(spark, sf):
    res = J.run_to_table(J.stream_alert_windows(J.log_stream(spark, sf)), spark, "alerts95", "append")
    return J.alerts_from_windows(res).where(F.col("level") == "medium")


@register("stream_p95_bounds", f"""
SELECT strftime(w, {_FMT}) AS window_start, quantile_disc(response_time, {0.95 - J.RANK_ERROR}) AS at_least,
       quantile_disc(response_time, {0.95 + J.RANK_ERROR}) AS at_most, true AS p95_between
FROM (SELECT *, date_trunc('hour', ts) AS w FROM fx_log)
WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM fx_log) - INTERVAL 10 MINUTE
GROUP BY w
""", ("fx_log",), dbl=("at_least", "at_most"))
def q_stream_p95_bounds(spark, sf):
    """The streamed p95 of every closed window against the exact quantiles at
    p95 minus and plus the sketch's rank error."""
    from tavola import fixtures
    res = J.run_to_table(J.stream_alert_windows(J.log_stream(spark, sf)), spark, "bounds", "append")
    exact = fixtures.fx_log(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("w")).agg(
        *[F.expr(f"percentile_disc({0.95 + s * J.RANK_ERROR}) WITHIN GROUP (ORDER BY response_time)").alias(n) for s, n in ((-1, "at_least"), (1, "at_most"))])
    both = res.join(exact, F.col("window.start") == F.col("w"))
    return both.select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "at_least", "at_most",
                       F.col("p95_response_time").between(F.col("at_least"), F.col("at_most")).alias("p95_between"))


@register("stream_score", f"""
SELECT {KS}, task AS model, prediction, probability, confidence, true AS success, 12 AS feature_count
FROM rule_scores
""", ("rule_scores",), dbl=("probability",))
def q_stream_score(spark, sf):
    req_dir, log_dir, checkpoint = _stream_folders(spark, "score-rules")
    venue.requests(spark, sf).write.parquet(req_dir)
    J.stream_score(J.request_stream(spark, req_dir, venue.requests(spark, sf).schema), log_dir, checkpoint, K)
    log = io.read_prediction_log(spark, log_dir, ", ".join([io.LOG_SCHEMA, *[f"{k} string" for k in K]]))
    return log.select(*K, "model", "prediction.prediction", "prediction.probability", "prediction.confidence",
                      "success", "feature_count")


def _stream_folders(spark, name: str) -> tuple[str, str, str]:
    """New folders of requests, log and checkpoint."""
    base = scratch_path(spark, f"stream/{name}-{uuid.uuid4().hex[:12]}")
    return tuple(os.path.join(base, x) for x in ("requests", "log", "checkpoint"))


@register("stream_score_models", f"""
SELECT t.model, count(*) AS records, count(*) AS succeeded, 12 AS feature_count, avg(CAST(dish_count AS DOUBLE)) AS avg_dish_count,
       sum(CAST(total_rating_count AS DOUBLE)) AS sum_rating_count, 2 AS runs_with_batches, CAST(0 AS BIGINT) AS unlike_score_batch
FROM requests, (VALUES ('high_rated'), ('popular'), ('premium')) AS t(model) GROUP BY t.model
""", ("requests",), dbl=("avg_dish_count", "sum_rating_count"))
def q_stream_score_models(spark, sf):
    """Saved pipelines on a stream of request files that is stopped and started again
    between files (the last start finds none); the log as the monitor reads it, against
    ``score_requests`` of all requests at once."""
    from tavola.plans.queries_ml import raw_requests, request_models

    models = request_models(spark, sf)
    requests = raw_requests(spark, sf)
    req_dir, log_dir, checkpoint = _stream_folders(spark, "score-models")
    part = F.pmod(F.xxhash64("request_id"), F.lit(4))
    runs = 0
    for files in ((0, 1), (2, 3), ()):
        for k in files:
            requests.where(part == k).write.mode("append").parquet(req_dir)
        runs += int(J.stream_score(J.request_stream(spark, req_dir, requests.schema, 1), log_dir, checkpoint, models=models) > 0)
    log = io.read_prediction_log(spark, log_dir)
    shown = lambda df: df.groupBy("model", F.array_sort(F.map_entries("features")).alias("f"), "prediction").agg(F.count("*").alias("n"))
    want = prediction_records(requests, models, ["request_id"], F.lit(None))
    both = shown(log).withColumn("side", F.lit(1)).unionByName(shown(want).withColumn("side", F.lit(-1)))
    unlike = (both.groupBy("model", "f", "prediction").agg(F.abs(F.sum(F.col("n") * F.col("side"))).alias("d"))
              .groupBy("model").agg(F.sum("d").alias("unlike_score_batch")))
    return (log.groupBy("model").agg(F.count("*").alias("records"), F.count_if("success").alias("succeeded"), F.max("feature_count").alias("feature_count"),
                                     F.avg(F.col("features")["dish_count"]).alias("avg_dish_count"), F.sum(F.col("features")["total_rating_count"]).alias("sum_rating_count"))
            .withColumn("runs_with_batches", F.lit(runs)).join(unlike, "model"))
