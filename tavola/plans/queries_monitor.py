"""Registered queries: monitoring over the prediction log (fx_log)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola import fixtures
from tavola.operators import monitor as M
from tavola.plans.catalog import register
from tavola.plans.oracle import cte

cte("log_w", """
SELECT *, (SELECT max(ts) FROM fx_log) AS as_of FROM fx_log
""", "fx_log")


def _log(spark, sf):
    return fixtures.fx_log(spark, sf)


def _win(h):
    return f"ts > as_of - INTERVAL {h} HOUR"


_LM = "\nUNION ALL\n".join(f"""
SELECT {h} AS hours, count(*) FILTER (WHERE {_win(h)}) AS total_predictions,
       avg(CASE WHEN {_win(h)} THEN CAST(success AS DOUBLE) END) AS success_rate,
       avg(CASE WHEN {_win(h)} THEN response_time END) AS avg_response_time,
       quantile_cont(CASE WHEN {_win(h)} THEN response_time END, 0.95) AS p95_response_time
FROM log_w""" for h in M.WINDOW_HOURS)
cte("log_metrics", _LM, "log_w")
LM_DBL = ("success_rate", "avg_response_time", "p95_response_time")


@register("log_metrics", "SELECT * FROM log_metrics", ("log_metrics",), dbl=LM_DBL)
def q_log_metrics(spark, sf):
    return M.log_metrics(_log(spark, sf)).drop("as_of")


@register("log_by_model", f"SELECT model, count(*) AS requests FROM log_w WHERE {_win(24)} GROUP BY model",
          ("log_w",))
def q_log_by_model(spark, sf):
    return M.log_by_model(_log(spark, sf), 24)


@register("hourly_volume", f"""
SELECT strftime(ts, '%H:00') AS hour, count(*) AS requests FROM log_w WHERE {_win(24)} GROUP BY hour
""", ("log_w",))
def q_hourly_volume(spark, sf):
    return M.hourly_volume(_log(spark, sf), 24)


def _health_sql(h):
    low = "coalesce(success_rate < 0.95, false)"
    slow = "coalesce(avg_response_time > 1.0, false)"
    idle = "total_predictions = 0"
    conds = [low, slow, idle]
    iss = " || ".join(f"CASE WHEN {c} THEN '{i}; ' ELSE '' END" for c, (i, _r) in zip(conds, M.ISSUES))
    rec = " || ".join(f"CASE WHEN {c} THEN '{r}; ' ELSE '' END" for c, (_i, r) in zip(conds, M.ISSUES))
    return f"""
SELECT hours, CASE WHEN {idle} THEN 'idle' WHEN {low} OR {slow} THEN 'degraded' ELSE 'healthy' END AS status,
       rtrim({iss}, '; ') AS issues, rtrim({rec}, '; ') AS recommendations
FROM log_metrics WHERE hours = {h}
"""


def _health_flat(df):
    return df.select("hours", "status", F.array_join("issues", "; ").alias("issues"),
                     F.array_join("recommendations", "; ").alias("recommendations"))


@register("system_health", _health_sql(1), ("log_metrics",))
def q_system_health(spark, sf):
    return _health_flat(M.system_health(M.log_metrics(_log(spark, sf))))


@register("system_health_24h", _health_sql(24), ("log_metrics",))
def q_system_health_24h(spark, sf):
    return _health_flat(M.system_health(M.log_metrics(_log(spark, sf)), 24))


def _alerts_sql(h):
    return f"""
SELECT 'high' AS level, '{M.ALERT_MESSAGES[0]}' AS message, 'success_rate' AS metric, success_rate AS value
FROM log_metrics WHERE hours = {h} AND success_rate < 0.9
UNION ALL
SELECT 'medium', '{M.ALERT_MESSAGES[1]}', 'response_time', p95_response_time
FROM log_metrics WHERE hours = {h} AND p95_response_time > 2.0
"""


@register("alerts", _alerts_sql(1), ("log_metrics",), dbl=("value",))
def q_alerts(spark, sf):
    return M.alerts(M.log_metrics(_log(spark, sf)))


@register("alerts_168h", _alerts_sql(168), ("log_metrics",), dbl=("value",))
def q_alerts_168h(spark, sf):
    return M.alerts(M.log_metrics(_log(spark, sf)), 168)


@register("retain_last", """
SELECT log_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, model, response_time, success, feature_count, scenario
FROM fx_log ORDER BY fx_log.ts DESC, log_id DESC LIMIT 1000
""", ("fx_log",), dbl=("response_time",))
def q_retain_last(spark, sf):
    r = M.retain_last(_log(spark, sf), 1000)
    return r.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _report_cols():
    out = []
    for h in M.WINDOW_HOURS:
        for c in ("total_predictions", "success_rate", "avg_response_time", "p95_response_time"):
            out.append((f"h{h}_{c}", h, c))
    return out


def _shown(key):
    return lambda x: F.concat(x[key], F.lit("="), x["requests"].cast("string"))


@register("monitoring_report", f"""
WITH hl AS ({_health_sql(1)})
SELECT (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM fx_log) AS as_of, hl.status, hl.issues,
       (SELECT coalesce(string_agg(level || ':' || metric, '; ' ORDER BY level, metric), '') FROM ({_alerts_sql(1)})) AS alerts,
       {", ".join(f"(SELECT coalesce(string_agg(k || '=' || n, '; ' ORDER BY k), '') FROM (SELECT {e} AS k, CAST(count(*) AS VARCHAR) AS n FROM log_w WHERE {_win(h)} GROUP BY 1)) AS h{h}_{c}" for h in M.WINDOW_HOURS for c, e in (("models_used", "model"), ("hourly_volume", "strftime(ts, '%H:00')")))},
       {", ".join(f"(SELECT {c} FROM log_metrics WHERE hours = {h}) AS {n}" for n, h, c in _report_cols())}
FROM hl
""", ("log_metrics", "log_w"), dbl=tuple(n for n, _h, c in _report_cols() if c != "total_predictions"))
def q_monitoring_report(spark, sf):
    r = M.monitoring_report(_log(spark, sf))
    return r.select(F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), "system_health.status",
                    F.array_join("system_health.issues", "; ").alias("issues"),
                    F.array_join(F.transform("alerts", lambda a: F.concat(a["level"], F.lit(":"), a["metric"])), "; ").alias("alerts"),
                    *[F.array_join(F.transform(F.col(f"last_{h}h.{c}"), _shown(k)), "; ").alias(f"h{h}_{c}")
                      for h in M.WINDOW_HOURS for c, k in (("models_used", "model"), ("hourly_volume", "hour"))],
                    *[F.col(f"last_{h}h.{c}").alias(n) for n, h, c in _report_cols()])


@register("latency_summary", """
SELECT CASE WHEN g = 1 THEN 'all' ELSE model END AS model, total, successes, CAST(successes AS DOUBLE) / total AS success_rate,
       avg_latency, min_latency, max_latency,
       CASE WHEN successes = 0 THEN 'UNKNOWN' WHEN avg_latency < 0.5 THEN 'EXCELLENT' WHEN avg_latency < 1.0 THEN 'GOOD'
            WHEN avg_latency < 2.0 THEN 'ACCEPTABLE' ELSE 'POOR' END AS grade
FROM (SELECT model, grouping(model) AS g, count(*) AS total, count(*) FILTER (WHERE success) AS successes,
             avg(CASE WHEN success THEN response_time END) AS avg_latency,
             min(CASE WHEN success THEN response_time END) AS min_latency,
             max(CASE WHEN success THEN response_time END) AS max_latency
      FROM (SELECT * REPLACE (CASE WHEN log_id % 10 = 0 THEN NULL ELSE model END AS model) FROM fx_log) GROUP BY ROLLUP (model))
""", ("fx_log",), dbl=("success_rate", "avg_latency", "min_latency", "max_latency"))
def q_latency_summary(spark, sf):
    log = _log(spark, sf).withColumn("model", F.when(F.col("log_id") % 10 != 0, F.col("model")))  # null is not "all"
    return M.latency_summary(log)


_RG = M.READINESS_GRADES


@register("latency_grade", f"""
SELECT model, average_response_time,
       CASE WHEN average_response_time < 1.0 THEN 'A' WHEN average_response_time < 2.0 THEN 'B'
            WHEN average_response_time < 5.0 THEN 'C' ELSE 'D' END AS grade,
       average_response_time < 5.0 AS acceptable,
       CASE WHEN average_response_time < 1.0 THEN '{_RG[0][2]}' WHEN average_response_time < 2.0 THEN '{_RG[1][2]}'
            WHEN average_response_time < 5.0 THEN '{_RG[2][2]}' ELSE '{_RG[3][2]}' END AS message
FROM (SELECT model, avg(CASE WHEN success THEN response_time ELSE 10.0 END) AS average_response_time
      FROM fx_log GROUP BY model)
""", ("fx_log",), dbl=("average_response_time",))
def q_latency_grade(spark, sf):
    return M.latency_grade(_log(spark, sf))


@register("scenario_success", """
SELECT scenario, model, count(*) AS calls, avg(CAST(success AS DOUBLE)) AS success_ratio,
       avg(CAST(success AS DOUBLE)) >= 0.8 AS passed
FROM fx_log GROUP BY scenario, model
UNION ALL SELECT 'all', 'all', count(*), avg(CAST(success AS DOUBLE)), avg(CAST(success AS DOUBLE)) >= 0.8 FROM fx_log
""", ("fx_log",), dbl=("success_ratio",))
def q_scenario_success(spark, sf):
    return M.scenario_success(_log(spark, sf))


cte("checks", f"""
SELECT 'model_' || model AS check_name,
       CASE WHEN sr >= 0.95 AND lat <= 1.0 THEN 'pass' WHEN sr >= 0.9 THEN 'warning' ELSE 'fail' END AS status,
       printf('success %.3f, mean latency %.3f s', sr, lat) AS message, sr AS val
FROM (SELECT model, avg(CAST(success AS DOUBLE)) AS sr, avg(response_time) AS lat FROM log_w WHERE {_win(24)}
      GROUP BY model)
""", "log_w")


@register("derive_checks", "SELECT * FROM checks", ("checks",), dbl=("val",))
def q_derive_checks(spark, sf):
    return M.derive_checks(_log(spark, sf))


@register("check_rollup", f"""
WITH hl AS ({_health_sql(1)})
SELECT count(*) FILTER (WHERE status = 'pass') AS checks_passed, count(*) AS checks_total,
       CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS overall_status,
       array_to_string(list_concat(list_filter([CASE WHEN NOT bool_and(status = 'pass') THEN '{M.GENERAL_STEPS[0]}' END,
           CASE WHEN (SELECT status FROM hl) <> 'healthy' THEN '{M.GENERAL_STEPS[1]}' END,
           CASE WHEN (SELECT status FROM hl) = 'idle' THEN '{M.GENERAL_STEPS[2]}' END], lambda x: x IS NOT NULL),
         coalesce(list_sort(list('Fix ' || check_name || ': ' || message) FILTER (WHERE status <> 'pass')), [])), ' | ') AS recommendations,
       CASE WHEN bool_and(status = 'pass') THEN '{" | ".join(M.NEXT_STEPS["pass"])}'
            ELSE '{" | ".join(M.NEXT_STEPS["fail"])}' END AS next_steps
FROM checks
""", ("checks", "log_metrics"))
def q_check_rollup(spark, sf):
    log = _log(spark, sf)
    r = M.check_rollup(M.derive_checks(log), M.system_health(M.log_metrics(log), 1))
    return r.select("checks_passed", "checks_total", "overall_status",
                    F.array_join("recommendations", " | ").alias("recommendations"),
                    F.array_join("next_steps", " | ").alias("next_steps"))
