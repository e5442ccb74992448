"""Monitoring over the prediction log: trailing-window metrics, volumes,
health, alerts, retention, latency grades, scenario success, check roll-up.

``as_of`` is an argument (default: the newest record), never the wall clock,
so results are reproducible.  All window metrics come from one aggregate with
conditional aggregates (no join, no row explosion)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_HOURS = (1, 24, 168)

# Health / alert rules.
HEALTH = {"min_success": 0.95, "max_mean_latency": 1.0}
ALERTS = {"high_success": 0.9, "medium_p95": 2.0}
ISSUES = (("Low success rate", "Check model serving infrastructure"),
          ("High response time", "Optimize feature preparation"),
          ("No recent predictions", "Check API connectivity"))
ALERT_MESSAGES = ("Success rate below 90%", "95th percentile response time above 2 seconds")
# Latency grade labels.
SUMMARY_GRADES = ((0.5, "EXCELLENT"), (1.0, "GOOD"), (2.0, "ACCEPTABLE"), (None, "POOR"))
READINESS_GRADES = ((1.0, "A", "Excellent performance"), (2.0, "B", "Good performance for ML system"),
                    (5.0, "C", "Acceptable for batch processing"), (None, "D", "Performance needs improvement"))
FAILED_CALL_SECONDS = 10.0
SCENARIO_PASS = 0.8
# Texts of the deployment report.
GENERAL_STEPS = ("Fix deployment check failures before production", "Address system health issues",
                 "Generate more test traffic to validate monitoring")
NEXT_STEPS = {
    "pass": ("Deploy to production environment", "Set up continuous monitoring", "Configure alert notifications",
             "Plan for model retraining schedule", "Document API for consumers"),
    "fail": ("Fix identified deployment issues", "Re-run deployment checks", "Test with more diverse input data",
             "Validate error handling scenarios", "Perform load testing"),
}


def _as_of(log: DataFrame, ts: str, as_of) -> Column:
    """The reference instant as a *literal*: the newest record (one small
    aggregate job) unless given.  A literal bound lets Catalyst fold
    ``as_of - h hours`` and push ``ts > bound`` into the parquet scan, so a
    time-ordered or date-partitioned log only reads its recent row groups /
    partitions."""
    if as_of is None:
        as_of = log.agg(F.max(ts)).first()[0]
    return F.lit(as_of).cast("timestamp")


def _in_window(ts: str, hours: int) -> Column:
    return F.col(ts) > F.col("_as_of") - F.expr(f"INTERVAL {int(hours)} HOURS")


def log_metrics(log: DataFrame, hours: Sequence[int] = WINDOW_HOURS, as_of=None, ts: str = "ts",
                latency: str = "response_time", success: str = "success", method: str = "auto") -> DataFrame:
    """Per trailing window (records with ts > as_of - h): total, success
    rate, mean and p95 (linear) latency.  Empty windows give total 0 and null
    rates.  One scan for counts and means.  p95 is exact: a percentile in the
    same aggregate while the window's distinct latencies are within the
    checked limit, else narrowing by rank per window."""
    from tavola.functions.distributed_quantile import exact_quantiles, number
    from tavola.functions.stats import choose_methods

    d = log.withColumn("_as_of", _as_of(log, ts, as_of))
    # rows older than the widest window cannot contribute: filter (pushed down)
    d = d.where(_in_window(ts, max(hours)))
    if method == "auto":
        method = choose_methods(d, [latency])[latency]
    aggs = []
    for h in hours:
        w = _in_window(ts, h)
        rt = F.when(w, F.col(latency).cast("double"))
        if method == "distributed":
            p95 = F.lit(exact_quantiles(d.where(w), latency, [0.95])[0]).cast("double")
        else:
            p95 = F.percentile(number(rt), F.lit(0.95))
        aggs += [F.count_if(w).alias(f"n{h}"),
                 F.avg(F.when(w, F.col(success).cast("double"))).alias(f"s{h}"),
                 F.avg(rt).alias(f"a{h}"), p95.alias(f"p{h}")]
    wide = d.agg(F.max("_as_of").alias("as_of"), *aggs)
    rows = [F.struct(F.lit(h).alias("hours"), F.col(f"n{h}").alias("total_predictions"),
                     F.col(f"s{h}").alias("success_rate"), F.col(f"a{h}").alias("avg_response_time"),
                     F.col(f"p{h}").alias("p95_response_time")) for h in hours]
    return wide.select("as_of", F.inline(F.array(*rows)))


def log_by_model(log: DataFrame, hours: int = 24, as_of=None, ts: str = "ts", model: str = "model") -> DataFrame:
    d = log.withColumn("_as_of", _as_of(log, ts, as_of)).where(_in_window(ts, hours))
    return d.groupBy(model).agg(F.count("*").alias("requests"))


def hourly_volume(log: DataFrame, hours: int = 24, as_of=None, ts: str = "ts") -> DataFrame:
    """Requests per clock hour label 'HH:00' (days merged) in the window."""
    d = log.withColumn("_as_of", _as_of(log, ts, as_of)).where(_in_window(ts, hours))
    return d.groupBy(F.date_format(ts, "HH:00").alias("hour")).agg(F.count("*").alias("requests"))


def system_health(metrics: DataFrame, hours: int = 1) -> DataFrame:
    """healthy / degraded / idle for the ``hours`` window of ``log_metrics``,
    with issue and recommendation lists (in rule order)."""
    m = metrics.where(F.col("hours") == hours)
    low = F.coalesce(F.col("success_rate") < HEALTH["min_success"], F.lit(False))
    slow = F.coalesce(F.col("avg_response_time") > HEALTH["max_mean_latency"], F.lit(False))
    idle = F.col("total_predictions") == 0
    status = F.when(idle, "idle").when(low | slow, "degraded").otherwise("healthy")
    conds = [low, slow, idle]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(i)) for c, (i, _r) in zip(conds, ISSUES)]))
    recs = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, (_i, r) in zip(conds, ISSUES)]))
    return m.select("hours", status.alias("status"), issues.alias("issues"), recs.alias("recommendations"))


def alerts(metrics: DataFrame, hours: int = 1) -> DataFrame:
    """One row per firing alert: level, message, metric, value."""
    m = metrics.where(F.col("hours") == hours)
    a1 = F.when(F.col("success_rate") < ALERTS["high_success"],
                F.struct(F.lit("high").alias("level"), F.lit(ALERT_MESSAGES[0]).alias("message"),
                         F.lit("success_rate").alias("metric"), F.col("success_rate").alias("value")))
    a2 = F.when(F.col("p95_response_time") > ALERTS["medium_p95"],
                F.struct(F.lit("medium").alias("level"), F.lit(ALERT_MESSAGES[1]).alias("message"),
                         F.lit("response_time").alias("metric"), F.col("p95_response_time").alias("value")))
    return m.select(F.inline(F.array_compact(F.array(a1, a2))))


def retain_last(log: DataFrame, n: int = 1000, ts: str = "ts", key: str = "log_id") -> DataFrame:
    """The newest ``n`` records (TakeOrdered: per-partition top-n, merged)."""
    return log.orderBy(F.desc(ts), F.desc(key)).limit(n)


def monitoring_report(log: DataFrame, hours: Sequence[int] = WINDOW_HOURS, as_of=None) -> DataFrame:
    """One nested row: per window the metrics, requests per model and per hour of
    the day; health; the alerts that fire."""
    m = log_metrics(log, hours, as_of)
    at = _as_of(log, "ts", as_of)
    d = log.withColumn("_as_of", at).where(_in_window("ts", max(hours)))
    # one pass: per model and hour of the day (bounded), with a count per window
    g = d.groupBy("model", F.date_format("ts", "HH:00").alias("hour")).agg(*[F.count_if(_in_window("ts", h)).alias(f"n{h}") for h in hours])

    def listed(key: str, h: int) -> Column:
        one = g.groupBy(key).agg(F.sum(f"n{h}").alias("n")).where("n > 0")
        return one.agg(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n").alias("requests"))))).scalar()

    fired = alerts(m, hours[0]).agg(F.array_sort(F.collect_list(F.struct("level", "message", "metric", "value")))).scalar()
    out = system_health(m, hours[0]).select(F.struct("status", "issues", "recommendations").alias("system_health"), fired.alias("alerts"))
    for h in hours:
        s = m.where(F.col("hours") == h).select(F.struct("total_predictions", "success_rate", "avg_response_time", "p95_response_time").alias("s")).scalar()
        out = out.withColumn(f"last_{h}h", F.struct(*[s.getField(c).alias(c) for c in ("total_predictions", "success_rate", "avg_response_time", "p95_response_time")],
                                                    listed("model", h).alias("models_used"), listed("hour", h).alias("hourly_volume")))
    return out.withColumn("as_of", at)


def _grade(x: Column, table) -> Column:
    expr = None
    for lim, *vals in table:
        v = F.lit(vals[0])
        if lim is None:
            return expr.otherwise(v) if expr is not None else v
        expr = F.when(x < lim, v) if expr is None else expr.when(x < lim, v)
    return expr


def latency_summary(log: DataFrame, group: str = "model", latency: str = "response_time",
                    success: str = "success") -> DataFrame:
    """Per group and overall ('all', via ROLLUP): total, successes, success
    rate, avg/min/max latency of successful calls, grade of the average."""
    ok = F.col(success)
    rt = F.when(ok, F.col(latency).cast("double"))
    g = (log.rollup(group)
         .agg(F.grouping(group).alias("_all"), F.count("*").alias("total"), F.count_if(ok).alias("successes"),
              F.avg(rt).alias("avg_latency"), F.min(rt).alias("min_latency"), F.max(rt).alias("max_latency")))
    grade = F.when(F.col("successes") == 0, F.lit("UNKNOWN")).otherwise(_grade(F.col("avg_latency"), SUMMARY_GRADES))
    return g.select(F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(group)).alias(group), "total", "successes",
                    (F.col("successes") / F.col("total")).alias("success_rate"),
                    "avg_latency", "min_latency", "max_latency", grade.alias("grade"))


def latency_grade(log: DataFrame, group: str = "model", latency: str = "response_time",
                  success: str = "success") -> DataFrame:
    """Readiness grade per group: failed calls count as 10 s; A < 1 s, B < 2,
    C < 5, else D; acceptable = not D."""
    t = F.when(F.col(success), F.col(latency).cast("double")).otherwise(F.lit(FAILED_CALL_SECONDS))
    g = log.groupBy(group).agg(F.avg(t).alias("average_response_time"))
    grade = _grade(F.col("average_response_time"), [(l, gr) for l, gr, _m in READINESS_GRADES])
    msg = _grade(F.col("average_response_time"), [(l, m) for l, _g, m in READINESS_GRADES])
    return g.select(group, "average_response_time", grade.alias("grade"), (grade != "D").alias("acceptable"),
                    msg.alias("message"))


def scenario_success(log: DataFrame, scenario: str = "scenario", endpoint: str = "model",
                     success: str = "success", threshold: float = SCENARIO_PASS) -> DataFrame:
    """Success ratio per scenario x endpoint and, in one row with both 'all', over
    all calls; pass if >= threshold."""
    all_ = F.grouping_id(scenario, endpoint)
    g = (log.groupingSets([[scenario, endpoint], []], scenario, endpoint)
         .agg(F.count("*").alias("calls"), F.avg(F.col(success).cast("double")).alias("success_ratio"), all_.alias("_all")))
    g = g.withColumns({c: F.when(F.col("_all") == 3, F.lit("all")).otherwise(F.col(c)) for c in (scenario, endpoint)}).drop("_all")
    return g.withColumn("passed", F.col("success_ratio") >= threshold)


def derive_checks(log: DataFrame, hours: int = 24, as_of=None, ts: str = "ts", model: str = "model",
                  latency: str = "response_time", success: str = "success") -> DataFrame:
    """One check per model from the log window: pass (success >= 0.95 and
    mean latency <= 1 s), warning (success >= 0.9), else fail."""
    d = log.withColumn("_as_of", _as_of(log, ts, as_of)).where(_in_window(ts, hours))
    g = d.groupBy(model).agg(F.avg(F.col(success).cast("double")).alias("sr"),
                             F.avg(F.col(latency).cast("double")).alias("lat"))
    status = (F.when((F.col("sr") >= HEALTH["min_success"]) & (F.col("lat") <= HEALTH["max_mean_latency"]), "pass")
              .when(F.col("sr") >= ALERTS["high_success"], "warning").otherwise("fail"))
    msg = F.format_string("success %.3f, mean latency %.3f s", F.col("sr"), F.col("lat"))
    return g.select(F.concat(F.lit("model_"), F.col(model)).alias("check_name"), status.alias("status"),
                    msg.alias("message"), F.col("sr").alias("val"))


def check_rollup(checks: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """passed / total, overall pass only if every check passes, recommendations
    and the next-steps branch.  The recommendations are the general ones (a
    failed roll-up; with ``health``, the report of ``system_health``, an
    unhealthy system and no traffic) and then, sorted, one per failed check."""
    ok = F.col("status") == "pass"
    g = checks.agg(F.count_if(ok).alias("checks_passed"), F.count("*").alias("checks_total"),
                   F.bool_and(ok).alias("_all"),
                   F.array_sort(F.collect_list(F.when(~ok, F.concat(F.lit("Fix "), F.col("check_name"),
                                                                     F.lit(": "), F.col("message"))))).alias("recommendations"))
    overall = F.when(F.coalesce(F.col("_all"), F.lit(False)), "pass").otherwise("fail")
    steps = F.when(overall == "pass", F.array(*[F.lit(s) for s in NEXT_STEPS["pass"]])) \
        .otherwise(F.array(*[F.lit(s) for s in NEXT_STEPS["fail"]]))
    general = [F.when(overall != "pass", F.lit(GENERAL_STEPS[0]))]
    if health is not None:
        status = health.agg(F.first("status")).scalar()
        general += [F.when(status != "healthy", F.lit(GENERAL_STEPS[1])), F.when(status == "idle", F.lit(GENERAL_STEPS[2]))]
    recommendations = F.concat(F.array_compact(F.array(*general)), F.col("recommendations"))
    return g.select("checks_passed", "checks_total", overall.alias("overall_status"), recommendations.alias("recommendations"),
                    steps.alias("next_steps"))
