"""Registered queries: evaluation (fx_scored and rule/dummy scored tests),
model selection and the metrics report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola import fixtures
from tavola.operators import evaluate as EV
from tavola.operators.rollup import ENTITY_KEYS
from tavola.plans import queries_features  # noqa: F401  (registers train_feats)
from tavola.plans import venue
from tavola.plans.catalog import register
from tavola.plans.oracle import cte

K = list(ENTITY_KEYS)
KS = ", ".join(K)
_HK = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in K)

cte("requests", f"""
SELECT {KS}, avg_price, dish_count, total_rating_count, avg_rating, median_rating, rating_std, price_std,
       category_diversity, price_to_dish_ratio, rating_count_per_dish, has_high_variance, price_volatility, city,
       is_high_rated, is_popular, is_premium
FROM train_feats
""", "train_feats")


def _rule_sql(src):
    specs = [("high_rated", "avg_rating >= CAST(4.2 AS DOUBLE)", "avg_rating / CAST(5 AS DOUBLE)"),
             ("popular", "total_rating_count >= 100", "least(CAST(total_rating_count AS DOUBLE) / 1000, CAST(1 AS DOUBLE))"),
             ("premium", "avg_price > 400", "least(avg_price / 1000, CAST(1 AS DOUBLE))")]
    parts = []
    for t, cond, prob in specs:
        pr = f"coalesce({cond}, false)"
        parts.append(f"""SELECT {KS}, '{t}' AS task, CAST({pr} AS INTEGER) AS prediction, {prob} AS probability,
  CASE WHEN {pr} AND {prob} > 0.8 THEN 'high' WHEN {pr} AND {prob} > 0.6 THEN 'medium' ELSE 'low' END AS confidence
FROM {src}""")
    return "\nUNION ALL\n".join(parts)


cte("rule_scores", _rule_sql("requests"), "requests")
cte("task_split", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY task, label ORDER BY md5(concat_ws('|', {_HK}, '42')), {KS}) - 1
               < floor(count(*) OVER (PARTITION BY task, label) * 0.2 + 0.5) AS INTEGER) AS is_test
FROM (SELECT {KS}, 'high_rated' AS task, is_high_rated AS label FROM requests
      UNION ALL SELECT {KS}, 'popular', is_popular FROM requests
      UNION ALL SELECT {KS}, 'premium', is_premium FROM requests)
""", "requests")
cte("eval_scored", f"""
WITH pri AS (SELECT task, avg(CAST(label AS DOUBLE)) AS prior FROM task_split WHERE is_test = 0 GROUP BY task),
te AS (SELECT * FROM task_split WHERE is_test = 1)
SELECT {KS}, te.task, 'rules' AS model, label AS y, probability AS p
FROM te JOIN rule_scores USING ({KS}, task)
UNION ALL
SELECT {KS}, te.task, 'dummy_most_frequent', label, CASE WHEN prior >= 0.5 THEN 1.0 ELSE 0.0 END
FROM te JOIN pri USING (task)
UNION ALL
SELECT {KS}, te.task, 'dummy_stratified', label,
       CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', {_HK}, te.task, '42')), 1, 8)) AS BIGINT) / 4294967296.0 < prior
            THEN 1.0 ELSE 0.0 END
FROM te JOIN pri USING (task)
""", "task_split", "rule_scores")


def _cum_sql(src, g):
    gs = ", ".join(g)
    gsel = (gs + ", ") if g else ""
    part = f"PARTITION BY {gs}" if g else ""
    return f"""
SELECT {gsel}p, pos, neg,
       sum(pos) OVER ({part} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
       sum(neg) OVER ({part} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
       sum(pos) OVER ({part}) AS "tot_pos", sum(neg) OVER ({part}) AS "tot_neg"
FROM (SELECT {gsel}p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
      FROM {src} WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY {gsel}p)
"""


def _div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


def _metrics_sql(src, g, pred="CAST(p >= 0.5 AS INTEGER)"):
    gs = ", ".join(g)
    gsel = (gs + ", ") if g else ""
    grp = f"GROUP BY {gs}" if g else ""
    return f"""
SELECT {gsel}{_div('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_div('tp', 'tp + fp')} AS precision,
       {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
       ({_div('tp', 'tp + fn')} + {_div('tn', 'tn + fp')}) / 2 AS balanced_accuracy,
       {_div('tp + fn', 'tp + fp + tn + fn')} AS positive_rate, tp + fn AS n_positive, tn + fp AS n_negative
FROM (SELECT {gsel}count(*) FILTER (WHERE y = 1 AND pr = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pr = 1) AS fp,
             count(*) FILTER (WHERE y = 0 AND pr = 0) AS tn, count(*) FILTER (WHERE y = 1 AND pr = 0) AS fn
      FROM (SELECT *, {pred} AS pr FROM {src}) {grp})
"""


def _auc_sql(src, g, kind):
    gs = ", ".join(g)
    gsel = (gs + ", ") if g else ""
    part = f"PARTITION BY {gs}" if g else ""
    grp = f"GROUP BY {gs}" if g else ""
    if kind == "roc":
        x, yv, y0 = _div("fps", '"tot_neg"'), _div("tps", '"tot_pos"'), "0.0"
    else:
        x, yv, y0 = _div("tps", '"tot_pos"'), _div("tps", "tps + fps"), "1.0"
    return f"""
SELECT {gsel}sum((x - coalesce(lag(x) OVER w, 0.0)) * (yv + coalesce(lag(yv) OVER w, {y0})) / 2) AS {kind}_auc
FROM (SELECT *, {x} AS x, {yv} AS yv FROM ({_cum_sql(src, g)}))
WINDOW w AS ({part} ORDER BY p DESC)
{grp}
"""


# DuckDB cannot use a window inside an aggregate; compute the terms first.
def _auc_sql2(src, g, kind):
    gs = ", ".join(g)
    gsel = (gs + ", ") if g else ""
    part = f"PARTITION BY {gs}" if g else ""
    grp = f"GROUP BY {gs}" if g else ""
    if kind == "roc":
        x, yv, y0 = _div("fps", '"tot_neg"'), _div("tps", '"tot_pos"'), "0.0"
    else:
        x, yv, y0 = _div("tps", '"tot_pos"'), _div("tps", "tps + fps"), "1.0"
    return f"""
SELECT {gsel}sum(a) AS {kind}_auc FROM (
  SELECT {gsel}(x - coalesce(lag(x) OVER ({part} ORDER BY p DESC), 0.0))
               * (yv + coalesce(lag(yv) OVER ({part} ORDER BY p DESC), {y0})) / 2 AS a
  FROM (SELECT *, {x} AS x, {yv} AS yv FROM ({_cum_sql(src, g)})))
{grp}
"""


MET_DBL = ("accuracy", "precision", "recall", "f1", "balanced_accuracy", "positive_rate")


@register("classify", "SELECT id, y, p, CAST(p >= 0.5 AS INTEGER) AS prediction FROM fx_scored", ("fx_scored",),
          dbl=("p",))
def q_classify(spark, sf):
    return EV.classify(fixtures.fx_scored(spark, sf))


@register("classification_metrics",
          "SELECT accuracy, precision, recall, f1 FROM (" + _metrics_sql("fx_scored", []) + ")",
          ("fx_scored",), dbl=("accuracy", "precision", "recall", "f1"))
def q_classification_metrics(spark, sf):
    return EV.classification_metrics(EV.classify(fixtures.fx_scored(spark, sf)), [], "y").select(
        "accuracy", "precision", "recall", "f1")


@register("balanced_accuracy", "SELECT balanced_accuracy FROM (" + _metrics_sql("fx_scored", []) + ")",
          ("fx_scored",), dbl=("balanced_accuracy",))
def q_balanced_accuracy(spark, sf):
    return EV.balanced_accuracy(EV.classify(fixtures.fx_scored(spark, sf)), [], "y")


@register("class_distribution", """
SELECT avg(CAST(y AS DOUBLE)) AS positive_rate, count(*) FILTER (WHERE y = 1) AS n_positive,
       count(*) FILTER (WHERE y = 0) AS n_negative FROM fx_scored
""", ("fx_scored",), dbl=("positive_rate",))
def q_class_distribution(spark, sf):
    return EV.class_distribution(fixtures.fx_scored(spark, sf), [], "y")


@register("roc_auc", _auc_sql2("fx_scored", [], "roc"), ("fx_scored",), dbl=("roc_auc",))
def q_roc_auc(spark, sf):
    return EV.roc_auc(fixtures.fx_scored(spark, sf))


@register("pr_auc", _auc_sql2("fx_scored", [], "pr"), ("fx_scored",), dbl=("pr_auc",))
def q_pr_auc(spark, sf):
    return EV.pr_auc(fixtures.fx_scored(spark, sf))


@register("roc_curve", f"""
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT CAST(p AS DOUBLE), {_div('fps', '"tot_neg"')}, {_div('tps', '"tot_pos"')} FROM ({_cum_sql('fx_scored', [])})
""", ("fx_scored",), dbl=("threshold", "fpr", "tpr"))
def q_roc_curve(spark, sf):
    return EV.roc_curve(fixtures.fx_scored(spark, sf))


@register("pr_curve", f"""
WITH c AS ({_cum_sql('fx_scored', [])})
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS recall, 1.0 AS precision,
       (SELECT DISTINCT {_div('"tot_pos"', '"tot_pos" + "tot_neg"')} FROM c) AS baseline
UNION ALL
SELECT CAST(p AS DOUBLE), {_div('tps', '"tot_pos"')}, {_div('tps', 'tps + fps')}, {_div('"tot_pos"', '"tot_pos" + "tot_neg"')} FROM c
""", ("fx_scored",), dbl=("threshold", "recall", "precision", "baseline"))
def q_pr_curve(spark, sf):
    return EV.pr_curve(fixtures.fx_scored(spark, sf))


G = ["task", "model"]
cte("eval_metrics", f"""
SELECT * FROM ({_metrics_sql('eval_scored', G)})
JOIN ({_auc_sql2('eval_scored', G, 'roc')}) USING (task, model)
JOIN ({_auc_sql2('eval_scored', G, 'pr')}) USING (task, model)
""", "eval_scored")

ALL_DBL = MET_DBL + ("roc_auc", "pr_auc")


def _eval_metrics(spark, sf):
    return EV.evaluate(venue.eval_scored(spark, sf), G, "y", "p")


@register("model_metrics", "SELECT * FROM eval_metrics", ("eval_metrics",), dbl=ALL_DBL)
def q_model_metrics(spark, sf):
    return _eval_metrics(spark, sf)


@register("rule_roc_curve", f"""
SELECT task, model, CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM eval_scored GROUP BY task, model
UNION ALL
SELECT task, model, CAST(p AS DOUBLE), {_div('fps', '"tot_neg"')}, {_div('tps', '"tot_pos"')} FROM ({_cum_sql('eval_scored', G)})
""", ("eval_scored",), dbl=("threshold", "fpr", "tpr"))
def q_rule_roc_curve(spark, sf):
    return EV.roc_curve(venue.eval_scored(spark, sf), G)


@register("select_best", """
SELECT task, model AS best_model, roc_auc FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY roc_auc DESC NULLS LAST, model) AS r FROM eval_metrics)
WHERE r = 1
""", ("eval_metrics",), dbl=("roc_auc",))
def q_select_best(spark, sf):
    return EV.select_best(_eval_metrics(spark, sf), "roc_auc")


_MR = ", ".join(f"round({m}, 3) AS {m}" if m not in ("n_positive", "n_negative") else
                f"round(CAST({m} AS DOUBLE), 3) AS {m}" for m in EV.METRICS)


@register("metrics_report", f"SELECT task, model, {_MR} FROM eval_metrics", ("eval_metrics",),
          dbl=tuple(EV.METRICS))
def q_metrics_report(spark, sf):
    return EV.metrics_report(EV.metrics_long(_eval_metrics(spark, sf), G), G)
