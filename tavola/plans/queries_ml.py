"""Registered queries: MLlib training, cross-validation, importances, model
scoring (rows-only checks), and interpretation of a score column (SQL)."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from tavola.operators import evaluate as EV
from tavola.operators import explain as X
from tavola.operators import score as S
from tavola.operators import serving as SV
from tavola.operators import train as T
from tavola.operators.features import TASK_FEATURES, fold_ids
from tavola.operators.rollup import ENTITY_KEYS
from tavola.plans import queries_eval  # noqa: F401  (CTEs)
from tavola.plans import venue
from tavola.plans.catalog import register
from tavola.session import scratch_path
from tavola.sources import io

K = list(ENTITY_KEYS)
KS = ", ".join(K)
MODELS = ("logistic", "random_forest", "boosted_trees")
_CACHE: dict = {}


def _grid(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        data = venue.task_data(spark, sf)
        sets = venue.task_feature_sets(data)
        fitted, scored = T.train_grid(data, sets, MODELS, K, preset="small")
        _CACHE[key] = (fitted, scored.persist(), sets)
    return _CACHE[key]


@register("train_models")
def q_train_models(spark, sf):
    _f, scored, _s = _grid(spark, sf)
    return EV.evaluate(scored, ["task", "model"], "y", "p")


REFERENCE = {"quick": (("logistic", "baseline"), ("random_forest", "baseline"), ("random_forest", "advanced")), "boosted": (("boosted_trees", "advanced"),)}
TREES = {("random_forest", "baseline"): 100, ("random_forest", "advanced"): 200, ("boosted_trees", "advanced"): 200}


def _reference(spark, sf, kinds):
    """Models (``kinds``: pairs of model and preset) with the reference's own presets of all
    three tasks, each fitted once: ({(task, model, preset): fitted}, stored rows, feature sets)."""
    app = spark.sparkContext.applicationId
    if (app, sf, "reference") not in _CACHE:
        data = venue.task_data(spark, sf)
        sets = venue.task_feature_sets(data)
        rows = T.store_rows(data, scratch_path(spark, f"reference/{uuid.uuid4().hex[:12]}"), "task")
        train = {t: rows.where((F.col("task") == t) & (F.col("is_test") == 0)) for t in sets}
        with ThreadPoolExecutor(max_workers=len(sets)) as ex:
            learned = dict(zip(sets, ex.map(lambda t: T.learn_inputs(train[t], sets[t]), sets)))
        _CACHE[app, sf, "reference"] = rows, sets, train, learned
    rows, sets, train, learned = _CACHE[app, sf, "reference"]
    jobs = [(t, m, p) for m, p in kinds for t in sets]

    def run(job):
        if (app, sf, job) not in _CACHE:
            t, m, p = job
            _CACHE[app, sf, job] = T.fit(train[t], sets[t], m, p, learned=learned[t])
        return _CACHE[app, sf, job]
    # a pass of a fit has few tasks and then the driver's part: all fits side by side keep the cores busy
    with ThreadPoolExecutor(max_workers=len(jobs)) as ex:
        return dict(zip(jobs, ex.map(run, jobs))), rows, sets


def _facts_sql(part):
    kinds = ", ".join(f"('{m}', '{p}', {TREES.get((m, p), 0)})" for m, p in REFERENCE[part])
    bases = ", ".join(f"('{t}', {n})" for t, n in {t: len(fs) for t, fs in TASK_FEATURES.items()}.items())
    return f"""
WITH n AS (SELECT task, CAST(count(*) FILTER (WHERE is_test = 0) AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE is_test = 0 AND label = 1) AS BIGINT) AS n_train_positive,
                  CAST(count(*) FILTER (WHERE is_test = 1) AS BIGINT) AS n_scored FROM task_split GROUP BY task),
c AS (SELECT least(count(DISTINCT city), 10) + CAST(count(DISTINCT city) > 10 AS INTEGER) AS cities FROM entities)
SELECT n.task, model, preset, CAST(base + cities AS INTEGER) AS n_features, n_train, n_train_positive, n_scored, CAST(trees AS INTEGER) AS n_trees, true AS sums_hold
FROM n JOIN (VALUES {bases}) AS b(task, base) USING (task), (VALUES {kinds}) AS k(model, preset, trees), c
"""


def _facts(spark, sf, part):
    """What must hold of every fitted model, whatever it learned: its rows, classes, inputs
    and trees; importances that sum to 1; for logistic regression, whose intercept is
    not penalised, a mean probability of the train rows that is their positive rate."""
    fitted, rows, sets = _reference(spark, sf, REFERENCE[part])
    out = None
    for (t, m, p), pm in fitted.items():
        one, last = rows.where(F.col("task") == t), pm.stages[-1]
        scored = T.predict(pm, one, ["is_test", "label"])
        tree = hasattr(last, "featureImportances")
        mean = F.avg(F.when(F.col("is_test") == 0, F.col("p"))) - F.avg(F.when(F.col("is_test") == 0, F.col("label")))
        holds = F.lit(abs(float(last.featureImportances.toArray().sum()) - 1) < 1e-9) if tree else F.abs(mean) < 1e-4
        d = scored.agg(F.count_if(F.col("is_test") == 0).alias("n_train"), F.count_if((F.col("is_test") == 0) & (F.col("label") == 1)).alias("n_train_positive"),
                       F.count_if((F.col("is_test") == 1) & F.col("p").between(0, 1)).alias("n_scored"), holds.alias("sums_hold"))
        d = d.select(F.lit(t).alias("task"), F.lit(m).alias("model"), F.lit(p).alias("preset"), F.lit(last.numFeatures).alias("n_features"), "n_train",
                     "n_train_positive", "n_scored", F.lit(last.getNumTrees if tree else 0).alias("n_trees"), "sums_hold")
        out = d if out is None else out.unionByName(d)
    return out


@register("train_reference", _facts_sql("quick"), ("task_split", "entities"))
def q_train_reference(spark, sf):
    """Logistic regression (1000 iterations) and the forests of 100 and of 200 trees."""
    return _facts(spark, sf, "quick")


@register("train_reference_boosted", _facts_sql("boosted"), ("task_split", "entities"))
def q_train_reference_boosted(spark, sf):
    """Boosted trees of 200 rounds and depth 8; the longest of all queries (README)."""
    return _facts(spark, sf, "boosted")


def _reference_scores(model, preset):
    def run(spark, sf):
        fitted, rows, _s = _reference(spark, sf, [(model, preset)])
        out = None
        for t in TASK_FEATURES:
            test = rows.where((F.col("task") == t) & (F.col("is_test") == 1))
            d = T.predict(fitted[t, model, preset], test, [*K, "task", F.col("label").alias("y")])
            out = d if out is None else out.unionByName(d)
        return out
    return run


register("fit_logistic")(_reference_scores("logistic", "baseline"))
register("fit_random_forest")(_reference_scores("random_forest", "advanced"))


@register("fit_boosted_trees")
def q_fit_boosted_trees(spark, sf):
    """Test scores of all tasks (the reference preset runs in ``train_reference_boosted``)."""
    _f, scored, _s = _grid(spark, sf)
    return scored.where(F.col("model") == "boosted_trees").select(*K, "task", "y", "p")


@register("fit_dummy", "SELECT * FROM eval_scored WHERE model LIKE 'dummy%'", ("eval_scored",), dbl=("p",))
def q_fit_dummy(spark, sf):
    return venue.eval_scored(spark, sf).where(F.col("model").startswith("dummy"))


def _cross_scores(spark, sf):
    """Out-of-fold scores of all tasks and models, computed once."""
    key = (spark.sparkContext.applicationId, sf, "folds")
    if key not in _CACHE:
        data = venue.task_data(spark, sf).drop("is_test")
        sets = venue.task_feature_sets(data)
        folded = fold_ids(data, "label", K, 5, 42, by=["task"])
        _CACHE[key] = T.cross_validation_scores(folded, sets, MODELS, K, scratch_path(spark, f"cv/{uuid.uuid4().hex[:12]}"))
    return _CACHE[key]


@register("cross_validate")
def q_cross_validate(spark, sf):
    """Five folds of all three tasks and models."""
    return T.cross_validation_report(_cross_scores(spark, sf))


@register("cross_validate_folds", f"""
WITH f AS (SELECT task, label, (row_number() OVER (PARTITION BY task, label ORDER BY md5(concat_ws('|', {queries_eval._HK}, '42')), {KS}) - 1) % 5 AS fold FROM task_split)
SELECT task, m.model, CAST(fold AS INTEGER) AS fold, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive, true AS auc_is_rank_sum
FROM f, (VALUES ('logistic'), ('random_forest'), ('boosted_trees')) AS m(model) GROUP BY ALL
""", ("task_split",))
def q_cross_validate_folds(spark, sf):
    """Rows and classes of every fold in the stored scores, and whether its area equals
    the rank-sum statistic (mean ranks of ties) of the same scores."""
    scores = _cross_scores(spark, sf)
    g = ["task", "model", "fold"]
    tied = scores.groupBy(*g, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*g).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("rank", below + (F.col("n") + 1) / 2).groupBy(*g).agg(
        F.sum("n").alias("n_rows"), F.sum("pos").cast("long").alias("n_positive"), F.sum(F.col("rank") * F.col("pos")).alias("s"))
    pos, neg = F.col("n_positive"), F.col("n_rows") - F.col("n_positive")
    area = (F.col("s") - pos * (pos + 1) / 2) / (pos * neg)
    return (ranked.join(T.cross_validation_report(scores), g)
            .select(*g, "n_rows", "n_positive", (F.abs(area - F.col("roc_auc")) < 1e-9).alias("auc_is_rank_sum")))


@register("coefficient_importance")
def q_coefficient_importance(spark, sf):
    fitted, _rows, sets = _reference(spark, sf, [("logistic", "baseline")])
    out = None
    for t in sets:
        d = T.coefficient_importance(fitted[t, "logistic", "baseline"], sets[t]).select(F.lit(t).alias("task"), "feature", "coefficient", "abs_coefficient")
        out = d if out is None else out.unionByName(d)
    return out


@register("tree_importance")
def q_tree_importance(spark, sf):
    fitted, _s, sets = _grid(spark, sf)
    out = None
    for t in sets:
        for m in ("random_forest", "boosted_trees"):
            d = T.tree_importance(fitted[(t, m)], sets[t], 15).select(
                F.lit(t).alias("task"), F.lit(m).alias("model"), "feature", "importance")
            out = d if out is None else out.unionByName(d)
    return out


_FIRST5 = {t: ", ".join(list(fs)[:5]) for t, fs in TASK_FEATURES.items()}
_NBASE = {t: len(fs) for t, fs in TASK_FEATURES.items()}


@register("model_info", """
WITH nc AS (SELECT count(*) AS k FROM (SELECT city FROM entities GROUP BY city ORDER BY count(*) DESC, city LIMIT 10)),
other AS (SELECT CAST(count(DISTINCT city) > 10 AS INTEGER) AS o FROM entities)
SELECT t.task, m.model, m.model_type, CAST(t.nbase + nc.k + other.o AS INTEGER) AS n_features, t.first_features
FROM (VALUES """ + ", ".join(f"('{t}', {_NBASE[t]}, '{_FIRST5[t]}')" for t in _FIRST5) + """) AS t(task, nbase, first_features),
     (VALUES ('logistic', 'LogisticRegressionModel'), ('random_forest', 'RandomForestClassificationModel'),
             ('boosted_trees', 'GBTClassificationModel')) AS m(model, model_type),
     nc, other
""", ("entities",))
def q_model_info(spark, sf):
    fitted, _s, sets = _grid(spark, sf)
    return T.model_info(fitted, sets)


def _rows_to_score(spark, sf):
    """One row per entity with its raw features: nulls are the models' business."""
    venue.task_data(spark, sf)
    split = venue.stage(spark, sf, "task_split", lambda: None)
    return split.where(F.col("task") == "high_rated").drop("task", "label", "is_test")


@register("score_models")
def q_score_models(spark, sf):
    fitted, _s, sets = _grid(spark, sf)
    rows = _rows_to_score(spark, sf)
    out = None
    for (t, m), pm in fitted.items():
        d = S.score(rows, pm, t, K, len(sets[t])).withColumn("model", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return out


@register("score_batch")
def q_score_batch(spark, sf):
    """All three tasks per row as nested results of one pass over the rows."""
    fitted, _s, sets = _grid(spark, sf)
    return S.score_batch(_rows_to_score(spark, sf), {t: fitted[(t, "random_forest")] for t in sets}, K)


def _task_train(spark, sf, task):
    """A task's train rows with their city text and without one-hots."""
    venue.task_data(spark, sf)
    split = venue.stage(spark, sf, "task_split", lambda: None)
    return split.where((F.col("task") == task) & (F.col("is_test") == 0)).select(*K, *TASK_FEATURES[task], "label")


def request_models(spark, sf):
    """A pipeline per task that takes raw requests, saved and loaded again."""
    key = (spark.sparkContext.applicationId, sf, "requests")
    if key not in _CACHE:
        folder = scratch_path(spark, f"models/requests-{uuid.uuid4().hex[:12]}")
        train = {t: _task_train(spark, sf, t) for t in TASK_FEATURES}

        def saved(t):
            io.save_model(T.fit_for_requests(train[t], TASK_FEATURES[t], "random_forest"), f"{folder}/{t}")
            return io.load_model(f"{folder}/{t}")
        with ThreadPoolExecutor(max_workers=len(train)) as ex:
            _CACHE[key] = dict(zip(train, ex.map(saved, train)))
    return _CACHE[key]


def raw_requests(spark, sf):
    """13-field requests as they come in: an id, numbers, and city texts in any case, padded."""
    req = venue.requests(spark, sf)
    city = F.when(F.col("dish_count") % 2 == 0, F.concat(F.lit("  "), F.upper("city"))).otherwise(F.initcap("city"))
    return req.select(F.concat_ws("|", *K).alias("request_id"), *[f for f in S.REQUEST_FIELDS if f != "city"], city.alias("city"))


@register("serving_pipeline", """
WITH n AS (SELECT task, is_test, CASE lower(trim(city)) WHEN 'bangalore' THEN 'bengaluru' WHEN 'delhi' THEN 'new delhi' ELSE lower(trim(city)) END AS c FROM task_split),
top AS (SELECT task, c FROM n WHERE is_test = 0 GROUP BY task, c QUALIFY row_number() OVER (PARTITION BY task ORDER BY count(*) DESC, c) <= 10)
SELECT task, coalesce(top.c, 'other') AS city_known, count(*) AS n_rows, CAST(0 AS BIGINT) AS unlike_training_row
FROM n LEFT JOIN top USING (task, c) GROUP BY ALL
""", ("task_split",))
def q_serving_pipeline(spark, sf):
    """Saved pipelines on raw requests, against models of the encoded training table
    on its own rows: every request must get the probability of its training row."""
    requests, models = raw_requests(spark, sf), request_models(spark, sf)
    scored = SV.score_requests(requests, models, ["request_id"])
    train = {t: _task_train(spark, sf, t) for t in TASK_FEATURES}

    def encoded_model(t):
        known = SV.learn_vocabulary(train[t])
        return known, T.fit(known.encoded(train[t]), [*TASK_FEATURES[t], *known.names], "random_forest")
    with ThreadPoolExecutor(max_workers=len(train)) as ex:
        fitted = dict(zip(train, ex.map(encoded_model, train)))
    out = None
    for t, (known, own) in fitted.items():
        rows = known.encoded(_rows_to_score(spark, sf).select(*K, *[f for f in S.REQUEST_FIELDS if f not in K]))
        trained = T.predict(own, rows.withColumn("city_known", F.expr(known.known_sql())), [F.concat_ws("|", *K).alias("request_id"), "city_known"])
        d = (trained.join(scored.select("request_id", F.col(f"{t}.probability").alias("served")), "request_id")
             .groupBy(F.lit(t).alias("task"), "city_known")
             .agg(F.count("*").alias("n_rows"), F.count_if(~F.round("p", 4).eqNullSafe(F.col("served"))).alias("unlike_training_row")))
        out = d if out is None else out.unionByName(d)
    return out


@register("score_scenarios_models", """
SELECT t.task, CAST(s.i AS INTEGER) AS scenario, count(*) AS n_rows, CAST(0 AS BIGINT) AS unlike_score, CAST(0 AS BIGINT) AS out_of_order
FROM requests, (VALUES ('high_rated'), ('popular'), ('premium')) AS t(task), range(4) AS s(i) GROUP BY ALL
""", ("requests",))
def q_score_scenarios_models(spark, sf):
    """The what-if grid scored by the saved pipelines, against ``score`` of each overlaid
    row by itself; a better ranked scenario never has a smaller probability."""
    from tavola.plans.queries_score import SCENARIOS
    requests, models = raw_requests(spark, sf), request_models(spark, sf)
    grid = S.score_scenarios(requests, list(SCENARIOS), ["request_id"], models)
    alone = None
    for i, combo in enumerate(SCENARIOS):
        overlaid = S.derive_serving_features(requests.withColumns({f: F.lit(v).cast("double") for f, v in combo.items()}))
        for t, m in models.items():
            d = S.score(overlaid, m, t, ["request_id"]).select("request_id", "task", F.lit(i).alias("scenario"), F.col("probability").alias("alone"))
            alone = d if alone is None else alone.unionByName(d)
    w = Window.partitionBy("request_id", "task").orderBy("rank")
    both = grid.withColumn("better", F.when(F.col("rank").isNotNull(), F.lag("probability").over(w))).withColumn("better_rank", F.lag("rank").over(w))
    return (both.join(alone, ["request_id", "task", "scenario"]).groupBy("task", "scenario")
            .agg(F.count("*").alias("n_rows"), F.count_if(F.col("probability") != F.col("alone")).alias("unlike_score"),
                 F.count_if(F.col("rank").isNotNull() & F.col("better_rank").isNotNull() & (F.col("better") < F.col("probability"))).alias("out_of_order")))


@register("score_to_log", """
SELECT task AS model, count(*) AS total_predictions, CAST(1 AS DOUBLE) AS success_rate,
       avg(CAST(dish_count AS DOUBLE)) / 1000 AS avg_response_time, avg(probability) AS avg_probability
FROM (SELECT * FROM rule_scores JOIN requests USING ({KS})) GROUP BY task
""".replace("{KS}", KS), ("rule_scores", "requests"), dbl=("success_rate", "avg_response_time", "avg_probability"))
def q_score_to_log(spark, sf):
    """Rule scores of the requests appended to the prediction log, read back and
    summarised per model."""
    from tavola.operators import monitor as M
    scored = _rule_scored(spark, sf)
    path = scratch_path(spark, f"io/score-log-{uuid.uuid4().hex[:12]}")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for t in TASK_FEATURES:
        d = scored.where(F.col("task") == t)
        io.append_prediction_log(S.log_records(d, FEATS, t, at, F.col("dish_count") / 1000), path)
    log = io.read_prediction_log(spark, path)
    p = log.groupBy("model").agg(F.avg("prediction.probability").alias("avg_probability"))
    g = log.groupBy("model").agg(F.count("*").alias("total_predictions"), F.avg(F.col("success").cast("double")).alias("success_rate"),
                                 F.avg("response_time").alias("avg_response_time"))
    assert M.log_metrics(log.withColumnRenamed("timestamp", "ts"), [1]).count() == 1
    return g.join(p, "model")


@register("save_load_model")
def q_save_load_model(spark, sf):
    fitted, _s, sets = _grid(spark, sf)
    path = scratch_path(spark, f"models/premium_boosted_trees-{uuid.uuid4().hex[:12]}")
    io.save_model(fitted[("premium", "boosted_trees")], path)
    pm = io.load_model(path)
    data = venue.task_data(spark, sf).where((F.col("task") == "premium") & (F.col("is_test") == 1))
    return T.predict(pm, data, [*K, F.col("label").alias("y")])


# --- interpretation on the rule-based score column (SQL-checkable) ---------
FEATS = ("avg_price", "dish_count", "total_rating_count", "avg_rating", "median_rating", "rating_std",
         "price_std", "category_diversity", "price_to_dish_ratio", "rating_count_per_dish", "has_high_variance",
         "price_volatility")


def _rule_scored(spark, sf):
    req = venue.requests(spark, sf)
    return S.rule_scores(req, K).join(req, on=K)


def _corr_sql():
    rows = " UNION ALL ".join(
        f"SELECT task, '{f}' AS feature, CASE WHEN isnan(corr(CAST({f} AS DOUBLE), probability)) THEN NULL "
        f"ELSE corr(CAST({f} AS DOUBLE), probability) END AS r FROM rs GROUP BY task" for f in FEATS)
    return f"WITH rs AS (SELECT * FROM rule_scores JOIN requests USING ({KS})) {rows}"


@register("prediction_correlations", _corr_sql(), ("rule_scores", "requests"), dbl=("r",))
def q_prediction_correlations(spark, sf):
    return X.prediction_correlations(_rule_scored(spark, sf), FEATS, "probability")


@register("prediction_stats", """
SELECT task, avg(probability) AS mean_probability, stddev_pop(probability) AS std_probability,
       avg(CAST(CASE WHEN avg_price > 300 THEN 1 ELSE 0 END AS DOUBLE)) AS positive_rate,
       avg(CAST(prediction AS DOUBLE)) AS predicted_rate
FROM (SELECT * FROM rule_scores JOIN requests USING ({KS})) GROUP BY task
""".replace("{KS}", KS), ("rule_scores", "requests"), dbl=("mean_probability", "std_probability", "positive_rate", "predicted_rate"))
def q_prediction_stats(spark, sf):
    """A label that differs from the prediction, so the two rates are told apart."""
    return X.prediction_stats(_rule_scored(spark, sf).withColumn("y", (F.col("avg_price") > 300).cast("int")), "probability")


@register("insight_report", f"""
SELECT *, rank <= 5 AS saved FROM (
  SELECT task, feature, r, CAST(row_number() OVER (PARTITION BY task ORDER BY abs(r) DESC NULLS LAST, feature) AS INTEGER) AS rank,
         CASE WHEN r > 0 THEN 'increases' ELSE 'decreases' END AS direction,
         CASE WHEN abs(r) > 0.3 THEN '***' WHEN abs(r) > 0.2 THEN '**' ELSE '*' END AS strength
  FROM ({_corr_sql()}) WHERE r IS NOT NULL)
WHERE rank <= 8
""", ("rule_scores", "requests"), dbl=("r",))
def q_insight_report(spark, sf):
    return X.insight_report(X.prediction_correlations(_rule_scored(spark, sf), FEATS, "probability"))
