"""Model training with MLlib: baselines, logistic regression, random forest,
gradient-boosted trees, the task x model grid and cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.distributed_quantile import number
from tavola.functions.stats import quantile_struct
from tavola.operators.forest import fit_forest

# Model presets (reference values) and a small preset for checks.
PRESETS = {
    "baseline": {"random_forest": {"numTrees": 100, "maxDepth": 30, "minInstancesPerNode": 1},
                 "logistic": {"maxIter": 1000}},
    "advanced": {"random_forest": {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 2},
                 "boosted_trees": {"maxIter": 200, "maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.8}},
    "small": {"random_forest": {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 2},
              "boosted_trees": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8},
              "logistic": {"maxIter": 100}},
}
SEED = 42
#: Training rows in a file, and so in a task of a fit: passes over little data are mostly the cost of tasks.
ROWS_PER_TASK = 50_000
#: Deeper forests have too many nodes for the driver, which holds all of an MLlib forest.
DRIVER_DEPTH = 10


def hash_uniform(keys: Sequence[str], salt: str) -> Column:
    """Deterministic uniform [0, 1) per key from md5 (engine neutral)."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def fit_dummy(train: DataFrame, df: DataFrame, keys: Sequence[str], strategy: str = "most_frequent",
              label: str = "label", by: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """Baseline scores for ``df`` learned from ``train``: the class prior per
    ``by`` group.  most_frequent -> p = 1 if prior >= 0.5 else 0;
    stratified -> p = 1 when a key-hash uniform is below the prior."""
    prior = train.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("_prior"))
    d = df.join(F.broadcast(prior), on=list(by)) if by else df.withColumn("_prior", prior.select("_prior").scalar())
    if strategy == "most_frequent":
        p = F.when(F.col("_prior") >= 0.5, 1.0).otherwise(0.0)
    elif strategy == "stratified":
        p = F.when(hash_uniform([*keys, *by], str(seed)) < F.col("_prior"), 1.0).otherwise(0.0)
    else:
        raise ValueError(strategy)
    return d.withColumn("p", p).drop("_prior")


def _classifier(model: str, preset: str, label: str = "label", features: str = "features"):
    cfg = PRESETS[preset].get(model, {})
    if model == "logistic":
        return LogisticRegression(labelCol=label, featuresCol=features, elasticNetParam=0.0,
                                  standardization=False, **cfg)
    if model == "random_forest":
        # without the cache every pass ships all trees so far to every task and walks them from the root
        return RandomForestClassifier(labelCol=label, featuresCol=features, featureSubsetStrategy="sqrt",
                                      seed=SEED, cacheNodeIds=True, **cfg)
    if model == "boosted_trees":
        return GBTClassifier(labelCol=label, featuresCol=features, featureSubsetStrategy="0.8",
                             seed=SEED, **cfg)
    raise ValueError(model)


def _input(feature: str) -> str:
    return f"{feature}__in"


def build_pipeline(features: Sequence[str], model: str, preset: str = "small", n_train: int | None = None,
                   label: str = "label", medians: dict[str, float] | None = None,
                   scaling: dict[str, tuple[float, float]] | None = None, vocabulary=None) -> Pipeline:
    """(vocabulary ->) imputer (and scaler) -> assembler -> classifier, all saved with the model.

    With a ``serving.Vocabulary`` its columns are made of the text column itself, so
    the saved model scores rows that hold the text.  A null or NaN feature gets its median, then is centred and divided by its
    population deviation where ``scaling`` gives (mean, deviation).  Logistic
    regression takes sklearn's C=1 penalty: regParam = 1 / n_train."""
    def expr(f: str) -> str:
        known = vocabulary is not None and f in vocabulary.names
        x = vocabulary.input_sql(f) if known else f"CAST(`{f}` AS DOUBLE)"
        if medians and not known:
            x = f"coalesce(CASE WHEN NOT isnan({x}) THEN {x} END, {float(medians.get(f, 0.0))!r}D)"
        if scaling:
            mean, dev = scaling[f]
            x = f"({x} - ({float(mean)!r}D)) / {float(dev) or 1.0!r}D"
        return f"{x} AS `{_input(f)}`"

    clf = _classifier(model, preset, label)
    if model == "logistic":
        clf.setRegParam(1.0 / max(n_train or 1, 1))
    return Pipeline(stages=[*([vocabulary.stage()] if vocabulary is not None else []),
                            SQLTransformer(statement=f"SELECT *, {', '.join(expr(f) for f in features)} FROM __THIS__"),
                            VectorAssembler(inputCols=[_input(f) for f in features], outputCol="features", handleInvalid="keep"), clf])


def learn_inputs(train: DataFrame, features: Sequence[str]) -> tuple[int, dict[str, float], dict[str, tuple[float, float]]]:
    """Rows, exact medians, and mean and population deviation after imputation."""
    features = list(features)
    q = train.select(quantile_struct(train, features, [0.5]).alias("q")).first() if features else None
    med = {f: (q["q"][f"q{i}"][0] if q and q["q"][f"q{i}"] and q["q"][f"q{i}"][0] is not None else 0.0) for i, f in enumerate(features)}
    aggs = []
    for i, f in enumerate(features):
        x = F.coalesce(number(F.col(f"`{f}`")), F.lit(med[f]))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = train.agg(F.count("*").alias("n"), *aggs).first()
    return r["n"], med, {f: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, f in enumerate(features)}


def fit(train: DataFrame, features: Sequence[str], model: str, preset: str = "small",
        label: str = "label", vocabulary=None, learned: tuple | None = None) -> PipelineModel:
    """A saved model needs nothing else to score raw rows: what it imputes and
    scales with, and the text values it knows, are learned from ``train`` and part of it.
    Fits of the same rows and features share ``learned`` (``learn_inputs`` of them)."""
    n, medians, scaling = learned or learn_inputs(vocabulary.encoded(train) if vocabulary is not None else train, features)
    pipeline = build_pipeline(features, model, preset, n, label, medians, scaling if model == "logistic" else None, vocabulary)
    cfg = PRESETS[preset].get(model, {})
    if model == "random_forest" and cfg.get("maxDepth", 0) > DRIVER_DEPTH:
        inputs = PipelineModel(pipeline.getStages()[:-2])
        forest = fit_forest(inputs.transform(train), [_input(f) for f in features], label, cfg["numTrees"], cfg["maxDepth"], cfg["minInstancesPerNode"], SEED)
        return PipelineModel([*inputs.stages, forest])
    return pipeline.fit(train)


def fit_for_requests(train: DataFrame, features: Sequence[str], model: str, preset: str = "small", label: str = "label",
                     column: str = "city", k: int = 10) -> PipelineModel:
    """A model of raw requests: ``features`` and the k most frequent values of the text ``column``."""
    from tavola.operators.serving import learn_vocabulary

    vocabulary = learn_vocabulary(train, column, k)
    return fit(train, [*features, *vocabulary.names], model, preset, label, vocabulary)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep columns + p = probability of class 1."""
    return model.transform(df).select(*keep, vector_to_array(F.col("probability"))[1].alias("p"))


def train_grid(data: DataFrame, feature_sets: dict[str, list[str]], models: Sequence[str], keys: Sequence[str],
               preset: str = "small", label: str = "label", task_col: str = "task",
               parallelism: int = 3) -> tuple[dict, DataFrame]:
    """Every model x every task: fit on the task's train rows (is_test = 0),
    score its test rows.  Returns ({(task, model): PipelineModel}, scored
    test rows (keys, task, model, y, p)).  Fits run in a small driver thread
    pool; each fit is itself a distributed MLlib job."""
    jobs = [(t, m) for t in feature_sets for m in models]
    # Each task's train rows are read by every iteration of three fits:
    # keep them (only the task's columns) in executor memory, spilling to
    # disk, and recomputable from the staged input if an executor is lost.
    train_sets = {}
    for t in feature_sets:
        cols = [*keys, *feature_sets[t], label]
        d = data.where(F.col(task_col) == t)
        train_sets[t] = d.where(F.col("is_test") == 0).select(*cols).persist(StorageLevel.MEMORY_AND_DISK)

    # what the models of a task impute and scale with is the same: learned once
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        learned = dict(zip(feature_sets, ex.map(lambda t: learn_inputs(train_sets[t], feature_sets[t]), feature_sets)))

    def run(job):
        t, m = job
        d = data.where(F.col(task_col) == t)
        tr, te = train_sets[t], d.where(F.col("is_test") == 1)
        pm = fit(tr, feature_sets[t], m, preset, label, learned=learned[t])
        sc = predict(pm, te, [*keys, F.col(label).alias("y")]).select(
            *keys, F.lit(t).alias("task"), F.lit(m).alias("model"), "y", "p")
        return (t, m), pm, sc

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        results = list(ex.map(run, jobs))
    for tr in train_sets.values():
        tr.unpersist()
    fitted = {k: pm for k, pm, _ in results}
    scored = results[0][2]
    for _k, _pm, sc in results[1:]:
        scored = scored.unionByName(sc)
    return fitted, scored


def store_rows(data: DataFrame, path: str, by: str, rows_per_file: int = ROWS_PER_TASK) -> DataFrame:
    """data written once as Parquet, a folder per value of ``by``, in files of about
    ``rows_per_file`` rows: what every fit reads, with a task for each file."""
    n = data.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    spread = F.pmod(F.xxhash64(*[c for c in data.columns if c != by]), F.lit(max(1, -(-n // rows_per_file)))).cast("int")
    (data.withColumn("_file", spread).repartition(by, "_file").drop("_file").write.partitionBy(by).parquet(path))
    return data.sparkSession.read.schema(data.schema).parquet(path)


def cross_validation_scores(data: DataFrame, feature_sets: dict[str, list[str]], models: Sequence[str], keys: Sequence[str], path: str,
                            k: int = 5, preset: str = "small", label: str = "label", fold_col: str = "fold", task_col: str = "task",
                            parallelism: int = 4) -> DataFrame:
    """Out-of-fold scores of every (task, model): task, model, fold, keys, y, p.

    ``data`` has a row per (key, task) with its fold (``features.fold_ids``) and is
    stored once under ``path``; all tasks x models x k fits read it, ``parallelism`` at
    a time, and each writes the scores of its own fold beside it, so a fit that
    is repeated replaces its own scores only."""
    spark = data.sparkSession
    cols = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    stored = store_rows(data.select(*keys, *[c for c in cols if c not in keys], task_col, fold_col, label), f"{path}/rows", task_col)

    def train(t: str, f: int) -> DataFrame:
        return stored.where((F.col(task_col) == t) & (F.col(fold_col) != f))

    def run(job: tuple[str, str, int]) -> None:
        t, m, f = job
        rows = stored.where(F.col(task_col) == t)
        pm = fit(train(t, f), feature_sets[t], m, preset, label, learned=learned[t, f])
        predict(pm, rows.where(F.col(fold_col) == f), [*keys, F.col(label).alias("y")]).write.mode("overwrite").parquet(f"{path}/scores/task={t}/model={m}/fold={f}")

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        parts = [(t, f) for t in feature_sets for f in range(k)]
        learned = dict(zip(parts, ex.map(lambda p: learn_inputs(train(*p), feature_sets[p[0]]), parts)))
        list(ex.map(run, [(t, m, f) for t in feature_sets for m in models for f in range(k)]))
    return spark.read.parquet(f"{path}/scores")


def cross_validation_report(scores: DataFrame) -> DataFrame:
    """Exact ROC-AUC per (task, model, fold) of stored scores, in one grouped pass,
    with the folds' mean and population deviation."""
    from tavola.operators.evaluate import roc_auc

    auc = roc_auc(scores, ["task", "model", "fold"], "y", "p").select("task", "model", "fold", "roc_auc")
    over = Window.partitionBy("task", "model")  # as many rows as there are folds
    return auc.withColumns({"cv_mean": F.avg("roc_auc").over(over), "cv_std": F.stddev_pop("roc_auc").over(over)})


def cross_validate(data: DataFrame, feature_sets: dict[str, list[str]], models: Sequence[str], keys: Sequence[str], path: str,
                   k: int = 5, preset: str = "small", **how) -> DataFrame:
    """Stratified k-fold cross-validation of every model on every task."""
    return cross_validation_report(cross_validation_scores(data, feature_sets, models, keys, path, k, preset, **how))


def coefficient_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Logistic coefficients and |coefficient| per feature, descending."""
    lr = model.stages[-1]
    coefs = lr.coefficients.toArray().tolist()
    spark = model_session()
    rows = [(f, float(c), abs(float(c))) for f, c in zip(features, coefs)]
    return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double") \
        .orderBy(F.desc("abs_coefficient"))


def tree_importance(model: PipelineModel, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Impurity importances per feature (sum to 1), descending."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    df = model_session().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


def model_info(fitted: dict, feature_sets: dict[str, list[str]]) -> DataFrame:
    """Per (task, model): model type, number of features, first 5 names."""
    rows = [(t, m, type(pm.stages[-1]).__name__, len(feature_sets[t]), ", ".join(feature_sets[t][:5]))
            for (t, m), pm in fitted.items()]
    return model_session().createDataFrame(
        rows, "task string, model string, model_type string, n_features int, first_features string")


def model_session():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()
