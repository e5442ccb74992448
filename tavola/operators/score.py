"""Scoring helpers: serving features, vector layouts, city normalisation,
confidence tiers, rule-based fallback scores, insights, what-if grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.exprs import rint_round, when_chain

REQUEST_FIELDS = ("avg_price", "dish_count", "total_rating_count", "avg_rating", "median_rating",
                  "rating_std", "price_std", "category_diversity", "price_to_dish_ratio",
                  "rating_count_per_dish", "has_high_variance", "price_volatility", "city")

# City aliases and the cities known to the serving layout.
CITY_ALIASES = {"bangalore": "bengaluru", "delhi": "new delhi"}
KNOWN_CITIES = ("ahmedabad", "bengaluru", "chandigarh", "chennai", "hyderabad", "jaipur", "kolkata",
                "lucknow", "mumbai", "new delhi")

# The three 30-slot vector layouts of the serving code.
# numeric: feature -> slot; city: value -> slot ('other' for the rest);
# city_mode: 'normalize' (lower-case + aliases), 'lower' or 'raw';
# consistency/price_tier/count: slots of the derived values (or None).
VECTOR_LAYOUTS = {
    "fixed": {
        "numeric": {"avg_price": 0, "dish_count": 1, "total_rating_count": 2, "avg_rating": 3,
                    "median_rating": 4, "rating_std": 5, "price_std": 6, "category_diversity": 7,
                    "price_to_dish_ratio": 8, "rating_count_per_dish": 9, "has_high_variance": 10,
                    "price_volatility": 11},
        "city": {"mumbai": 12, "delhi": 13, "bangalore": 14, "chennai": 15, "kolkata": 16,
                 "hyderabad": 17, "pune": 18, "ahmedabad": 19, "other": 20},
        "city_mode": "lower", "consistency": 21, "price_tier": 22, "count": 23,
    },
    "correct": {
        "numeric": {"avg_price": 0, "dish_count": 1, "total_rating_count": 2, "rating_std": 3,
                    "price_std": 4, "category_diversity": 5, "price_to_dish_ratio": 6,
                    "rating_count_per_dish": 7, "has_high_variance": 8},
        "city": {"ahmedabad": 9, "bengaluru": 10, "chandigarh": 11, "chennai": 12, "hyderabad": 13,
                 "jaipur": 14, "kolkata": 15, "lucknow": 16, "mumbai": 17, "new delhi": 18, "other": 19},
        "city_mode": "normalize", "consistency": 20, "price_tier": 21, "count": 22,
    },
    "mapper": {
        "numeric": {"avg_price": 0, "dish_count": 1, "total_rating_count": 2, "rating_std": 3,
                    "price_std": 4, "category_diversity": 5, "price_to_dish_ratio": 6,
                    "rating_count_per_dish": 7, "has_high_variance": 8},
        "city": {"mumbai": 9, "delhi": 10, "bangalore": 11, "chennai": 12, "kolkata": 13,
                 "hyderabad": 14, "pune": 15, "ahmedabad": 16, "other": 17},
        "city_mode": "raw", "consistency": None, "price_tier": None, "count": None,
    },
}
VECTOR_SIZE = 30

# Confidence cut-offs (high, medium) per task.
TIERS = {"high_rated": (0.8, 0.6), "popular": (0.9, 0.7), "premium": (0.8, 0.6)}

# Rule thresholds of the fallback scorer.
RULES = {"high_rated": 4.2, "popular": 100, "premium": 400}


def derive_serving_features(req: DataFrame) -> DataFrame:
    """Serving-time derived fields: ratios over max(dish_count, 1),
    volatility over max(avg_price, 1), has_high_variance = rating_std > 0.5,
    ratios rounded to 2 decimals."""
    return req.withColumns({
        "price_to_dish_ratio": rint_round(F.col("avg_price") / F.greatest(F.col("dish_count"), F.lit(1)), 2),
        "rating_count_per_dish": rint_round(F.col("total_rating_count") / F.greatest(F.col("dish_count"), F.lit(1)), 2),
        "has_high_variance": F.coalesce((F.col("rating_std") > 0.5).cast("int"), F.lit(0)),
        "price_volatility": rint_round(F.col("price_std") / F.greatest(F.col("avg_price"), F.lit(1.0)), 2),
    })


def normalize_city(c, aliases: Mapping[str, str] = CITY_ALIASES,
                   known: Sequence[str] = KNOWN_CITIES) -> Column:
    """lower-case, aliases, then anything not known -> 'other'."""
    low = F.lower(F.trim(c if isinstance(c, Column) else F.col(c)))
    amap = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    norm = F.coalesce(F.element_at(amap, low), low)
    return F.when(norm.isin(list(known)), norm).otherwise(F.lit("other"))


def confidence_tier(p, task) -> Column:
    """high / medium / low by per-task cut-offs (>=)."""
    p = p if isinstance(p, Column) else F.col(p)
    task = task if isinstance(task, Column) else F.lit(task)
    hi = when_chain([(task == t, v[0]) for t, v in TIERS.items()], 0.8)
    mid = when_chain([(task == t, v[1]) for t, v in TIERS.items()], 0.6)
    return F.when(p >= hi, "high").when(p >= mid, "medium").otherwise("low")


def assemble_vector30(req: DataFrame, layout: str = "correct", out: str = "features") -> DataFrame:
    """Fixed 30-slot array<double> built from a layout table (absent -> 0)."""
    spec = VECTOR_LAYOUTS[layout]
    slots: list[Column] = [F.lit(0.0)] * VECTOR_SIZE
    cols = set(req.columns)
    for f, i in spec["numeric"].items():
        slots[i] = F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in cols else F.lit(0.0)
    city = F.coalesce(F.col("city"), F.lit("other")) if "city" in cols else F.lit("other")
    if spec["city_mode"] == "normalize":
        key = normalize_city(city)
    elif spec["city_mode"] == "lower":
        key = F.lower(city)
    else:
        key = city
    named = [v for v in spec["city"] if v != "other"]
    key = F.when(key.isin(named), key).otherwise(F.lit("other"))
    for v, i in spec["city"].items():
        slots[i] = (key == F.lit(v)).cast("double")
    if spec["consistency"] is not None:
        slots[spec["consistency"]] = F.when(F.coalesce(F.col("rating_std"), F.lit(1.0)) < 0.3, 1.0).otherwise(0.0)
    if spec["price_tier"] is not None:
        ap = F.coalesce(F.col("avg_price"), F.lit(0.0))
        slots[spec["price_tier"]] = F.when(ap > 500, 2.0).when(ap > 300, 1.0).otherwise(0.0)
    if spec["count"] is not None:
        slots[spec["count"]] = F.least(F.coalesce(F.col("total_rating_count"), F.lit(0)) / 1000.0, F.lit(1.0))
    return req.withColumn(out, F.array(*slots))


def assemble_by_metadata(req: DataFrame, feature_names: Sequence[str], out: str = "features") -> DataFrame:
    """The task's ordered features taken from the request; ``city_<v>``
    names become 1 when the request's city is ``v``; absent fields -> 0."""
    cols = set(req.columns)
    city = F.col("city") if "city" in cols else F.lit("other")
    vals = []
    for f in feature_names:
        if f in cols:
            vals.append(F.coalesce(F.col(f).cast("double"), F.lit(0.0)))
        elif f.startswith("city_"):
            vals.append((city == F.lit(f[5:])).cast("double"))
        else:
            vals.append(F.lit(0.0))
    return req.withColumn(out, F.array(*vals))


def rule_scores(req: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fallback scores, one row per (key, task): prediction, probability,
    confidence (> 0.8 high, > 0.6 medium when predicted, else low)."""
    ar, cnt, ap = F.col("avg_rating"), F.col("total_rating_count"), F.col("avg_price")
    spec = [
        ("high_rated", ar >= RULES["high_rated"], ar / 5.0),
        ("popular", cnt >= RULES["popular"], F.least(cnt / 1000.0, F.lit(1.0))),
        ("premium", ap > RULES["premium"], F.least(ap / 1000.0, F.lit(1.0))),
    ]
    rows = []
    for task, pred, prob in spec:
        pr = F.coalesce(pred, F.lit(False))
        conf = F.when(pr & (prob > 0.8), "high").when(pr & (prob > 0.6), "medium").otherwise("low")
        rows.append(F.struct(F.lit(task).alias("task"), pr.cast("int").alias("prediction"),
                             prob.cast("double").alias("probability"), conf.alias("confidence")))
    return req.select(*keys, F.inline(F.array(*rows)))


# Insight labels (positive, negative) per rule.
INSIGHTS = (
    ("rating", "High Potential", "Improvement Opportunity"),
    ("popularity", "Popular Spot", "Growth Potential"),
    ("price", "Premium Positioning", "Value Focus"),
    ("consistency", "Consistent Quality", "Inconsistent Experience"),
    ("menu", "Extensive Menu", "Focused Menu"),
)

# Recommendation labels, first match wins.
RECOMMENDATIONS = ("Focus on Quality & Marketing", "Leverage High Ratings", "Premium Experience",
                   "Solid Foundation")


def rule_insights(req: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Five labelled findings per row (rating >= 4.2, count >= 100,
    price > 400, rating_std < 0.5, dishes > 50)."""
    conds = [F.col("avg_rating") >= 4.2, F.col("total_rating_count") >= 100, F.col("avg_price") > 400,
             F.col("rating_std") < 0.5, F.col("dish_count") > 50]
    rows = [F.struct(F.lit(aspect).alias("aspect"), F.coalesce(c, F.lit(False)).alias("positive"),
                     F.when(F.coalesce(c, F.lit(False)), F.lit(pos)).otherwise(F.lit(neg)).alias("insight"))
            for (aspect, pos, neg), c in zip(INSIGHTS, conds)]
    return req.select(*keys, F.inline(F.array(*rows)))


def recommendation(req: DataFrame) -> DataFrame:
    ar, cnt, ap = F.col("avg_rating"), F.col("total_rating_count"), F.col("avg_price")
    a, b, c, d = RECOMMENDATIONS
    rec = (F.when((ar < 4.2) & (cnt < 100), a).when((ar >= 4.2) & (cnt < 100), b)
           .when(ap > 500, c).otherwise(d))
    return req.withColumn("recommendation", rec)


NORMALIZED = ("avg_price", "dish_count", "total_rating_count", "category_diversity")


def normalized_metrics(req: DataFrame, keys: Sequence[str], cols: Sequence[str] = NORMALIZED) -> DataFrame:
    """Per row: each metric as 100 * v / max(v of the row) (max <= 0 -> 1)."""
    vals = [F.col(c).cast("double") for c in cols]
    mx = F.greatest(*vals)
    den = F.when(mx > 0, mx).otherwise(F.lit(1.0))
    rows = [F.struct(F.lit(c).alias("metric"), v.alias("value"), (v / den * 100.0).alias("normalized"))
            for c, v in zip(cols, vals)]
    return req.select(*keys, F.inline(F.array(*rows)))


def by_task(models: Mapping[str, object]) -> Column:
    """The task structs of ``score_batch`` as rows (task, prediction, probability, confidence)."""
    return F.inline(F.array(*[F.struct(F.lit(t).alias("task"), *[F.col(f"`{t}`.{c}").alias(c) for c in ("prediction", "probability", "confidence")]) for t in models]))


def scenario_grid(base: DataFrame, combos: Sequence[Mapping[str, float]]) -> DataFrame:
    """Every base row overlaid with each combination (a short parameter list,
    expanded per row by ``inline`` rather than a join), serving ratios re-derived."""
    fields = sorted({k for c in combos for k in c})
    structs = [F.struct(F.lit(i).alias("scenario"),
                        *[F.lit(c.get(f)).cast("double").alias(f"_o_{f}") for f in fields])
               for i, c in enumerate(combos)]
    grid = base.select("*", F.inline(F.array(*structs)))
    grid = grid.withColumns({f: F.coalesce(F.col(f"_o_{f}"), F.col(f).cast("double")) for f in fields})
    return derive_serving_features(grid.drop(*[f"_o_{f}" for f in fields]))


def score_scenarios(base: DataFrame, combos: Sequence[Mapping[str, float]], keys: Sequence[str],
                    models: Mapping[str, object] | None = None) -> DataFrame:
    """What-if grid, one row per (row, scenario, task).  Without ``models`` the fallback
    rules score; with them every fitted pipeline scores the whole grid in one pass, and
    ``rank`` orders a row's positive scenarios of a task by probability (null: not positive).
    A window holds the scenarios of one row and task, as many as there are combinations."""
    grid = scenario_grid(base, combos)
    if models is None:
        return rule_scores(grid, [*keys, "scenario"])
    scored = score_tasks(grid, models, [*keys, "scenario"])
    each = scored.select(*keys, "scenario", by_task(models))
    best = Window.partitionBy(*keys, "task", "prediction").orderBy(F.desc("probability"), "scenario")
    return each.withColumn("rank", F.when(F.col("prediction") == 1, F.row_number().over(best)))


def score(df: DataFrame, model, task: str, keys: Sequence[str], n_features: int | None = None) -> DataFrame:
    """keys, task, probability (4 decimals), prediction (>= 0.5), confidence and
    features_used of every row; the model imputes and scales by itself."""
    rows = score_batch(df, {task: model}, keys)
    used = n_features if n_features is not None else _inputs(model)
    return rows.select(*keys, F.lit(task).alias("task"), F.col(f"{task}.probability").alias("probability"),
                       F.col(f"{task}.prediction").alias("prediction"), F.col(f"{task}.confidence").alias("confidence"),
                       F.lit(used).alias("features_used"))


def _inputs(model) -> int:
    """Length of the feature vector that the pipeline assembles."""
    return next((len(s.getInputCols()) for s in model.stages if hasattr(s, "getInputCols")), 0)


def score_tasks(df: DataFrame, models: Mapping[str, object], keep: Sequence[str]) -> DataFrame:
    """``keep`` and one struct (prediction, probability, confidence) per task: every
    model transforms the same rows in turn, without a join or shuffle."""
    out, names = df, list(df.columns)
    for task, model in models.items():
        done = [c for c in out.columns if c not in names]
        p = F.round(vector_to_array(F.col("probability"))[1], 4)
        out = model.transform(out).select(*names, *done, F.struct((p >= 0.5).cast("int").alias("prediction"), p.alias("probability"),
                                                                  confidence_tier(p, task).alias("confidence")).alias(task))
    return out.select(*keep, *models)


def score_batch(df: DataFrame, models: Mapping[str, object], keys: Sequence[str]) -> DataFrame:
    """keys, index and the tasks' structs of ``score_tasks``.
    ``index`` is a hash of the keys, so it does not depend on the order of rows."""
    return score_tasks(df, models, keys).select(*keys, F.xxhash64(*keys).alias("index"), *models)


def log_records(scored: DataFrame, features: Sequence[str], task: str, timestamp: Column, response_time: Column) -> DataFrame:
    """Records of the prediction log (``sources.io.LOG_SCHEMA``) of rows that hold
    their features and probability, prediction and confidence."""
    return scored.select(timestamp.cast("timestamp").alias("timestamp"), F.lit(task).alias("model"),
                         F.create_map(*[x for f in features for x in (F.lit(f), F.col(f"`{f}`").cast("double"))]).alias("features"),
                         F.struct(F.col("prediction").cast("int").alias("prediction"), F.col("probability").cast("double").alias("probability"),
                                  "confidence").alias("prediction"),
                         response_time.cast("double").alias("response_time"), F.lit(True).alias("success"), F.lit(len(features)).alias("feature_count"))
