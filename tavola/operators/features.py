"""Feature engineering, encoding, imputation, scaling and splitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.exprs import present, q, when_chain
from tavola.functions.stats import quantiles
from tavola.functions.windows import global_rank

# Right-closed bin edges and labels.
PRICE_SEGMENTS = ((200, "budget"), (400, "mid_range"), (600, "premium"), (None, "luxury"))
SIZE_CATEGORIES = ((50, "small"), (100, "medium"), (200, "large"), (None, "very_large"))

# Modelling column lists.
MODEL_NUMERIC = ("avg_price", "dish_count", "avg_rating", "total_rating_count", "median_rating",
                 "rating_std", "price_std", "popularity_score", "rating_consistency",
                 "price_consistency", "value_score", "popularity_density", "category_diversity",
                 "premium_score")
ENCODED = ("price_segment_encoded", "size_category_encoded")
TASK_FEATURES = {
    "high_rated": ("avg_price", "dish_count", "total_rating_count", "price_std", "category_diversity",
                   "price_to_dish_ratio", "rating_count_per_dish", "has_high_variance", "price_volatility"),
    "popular": ("avg_price", "dish_count", "avg_rating", "median_rating", "price_std",
                "category_diversity", "price_to_dish_ratio", "has_high_variance", "price_volatility"),
    "premium": ("dish_count", "avg_rating", "median_rating", "total_rating_count", "rating_std",
                "category_diversity", "rating_count_per_dish", "has_high_variance"),
}
TASK_TARGET = {"high_rated": "is_high_rated", "popular": "is_popular", "premium": "is_premium"}
SAFE_BASE = ("avg_price", "dish_count", "total_rating_count", "rating_std", "price_std",
             "category_diversity", "price_to_dish_ratio", "rating_count_per_dish", "has_high_variance")
LEAKY_SCORES = ("popularity_score", "value_score", "premium_score", "rating_consistency",
                "price_consistency")


def _cut(c: Column, edges) -> Column:
    """Right-closed bins (0, e1], (e1, e2], ...; <= 0 or null -> null."""
    cases = [(c <= F.lit(0), None)]
    for edge, label in edges:
        cases.append(((c <= F.lit(edge)) if edge is not None else c.isNotNull(), label))
    expr = None
    for cond, val in cases:
        v = F.lit(val).cast("string")
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr


def price_segment(e: DataFrame, column: str = "avg_price", out: str = "price_segment") -> DataFrame:
    return e.withColumn(out, _cut(F.col(column), PRICE_SEGMENTS))


def size_category(e: DataFrame, column: str = "dish_count", out: str = "size_category") -> DataFrame:
    return e.withColumn(out, _cut(F.col(column), SIZE_CATEGORIES))


def consistency_scores(e: DataFrame) -> DataFrame:
    return e.withColumns({
        "rating_consistency": 1.0 / (1.0 + F.coalesce(F.col("rating_std"), F.lit(0.0))),
        "price_consistency": 1.0 / (1.0 + F.coalesce(F.col("price_std"), F.lit(0.0))),
    })


def value_score(e: DataFrame) -> DataFrame:
    return e.withColumn("value_score", F.col("avg_rating") / (F.col("avg_price") + 1.0))


def popularity_density(e: DataFrame) -> DataFrame:
    return e.withColumn("popularity_density", F.col("total_rating_count") / (F.col("dish_count") + 1.0))


def category_diversity(e: DataFrame, column: str = "categories") -> DataFrame:
    """Number of comma-separated parts (names holding commas count more than
    once, as in the reference); null -> 1."""
    return e.withColumn("category_diversity",
                        F.coalesce(F.size(F.split(F.col(column), ",")), F.lit(1)).cast("int"))


def premium_score(e: DataFrame) -> DataFrame:
    return e.withColumn("premium_score", (F.col("avg_price") / 100.0) * F.col("avg_rating"))


def enhance_entities(e: DataFrame) -> DataFrame:
    """Operators 37-43 in one projection."""
    return (e.transform(price_segment).transform(size_category).transform(consistency_scores)
             .transform(value_score).transform(popularity_density).transform(category_diversity)
             .transform(premium_score))


VOCAB_INLINE_LIMIT = 10_000


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_encoded",
                 missing: str = "nan", inline_limit: int = VOCAB_INLINE_LIMIT) -> DataFrame:
    """Integer code = position of the value in the sorted distinct values
    present (missing is the string 'nan').

    The vocabulary size is checked first (one HyperLogLog job): a small
    vocabulary is a sorted array in a scalar subquery (no join); a large one
    is ranked with ``global_rank`` (range partitioning, never one task) and
    joined back on the value (AQE decides broadcast or shuffle from its
    measured size)."""
    cols = list(cols)
    st = df.agg(*[F.approx_count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(missing)), 0.05).alias(c)
                  for c in cols]).first()
    out = df
    for c in cols:
        v = F.coalesce(F.col(c).cast("string"), F.lit(missing))
        if st[c] <= inline_limit:
            vocab = df.agg(F.array_sort(F.collect_set(v))).scalar()
            out = out.withColumn(f"_voc_{c}", vocab)
            out = out.withColumn(f"{c}{suffix}", (F.array_position(F.col(f"_voc_{c}"), v) - 1).cast("int"))
            out = out.drop(f"_voc_{c}")
        else:
            values = df.select(v.alias("_v")).distinct()
            codes = global_rank(values, [], ["_v"], out="_code")
            out = (out.withColumn("_v", v).join(codes, on="_v", how="left")
                   .withColumn(f"{c}{suffix}", F.col("_code").cast("int")).drop("_v", "_code"))
    return out


def top_values(df: DataFrame, column: str, k: int) -> list[str]:
    """The k most frequent non-null values (ties by value).  Collects exactly
    k values: they become column names / literals."""
    rows = (df.where(F.col(column).isNotNull()).groupBy(column).count()
            .orderBy(F.desc("count"), F.asc(column)).limit(k).collect())
    return [r[0] for r in rows]


def topk_category(df: DataFrame, column: str, k: int, out: str | None = None,
                  other: str = "other", values: Sequence[str] | None = None) -> DataFrame:
    """Keep the k most frequent values, everything else (and null) -> 'other'."""
    keep = list(values) if values is not None else top_values(df, column, k)
    c = F.col(column)
    return df.withColumn(out or column, F.when(c.isin(keep), c).otherwise(F.lit(other)))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """0/1 column ``<prefix>_<value>`` per value."""
    prefix = prefix or column
    c = F.col(column)
    return df.withColumns({f"{prefix}_{v}": (c == F.lit(v)).cast("int") for v in values})


def one_hot_topk_other(df: DataFrame, column: str = "city", k: int = 10, prefix: str | None = None,
                       values: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Top-k one-hot columns plus ``<prefix>_other`` (1 when the value is not
    in the top k; present only if such values exist).  Returns the frame and
    the new column names, in output order."""
    prefix = prefix or column
    keep = list(values) if values is not None else top_values(df, column, k)
    out = one_hot(df, column, keep, prefix)
    names = [f"{prefix}_{v}" for v in keep]
    has_other = df.where(~F.col(column).isin(keep) | F.col(column).isNull()).limit(1).count() > 0
    if has_other and f"{prefix}_other" not in names:
        out = out.withColumn(f"{prefix}_other", (~F.coalesce(F.col(column).isin(keep), F.lit(False))).cast("int"))
        names.append(f"{prefix}_other")
    return out, names


def encode_entities(e: DataFrame, top_cities: int = 20, city: str = "city") -> tuple[DataFrame, list[str]]:
    """Label-encode the two segments and one-hot the top cities ('other' for
    the rest), as the phase-4 table.  Returns (frame, city dummy names)."""
    out = label_encode(e, ["price_segment", "size_category"])
    keep = top_values(out, city, top_cities)
    out = topk_category(out, city, top_cities, out="_city_top", values=keep)
    present_vals = sorted(r[0] for r in out.select("_city_top").distinct().collect())
    out = one_hot(out, "_city_top", present_vals, prefix=city)
    return out.drop("_city_top"), [f"{city}_{v}" for v in present_vals]


def ratio_features(e: DataFrame, mode: str = "train") -> DataFrame:
    """price_to_dish_ratio, rating_count_per_dish, price_volatility.

    ``mode='train'`` divides by (dish_count + 1) and (avg_price + 1);
    ``mode='serve'`` by max(dish_count, 1) and max(avg_price, 1) with 2-dp
    rounding (the serving form)."""
    if mode == "train":
        return e.withColumns({
            "price_to_dish_ratio": F.col("avg_price") / (F.col("dish_count") + 1.0),
            "rating_count_per_dish": F.col("total_rating_count") / (F.col("dish_count") + 1.0),
            "price_volatility": F.col("price_std") / (F.col("avg_price") + 1.0),
        })
    from tavola.functions.exprs import rint_round
    return e.withColumns({
        "price_to_dish_ratio": rint_round(F.col("avg_price") / F.greatest(F.col("dish_count"), F.lit(1)), 2),
        "rating_count_per_dish": rint_round(F.col("total_rating_count") / F.greatest(F.col("dish_count"), F.lit(1)), 2),
        "price_volatility": rint_round(F.col("price_std") / F.greatest(F.col("avg_price"), F.lit(1.0)), 2),
    })


def high_variance_flag(e: DataFrame, column: str = "rating_std", out: str = "has_high_variance",
                       mode: str = "train", threshold: float = 0.5) -> DataFrame:
    """train: column > median(column) over all rows; serve: column > 0.5.
    null -> 0."""
    if mode == "train":
        med = quantiles(e, column, [0.5]).getItem(0)
        e2 = e.withColumn("_med", med)
        return e2.withColumn(out, F.coalesce((F.col(column) > F.col("_med")).cast("int"), F.lit(0))).drop("_med")
    return e.withColumn(out, F.coalesce((F.col(column) > F.lit(threshold)).cast("int"), F.lit(0)))


def impute_median(df: DataFrame, cols: Sequence[str], method: str = "auto") -> DataFrame:
    """null -> exact median of the column.  Columns within the checked
    distinct-value limit share one ``percentile`` aggregate; larger ones share
    the scans of ``column_quantiles``."""
    from tavola.functions.distributed_quantile import column_quantiles, number
    from tavola.functions.stats import exact_distinct_limit

    cols = present(df, cols)
    if not cols:
        return df
    # one small job: which columns have nulls, and how many distinct values
    st = df.agg(*[F.count_if(F.col(q(c)).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
                *[F.approx_count_distinct(F.col(q(c)), 0.05).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    limit = exact_distinct_limit(df)
    if method == "auto":
        methods = {c: ("exact" if st[f"d{i}"] <= limit else "distributed") for i, c in enumerate(cols)}
    else:
        methods = {c: method for c in cols}
    cols = [c for i, c in enumerate(cols) if st[f"n{i}"] > 0]  # nothing to fill elsewhere
    if not cols:
        return df
    wide = [c for c in cols if methods[c] == "distributed"]
    found = dict(zip(wide, column_quantiles(df, wide, [0.5]))) if wide else {}
    fields = []
    for i, c in enumerate(cols):
        if methods[c] == "distributed":
            fields.append(F.lit(found[c][0]).cast("double").alias(f"m{i}"))
        else:
            fields.append(F.percentile(number(F.col(q(c))), F.lit(0.5)).alias(f"m{i}"))
    med = df.agg(F.struct(*fields).alias("s")).scalar()
    out = df.withColumn("_med", med)
    out = out.withColumns({c: F.coalesce(F.col(q(c)), F.col(f"_med.m{i}").cast(dict(df.dtypes)[c]))
                           for i, c in enumerate(cols)})
    return out.drop("_med")


def impute_constant(df: DataFrame, cols: Sequence[str], value: float = 0) -> DataFrame:
    return df.na.fill(value, subset=present(df, cols))


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def model_matrix(enc: DataFrame, keys: Sequence[str], include_city: bool = False,
                 city_cols: Sequence[str] = (), targets: Sequence[str] = ("is_high_rated", "is_popular", "is_premium"),
                 ) -> tuple[DataFrame, list[str]]:
    """Key + ordered numeric/encoded feature columns (median-imputed) + targets.

    The default is the 14 numeric + 2 encoded columns; the city dummies join
    only with ``include_city=True`` (the reference's dtype filter drops them).
    """
    types = dict(enc.dtypes)
    feats = [c for c in list(MODEL_NUMERIC) + (list(city_cols) if include_city else []) + list(ENCODED)
             if c in types and types[c] in NUMERIC]
    m = enc.select(*keys, *feats, *present(enc, targets))
    return impute_median(m, feats), feats


def feature_set(df: DataFrame, task: str, keys: Sequence[str], city_cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Leakage-free columns of one task plus the city dummies, median-imputed."""
    feats = list(dict.fromkeys(list(TASK_FEATURES[task]) + list(city_cols)))
    m = df.select(*keys, *feats, F.col(TASK_TARGET[task]).alias("label"))
    return impute_median(m, feats), feats


def safe_features(e: DataFrame, keys: Sequence[str], k: int = 10, city: str = "city") -> tuple[DataFrame, list[str]]:
    """6 base + 3 derived features + one-hots of the top-k cities ('other'
    for the rest); target-derived scores excluded; median-imputed."""
    d = e.transform(ratio_features).transform(high_variance_flag)
    keep = top_values(d, city, k)
    d = topk_category(d, city, k, out="_city_safe", values=keep)
    vals = sorted(r[0] for r in d.select("_city_safe").distinct().collect())
    d = one_hot(d, "_city_safe", vals, prefix=city)
    feats = [f for f in dict.fromkeys(list(SAFE_BASE) + [f"{city}_{v}" for v in vals]) if f not in LEAKY_SCORES]
    m = d.select(*keys, *feats, *present(d, ("is_high_rated", "is_popular", "is_premium")))
    return impute_median(m, feats), feats


def standard_scale(train: DataFrame, df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std, both learned on ``train``; zero std -> 1."""
    st = train.agg(F.struct(*[F.avg(q(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                            *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).alias("s")).scalar()
    out = df.withColumn("_sc", st)
    out = out.withColumns({
        f"{c}{suffix}": (F.col(q(c)) - F.col(f"_sc.a{i}"))
        / F.when(F.coalesce(F.col(f"_sc.s{i}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"_sc.s{i}"))
        for i, c in enumerate(cols)})
    return out.drop("_sc")


def hash_order(keys: Sequence[str], seed: int) -> Column:
    """Engine-neutral pseudo-random order: md5 of the key and the seed."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys],
                             F.lit(str(seed))))


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], test_size: float = 0.2,
                     seed: int = 42, out: str = "is_test", by: Sequence[str] = ()) -> DataFrame:
    """Exact stratified split: within each class the round(test_size * n)
    rows first in md5(key|seed) order are test rows.

    The per-class position comes from ``global_rank`` (range partitioning),
    never from a window holding a whole class in one task.  Class sizes are a
    tiny aggregate (one row per class)."""
    strata = [*by, label]
    d = df.withColumn("_h", hash_order(keys, seed))
    ranked = global_rank(d, strata, ["_h", *keys], out="_r")
    # one row per stratum (tasks x classes): a proven-small broadcast side
    sizes = df.groupBy(*strata).agg(F.floor(F.count("*") * F.lit(test_size) + F.lit(0.5)).alias("_ntest"))
    return (ranked.join(F.broadcast(sizes), on=strata)
            .withColumn(out, (F.col("_r") < F.col("_ntest")).cast("int"))
            .drop("_h", "_r", "_ntest"))


def fold_ids(df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = 42,
             out: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """Stratified k folds: the class-local md5 position modulo k, so every
    fold holds floor/ceil(n_class / k) rows of each class (of each ``by`` group)."""
    d = df.withColumn("_h", hash_order(keys, seed))
    ranked = global_rank(d, [*by, label], ["_h", *keys], out="_r")
    return ranked.withColumn(out, (F.col("_r") % k).cast("int")).drop("_h", "_r")
