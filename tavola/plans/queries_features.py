"""Registered queries: feature engineering, encoding, imputation, scaling, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.operators import features as FE
from tavola.operators.rollup import ENTITY_KEYS
from tavola.plans import venue
from tavola.plans.catalog import register
from tavola.plans.oracle import cte

K = list(ENTITY_KEYS)
KS = ", ".join(K)

# --- oracle CTEs -----------------------------------------------------------
cte("features_base", """
SELECT *,
  CASE WHEN avg_price <= 0 THEN NULL WHEN avg_price <= 200 THEN 'budget' WHEN avg_price <= 400 THEN 'mid_range'
       WHEN avg_price <= 600 THEN 'premium' WHEN avg_price IS NOT NULL THEN 'luxury' END AS price_segment,
  CASE WHEN dish_count <= 0 THEN NULL WHEN dish_count <= 50 THEN 'small' WHEN dish_count <= 100 THEN 'medium'
       WHEN dish_count <= 200 THEN 'large' WHEN dish_count IS NOT NULL THEN 'very_large' END AS size_category,
  1.0 / (1.0 + coalesce(rating_std, 0)) AS rating_consistency,
  1.0 / (1.0 + coalesce(price_std, 0)) AS price_consistency,
  avg_rating / (avg_price + 1.0) AS value_score,
  total_rating_count / (dish_count + 1.0) AS popularity_density,
  CAST(coalesce(len(string_split(categories, ',')), 1) AS INTEGER) AS category_diversity,
  (avg_price / 100.0) * avg_rating AS premium_score
FROM entities
""", "entities")
cte("top20_city", """
SELECT city FROM entities GROUP BY city ORDER BY count(*) DESC, city LIMIT 20
""", "entities")
cte("top10_city", """
SELECT city FROM entities GROUP BY city ORDER BY count(*) DESC, city LIMIT 10
""", "entities")
cte("features_enc", """
SELECT *,
  CAST(dense_rank() OVER (ORDER BY coalesce(price_segment, 'nan')) - 1 AS INTEGER) AS price_segment_encoded,
  CAST(dense_rank() OVER (ORDER BY coalesce(size_category, 'nan')) - 1 AS INTEGER) AS size_category_encoded,
  CASE WHEN city IN (SELECT city FROM top20_city) THEN city ELSE 'other' END AS city_top
FROM features_base
""", "features_base", "top20_city")
cte("train_feats", """
SELECT *,
  avg_price / (dish_count + 1.0) AS price_to_dish_ratio,
  total_rating_count / (dish_count + 1.0) AS rating_count_per_dish,
  price_std / (avg_price + 1.0) AS price_volatility,
  coalesce(CAST(rating_std > (SELECT quantile_cont(rating_std, 0.5) FROM features_enc) AS INTEGER), 0) AS has_high_variance
FROM features_enc
""", "features_enc")

FEAT_DBL = ("rating_consistency", "price_consistency", "value_score", "popularity_density", "premium_score")


def _enhanced(spark, sf):
    return venue.enhanced(spark, sf)


@register("entity_features", f"""
SELECT {KS}, price_segment, size_category, rating_consistency, price_consistency, value_score,
       popularity_density, category_diversity, premium_score, price_segment_encoded, size_category_encoded
FROM features_enc
""", ("features_enc",), dbl=FEAT_DBL)
def q_entity_features(spark, sf):
    cols = ["price_segment", "size_category", *FEAT_DBL[:4], "category_diversity", "premium_score",
            "price_segment_encoded", "size_category_encoded"]
    return _enhanced(spark, sf).select(*K, *cols)


@register("label_encode", f"""
SELECT {KS}, price_segment_encoded, size_category_encoded FROM features_enc
""", ("features_enc",))
def q_label_encode(spark, sf):
    e = FE.enhance_entities(venue.entities(spark, sf))
    return FE.label_encode(e, ["price_segment", "size_category"]).select(
        *K, "price_segment_encoded", "size_category_encoded")


@register("topk_category", f"SELECT {KS}, city_top FROM features_enc", ("features_enc",))
def q_topk_category(spark, sf):
    return FE.topk_category(venue.entities(spark, sf), "city", 20, out="city_top").select(*K, "city_top")


@register("one_hot_city", f"""
SELECT {KS}, 'city_' || v AS column_name, CAST(city_top = v AS INTEGER) AS value
FROM features_enc, (SELECT DISTINCT city_top AS v FROM features_enc)
""", ("features_enc",))
def q_one_hot_city(spark, sf):
    d = _enhanced(spark, sf)
    cols = venue.city_columns(d)
    return d.select(*K, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value"))
                                            for c in cols])))


@register("one_hot_topk_other", f"""
SELECT {KS}, 'city_' || v AS column_name, CAST(city = v AS INTEGER) AS value
FROM entities, top10_city AS t(v)
UNION ALL
SELECT {KS}, 'city_other', CAST(city NOT IN (SELECT city FROM top10_city) AS INTEGER) FROM entities
""", ("entities", "top10_city"))
def q_one_hot_topk_other(spark, sf):
    d, names = FE.one_hot_topk_other(venue.entities(spark, sf), "city", 10)
    return d.select(*K, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value"))
                                            for c in names])))


@register("ratio_features", f"""
SELECT {KS}, price_to_dish_ratio, rating_count_per_dish, price_volatility, has_high_variance FROM train_feats
""", ("train_feats",), dbl=("price_to_dish_ratio", "rating_count_per_dish", "price_volatility"))
def q_ratio_features(spark, sf):
    d = FE.high_variance_flag(FE.ratio_features(_enhanced(spark, sf)))
    return d.select(*K, "price_to_dish_ratio", "rating_count_per_dish", "price_volatility", "has_high_variance")


@register("high_variance_flag", f"SELECT {KS}, has_high_variance FROM train_feats", ("train_feats",))
def q_high_variance_flag(spark, sf):
    return FE.high_variance_flag(venue.entities(spark, sf)).select(*K, "has_high_variance")


@register("impute_median", f"""
SELECT {KS}, coalesce(price_std, (SELECT quantile_cont(price_std, 0.5) FROM entities)) AS price_std,
       coalesce(rating_std, (SELECT quantile_cont(rating_std, 0.5) FROM entities)) AS rating_std
FROM entities
""", ("entities",), dbl=("price_std", "rating_std"))
def q_impute_median(spark, sf):
    return FE.impute_median(venue.entities(spark, sf).select(*K, "price_std", "rating_std"),
                            ["price_std", "rating_std"])


@register("impute_constant", f"""
SELECT {KS}, coalesce(price_std, 0) AS price_std, coalesce(rating_std, 0) AS rating_std FROM entities
""", ("entities",), dbl=("price_std", "rating_std"))
def q_impute_constant(spark, sf):
    return FE.impute_constant(venue.entities(spark, sf).select(*K, "price_std", "rating_std"),
                              ["price_std", "rating_std"], 0)


MM = list(FE.MODEL_NUMERIC) + list(FE.ENCODED)
_INT_MM = {"dish_count": "BIGINT", "total_rating_count": "BIGINT", "category_diversity": "INTEGER",
           "price_segment_encoded": "INTEGER", "size_category_encoded": "INTEGER",
           "has_high_variance": "INTEGER"}


def _imputed(src, cols):
    out = []
    for c in cols:
        med = f"(SELECT quantile_cont({c}, 0.5) FROM {src})"
        t = _INT_MM.get(c)
        out.append(f"coalesce({c}, CAST({med} AS {t})) AS {c}" if t else f"coalesce({c}, {med}) AS {c}")
    return ", ".join(out)


cte("model_matrix", f"""
SELECT {KS}, {_imputed('features_enc', MM)}, is_high_rated, is_popular, is_premium FROM features_enc
""", "features_enc")

MM_DBL = tuple(c for c in MM if c not in _INT_MM)


@register("model_matrix", "SELECT * FROM model_matrix", ("model_matrix",), dbl=MM_DBL)
def q_model_matrix(spark, sf):
    m, _f = FE.model_matrix(_enhanced(spark, sf), K)
    return m


def _fs_sql(task):
    cols = list(FE.TASK_FEATURES[task])
    return f"SELECT {KS}, {_imputed('train_feats', cols)}, {FE.TASK_TARGET[task]} AS label FROM train_feats"


def _fs_dbl(task):
    return tuple(c for c in FE.TASK_FEATURES[task] if c not in _INT_MM and c != "has_high_variance")


def _fs_query(task):
    def run(spark, sf):
        d = FE.high_variance_flag(FE.ratio_features(_enhanced(spark, sf)))
        # City dummies are checked by one_hot_topk_other; the imputed task
        # columns and label are compared here.
        m, feats = FE.feature_set(d, task, K, [])
        return m
    return run


for _t in FE.TASK_FEATURES:
    register(f"feature_set_{_t}", _fs_sql(_t), ("train_feats",), dbl=_fs_dbl(_t))(_fs_query(_t))

SAFE = list(FE.SAFE_BASE)


@register("safe_features", f"""
SELECT {KS}, {_imputed('train_feats', SAFE)}, is_high_rated, is_popular, is_premium FROM train_feats
""", ("train_feats",), dbl=tuple(c for c in SAFE if c not in _INT_MM and c != "has_high_variance"))
def q_safe_features(spark, sf):
    m, feats = FE.safe_features(_enhanced(spark, sf).drop(*venue.city_columns(_enhanced(spark, sf))), K)
    return m.drop(*[f for f in feats if f.startswith("city_")])


@register("feature_sets_city", f"""
WITH s AS (SELECT * FROM (VALUES ('high_rated'), ('popular'), ('premium'), ('safe')) AS t(feature_set))
SELECT {KS}, feature_set, 'city_' || v AS column_name, CAST(city = v AS INTEGER) AS value FROM entities, top10_city AS t(v), s
UNION ALL
SELECT {KS}, feature_set, 'city_other', CAST(city NOT IN (SELECT city FROM top10_city) AS INTEGER) FROM entities, s
WHERE (SELECT count(DISTINCT city) FROM entities) > 10
""", ("entities", "top10_city"))
def q_feature_sets_city(spark, sf):
    """The city columns of every task's feature set and of the safe features."""
    e = _enhanced(spark, sf)
    e = e.drop(*venue.city_columns(e))
    d, names = FE.one_hot_topk_other(FE.high_variance_flag(FE.ratio_features(e)), "city", 10)
    found = [(t, *FE.feature_set(d, t, K, names)) for t in FE.TASK_FEATURES] + [("safe", *FE.safe_features(e, K))]
    out = None
    for name, m, feats in found:
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("int").alias("value")) for c in feats if c.startswith("city_")]
        part = m.select(*K, F.lit(name).alias("feature_set"), F.inline(F.array(*cells)))
        out = part if out is None else out.unionByName(part)
    return out


_SPLIT = """
SELECT {keys}, label,
       CAST(row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', {hk}, '42')), {keys}) - 1
            < floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS INTEGER) AS is_test
FROM (SELECT {keys}, is_high_rated AS label FROM entities)
"""
_HK = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in K)


@register("stratified_split", _SPLIT.format(keys=KS, hk=_HK), ("entities",))
def q_stratified_split(spark, sf):
    e = venue.entities(spark, sf).select(*K, F.col("is_high_rated").alias("label"))
    return FE.stratified_split(e, "label", K, 0.2, 42)


@register("fold_ids", f"""
SELECT {KS}, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', {_HK}, '42')), {KS}) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT {KS}, is_popular AS label FROM entities)
""", ("entities",))
def q_fold_ids(spark, sf):
    e = venue.entities(spark, sf).select(*K, F.col("is_popular").alias("label"))
    return FE.fold_ids(e, "label", K, 5, 42)


_HR = list(FE.TASK_FEATURES["high_rated"])


@register("standard_scale", f"""
WITH fs AS ({_fs_sql('high_rated')}),
sp AS (SELECT fs.*, CAST(row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', {_HK}, '42')), {KS}) - 1
                       < floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS INTEGER) AS is_test FROM fs),
st AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _HR)} FROM sp WHERE is_test = 0)
SELECT {KS}, is_test, {", ".join(f"({c} - a_{c}) / CASE WHEN coalesce(s_{c}, 0) = 0 THEN 1 ELSE s_{c} END AS {c}" for c in _HR)}
FROM sp, st
""", ("train_feats",), dbl=tuple(_HR))
def q_standard_scale(spark, sf):
    m = _fs_query("high_rated")(spark, sf)
    sp = FE.stratified_split(m, "label", K, 0.2, 42)
    scaled = FE.standard_scale(sp.where(F.col("is_test") == 0), sp, _HR)
    return scaled.select(*K, "is_test", *[F.col(c).cast("double").alias(c) for c in _HR])
