"""Registered queries: serving features, vectors, rules, tiers, insights,
what-if scenarios over the request table derived from the entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.operators import score as S
from tavola.operators.features import TASK_FEATURES, one_hot_topk_other
from tavola.operators.rollup import ENTITY_KEYS
from tavola.plans import queries_eval  # noqa: F401  (registers requests / rule_scores CTEs)
from tavola.plans import venue
from tavola.plans.catalog import register

K = list(ENTITY_KEYS)
KS = ", ".join(K)


def _req(spark, sf):
    return venue.requests(spark, sf)


@register("derive_serving_features", f"""
SELECT {KS},
  round_even(round(avg_price / greatest(dish_count, 1), 9) * 100, 0) / 100 AS price_to_dish_ratio,
  round_even(round(total_rating_count / greatest(dish_count, 1), 9) * 100, 0) / 100 AS rating_count_per_dish,
  coalesce(CAST(rating_std > 0.5 AS INTEGER), 0) AS has_high_variance,
  round_even(round(price_std / greatest(avg_price, 1.0), 9) * 100, 0) / 100 AS price_volatility
FROM requests
""", ("requests",), dbl=("price_to_dish_ratio", "rating_count_per_dish", "price_volatility"))
def q_derive_serving_features(spark, sf):
    return S.derive_serving_features(_req(spark, sf)).select(
        *K, "price_to_dish_ratio", "rating_count_per_dish", "has_high_variance", "price_volatility")


_CITY_NORM = """CASE WHEN coalesce(m, lower(trim(city))) IN ('ahmedabad', 'bengaluru', 'chandigarh', 'chennai', 'hyderabad',
  'jaipur', 'kolkata', 'lucknow', 'mumbai', 'new delhi') THEN coalesce(m, lower(trim(city))) ELSE 'other' END"""
_ALIAS = """(CASE lower(trim(city)) WHEN 'bangalore' THEN 'bengaluru' WHEN 'delhi' THEN 'new delhi' END)"""


@register("normalize_city", f"""
SELECT {KS}, {_CITY_NORM.replace('m,', _ALIAS + ',')} AS city_normalized FROM requests
""", ("requests",))
def q_normalize_city(spark, sf):
    return _req(spark, sf).select(*K, S.normalize_city(F.col("city")).alias("city_normalized"))


@register("rule_scores", "SELECT * FROM rule_scores", ("rule_scores",), dbl=("probability",))
def q_rule_scores(spark, sf):
    return S.rule_scores(_req(spark, sf), K)


@register("confidence_tier", f"""
SELECT {KS}, task, probability,
  CASE WHEN probability >= CASE WHEN task = 'popular' THEN 0.9 ELSE 0.8 END THEN 'high'
       WHEN probability >= CASE WHEN task = 'popular' THEN 0.7 ELSE 0.6 END THEN 'medium' ELSE 'low' END AS tier
FROM rule_scores
""", ("rule_scores",), dbl=("probability",))
def q_confidence_tier(spark, sf):
    r = S.rule_scores(_req(spark, sf), K)
    return r.select(*K, "task", "probability", S.confidence_tier(F.col("probability"), F.col("task")).alias("tier"))


_INS = [("rating", "avg_rating >= CAST(4.2 AS DOUBLE)"), ("popularity", "total_rating_count >= 100"),
        ("price", "avg_price > 400"), ("consistency", "rating_std < 0.5"), ("menu", "dish_count > 50")]


@register("rule_insights", "\nUNION ALL\n".join(
    f"SELECT {KS}, '{a}' AS aspect, coalesce({c}, false) AS positive, "
    f"CASE WHEN coalesce({c}, false) THEN '{pos}' ELSE '{neg}' END AS insight FROM requests"
    for (a, c), (_a, pos, neg) in zip(_INS, S.INSIGHTS)), ("requests",))
def q_rule_insights(spark, sf):
    return S.rule_insights(_req(spark, sf), K)


@register("recommendation", f"""
SELECT {KS}, CASE WHEN avg_rating < 4.2 AND total_rating_count < 100 THEN '{S.RECOMMENDATIONS[0]}'
                  WHEN avg_rating >= 4.2 AND total_rating_count < 100 THEN '{S.RECOMMENDATIONS[1]}'
                  WHEN avg_price > 500 THEN '{S.RECOMMENDATIONS[2]}' ELSE '{S.RECOMMENDATIONS[3]}' END AS recommendation
FROM requests
""", ("requests",))
def q_recommendation(spark, sf):
    return S.recommendation(_req(spark, sf)).select(*K, "recommendation")


_NM = S.NORMALIZED
_mx = f"greatest({', '.join(f'CAST({c} AS DOUBLE)' for c in _NM)})"


@register("normalized_metrics", "\nUNION ALL\n".join(
    f"SELECT {KS}, '{c}' AS metric, CAST({c} AS DOUBLE) AS value, "
    f"CAST({c} AS DOUBLE) / (CASE WHEN {_mx} > 0 THEN {_mx} ELSE 1.0 END) * 100.0 AS normalized FROM requests"
    for c in _NM), ("requests",), dbl=("value", "normalized"))
def q_normalized_metrics(spark, sf):
    return S.normalized_metrics(_req(spark, sf), K)


def _vec_sql(layout):
    spec = S.VECTOR_LAYOUTS[layout]
    slots = ["0.0"] * S.VECTOR_SIZE
    for f, i in spec["numeric"].items():
        slots[i] = f"coalesce(CAST({f} AS DOUBLE), 0.0)"
    if spec["city_mode"] == "normalize":
        key = _CITY_NORM.replace("m,", _ALIAS + ",").replace("coalesce(city", "coalesce(city")
    elif spec["city_mode"] == "lower":
        key = "lower(coalesce(city, 'other'))"
    else:
        key = "coalesce(city, 'other')"
    named = ", ".join(f"'{v}'" for v in spec["city"] if v != "other")
    key = f"(CASE WHEN {key} IN ({named}) THEN {key} ELSE 'other' END)"
    for v, i in spec["city"].items():
        slots[i] = f"CAST({key} = '{v}' AS DOUBLE)"
    if spec["consistency"] is not None:
        slots[spec["consistency"]] = "CASE WHEN coalesce(rating_std, 1.0) < 0.3 THEN 1.0 ELSE 0.0 END"
    if spec["price_tier"] is not None:
        slots[spec["price_tier"]] = ("CASE WHEN coalesce(avg_price, 0.0) > 500 THEN 2.0 "
                                     "WHEN coalesce(avg_price, 0.0) > 300 THEN 1.0 ELSE 0.0 END")
    if spec["count"] is not None:
        slots[spec["count"]] = "least(CAST(coalesce(total_rating_count, 0) AS DOUBLE) / 1000, 1.0)"
    return "\nUNION ALL\n".join(f"SELECT {KS}, '{layout}' AS layout, {i} AS slot, CAST({e} AS DOUBLE) AS value "
                                f"FROM requests" for i, e in enumerate(slots))


@register("assemble_vector30", "\nUNION ALL\n".join(_vec_sql(l) for l in S.VECTOR_LAYOUTS), ("requests",),
          dbl=("value",))
def q_assemble_vector30(spark, sf):
    req = _req(spark, sf)
    out = None
    for layout in S.VECTOR_LAYOUTS:
        v = S.assemble_vector30(req, layout).select(*K, F.lit(layout).alias("layout"),
                                                    F.posexplode("features").alias("slot", "value"))
        out = v if out is None else out.unionByName(v)
    return out


def _meta_sql():
    parts = []
    for task, feats in TASK_FEATURES.items():
        for i, f in enumerate(feats):
            parts.append(f"SELECT {KS}, '{task}' AS task, {i} AS position, '{f}' AS feature, "
                         f"coalesce(CAST({f} AS DOUBLE), 0.0) AS value FROM requests")
        n = len(feats)
        parts.append(f"""SELECT {KS}, '{task}', {n} + r, 'city_' || v, CAST(city = v AS DOUBLE)
FROM requests, (SELECT city AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, city) - 1 AS INTEGER) AS r
                FROM entities GROUP BY city ORDER BY count(*) DESC, city LIMIT 10)""")
        parts.append(f"SELECT {KS}, '{task}', {n + 10}, 'city_other', CAST(city = 'other' AS DOUBLE) FROM requests")
    return "\nUNION ALL\n".join(parts)


@register("assemble_by_metadata", _meta_sql(), ("requests", "entities"), dbl=("value",))
def q_assemble_by_metadata(spark, sf):
    req = _req(spark, sf)
    _d, city_names = one_hot_topk_other(venue.entities(spark, sf), "city", 10)
    out = None
    for task, feats in TASK_FEATURES.items():
        names = list(feats) + city_names
        v = S.assemble_by_metadata(req, names).select(*K, F.lit(task).alias("task"),
                                                      F.posexplode("features").alias("position", "value"))
        lab = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1)
        v = v.select(*K, "task", F.col("position").cast("int").alias("position"), lab.alias("feature"), "value")
        out = v if out is None else out.unionByName(v)
    return out


# The what-if combinations of the reference's scenario search.
SCENARIOS = (
    {"avg_rating": 4.9, "median_rating": 5.0, "rating_std": 0.05, "total_rating_count": 5000, "avg_price": 1000},
    {"avg_rating": 4.5, "median_rating": 4.6, "rating_std": 0.2, "total_rating_count": 20000, "avg_price": 500},
    {"avg_rating": 4.7, "median_rating": 4.8, "rating_std": 0.1, "total_rating_count": 3000, "avg_price": 3000},
    {"avg_rating": 5.0, "median_rating": 5.0, "rating_std": 0.01, "total_rating_count": 50000, "avg_price": 5000},
)


def _scen_sql():
    vals = ", ".join("(" + ", ".join([str(i)] + [f"CAST({c[f]} AS DOUBLE)" for f in sorted(c)]) + ")"
                     for i, c in enumerate(SCENARIOS))
    cols = ", ".join(["scenario"] + [f"o_{f}" for f in sorted(SCENARIOS[0])])
    rs = queries_eval._rule_sql("g").replace(f"SELECT {KS},", f"SELECT {KS}, scenario,")
    return f"""
WITH g AS (SELECT {KS}, scenario, o_avg_rating AS avg_rating, o_median_rating AS median_rating,
                  o_rating_std AS rating_std, o_total_rating_count AS total_rating_count, o_avg_price AS avg_price
           FROM requests, (VALUES {vals}) AS c({cols}))
{rs}
"""


@register("score_scenarios", _scen_sql(), ("requests",), dbl=("probability",))
def q_score_scenarios(spark, sf):
    return S.score_scenarios(_req(spark, sf), list(SCENARIOS), K)
