"""Registered queries: feature diagnostics over the model matrix."""

from __future__ import annotations

from tavola.operators import diagnose as D
from tavola.operators import features as FE
from tavola.operators.rollup import ENTITY_KEYS
from tavola.plans import queries_features  # noqa: F401  (registers the model_matrix CTE)
from tavola.plans import venue
from tavola.plans.catalog import register

K = list(ENTITY_KEYS)
MM = list(FE.MODEL_NUMERIC) + list(FE.ENCODED)
T = list(D.TARGETS)


def _mm(spark, sf):
    def build():
        m, _f = FE.model_matrix(venue.enhanced(spark, sf), K)
        return m
    return venue.stage(spark, sf, "model_matrix", build)


def _pairs_sql(cols):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c{i}" for i, (a, b) in enumerate(pairs))
    rows = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
                              f"CASE WHEN isnan(c{i}) THEN NULL ELSE c{i} END AS r FROM w"
                              for i, (a, b) in enumerate(pairs))
    return f"WITH w AS (SELECT {aggs} FROM model_matrix) SELECT * FROM ({rows})"


@register("top_correlated_pairs", _pairs_sql(MM).replace(
    "SELECT * FROM (", "SELECT * FROM (SELECT * FROM (", 1) + """) WHERE r IS NOT NULL AND r <> 1
ORDER BY abs(r) DESC, feature_a, feature_b LIMIT 10""", ("model_matrix",), dbl=("r",))
def q_top_correlated_pairs(spark, sf):
    return D.top_correlated_pairs(_mm(spark, sf), MM, 10)


@register("redundant_pairs", _pairs_sql(MM) + " WHERE abs(r) > 0.95", ("model_matrix",), dbl=("r",))
def q_redundant_pairs(spark, sf):
    return D.redundant_pairs(_mm(spark, sf), MM, 0.95)


_var_rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, var_samp(CAST({c} AS DOUBLE)) AS variance FROM model_matrix"
                               for c in MM)


@register("feature_variance", f"""
SELECT column_name, variance,
       CAST(row_number() OVER (ORDER BY variance DESC NULLS LAST, column_name) AS INTEGER) AS rank
FROM ({_var_rows})
""", ("model_matrix",), dbl=("variance",))
def q_feature_variance(spark, sf):
    return D.feature_variance(_mm(spark, sf), MM)


_cd_rows = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM model_matrix"
                              for c in MM)


@register("constant_columns", f"SELECT column_name, least(n_distinct, 2) AS n_distinct, n_distinct = 1 AS is_constant FROM ({_cd_rows})",
          ("model_matrix",))
def q_constant_columns(spark, sf):
    return D.constant_columns(_mm(spark, sf), MM)


def _leak_sql():
    sel = []
    for f in MM:
        rs = [f"CASE WHEN isnan(corr(CAST({f} AS DOUBLE), CAST({t} AS DOUBLE))) THEN NULL "
              f"ELSE corr(CAST({f} AS DOUBLE), CAST({t} AS DOUBLE)) END" for t in T]
        sel.append(f"SELECT '{f}' AS feature, " + ", ".join(f"{r} AS r_{t}" for r, t in zip(rs, T))
                   + " FROM model_matrix")
    body = " UNION ALL ".join(sel)
    return f"""
SELECT *, coalesce(greatest({", ".join(f"abs(r_{t})" for t in T)}) > 0.8, false) AS suspicious
FROM (SELECT *, greatest({", ".join(f"abs(r_{t})" for t in T)}) AS max_abs_r FROM ({body}))
"""


LEAK_DBL = tuple(f"r_{t}" for t in T) + ("max_abs_r",)


@register("leakage_by_correlation", _leak_sql(), ("model_matrix",), dbl=LEAK_DBL)
def q_leakage_by_correlation(spark, sf):
    return D.leakage_by_correlation(_mm(spark, sf), MM, T, 0.8)


def _mi_sql():
    probs = ", ".join(str(i / 10) for i in range(1, 10))
    cuts = ", ".join(f"quantile_cont(CAST({f} AS DOUBLE), [{probs}]) AS k_{f}" for f in MM)
    longs = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{t}' AS target, len(list_filter(k_{f}, lambda c: c < CAST({f} AS DOUBLE))) AS bin, "
        f"CAST({t} AS INTEGER) AS y FROM model_matrix, cuts WHERE {f} IS NOT NULL AND {t} IS NOT NULL"
        for f in MM for t in T)
    return f"""
WITH cuts AS (SELECT {cuts} FROM model_matrix),
j AS (SELECT feature, target, bin, y, count(*) AS n_by FROM ({longs}) GROUP BY ALL),
m AS (SELECT *, sum(n_by) OVER (PARTITION BY feature, target) AS n,
             sum(n_by) OVER (PARTITION BY feature, target, bin) AS n_b,
             sum(n_by) OVER (PARTITION BY feature, target, y) AS n_y FROM j),
mi AS (SELECT target, feature, sum((n_by / n) * ln((n_by * n) / (n_b * n_y))) AS mi FROM m GROUP BY target, feature)
SELECT *, rank <= 5 AND mi > 0.5 AS suspicious FROM (
  SELECT target, feature, mi, CAST(row_number() OVER (PARTITION BY target ORDER BY round_even(mi * 1e9, 0) DESC, feature) AS INTEGER) AS rank
  FROM mi)
"""


cte_mi = _mi_sql()


@register("mutual_information", cte_mi, ("model_matrix",), dbl=("mi",))
def q_mutual_information(spark, sf):
    return D.mutual_information(_mm(spark, sf), MM, T)


def _digamma(n):
    x = f"(CAST({n} AS DOUBLE) + 6)"
    return (f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8)"
            + "".join(f" - 1 / (CAST({n} AS DOUBLE) + {j})" for j in range(6)) + ")")


def _knn_sql(k=3):
    longs = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{t}' AS target, CAST({f} AS DOUBLE) + 0.0 AS x, CAST({t} AS INTEGER) AS y "
                               f"FROM model_matrix WHERE {f} IS NOT NULL AND {t} IS NOT NULL" for f in MM for t in T)
    sides = ", ".join(f"abs(x - {s}(x, {j}) OVER w)" for s in ("lag", "lead") for j in range(1, k + 1))
    return f"""
WITH pts AS ({longs}),
c AS (SELECT *, count(*) OVER (PARTITION BY feature, target, y) AS n_y, list_sort(list_filter([{sides}], lambda a: a IS NOT NULL)) AS dists
      FROM pts WINDOW w AS (PARTITION BY feature, target, y ORDER BY x)),
p AS (SELECT feature, target, y, x, n_y, least({k}, n_y - 1) AS k, dists[least({k}, n_y - 1)] AS d, count(*) AS n FROM c WHERE n_y > 1 GROUP BY ALL),
v AS (SELECT feature, target, x, sum(n) AS n FROM p GROUP BY ALL),
m AS (SELECT p.feature, p.target, p.n_y, p.k, p.n, sum(v.n) AS m
      FROM p JOIN v ON p.feature = v.feature AND p.target = v.target AND ((p.d = 0 AND v.x = p.x) OR (p.d > 0 AND v.x > p.x - p.d AND v.x < p.x + p.d))
      GROUP BY p.feature, p.target, p.y, p.x, p.n_y, p.k, p.n, p.d),
mi AS (SELECT target, feature, greatest({_digamma('sum(n)')} + sum(n * {_digamma('k')}) / sum(n) - sum(n * {_digamma('n_y')}) / sum(n)
              - sum(n * {_digamma('m')}) / sum(n), 0.0) AS mi FROM m GROUP BY target, feature)
SELECT *, rank <= 5 AND mi > 0.5 AS suspicious FROM (
  SELECT target, feature, mi, CAST(row_number() OVER (PARTITION BY target ORDER BY round_even(mi * 1e9, 0) DESC, feature) AS INTEGER) AS rank
  FROM mi)
"""


@register("mutual_information_knn", _knn_sql(), ("model_matrix",), dbl=("mi",))
def q_mutual_information_knn(spark, sf):
    return D.mutual_information_knn(_mm(spark, sf), MM, T)


@register("suspicious_features", f"""
WITH lk AS ({_leak_sql()}),
mi AS ({cte_mi})
SELECT DISTINCT feature, score, source FROM (
  SELECT feature, max_abs_r AS score, 'correlation' AS source FROM lk WHERE suspicious
  UNION ALL
  SELECT feature, mi AS score, 'mutual_information' AS source FROM mi WHERE suspicious)
""", ("model_matrix",), dbl=("score",))
def q_suspicious_features(spark, sf):
    m = _mm(spark, sf)
    return D.suspicious_features(D.leakage_by_correlation(m, MM, T, 0.8), D.mutual_information(m, MM, T))


def _cp_sql(target):
    rows = " UNION ALL ".join(
        f"SELECT '{target}' AS target, count(*) FILTER (WHERE {target} = 1) AS n_1, count(*) FILTER (WHERE {target} = 0) AS n_0, "
        f"'{f}' AS feature, avg(CAST({f} AS DOUBLE)) FILTER (WHERE {target} = 1) AS mean_1, "
        f"avg(CAST({f} AS DOUBLE)) FILTER (WHERE {target} = 0) AS mean_0 FROM model_matrix" for f in MM)
    return f"SELECT *, mean_1 - mean_0 AS difference FROM ({rows})"


@register("class_profile", " UNION ALL ".join(f"SELECT * FROM ({_cp_sql(t)})" for t in T), ("model_matrix",), dbl=("mean_1", "mean_0", "difference"))
def q_class_profile(spark, sf):
    out = None
    for t in T:
        d = D.class_profile(_mm(spark, sf), t, MM)
        out = d if out is None else out.unionByName(d)
    return out


_INTS = ("dish_count", "total_rating_count", "category_diversity", "price_segment_encoded",
         "size_category_encoded", "is_high_rated", "is_popular", "is_premium")


@register("find_binary_targets", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, least(count(DISTINCT {c}), 3) AS n_distinct, "
    f"count(*) FILTER (WHERE CAST({c} AS DOUBLE) = 1) AS positives, "
    f"CAST(count(*) FILTER (WHERE CAST({c} AS DOUBLE) = 1) AS DOUBLE) * 100 / count(*) AS pct_positive, "
    f"{'true' if 'is_' in c else 'false'} AS name_match FROM model_matrix) WHERE n_distinct = 2 OR name_match"
    for c in _INTS), ("model_matrix",), dbl=("pct_positive",))
def q_find_binary_targets(spark, sf):
    return D.find_binary_targets(_mm(spark, sf).drop(*K))


@register("feature_stats", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"avg(CAST({c} AS DOUBLE)) AS mean FROM model_matrix" for c in MM) + ") WHERE min < max",
    ("model_matrix",), dbl=("min", "max", "mean"))
def q_feature_stats(spark, sf):
    return D.feature_stats(_mm(spark, sf), T, MM)
