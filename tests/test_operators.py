"""Unit tests on tiny literal frames: edge cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tavola.functions.distributed_quantile import exact_quantiles
from tavola.functions.windows import global_rank, top_n_per_group
from tavola.operators import clean as C
from tavola.operators import evaluate as EV
from tavola.operators import features as FE
from tavola.operators import monitor as M
from tavola.operators import rollup as R
from tavola.operators import score as S


def test_clean_text_unicode_blanks_and_tokens(spark):
    df = spark.createDataFrame([("  Foo   Bar \t",), ("NaN",), (" None ",), (None,), ("a  b",)], "t string")
    out = [r[0] for r in C.clean_text(df, ["t"]).collect()]
    assert out == ["foo bar", None, None, None, "a b"]


def test_dedupe_runs_before_text_cleaning(spark):
    rows = [("A", 1.0), ("a ", 1.0), ("A", 1.0)]
    df = spark.createDataFrame(rows, "city string, price double")
    out = C.clean_text(C.drop_exact_duplicates(df), ["city"])
    assert out.count() == 2  # 'A' and 'a ' survive de-duplication, then both read 'a'


def test_cap_outliers_keeps_nulls_and_clips(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "price double")
    out = [r[0] for r in C.cap_outliers_iqr(df, "price").collect()]
    q1, q3 = np.percentile([1, 2, 3, 4, 100], [25, 75])
    hi = q3 + 1.5 * (q3 - q1)
    assert out[:4] == [1.0, 2.0, 3.0, 4.0] and out[4] == pytest.approx(hi) and out[5] is None


def test_rollup_drops_null_keys_and_one_row_std_is_null(spark):
    rows = [("r1", "c", "l", "x", "d1", 10.0, 4.0, 5), ("r1", "c", "l", None, "d2", 20.0, 5.0, None),
            (None, "c", "l", "x", "d3", 30.0, 3.0, 1), ("r2", "c", "l", "y", "d4", 40.0, None, None)]
    df = spark.createDataFrame(rows, "restaurant_name string, city string, location string, category string, "
                                     "dish_name string, price double, rating double, rating_count int")
    e = {r["restaurant_name"]: r for r in R.rollup_entities(df).collect()}
    assert set(e) == {"r1", "r2"}
    assert e["r1"]["categories"] == "unknown, x" and e["r1"]["avg_price"] == 15.0
    assert e["r2"]["price_std"] is None and e["r2"]["total_rating_count"] == 0 and e["r2"]["avg_rating"] is None


def test_labels_null_is_zero(spark):
    df = spark.createDataFrame([(None, 5, 1.0), (4.2, 100, 2.0)], "avg_rating double, total_rating_count long, avg_price double")
    out = R.label_premium(R.label_popular(R.label_high_rated(df))).collect()
    assert [(r.is_high_rated, r.is_popular) for r in out] == [(0, 0), (1, 1)]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v, int(v)) for v in (0.0, 200.0, 200.01, 400.0, 600.0, 600.5)],
                               "avg_price double, dish_count long")
    seg = [r.price_segment for r in FE.price_segment(df).collect()]
    assert seg == [None, "budget", "mid_range", "mid_range", "premium", "luxury"]
    size = [r.size_category for r in FE.size_category(df).collect()]
    assert size == [None, "large", "large", "very_large", "very_large", "very_large"]


def test_stratified_split_exact_counts(spark):
    rows = [(f"k{i}", i % 3 == 0) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, y boolean").withColumn("y", F.col("y").cast("int"))
    sp = FE.stratified_split(df, "y", ["k"], 0.2, 42).collect()
    for cls in (0, 1):
        n = sum(1 for r in sp if r.y == cls)
        t = sum(1 for r in sp if r.y == cls and r.is_test == 1)
        assert t == int(np.floor(n * 0.2 + 0.5))
    assert len({r.k for r in sp}) == 101


def test_global_rank_equals_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"),
                                    "id")
    a = {(r.g, r.id): r.rank0 for r in global_rank(df, ["g"], ["h", "id"], num_partitions=7).collect()}
    w = Window.partitionBy("g").orderBy("h", "id")
    b = {(r.g, r.id): r.rn - 1 for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert a == b


def test_top_n_per_group_matches_brute_force(spark):
    df = spark.range(0, 2000).select((F.col("id") % 4).alias("g"), ((F.col("id") * 7919) % 101).alias("v"), "id")
    got = {(r.g, r.id) for r in top_n_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 5, salt_buckets=9).collect()}
    rows = df.collect()
    want = set()
    for g in range(4):
        best = sorted([r for r in rows if r.g == g], key=lambda r: (-r.v, r.id))[:5]
        want |= {(r.g, r.id) for r in best}
    assert got == want


@pytest.mark.parametrize("probs", [[0.25, 0.75], [0.0, 0.5, 1.0], [0.8, 0.95]])
def test_exact_quantiles_match_numpy(spark, probs):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.lognormal(3, 2, 3000), np.full(1500, 7.0), [1e9, -5.0]])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    got = exact_quantiles(df, "x", probs, splitters=5, final_rows=50)
    assert got == pytest.approx(list(np.percentile(vals, [p * 100 for p in probs])), rel=1e-12)


def test_roc_auc_equals_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.linalg import Vectors
    rows = [(int(i % 3 == 0), round((i * 37 % 71) / 100 + (0.25 if i % 3 == 0 else 0), 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, p double")
    ours = EV.roc_auc(df).first()[0]
    vec = spark.createDataFrame([(float(y), Vectors.dense([1 - p, p])) for y, p in rows], ["label", "rawPrediction"])
    ref = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(vec)
    assert ours == pytest.approx(ref, abs=1e-12)


def test_one_hot_rows_sum_to_one(spark):
    df = spark.createDataFrame([(c,) for c in "aabbbccd"], "city string")
    out, names = FE.one_hot_topk_other(df, "city", 2)
    sums = [sum(r[n] for n in names) for r in out.collect()]
    assert set(sums) == {1} and names[-1] == "city_other"


def test_empty_window_is_idle(spark):
    log = spark.createDataFrame([("2024-01-01 00:00:00", "m", 0.5, True)],
                                "ts string, model string, response_time double, success boolean") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    m = M.log_metrics(log, (1,), as_of="2024-01-02 00:00:00")
    assert M.system_health(m).first().status == "idle"
    assert M.alerts(m).count() == 0


def test_rule_scores_tiers(spark):
    df = spark.createDataFrame([("k", 4.5, 900, 450.0)], "k string, avg_rating double, total_rating_count long, avg_price double")
    r = {x.task: x for x in S.rule_scores(df, ["k"]).collect()}
    assert r["high_rated"].confidence == "high" and r["popular"].confidence == "high"
    assert r["premium"].prediction == 1 and r["premium"].confidence == "low"


def test_vector_layout_sizes(spark):
    df = spark.createDataFrame([(450.0, 85, 1200, 0.3, "Delhi")],
                               "avg_price double, dish_count int, total_rating_count int, rating_std double, city string")
    for layout in S.VECTOR_LAYOUTS:
        v = S.assemble_vector30(df, layout).first().features
        assert len(v) == 30 and sum(v[i] for i in S.VECTOR_LAYOUTS[layout]["city"].values()) == 1.0
    v = S.assemble_vector30(df, "correct").first().features
    assert v[18] == 1.0 and v[21] == 1.0 and v[22] == 1.0


def test_prefix_sums_match_window(spark):
    from pyspark.sql import Window
    from tavola.functions.windows import prefix_sums
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 3001).alias("s"),
                                     (F.col("id") % 5).alias("v"))
    got = {(r.g, r.s): r.cum_v for r in prefix_sums(df, ["g"], "s", ["v"], num_partitions=6).collect()}
    w = Window.partitionBy("g").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.g, r.s): r.c for r in df.withColumn("c", F.sum("v").over(w)).collect()}
    assert got == want


def test_roc_auc_large_path_equals_window_path(spark):
    import tavola.operators.evaluate as ev
    rows = [(int(i % 3 == 0), ((i * 7919) % 1000) / 1000.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "y int, p double")
    a = ev.roc_auc(df).first()[0]
    old = ev.WINDOW_ROWS_LIMIT
    ev.WINDOW_ROWS_LIMIT = 10
    try:
        b = ev.roc_auc(df).first()[0]
        c = ev.pr_auc(df).first()[0]
    finally:
        ev.WINDOW_ROWS_LIMIT = old
    assert a == pytest.approx(b, abs=1e-12)
    assert c == pytest.approx(ev.pr_auc(df).first()[0], abs=1e-12)


def test_exact_group_quantiles_match_numpy(spark):
    from tavola.functions.distributed_quantile import exact_group_quantiles
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.lognormal(2, 1.5, 4000)] + [("cold", float(v)) for v in rng.normal(0, 1, 300)] \
        + [(None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"],): r["q"] for r in exact_group_quantiles(df, ["g"], "x", [0.25, 0.5, 0.95]).collect()}
    for g in ("hot", "cold", None):
        vals = [v for k, v in rows if k == g]
        assert got[(g,)] == pytest.approx(list(np.percentile(vals, [25, 50, 95])), rel=1e-12)


def test_hot_entity_holding_a_third_of_rows(spark):
    """One entity with a third of all items: roll-up, per-class ranks and
    top-n stay exact (the helpers never need a whole group in one task)."""
    rows = []
    for i in range(3000):
        name = "hot" if i % 3 == 0 else f"r{i % 97}"
        rows.append((name, "c", "l", f"cat{i % 5}", f"d{i}", float(i % 50), 3.0 + (i % 20) / 10, i % 7))
    df = spark.createDataFrame(rows, "restaurant_name string, city string, location string, category string, "
                                     "dish_name string, price double, rating double, rating_count int")
    e = {r.restaurant_name: r for r in R.rollup_entities(df).collect()}
    hot = [r for r in rows if r[0] == "hot"]
    assert e["hot"].dish_count == len(hot) == 1000
    assert e["hot"].median_rating == pytest.approx(float(np.median([r[6] for r in hot])))
    lab = df.select("dish_name", (F.col("restaurant_name") == "hot").cast("int").alias("y"))
    sp = FE.stratified_split(lab, "y", ["dish_name"], 0.2, 42).groupBy("y").agg(F.sum("is_test").alias("t")).collect()
    assert {r.y: r.t for r in sp} == {1: 200, 0: 400}


def test_correlation_matrix_chunked_equals_single_pass(spark):
    from tavola.operators.profile import correlation_matrix
    df = spark.range(0, 200).select(*[((F.col("id") * (k + 3)) % (17 + k)).cast("double").alias(f"x{k}")
                                      for k in range(7)])
    cols = [f"x{k}" for k in range(7)]
    one = {(r.feature_a, r.feature_b): r.r for r in correlation_matrix(df, cols).collect()}
    many = {(r.feature_a, r.feature_b): r.r for r in correlation_matrix(df, cols, pairs_per_pass=4).collect()}
    assert one.keys() == many.keys() and len(one) == 21
    assert all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_label_encode_large_vocabulary_path_equals_inline(spark):
    df = spark.createDataFrame([(f"v{i % 37:03d}" if i % 11 else None,) for i in range(400)], "c string")
    small = {(r.c, r.c_encoded) for r in FE.label_encode(df, ["c"]).collect()}
    large = {(r.c, r.c_encoded) for r in FE.label_encode(df, ["c"], inline_limit=5).collect()}
    assert small == large
    assert dict(small)[None] == sorted({r[0] or "nan" for r in df.collect()}).index("nan")


def test_exact_group_medians_match_numpy(spark):
    from tavola.functions.distributed_quantile import exact_group_medians
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(5, 2, 3001)] + [(f"g{i % 40}", float(rng.integers(0, 9)))
                                                                   for i in range(800)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.median for r in exact_group_medians(df, ["g"], "x").collect()}
    for g in set(k for k, _ in rows):
        assert got[g] == pytest.approx(float(np.median([v for k, v in rows if k == g])), rel=1e-12)


def test_exact_quantiles_with_infinity_nan_and_one_value(spark):
    inf = float("inf")
    vals = [inf, -inf] + [float(i % 977) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals] + [(float("nan"),), (None,)], "x double")
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], splitters=4, final_rows=20)
    assert got == [-inf, *np.percentile(vals[2:] + [-inf, inf], [25, 50]).tolist(), inf]
    one = spark.createDataFrame([(3.5,)] * 400, "x double")
    assert exact_quantiles(one, "x", [0.1, 0.9], final_rows=10) == [3.5, 3.5]
    assert exact_quantiles(one.limit(0), "x", [0.5]) == [None]
    from tavola.functions.stats import quantiles
    both = [df.select(quantiles(df, "x", [0.5], method=m).getItem(0).alias("m")).first()["m"] for m in ("exact", "distributed")]
    assert both[0] == both[1]


def test_group_quantiles_of_many_groups(spark):
    from tavola.functions.distributed_quantile import exact_group_medians
    df = spark.range(36000).selectExpr("id % 12000 as g", "case when id % 7 = 0 then double('Infinity') else double(id) end as x")
    got = {r.g: r.median for r in exact_group_medians(df, ["g"], "x").collect()}
    want = {}
    for i in range(36000):
        want.setdefault(i % 12000, []).append(float("inf") if i % 7 == 0 else float(i))
    assert got == {g: sorted(v)[1] for g, v in want.items()}


def test_read_items_by_header_name(spark, tmp_path):
    from tavola.operators.clean import standardize_columns
    from tavola.operators.rollup import label_high_rated
    from tavola.sources import io
    f = tmp_path / "items.csv"
    f.write_text("City,State,Rating,Extra,Rating Count,Restaurant Name,Location,Category,Dish Name\n"
                 "Pune,MH,NaN,x,5.0,R,L,C,D\nDelhi,DL,4.5,y,abc,R2,L,C,D\nJaipur,RJ,4.1,z\n")
    rows = {r["City"]: r for r in io.read_items(spark, str(f), report_corrupt=True).collect()}
    assert rows["Pune"]["State"] == "MH" and rows["Pune"]["Rating"] is None and rows["Pune"]["Rating Count"] == 5
    assert rows["Pune"]["Price (INR)"] is None and rows["Pune"]["_corrupt_record"] is None
    assert rows["Delhi"]["Rating Count"] is None and "abc" in rows["Delhi"]["_corrupt_record"]
    assert rows["Jaipur"]["Rating"] == 4.1 and rows["Jaipur"]["_corrupt_record"] == "Jaipur,RJ,4.1,z"
    items = io.read_items(spark, str(f))
    assert items.columns == ["State", "City", "Restaurant Name", "Location", "Category", "Dish Name", "Price (INR)", "Rating", "Rating Count"]
    rated = standardize_columns(items).withColumn("avg_rating", F.col("rating"))
    assert label_high_rated(rated).where("city = 'Pune'").first()["is_high_rated"] == 0


def test_session_without_checkpoint_dir():
    """ensure_checkpoint_dir sets a folder on a context that has none."""
    import subprocess
    import sys
    code = ("from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate();"
            "from tavola.session import ensure_checkpoint_dir as e; a = e(s); s.range(3).checkpoint(); print('fine')")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=".")
    assert "fine" in out.stdout, out.stderr[-500:]


def test_saved_model_imputes_and_scores_alone(spark, tmp_path):
    from tavola.operators import score as S
    from tavola.operators import train as T
    from tavola.sources import io
    rows = [(i, None if i % 9 == 0 else float(i % 50), float((i * 7) % 31), int(i % 50 > 24)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    med = float(np.median([r[1] for r in rows if r[1] is not None]))
    for m in ("logistic", "random_forest"):
        pm = T.fit(df, ["a", "b"], m, "small")
        io.save_model(pm, str(tmp_path / m))
        loaded = io.load_model(str(tmp_path / m))
        a = {r["id"]: r["p"] for r in T.predict(pm, df, ["id"]).collect()}
        b = {r["id"]: r["p"] for r in T.predict(loaded, df, ["id"]).collect()}
        filled = {r["id"]: r["p"] for r in T.predict(pm, df.na.fill(med, ["a"]), ["id"]).collect()}
        nan = {r["id"]: r["p"] for r in T.predict(pm, df.withColumn("a", F.coalesce("a", F.lit(float("nan")))), ["id"]).collect()}
        assert a == b == filled == nan and all(0 <= p <= 1 for p in a.values())
        one = {r["id"]: (r["prediction"], r["probability"], r["confidence"], r["features_used"]) for r in S.score(df, pm, "premium", ["id"]).collect()}
        many = {r["id"]: r["premium"] for r in S.score_batch(df, {"popular": pm, "premium": loaded}, ["id"]).collect()}
        assert all(one[i] == (many[i]["prediction"], many[i]["probability"], many[i]["confidence"], 2) and one[i][1] == round(a[i], 4) for i in a)


def test_logistic_intercept_is_not_penalised(spark):
    """The mean predicted probability on train is the share of label 1."""
    from tavola.operators import train as T
    df = spark.createDataFrame([(float(i % 17), float(i % 5), int((i * 13) % 11 > 7)) for i in range(500)], "a double, b double, label int")
    r = T.predict(T.fit(df, ["a", "b"], "logistic", "baseline"), df, ["label"]).agg(F.avg("p").alias("p"), F.avg("label").alias("y")).first()
    assert r["p"] == pytest.approx(r["y"], abs=1e-4)
