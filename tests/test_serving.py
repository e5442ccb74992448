"""Raw requests through saved pipelines: vocabulary, filled requests, what-if grid, exactly-once log."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tavola.operators import score as S
from tavola.operators import serving as SV
from tavola.operators import train as T
from tavola.operators.features import TASK_FEATURES
from tavola.sources import io
from tavola.streaming import jobs as J

REQ = ("request_id long, avg_price double, dish_count long, total_rating_count long, avg_rating double, median_rating double, rating_std double, price_std double, "
       "category_diversity int, price_to_dish_ratio double, rating_count_per_dish double, has_high_variance int, price_volatility double, city string")


def request_rows(n, seed=0):
    rng = random.Random(seed)
    cities = ["mumbai", " Mumbai ", "BANGALORE", "bengaluru", "delhi", "New Delhi", "pune", "o'hare", "back\\slash", None, ""]
    out = []
    for i in range(n):
        price, dishes, ratings = rng.uniform(50, 900), rng.randint(0, 120), rng.randint(0, 3000)
        out.append((i, price, dishes, ratings, rng.choice([None, rng.uniform(3, 5)]), 4.0, rng.choice([None, float("nan"), rng.random()]), rng.uniform(1, 90),
                    rng.randint(1, 9), price / (dishes + 1), ratings / (dishes + 1), rng.randint(0, 1), rng.random(), rng.choice(cities)))
    return out


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(request_rows(300), REQ).cache()


@pytest.fixture(scope="module")
def models(spark, requests, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    train = requests.withColumn("label", (F.coalesce("avg_rating", F.lit(3.0)) + F.when(F.col("city").contains("umb"), 1).otherwise(0) > 4).cast("int"))
    for t in TASK_FEATURES:
        io.save_model(T.fit_for_requests(train, TASK_FEATURES[t], "logistic" if t == "popular" else "random_forest", k=4), f"{folder}/{t}")
    return {t: io.load_model(f"{folder}/{t}") for t in TASK_FEATURES}


def test_vocabulary_knows_aliases_and_leaves_the_rest_to_other(spark):
    rows = [("bangalore", 1), ("Bengaluru ", 2), ("delhi", 3), ("new delhi", 4), ("x", 5), ("x", 6), ("o'hare", 7), ("o'hare", 8), (None, 9), ("other", 10), ("rare", 11)]
    df = spark.createDataFrame(rows, "city string, id int")
    v = SV.learn_vocabulary(df, k=4)
    assert v.values == ("bengaluru", "new delhi", "o'hare", "x")
    got = {r.id: [r[n] for n in v.names] for r in v.encoded(df).collect()}
    want = {1: 0, 2: 0, 3: 1, 4: 1, 5: 3, 6: 3, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4}
    assert got == {i: [int(k == at) for k in range(5)] for i, at in want.items()}
    staged = {r.id: r[v.known] for r in v.stage().transform(df).collect()}
    assert staged[1] == "bengaluru" and staged[7] == "o'hare" and staged[9] == "other"
    none = SV.learn_vocabulary(df.where("false"))
    assert none.values == () and [r.city_other for r in none.encoded(df).collect()] == [1] * len(rows)


def test_loaded_model_scores_a_raw_request_as_its_training_row(spark, requests, models):
    train = requests.withColumn("label", (F.coalesce("avg_rating", F.lit(3.0)) + F.when(F.col("city").contains("umb"), 1).otherwise(0) > 4).cast("int"))
    served = {r.request_id: r for r in SV.score_requests(requests, models, ["request_id"]).collect()}
    assert len(served) == 300
    for t, feats in TASK_FEATURES.items():
        v = SV.learn_vocabulary(train, k=4)
        table = v.encoded(train)
        own = T.fit(table, [*feats, *v.names], "logistic" if t == "popular" else "random_forest")
        for r in T.predict(own, table, ["request_id"]).collect():
            assert served[r.request_id][t].probability == pytest.approx(r.p, abs=5.1e-5)
            assert served[r.request_id][t].prediction == int(served[r.request_id][t].probability >= 0.5)


def test_the_city_counts_and_fields_may_be_absent(spark, requests, models):
    one = requests.limit(1)
    by = {c: SV.score_requests(one.withColumn("city", F.lit(c)), models, ["request_id"]).first()["high_rated"].probability for c in ("Mumbai", " MUMBAI", "nowhere", "elsewhere")}
    assert by["Mumbai"] == by[" MUMBAI"] and by["nowhere"] == by["elsewhere"]
    few = SV.complete_request(requests.select("request_id", "avg_price", "dish_count", "total_rating_count"))
    row = few.where("dish_count > 0").first()
    assert set(S.REQUEST_FIELDS) <= set(few.columns) and row.city is None and row.price_to_dish_ratio == pytest.approx(row.avg_price / (row.dish_count + 1))
    assert SV.score_requests(few, models, ["request_id"]).where("premium.probability is not null").count() == 300


def test_scenarios_equal_scoring_each_overlaid_row(spark, requests, models):
    combos = [{"avg_rating": 4.9, "avg_price": 1000}, {"avg_rating": 3.1}, {"rating_std": 0.01, "total_rating_count": 50000}]
    grid = {(r.request_id, r.scenario, r.task): r for r in S.score_scenarios(requests, combos, ["request_id"], models).collect()}
    assert len(grid) == 300 * 3 * 3
    for i, combo in enumerate(combos):
        overlaid = S.derive_serving_features(requests.withColumns({f: F.lit(v).cast("double") for f, v in combo.items()}))
        for t, m in models.items():
            for r in S.score(overlaid, m, t, ["request_id"]).collect():
                g = grid[r.request_id, i, t]
                assert (g.probability, g.prediction, g.confidence) == (r.probability, r.prediction, r.confidence)
    for i in range(300):
        for t in models:
            found = [grid[i, s, t] for s in range(3)]
            best = sorted((g for g in found if g.prediction == 1), key=lambda g: (-g.probability, g.scenario))
            assert [g.rank for g in best] == list(range(1, len(best) + 1)) and all(g.rank is None for g in found if g.prediction == 0)


def log_key(df):
    return sorted((r.model, json.dumps(sorted(r.features.items(), key=str), default=str), tuple(r.prediction), r.success, r.feature_count) for r in df.collect())


@pytest.mark.parametrize("scorer", ["models", "rules"])
def test_stream_log_equals_batch_scores_over_stops_and_replays(spark, requests, models, scorer, tmp_path):
    used = models if scorer == "models" else None
    req, log, ckpt = (str(tmp_path / x) for x in ("req", "log", "ckpt"))
    clean = requests.na.drop(subset=["rating_std"])  # a NaN is no JSON number
    stamped = clean.withColumn("requested_at", F.timestamp_seconds(F.col("request_id") + 1_700_000_000))
    run = lambda: J.stream_score(J.request_stream(spark, req, stamped.schema, 1), log, ckpt, models=used)
    for k in range(2):
        stamped.where(F.col("request_id") % 3 == k).coalesce(1).write.mode("append").parquet(req)
    assert run() == 2 and run() == 0
    # stopped after a commit, before the stream noted it: the batch comes again
    os.remove(f"{ckpt}/commits/1")
    if os.path.exists(f"{ckpt}/commits/.1.crc"):
        os.remove(f"{ckpt}/commits/.1.crc")
    # an attempt that did not end leaves records that nobody reads
    stamped.limit(5).select(F.lit("x").alias("model")).write.json(f"{log}/_attempt-000000002-dead")
    stamped.where(F.col("request_id") % 3 == 2).coalesce(1).write.mode("append").parquet(req)
    assert run() == 1
    got = io.read_prediction_log(spark, log)
    want = SV.prediction_records(clean, used, ["request_id"], F.lit(None))
    assert got.columns == [f.split()[0] for f in ("timestamp", "model", "features", "prediction", "response_time", "success", "feature_count")]
    assert log_key(got) == log_key(want) and got.count() == 3 * clean.count()
    assert got.where("response_time is null or response_time <= 0 or timestamp is null").count() == 0
    assert got.agg(F.min("timestamp").cast("long")).first()[0] >= 1_700_000_000
    # the monitor reads it, beside appended records
    from tavola.operators.monitor import log_by_model, log_metrics
    n = got.count()
    io.append_prediction_log(got.limit(4), log)
    both = io.read_prediction_log(spark, log).withColumnRenamed("timestamp", "ts")
    assert both.count() == n + 4 == sum(r[1] for r in log_by_model(both, 10 ** 6).select("model", F.col(log_by_model(both, 1).columns[-1])).collect())
    assert log_metrics(both, [10 ** 6]).count() == 1
