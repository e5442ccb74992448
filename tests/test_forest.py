"""Deep forests: grown in tasks, kept as a table, as good as MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tavola.operators import forest as FO
from tavola.operators import train as T
from tavola.sources import io

COLS = ["a", "b", "c", "d"]


def _rows(spark, n=4000, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    d = rng.integers(0, 3, n)
    y = (x[:, 0] + x[:, 1] * (d == 1) + rng.normal(size=n) * 0.7 > 0).astype(int)
    return spark.createDataFrame([(f"r{i}", *map(float, x[i]), int(d[i]), int(y[i])) for i in range(n)],
                                 "id string, a double, b double, c double, d int, label int")


def _auc(scored):
    return BinaryClassificationEvaluator(rawPredictionCol="p").evaluate(scored)


def test_a_grown_tree_is_the_tree_of_mllib(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (3000, 4)).astype(np.uint8)
    y = (rng.random(3000) < 1 / (1 + np.exp(3 - 0.4 * x[:, 1] + 0.2 * x[:, 2]))).astype(int)
    tree = FO.pruned(FO.grow(x, y, np.ones(3000), 0, 4, 5, 4, np.random.default_rng(0)))
    leaf = FO.route(x, tree["feature"], tree["cut"], tree["left"])
    p = tree["pos"][leaf] / (tree["neg"] + tree["pos"])[leaf]
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(3000)], "id int, a double, b double, c double, d double, label int")
    df = VectorAssembler(inputCols=COLS, outputCol="features").transform(df)
    m = DecisionTreeClassifier(maxDepth=4, minInstancesPerNode=5).fit(df)
    other = np.array([r[0] for r in m.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()])
    assert np.allclose(p, other) and m.numNodes == len(tree["feature"])
    assert np.allclose(FO.importances(tree, 4), m.featureImportances.toArray())


@pytest.mark.parametrize("local_rows", [None, 300])
def test_forest_is_as_good_as_that_of_mllib(spark, local_rows):
    train, test = _rows(spark), _rows(spark, seed=6)
    m = FO.fit_forest(train, COLS, "label", 30, 15, 2, 42, local_rows)
    scored = m.transform(test).withColumn("p", vector_to_array("probability")[1])
    v = VectorAssembler(inputCols=COLS, outputCol="features")
    other = RandomForestClassifier(numTrees=30, maxDepth=15, minInstancesPerNode=2, seed=42).fit(v.transform(train))
    area = _auc(other.transform(v.transform(test)).withColumn("p", vector_to_array("probability")[1]))
    assert abs(_auc(scored) - area) < 0.015
    assert np.abs(m.featureImportances.toArray() - other.featureImportances.toArray()).max() < 0.08
    for r in m.trees.collect():  # every tree holds: weights of children, depth, least rows
        f, left = np.frombuffer(r["feature"], np.int16), np.frombuffer(r["left"], np.int32)
        depth = np.zeros(len(f), int)
        for i in np.flatnonzero(f >= 0):
            depth[left[i]: left[i] + 2] = depth[i] + 1
        assert depth.max() <= 15 and len(f) == r["nodes"] and 3000 < r["weight"] < 5000
        p = np.frombuffer(r["p"], float)
        assert ((p >= 0) & (p <= 1)).all() and (f >= 0).sum() == (f < 0).sum() - 1


def test_large_nodes_are_split_over_all_blocks(spark, monkeypatch):
    """With every feature in every subset a tree does not depend on where it is grown."""
    monkeypatch.setattr(FO, "BLOCK_ROWS", 500)
    df, trees = _rows(spark, 3000).repartition(4, "id").localCheckpoint(), []
    for local in (None, 200):
        m = FO.fit_forest(df, ["a"], "label", 3, 5, 2, 7, local)
        trees.append(m.trees.orderBy("tree").select("tree", "weight", "nodes", F.hex("p")).collect())
    assert [r[:2] for r in trees[0]] == [r[:2] for r in trees[1]]
    assert [r["nodes"] for r in trees[0]] == [r["nodes"] for r in trees[1]]


def test_rows_keep_their_columns_and_repeat(spark):
    df = _rows(spark, 200)
    m = FO.fit_forest(df, COLS, "label", 5, 12, 1, 42)
    more = df.unionByName(df).withColumn("nothing", F.lit(None).cast("string"))
    out = m.transform(more)
    assert out.count() == 400 and out.where("nothing is null").count() == 400
    assert out.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct(vector_to_array("probability")[1]).alias("k")).where("n != 2 or k != 1").count() == 0
    assert m.transform(more.limit(0)).count() == 0
    assert out.withColumn("p", vector_to_array("probability")[1]).where("(p > 0.5) != (prediction = 1)").count() == 0


def test_deep_presets_keep_their_trees_out_of_the_driver(spark, monkeypatch, tmp_path):
    monkeypatch.setitem(T.PRESETS, "advanced", {"random_forest": {"numTrees": 6, "maxDepth": 15, "minInstancesPerNode": 2}})
    df = _rows(spark, 500).withColumn("a", F.when(F.col("d") != 2, F.col("a")))
    pm = T.fit(df, COLS, "random_forest", "advanced")
    last = pm.stages[-1]
    assert last.trees.count() == last.getNumTrees == 6 and last.numFeatures == 4
    assert abs(last.featureImportances.toArray().sum() - 1) < 1e-9
    scored = sorted(map(tuple, T.predict(pm, df, ["id"]).collect()))
    assert len(scored) == 500 and len({p for _, p in scored}) > 20
    io.save_model(pm, str(tmp_path / "m"))
    again = sorted(map(tuple, T.predict(io.load_model(str(tmp_path / "m")), df, ["id"]).collect()))
    assert [i for i, _ in again] == [i for i, _ in scored] and np.allclose([p for _, p in again], [p for _, p in scored])
    assert hasattr(T.fit(df, COLS, "random_forest", "small").stages[-1], "totalNumNodes")  # small forests stay MLlib's


def test_one_class_and_few_rows(spark):
    df = _rows(spark, 3).withColumn("label", F.lit(0))
    m = FO.fit_forest(df, COLS, "label", 8, 15, 1, 42)
    assert m.getNumTrees == 8 and [r[0] for r in m.transform(df).select(vector_to_array("probability")[1]).collect()] == [0.0] * 3
    with pytest.raises(ValueError):
        FO.fit_forest(df.limit(0), COLS, "label", 2, 15, 1, 42)


def test_modules_are_shipped_once_by_fits_side_by_side(spark, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from tavola import session

    class Sc:
        applicationId, added = "side-by-side", []

        def addPyFile(self, path):
            self.added.append(path)

    class One:
        sparkContext = Sc()
    with ThreadPoolExecutor(8) as ex:
        list(ex.map(session.ship_package, [One()] * 8))
    assert len(Sc.added) == 1
