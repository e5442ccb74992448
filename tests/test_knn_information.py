"""Nearest-neighbour mutual information against a direct computation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tavola.functions.exprs import digamma
from tavola.operators.diagnose import mutual_information_knn


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def direct(points, k):
    """points: (x, y) without nulls."""
    size = {y: sum(1 for _, c in points if c == y) for y in (0, 1)}
    points = [(x, y) for x, y in points if size[y] > 1]
    total = 0.0
    for i, (x, y) in enumerate(points):
        kk = min(k, size[y] - 1)
        d = sorted(abs(x - u) for j, (u, c) in enumerate(points) if c == y and j != i)[kk - 1]
        m = sum((u == x) if d == 0 else (x - d < u < x + d) for u, _ in points)
        total += psi(kk) - psi(size[y]) - psi(m)
    return max(psi(len(points)) + total / len(points), 0.0) if points else None


def test_digamma(spark):
    got = spark.range(1, 300).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-10 for r in got)


@pytest.mark.parametrize("k,block", [(3, 100_000), (3, 7), (1, 2), (5, 3)])
def test_equals_direct_computation_with_ties_nulls_and_small_classes(spark, k, block):
    rng = random.Random(k * 31 + block)
    rows = []
    for i in range(180):
        y1, y2 = int(rng.random() < 0.4), int(i < 3)  # the second target has a class smaller than k
        a = rng.choice([round(rng.gauss(y1, 1), 1), 0.0, -0.0, 2.5])
        b = rng.choice([rng.gauss(0, 1) + 3 * y2, None, float("nan")]) if i >= 3 else 9.0 + i
        rows.append((a, b, float(y1), 1.0, y1, y2))
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, y1 int, y2 int").repartition(3)
    got = {(r.feature, r.target): r for r in mutual_information_knn(df, ["a", "b", "c", "flat"], ["y1", "y2"], k=k, block=block).collect()}
    assert len(got) == 8
    for j, f in enumerate(["a", "b", "c", "flat"]):
        for t, col in (("y1", 4), ("y2", 5)):
            points = [(r[j], r[col]) for r in rows if r[j] is not None and not math.isnan(r[j])]
            assert got[f, t].mi == pytest.approx(direct(points, k), abs=1e-9), (f, t)
    for t in ("y1", "y2"):
        ordered = sorted((r for (f, tt), r in got.items() if tt == t), key=lambda r: r.rank)
        assert [r.rank for r in ordered] == [1, 2, 3, 4] and all(a.mi >= b.mi - 1e-9 for a, b in zip(ordered, ordered[1:]))
        assert all(r.suspicious == (r.mi > 0.5) for r in ordered)


def test_a_class_of_one_row_is_left_out(spark):
    df = spark.createDataFrame([(float(i), int(i == 0)) for i in range(20)], "a double, y int")
    got = mutual_information_knn(df, ["a"], ["y"]).first()
    assert got.mi == pytest.approx(direct([(float(i), int(i == 0)) for i in range(20)], 3), abs=1e-9)
    assert mutual_information_knn(df.where("false"), ["a"], ["y"]).count() == 0


def test_a_value_is_kept_once_for_all_targets_and_classes(spark, monkeypatch):
    rng, kept = random.Random(5), []
    rows = [(rng.gauss(0, 1), i % 2, int(i % 3 == 0), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, y1 int, y2 int, y3 int")
    frame = type(df)
    checkpoint = frame.checkpoint

    def counted(self, eager=True):
        out = checkpoint(self, eager)
        kept.append(out.count())
        return out
    monkeypatch.setattr(frame, "checkpoint", counted)
    got = {r.target: r.mi for r in mutual_information_knn(df, ["a"], ["y1", "y2", "y3"], block=20).collect()}
    assert max(kept) <= 400  # not a row per value, target and place
    for j, t in enumerate(["y1", "y2", "y3"], 1):
        assert got[t] == pytest.approx(direct([(r[0], r[j]) for r in rows], 3), abs=1e-9)


def test_two_distant_classes_ask_places_ranges_away(spark):
    rows = [(float(i * i), int(i in (1, 2, 250))) for i in range(300)]  # the few rows of a class span nearly all ranges
    got = mutual_information_knn(spark.createDataFrame(rows, "a double, y int"), ["a"], ["y"], block=10).first()
    assert got.mi == pytest.approx(direct(rows, 3), abs=1e-9)
