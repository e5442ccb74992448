"""Pairwise-complete correlations of many columns in one scan, and histograms, with NaN."""

import numpy as np
import pytest

from tavola.operators.profile import correlation_matrix, numeric_histogram


def expected(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def check(got, x, names):
    assert len(got) == len(names) * (len(names) - 1) // 2
    at = {n: k for k, n in enumerate(names)}
    for r in got:
        want = expected(x, at[r.feature_a], at[r.feature_b])
        assert (r.r is None) == (want is None) and (want is None or r.r == pytest.approx(want, abs=1e-9)), r


def test_nan_null_constant_and_shifted_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 7))
    x[:, 1] = x[:, 0]
    x[:, 2] = 1e7 + rng.normal(size=300) * 1e-2  # far from 0
    x[:, 3] = 4.5
    x[:, 4] = np.where(rng.random(300) < 0.6, np.nan, x[:, 4])
    x[:, 5] = np.where(np.isnan(x[:, 4]), x[:, 5], 2.0)  # constant where column 4 is present
    x[:, 6] = np.nan
    names = list("abcdefg")
    rows = [[None if np.isnan(v) and k % 2 else float(v) for v in r] for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = correlation_matrix(df, names).collect()
    check(got, x, names)
    assert {(r.feature_a, r.feature_b): r.r for r in got}["a", "b"] == 1.0
    by_pass = {(r.feature_a, r.feature_b): r.r for r in correlation_matrix(df, list("abce"), pairs_per_pass=3).collect()}
    one = {(r.feature_a, r.feature_b): r.r for r in correlation_matrix(df, list("abce")).collect()}
    assert all(one[k] == (None if v is None else pytest.approx(v, abs=1e-6)) for k, v in by_pass.items())
    assert [r.r for r in correlation_matrix(df.where("false"), ["a", "b"]).collect()] == [None]


def test_five_hundred_columns_in_one_scan(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 500)) + rng.normal(size=(60, 1))
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"c{k}" for k in range(500)]
    df = spark.createDataFrame([[float(v) for v in r] for r in x], ", ".join(f"{n} double" for n in names))
    got = correlation_matrix(df, names).collect()
    assert len(got) == 500 * 499 // 2
    rng.shuffle(got)
    at = {n: k for k, n in enumerate(names)}
    for r in got[:3000]:
        assert r.r == pytest.approx(expected(x, at[r.feature_a], at[r.feature_b]), abs=1e-9)


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (3.0,)], "a double")
    assert [(r.bin, r["count"]) for r in numeric_histogram(df, ["a"], 2).orderBy("bin").collect()] == [(0, 1), (1, 2)]
