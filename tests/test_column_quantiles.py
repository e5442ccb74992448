"""Exact quantiles of many columns in shared scans, against numpy."""

import numpy as np

from tavola.functions import distributed_quantile as DQ
from tavola.functions import stats


def _frame(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), None if i % 7 == 0 else float(b), float(i % 3), float("nan") if i % 2 else float(i), None)
            for i, (a, b) in enumerate(zip(rng.normal(size=3000), rng.lognormal(size=3000)))]
    return rows, spark.createDataFrame(rows, "a double, `b c` double, same double, odd double, empty double")


def test_against_numpy(spark, monkeypatch):
    rows, df = _frame(spark)
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    names = ["a", "b c", "same", "odd", "empty"]
    for accuracy in (10_000, 20):  # intervals of few rows, and of many
        got = DQ.column_quantiles(df, names, probs, accuracy)
        for i in range(4):
            x = np.array([r[i] for r in rows if r[i] is not None and not np.isnan(r[i])])
            assert np.allclose(got[i], np.quantile(x, probs), rtol=1e-12, atol=0), (names[i], accuracy)
        assert got[4] == [None] * len(probs)
    monkeypatch.setattr(DQ, "COLLECTED_ROWS", 1)  # too many rows to collect: narrowed by rank
    assert DQ.column_quantiles(df, names, probs)[0] == DQ.exact_quantiles(df, "a", probs)


def test_wide_columns_share_scans_and_never_one_percentile_buffer(spark):
    """Columns of more values than one task should merge are not left to ``percentile``."""
    df = spark.range(60_000).selectExpr("id * 1.5 AS a", "id % 10 AS few")
    assert stats.choose_methods(df, ["a", "few"]) == {"a": "distributed", "few": "exact"}
    q = df.select(stats.quantile_struct(df, ["a", "few"], [0.25, 0.5]).alias("q")).first()["q"]
    assert list(q["q0"]) == [0.25 * 59_999 * 1.5, 0.5 * 59_999 * 1.5] and list(q["q1"]) == [2.0, 4.5]
