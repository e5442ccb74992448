"""Exact quantiles of columns with any number of distinct values.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer that one task merges; over billions of doubles that buffer does not
fit, and ``percentile_approx`` is not exact.

*Whole columns* (``exact_quantiles``) are narrowed by rank: each pass takes
splitters out of the interval that holds a wanted rank (approximate
percentiles, so actual values), counts the rows below, at and between them
exactly, and goes on with the one gap or value that holds the rank.  A pass
divides the rows left by about the number of splitters whatever the values
are, so infinities and heavy duplicates need no special care and the loop
ends without a limit on passes.  The driver sees splitters, counts and, at
the end, the at most ``final_rows`` values left in an interval.

*Groups* (``exact_group_quantiles``) are counted per (group, value); running
counts come from range-partitioned ``prefix_sums`` and the order statistics
are the values whose running-count interval holds the ranks.  Nothing goes
to the driver and no task holds a group.

Nulls and NaN are left out; infinities are ordinary values.  Interpolation
between neighbouring order statistics is linear, as numpy, Spark
``percentile`` and DuckDB ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(column: Column) -> Column:
    """The column as double, NaN as null."""
    x = column.cast("double")
    return F.when(~F.isnan(x), x)


def _between(lo: float | None, hi: float | None) -> Column:
    x = F.col("x")
    cond = F.lit(True)
    if lo is not None:
        cond &= x > F.lit(lo)
    if hi is not None:
        cond &= x < F.lit(hi)
    return cond


def _interpolate(v0: float, v1: float, frac: float) -> float:
    return v0 if v0 == v1 or frac == 0 else v0 + (v1 - v0) * frac


#: Rows that ``column_quantiles`` may collect for its last step.
COLLECTED_ROWS = 200_000


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000) -> list[list[float | None]]:
    """Exact quantiles of many columns in three scans of all of them together.

    The first counts values, the second takes approximate percentiles a little below and
    above every wanted place, the third counts the rows below such an interval and the
    values in it exactly.  Intervals hold a few rows in ``accuracy``, which grows with the
    rows, so the driver gets about ``COLLECTED_ROWS`` values.  A column whose ranks lie
    outside their intervals, or with too many rows for this, is narrowed by rank instead."""
    columns, probs = list(columns), [float(p) for p in probs]
    x = [number(F.col(f"`{c}`")) for c in columns]
    n = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(x)]).first()
    n = [n[f"n{i}"] for i in range(len(columns))]
    held = 8 * len(probs) * sum(n)
    accuracy = min(max(accuracy, -(-held // COLLECTED_ROWS)), 10 * accuracy)
    if held > 4 * accuracy * COLLECTED_ROWS:
        return [exact_quantiles(df, f"`{c}`", probs) for c in columns]
    ends = F.array(*[F.lit(min(max(p + s, 0.0), 1.0)) for p in probs for s in (-3 / accuracy, 3 / accuracy)])
    cuts = df.agg(*[F.percentile_approx(v, ends, accuracy).alias(f"c{i}") for i, v in enumerate(x)]).first()
    wanted = [(i, j) for i in range(len(columns)) if n[i] for j in range(len(probs))]
    parts = []
    for at, (i, j) in enumerate(wanted):
        lo, hi = (F.lit(v) for v in cuts[f"c{i}"][2 * j: 2 * j + 2])
        parts.append(F.struct(F.lit(at).alias("at"), F.when(x[i] >= lo, x[i]).alias("v"), (x[i] <= hi).alias("near")))
    counts: list[dict] = [{} for _ in wanted]
    if parts:
        near = df.select(F.inline(F.array(*parts))).where("near").groupBy("at", "v").agg(F.count("*").alias("k"))
        for r in near.collect():
            counts[r["at"]][r["v"]] = r["k"]
    out: list[list[float | None]] = [[None] * len(probs) for _ in columns]
    for (i, j), found in zip(wanted, counts):
        pos = probs[j] * (n[i] - 1)
        r0 = int(math.floor(pos))
        below, v = found.pop(None, 0), {}
        for value in sorted(found):
            for r in (r0, min(r0 + 1, n[i] - 1)):
                if below <= r < below + found[value]:
                    v[r] = value
            below += found[value]
        if len(v) == len({r0, min(r0 + 1, n[i] - 1)}):
            out[i][j] = _interpolate(v[r0], v[min(r0 + 1, n[i] - 1)], pos - r0)
        else:
            out[i][j] = exact_quantiles(df, f"`{columns[i]}`", [probs[j]])[0]
    return out


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], splitters: int = 64,
                    final_rows: int = 100_000) -> list[float | None]:
    vals = df.select(number(F.col(column)).alias("x")).where("x is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = vals.count()
        if n == 0:
            return [None for _ in probs]
        plan = []
        for p in probs:
            pos = float(p) * (n - 1)
            r0 = int(math.floor(pos))
            plan.append((r0, min(r0 + 1, n - 1), pos - r0))
        # rank -> open interval that holds it, rows below the interval, rows in it
        state: dict[int, tuple] = {r: (None, None, 0, n) for r0, r1, _ in plan for r in (r0, r1)}
        found: dict[int, float] = {}
        while state:
            small = sorted({s[:2] for s in state.values() if s[3] <= final_rows}, key=str)
            large = sorted({s[:2] for s in state.values() if s[3] > final_rows}, key=str)
            counts = _values(vals, small) | _bins(vals, large, splitters)
            nxt = {}
            for r, (lo, hi, below, _) in state.items():
                for value, gap, k in counts[(lo, hi)]:  # ascending; value None: the open gap
                    if r < below + k:
                        if value is not None:
                            found[r] = value
                        else:
                            nxt[r] = (*gap, below, k)
                        break
                    below += k
            state = nxt
        return [_interpolate(found[r0], found[r1], frac) for r0, r1, frac in plan]
    finally:
        vals.unpersist()


def _values(vals: DataFrame, intervals: list) -> dict:
    """(value, None, rows) of every distinct value of small intervals."""
    if not intervals:
        return {}
    marked = [vals.where(_between(*iv)).withColumn("id", F.lit(i)) for i, iv in enumerate(intervals)]
    rows = marked[0]
    for m in marked[1:]:
        rows = rows.union(m)
    out: dict = {iv: [] for iv in intervals}
    for r in sorted(rows.groupBy("id", "x").agg(F.count("*").alias("k")).collect(), key=lambda r: r["x"]):
        out[intervals[r["id"]]].append((r["x"], None, r["k"]))
    return out


def _bins(vals: DataFrame, intervals: list, splitters: int) -> dict:
    """(splitter, None, rows at it) and (None, gap, rows between) of large intervals."""
    if not intervals:
        return {}
    ps = F.array(*[F.lit((i + 1) / (splitters + 1)) for i in range(splitters)])
    got = vals.agg(*[F.percentile_approx(F.when(_between(*iv), F.col("x")), ps, 20 * splitters).alias(f"s{i}") for i, iv in enumerate(intervals)]).first()
    out = {}
    for i, (lo, hi) in enumerate(intervals):
        cuts = sorted(set(got[f"s{i}"]))
        x = F.col("x")
        # even: the gap before cut k / 2, odd: the cut itself
        at = sum(((x >= F.lit(c)).cast("int") + (x > F.lit(c)).cast("int") for c in cuts), F.lit(0))
        rows = dict(vals.where(_between(lo, hi)).groupBy(at.alias("k")).count().collect())
        edges = [lo, *cuts, hi]
        out[(lo, hi)] = [(cuts[k // 2], None, rows[k]) if k % 2 else (None, (edges[k // 2], edges[k // 2 + 1]), rows[k])
                         for k in range(2 * len(cuts) + 1) if k in rows]
    return out


def exact_group_quantiles(df: DataFrame, group_cols: Sequence[str], column: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """(group cols..., ``out`` array<double>): exact linear quantiles per group,
    for any number of groups and any values."""
    from tavola.functions.windows import prefix_sums

    group_cols = list(group_cols)
    vc = (df.select(*group_cols, number(F.col(column)).alias("_x")).where("_x is not null")
          .groupBy(*group_cols, "_x").agg(F.count("*").alias("_c")))
    ps = prefix_sums(vc, group_cols, "_x", ["_c"], descending=False)
    n = ps.groupBy(*group_cols).agg(F.sum("_c").alias("_n"))
    j = ps.join(n.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)], "_n"),
                on=[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group_cols)])
    lo = F.col("cum__c") - F.col("_c")
    aggs, cols = [F.max("_n").alias("_n")], []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for k, r in enumerate((F.floor(pos), F.least(F.floor(pos) + 1, F.col("_n") - 1))):
            aggs.append(F.max(F.when((lo <= r) & (r < F.col("cum__c")), F.col("_x"))).alias(f"_v{i}_{k}"))
        a, b = F.col(f"_v{i}_0"), F.col(f"_v{i}_1")
        cols.append(F.when((a == b) | (pos == F.floor(pos)), a).otherwise(a + (b - a) * (pos - F.floor(pos))))
    return j.groupBy(*group_cols).agg(*aggs).select(*group_cols, F.array(*cols).alias(out))


def exact_group_medians(df: DataFrame, group_cols: Sequence[str], column: str, out: str = "median") -> DataFrame:
    """Exact (linear) median per group."""
    return exact_group_quantiles(df, group_cols, column, [0.5], out).withColumn(out, F.col(out)[0])
