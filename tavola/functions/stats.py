"""Whole-column statistics delivered as scalar-subquery columns.

A statistic of the whole column (quantile bounds, medians, means) is computed
by one aggregate and used by every row.  Instead of a cross join, the one-row
aggregate becomes a *scalar subquery* (``DataFrame.scalar()``): Spark runs it
once as its own job and substitutes the value, the plan stays lazy and no
join is planned at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.distributed_quantile import column_quantiles, exact_group_medians, exact_group_quantiles, number


def scalar_stats(df: DataFrame, **aggs: Column) -> Column:
    """One struct column holding the named aggregates of ``df``.

    ``scalar_stats(df, lo=F.min('x'), hi=F.max('x')).getField('lo')``.
    """
    return df.agg(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("s")).scalar()


EXACT_DISTINCT_LIMIT_CONF = "tavola.quantile.exactDistinctLimit"
#: One task merges a ``percentile`` buffer of this many values of every column at most.
EXACT_DISTINCT_LIMIT = 20_000
#: Values of a column in one group; every group has its own buffer.
GROUP_DISTINCT_LIMIT = 1_000_000


def exact_distinct_limit(df: DataFrame, default: int = EXACT_DISTINCT_LIMIT) -> int:
    v = df.sparkSession.conf.get(EXACT_DISTINCT_LIMIT_CONF, None)
    return int(v) if v else default


def choose_methods(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Checked choice of the exact quantile strategy per column.

    One HyperLogLog job (``approx_count_distinct``, combined map-side)
    estimates the distinct values; a column whose estimate is within the
    limit (default 20,000; ``tavola.quantile.exactDistinctLimit``) uses
    Spark's exact ``percentile`` (its single merge buffer holds one entry per
    distinct value), larger ones use the distributed refinement."""
    limit = exact_distinct_limit(df)
    row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias(f"d{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: ("exact" if row[f"d{i}"] <= limit else "distributed") for i, c in enumerate(columns)}


def quantiles(df: DataFrame, column: str, probs: Sequence[float],
              method: str = "auto", accuracy: int = 10000) -> Column:
    """Linear-interpolated quantiles of a whole column as an array column.

    method:
      ``auto``         ``exact`` or ``distributed`` after a checked estimate
                       of the distinct values (see ``choose_methods``).
      ``exact``        Spark ``percentile``; its buffer holds one entry per
                       distinct value, fine for bounded value domains
                       (ratings, rounded prices, small tables).
      ``distributed``  exact as well, for columns with unbounded distinct
                       values: counts around the wanted ranks over the full
                       data (``column_quantiles``; three scans, nothing large
                       on the driver), result inlined as literals.
      ``approx``       ``percentile_approx`` (bounded memory, rank error
                       ~ n/accuracy).
    Element ``i`` of the array is the quantile for ``probs[i]``; nulls are
    skipped.
    """
    probs = [float(p) for p in probs]
    c = number(F.col(column))
    if method == "auto":
        method = choose_methods(df, [column])[column]
    if method == "exact":
        agg = F.percentile(c, F.array(*[F.lit(p) for p in probs]))
    elif method == "approx":
        agg = F.percentile_approx(c, F.array(*[F.lit(p) for p in probs]), accuracy)
    elif method == "distributed":
        vals = column_quantiles(df, [column], probs)[0]
        return F.array(*[F.lit(v).cast("double") for v in vals])
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    return df.agg(agg.alias("q")).scalar()


def quantiles_by_group(df: DataFrame, group_cols: Sequence[str], column: str, probs: Sequence[float],
                       method: str = "auto") -> DataFrame:
    """Exact linear quantiles per group: (group cols..., q array<double>).

    ``auto`` checks the largest per-group distinct count (HyperLogLog): within
    the limit, one ``percentile`` aggregate per group; above it running counts
    per (group, value) (``exact_group_quantiles``), for any number of groups.
    """
    group_cols = list(group_cols)
    probs = [float(p) for p in probs]
    if method == "auto":
        d = (df.groupBy(*group_cols).agg(F.approx_count_distinct(F.col(column), 0.05).alias("d"))
             .agg(F.max("d").alias("d")).first())["d"]
        method = "distributed" if (d or 0) > exact_distinct_limit(df, GROUP_DISTINCT_LIMIT) else "exact"
    if method == "exact":
        return df.groupBy(*group_cols).agg(
            F.percentile(number(F.col(column)), F.array(*[F.lit(p) for p in probs])).alias("q"))
    return exact_group_quantiles(df, group_cols, column, probs)


def quantile_struct(df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str = "auto") -> Column:
    """Struct column with field ``q<i>`` = array of the exact quantiles of
    ``columns[i]``.  Columns within the checked distinct limit share one
    ``percentile`` scalar subquery; larger ones share the scans of
    ``column_quantiles`` and are inlined as literals."""
    columns = list(columns)
    probs = [float(p) for p in probs]
    methods = choose_methods(df, columns) if method == "auto" else {c: method for c in columns}
    arr = F.array(*[F.lit(p) for p in probs])
    exact = [(i, c) for i, c in enumerate(columns) if methods[c] == "exact"]
    sub = None
    if exact:
        sub = df.agg(F.struct(*[F.percentile(number(F.col(f"`{c}`")), arr).alias(f"q{i}")
                                for i, c in exact]).alias("s")).scalar()
    wide = [c for c in columns if methods[c] != "exact"]
    found = dict(zip(wide, column_quantiles(df, wide, probs))) if wide else {}
    fields = []
    for i, c in enumerate(columns):
        if methods[c] == "exact":
            fields.append(sub.getField(f"q{i}").alias(f"q{i}"))
        else:
            vals = found[c]
            fields.append(F.array(*[F.lit(v).cast("double") for v in vals]).alias(f"q{i}"))
    return F.struct(*fields)


def medians_by_group(df: DataFrame, group_cols: Sequence[str], columns: Sequence[str],
                     prefix: str = "median_") -> DataFrame:
    """Exact medians of several columns per group, one row per group.

    One HyperLogLog job sizes every (group, column) value set; the columns
    within the limit share one grouped ``percentile`` aggregate, the others use
    running counts per (group, value)."""
    group_cols, columns = list(group_cols), list(columns)
    st = (df.groupBy(*group_cols).agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias(f"d{i}")
                                        for i, c in enumerate(columns)])
          .agg(*[F.max(f"d{i}").alias(f"d{i}") for i in range(len(columns))]).first())
    limit = exact_distinct_limit(df, GROUP_DISTINCT_LIMIT)
    big = [c for i, c in enumerate(columns) if (st[f"d{i}"] or 0) > limit]
    small = [c for c in columns if c not in big]
    out = None
    if small:
        out = df.groupBy(*group_cols).agg(*[F.percentile(number(F.col(f"`{c}`")), F.lit(0.5)).alias(f"{prefix}{c}")
                                            for c in small])
    for c in big:
        m = exact_group_medians(df, group_cols, c, f"{prefix}{c}")
        out = m if out is None else out.join(m, on=group_cols, how="full")
    return out
