"""Validation and profiling of a raw table (shape, nulls, duplicates, types,
ranges, quality score, histograms, value counts, correlations)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.distributed_quantile import number
from tavola.functions.exprs import numeric_columns, present, q, stack_expr, string_columns
from tavola.functions.stats import scalar_stats
from tavola.functions.windows import top_n_per_group

# Expected types of the default (real) item schema, compared by
# substring as the reference does ("int" matches "bigint").
DEFAULT_EXPECTED_TYPES = {
    "state": "string", "city": "string", "restaurant_name": "string", "location": "string",
    "category": "string", "dish_name": "string", "price": "double", "rating": "double",
    "rating_count": "int",
}

# Range rules (column, valid low, valid high, outlier-high limit).
DEFAULT_RANGE_RULES = (
    ("rating", 0.0, 5.0, None),
    ("price", 0.0, None, 10000.0),
)


def profile_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, plus row/column counts and the
    number of columns sharing the type.  Schema is metadata; the row count is
    a scalar subquery."""
    spark = df.sparkSession
    types = [t for _n, t in df.dtypes]
    rows = [(i, n, t, types.count(t)) for i, (n, t) in enumerate(df.dtypes)]
    meta = spark.createDataFrame(rows, "position int, column_name string, dtype string, dtype_count int")
    n = df.agg(F.count("*")).scalar()
    return meta.select("*", n.alias("n_rows"), F.lit(len(types)).alias("n_columns"))


def _null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [F.count("*").alias("_n")] + [F.count_if(F.col(q(c)).isNull()).alias(c) for c in cols]
    return df.agg(*aggs)


def profile_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with nulls: count and % of rows, by % descending (one scan)."""
    cols = list(cols or df.columns)
    wide = _null_counts(df, cols)
    long = wide.select("_n", stack_expr([(c, q(c)) for c in cols], "column_name", "missing"))
    return (long.where(F.col("missing") > 0)
            .select("column_name", "missing", (F.col("missing") * 100.0 / F.col("_n")).alias("missing_pct"))
            .orderBy(F.desc("missing_pct"), "column_name"))


def profile_duplicates(df: DataFrame) -> DataFrame:
    """Rows repeating an earlier row on all columns (nulls equal), and %."""
    distinct = df.distinct().agg(F.count("*")).scalar()
    return (df.agg(F.count("*").alias("rows"))
            .select("rows", (F.col("rows") - distinct).alias("duplicates"))
            .withColumn("duplicate_pct", F.try_divide(F.col("duplicates") * 100.0, F.col("rows"))))


def check_types(df: DataFrame, expected: Mapping[str, str] = DEFAULT_EXPECTED_TYPES) -> DataFrame:
    """Columns whose actual type does not contain the expected type name."""
    actual = dict(df.dtypes)
    rows = [(c, e, actual[c]) for c, e in expected.items() if c in actual and e not in actual[c]]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, actual string")


def check_ranges(df: DataFrame, rules=DEFAULT_RANGE_RULES) -> DataFrame:
    """Per rule: min, max, valid bounds, rows below the low / above the high
    bound (the reference's 'cost' rule counts > limit and < 0)."""
    aggs, pairs = [], []
    for c, lo, hi, high_limit in rules:
        if c not in df.columns:
            continue
        x = F.col(q(c))
        top = high_limit if high_limit is not None else hi
        aggs += [F.min(x).cast("double").alias(f"{c}__min"), F.max(x).cast("double").alias(f"{c}__max"),
                 F.count_if(x < F.lit(lo)).alias(f"{c}__below") if lo is not None else F.lit(0).cast("long").alias(f"{c}__below"),
                 F.count_if(x > F.lit(top)).alias(f"{c}__above") if top is not None else F.lit(0).cast("long").alias(f"{c}__above")]
        pairs.append((c, lo, top))
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                        F.lit(lo).cast("double").alias("valid_low"), F.lit(top).cast("double").alias("valid_high"),
                        F.col(f"{c}__below").alias("n_below"), F.col(f"{c}__above").alias("n_above"))
               for c, lo, top in pairs]
    return wide.select(F.inline(F.array(*structs)))


def quality_score_expr(missing_pct_sum: Column, duplicate_pct: Column, type_issues: Column) -> Column:
    """100 - min(0.5*sum missing %, 30) - min(2*dup %, 20) - min(5*#type issues, 20), >= 0."""
    return F.greatest(F.lit(0.0), F.lit(100.0)
                      - F.least(missing_pct_sum * 0.5, F.lit(30.0))
                      - F.least(duplicate_pct * 2.0, F.lit(20.0))
                      - F.least(type_issues * 5.0, F.lit(20.0)))


def validation_report(df: DataFrame, expected: Mapping[str, str] = DEFAULT_EXPECTED_TYPES,
                      rules=DEFAULT_RANGE_RULES) -> DataFrame:
    """Shape, nulls, duplicates, type issues, ranges and the quality score in
    one row.  ``nulls`` lists the columns with nulls (count and % of rows),
    ``type_issue_rows`` the columns of another type than expected, ``ranges``
    the minimum, maximum and out-of-range counts per rule.  Null counts and
    ranges share one scan; duplicates are one more aggregate (scalar subquery)."""
    cols = df.columns
    n_type_issues = sum(1 for c, e in expected.items() if c in dict(df.dtypes) and e not in dict(df.dtypes)[c])
    distinct = df.distinct().agg(F.count("*")).scalar()
    nulls = [F.count_if(F.col(q(c)).isNull()) for c in cols]
    rng = []
    ranges = []
    for c, lo, hi, lim in rules:
        if c in cols:
            x, end = F.col(q(c)), lim if lim is not None else hi
            ranges.append(F.struct(F.lit(c).alias("column_name"), F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"),
                                   (F.count_if(x < F.lit(lo)) if lo is not None else F.lit(0).cast("long")).alias("n_below"),
                                   (F.count_if(x > F.lit(end)) if end is not None else F.lit(0).cast("long")).alias("n_above")))
            rng += [F.min(q(c)).cast("double").alias(f"{c}_min"), F.max(q(c)).cast("double").alias(f"{c}_max")]
    base = df.agg(F.count("*").alias("n_rows"),
                  sum(nulls, F.lit(0)).cast("long").alias("missing_cells"),
                  sum((F.try_divide(x * 100.0, F.count("*")) for x in nulls), F.lit(0.0)).alias("missing_pct_sum"),
                  F.array(*[F.struct(F.lit(c).alias("column_name"), x.alias("missing"), F.try_divide(x * 100.0, F.count("*")).alias("missing_pct"))
                            for c, x in zip(cols, nulls)]).alias("nulls"),
                  F.array(*ranges).alias("ranges"), *rng)
    base = base.withColumn("nulls", F.filter("nulls", lambda s: s["missing"] > 0))
    out = (base.withColumn("n_columns", F.lit(len(cols)))
           .withColumn("duplicates", F.col("n_rows") - distinct)
           .withColumn("duplicate_pct", F.try_divide(F.col("duplicates") * 100.0, F.col("n_rows")))
           .withColumn("type_issues", F.lit(n_type_issues))
           .withColumn("type_issue_rows", F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(e).alias("expected"), F.lit(dict(df.dtypes)[c]).alias("actual"))
                                                    for c, e in expected.items() if c in cols and e not in dict(df.dtypes)[c]])))
    return out.withColumn("quality_score", quality_score_expr(F.col("missing_pct_sum"), F.col("duplicate_pct"),
                                                              F.col("type_issues").cast("double")))


def _range_stats(df: DataFrame, cols: Sequence[str]) -> Column:
    """Scalar subquery: per column the bin range [lo, hi] (constant column ->
    [v-0.5, v+0.5], as numpy) and its width."""
    aggs = {}
    for i, c in enumerate(cols):
        x = number(F.col(q(c)))
        mn, mx = F.min(x), F.max(x)
        lo = F.when(mn == mx, mn - 0.5).otherwise(mn)
        hi = F.when(mn == mx, mx + 0.5).otherwise(mx)
        aggs[f"lo{i}"], aggs[f"hi{i}"], aggs[f"w{i}"] = lo, hi, hi - lo
    return scalar_stats(df, **aggs)


def equal_width_bin(x: Column, lo: Column, width: Column, bins: int) -> Column:
    """floor((x - lo) / width * bins), the maximum folded into the last bin;
    null stays null (``least`` would skip it)."""
    raw = F.floor((x - lo) / width * F.lit(float(bins)))
    return F.when(raw > F.lit(bins - 1), F.lit(bins - 1)).otherwise(raw).cast("int")


def numeric_histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width histogram per numeric column: (column, bin, lo, hi, count).

    Bins span [min, max] of the column, the last bin is right-closed (numpy);
    a constant column uses the range [v-0.5, v+0.5] as numpy does; null and NaN
    are in no bin.  Only
    non-empty bins are returned.  The ranges are one aggregate (scalar
    subquery); each row only computes one small bin expression per column
    (a codegen-friendly projection), rows are unpivoted to (column, bin) and
    counted with map-side combine; bin edges are attached to the <= bins x
    columns result rows only.
    """
    cols = present(df, list(cols or numeric_columns(df)))
    st = _range_stats(df, cols)
    binned = df.select(st.alias("_st"), *[number(F.col(q(c))).alias(f"_x{i}") for i, c in enumerate(cols)]) \
        .select(*[equal_width_bin(F.col(f"_x{i}"), F.col(f"_st.lo{i}"), F.col(f"_st.w{i}"), bins).alias(f"_b{i}")
                  for i in range(len(cols))])
    long = binned.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_b{i}").alias("bin"))
                                             for i, c in enumerate(cols)]))).where(F.col("bin").isNotNull())
    counts = long.groupBy("column_name", "bin").agg(F.count("*").alias("count"))
    lo = F.col("_lo")
    width = (F.col("_hi") - lo) / F.lit(float(bins))
    pick = lambda key: F.element_at(F.map_from_arrays(
        F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(f"_st.{key}{i}") for i in range(len(cols))])),
        F.col("column_name"))
    return (counts.withColumn("_st", st).withColumn("_lo", pick("lo")).withColumn("_hi", pick("hi"))
            .select("column_name", "bin", (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"), "count"))


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, top_n: int = 15) -> DataFrame:
    """Most frequent non-null values of each text column: (column, value,
    count, rank); ties by value.  Exact two-level top-n, so a column with
    billions of distinct values is never ranked in one task."""
    cols = list(cols or string_columns(df))
    long = (df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(q(c)).cast("string").alias("value"))
                                          for c in cols])))
            .where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count("*").alias("count")))
    return top_n_per_group(long, ["column_name"], [F.desc("count"), F.asc("value")], top_n)


CENTRE_ROWS = 1000


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None,
                       pairs_per_pass: int | None = None) -> DataFrame:
    """Pearson r for every unordered pair (a < b by position), pairwise
    complete (a row counts for a pair when both values are present, NaN being
    absent); columns that are constant in a pair's rows give null.

    One scan for any number of columns: with x = 0 where a value is absent and p = 1
    where it is present, the sums of a pair over its complete rows are products of the
    columns x, x^2 and p, so all of them stand in the Gramian of one vector of three
    entries per column, which tasks add up in (3 n)^2 / 2 doubles.  Columns are moved
    near 0 first, by the mean of some rows, which changes no correlation.  The sums of
    n^2 / 2 pairs reach the driver.  With ``pairs_per_pass``, aggregates of so many
    ``corr`` functions, a scan each, instead (no constant columns)."""
    cols = list(cols or numeric_columns(df))
    if pairs_per_pass:
        return _correlations_by_pass(df, cols, pairs_per_pass)
    spark, schema = df.sparkSession, "feature_a string, feature_b string, r double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    values = df.select(*[number(F.col(q(c))).alias(f"x{i}") for i, c in enumerate(cols)])
    near = values.limit(CENTRE_ROWS).agg(*[fn(f"x{i}").alias(f"{fn.__name__}{i}") for i in range(len(cols)) for fn in (F.avg, F.min, F.max)]).first()
    parts = []
    for i in range(len(cols)):
        constant = near[f"min{i}"] == near[f"max{i}"]
        centre = (near[f"min{i}"] if constant else near[f"avg{i}"]) or 0.0
        x = F.coalesce(F.col(f"x{i}") - F.lit(centre if np.isfinite(centre) else 0.0), F.lit(0.0))
        parts.append((x, x * x, F.col(f"x{i}").isNotNull().cast("double")))
    vector = array_to_vector(F.array(*[p[k] for k in range(3) for p in parts]))
    n = len(cols)
    rows = MLUtils.convertVectorColumnsFromML(values.select(vector.alias("v")), "v")
    gram = RowMatrix(rows, 0, 3 * n).computeGramianMatrix().toArray() if not values.isEmpty() else np.zeros((3 * n, 3 * n))
    sx, sxx, count, sxy = gram[:n, 2 * n:], gram[n:2 * n, 2 * n:], gram[2 * n:, 2 * n:], gram[:n, :n]  # [a, b]: of a over the rows of both
    with np.errstate(all="ignore"):
        spread = np.maximum(count * sxx - sx ** 2, 0)
        spread[spread <= 1e-12 * count * sxx] = 0
        r = np.where(spread * spread.T > 0, np.clip((count * sxy - sx * sx.T) / np.sqrt(spread * spread.T), -1, 1), np.nan)
    a, b = np.triu_indices(n, 1)
    found = r[a, b]
    return spark.createDataFrame([(cols[i], cols[j], float(v) if np.isfinite(v) else None) for i, j, v in zip(a.tolist(), b.tolist(), found.tolist())], schema)


def _correlations_by_pass(df: DataFrame, cols: Sequence[str], pairs_per_pass: int) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    out = None
    for start in range(0, len(pairs), pairs_per_pass):
        chunk = pairs[start:start + pairs_per_pass]
        wide = df.agg(*[F.corr(number(F.col(q(a))), number(F.col(q(b)))).alias(f"c{i}") for i, (a, b) in enumerate(chunk)])
        structs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                            F.nanvl(F.col(f"c{i}"), F.lit(None).cast("double")).alias("r"))
                   for i, (a, b) in enumerate(chunk)]
        part = wide.select(F.inline(F.array(*structs)))
        out = part if out is None else out.unionByName(part)
    return out
