"""Feature diagnostics: correlations, variance, redundancy, constants,
leakage by correlation and mutual information, class profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.distributed_quantile import number
from tavola.functions.exprs import digamma, numeric_columns, q
from tavola.operators.profile import correlation_matrix
from tavola.session import ship_package

TARGETS = ("is_high_rated", "is_popular", "is_premium")


def top_correlated_pairs(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Unordered pairs by |r| descending, r = 1 excluded, each pair once."""
    m = correlation_matrix(df, cols)
    return (m.where(F.col("r").isNotNull() & (F.col("r") != 1.0))
            .orderBy(F.desc(F.abs("r")), "feature_a", "feature_b").limit(n))


def feature_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample variance per column with its rank (1 = highest)."""
    wide = df.agg(*[F.var_samp(F.col(q(c)).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("variance"))
                                           for i, c in enumerate(cols)])))
    # one row per column: a window over k rows
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("variance"), "column_name")))


def redundant_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    return correlation_matrix(df, cols).where(F.abs("r") > threshold)


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column 0 (no value), 1 (one distinct value) or 2 (two or more) as
    ``n_distinct``, and whether the column is constant (exactly one).  Only the
    minimum and maximum are needed, so one scan without a shuffle of values."""
    def kinds(i: int) -> Column:
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when(lo.isNull(), 0).when(lo == hi, 1).otherwise(2).cast("long")

    wide = df.agg(*[a for i, c in enumerate(cols) for a in (F.min(q(c)).alias(f"lo{i}"), F.max(q(c)).alias(f"hi{i}"))])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), kinds(i).alias("n_distinct")) for i, c in enumerate(cols)])))
    return long.withColumn("is_constant", F.col("n_distinct") == 1)


def leakage_by_correlation(df: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGETS,
                           threshold: float = 0.8) -> DataFrame:
    """Per feature: r with each target, max |r| and a flag (> threshold)."""
    aggs = [F.corr(F.col(q(f)).cast("double"), F.col(t).cast("double")).alias(f"c{i}_{j}")
            for i, f in enumerate(features) for j, t in enumerate(targets)]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(features):
        rs = [F.nanvl(F.col(f"c{i}_{j}"), F.lit(None).cast("double")) for j in range(len(targets))]
        rows.append(F.struct(F.lit(f).alias("feature"),
                             *[r.alias(f"r_{t}") for r, t in zip(rs, targets)],
                             F.greatest(*[F.abs(r) for r in rs]).alias("max_abs_r")))
    long = wide.select(F.inline(F.array(*rows)))
    return long.withColumn("suspicious", F.coalesce(F.col("max_abs_r") > threshold, F.lit(False)))


def mutual_information_knn(df: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGETS, k: int = 3,
                           top: int = 5, flag: float = 0.5, block: int = 100_000) -> DataFrame:
    """Mutual information (nats) of numeric features with 0/1 targets by nearest neighbours.

    For a row of class y, d is the distance to the k-th nearest other row of its class (to
    the last one in smaller classes) and m the number of rows of all classes nearer than
    d, itself included (of rows equal to it where d is 0); with digamma p,
    mi = p(N) + mean(p(k)) - mean(p(N_y)) - mean(p(m)), at least 0.  Ties get no noise, so
    the result is exact and the same everywhere.  Rows that are alone in their class are left out.

    Rows are counted per value first, with the counts of all classes side by side, and the values
    are dealt to ranges of about ``block`` values.  A range gets the k nearest values of every
    class on either side and the rows before it (``_range_sides``), so one pass finds every d and
    nearly every m.  Only a value whose d reaches past the next range asks for the rows
    before a place elsewhere: at most k + 1 values of a class do so at either end of a range, so
    places, like the ranges' summaries, are as few as the ranges and go through the driver."""
    kinds = [(j, y) for j in range(len(targets)) for y in (0, 1)]
    names, at = F.array(*[F.lit(f) for f in features]), list(range(len(features)))
    x = lambda f: number(F.col(q(f)).cast("double")) + F.lit(0.0)  # noqa: E731  (no negative zero)
    long = df.select(*[F.col(q(t)).cast("int").alias(f"_y{j}") for j, t in enumerate(targets)],
                     F.inline(F.array(*[F.struct(F.lit(i).alias("f"), x(features[i]).alias("x")) for i in at]))).where("x is not null")
    counted = long.groupBy("f", "x").agg(*[F.count_if(F.col(f"_y{j}") == y).alias(f"n{j}_{y}") for j, y in kinds]).checkpoint(eager=True)
    totals = {r["f"]: list(r)[1:] for r in counted.groupBy("f").agg(*[F.sum(f"n{j}_{y}") for j, y in kinds]).collect()}  # a row per feature
    n_ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200), -(-counted.count() // block))
    ranges = (counted.repartitionByRange(n_ranges, "f", "x").sortWithinPartitions("f", "x")
              .withColumn("at", F.spark_partition_id()).checkpoint(eager=True))
    ship_package(df.sparkSession)
    share = df.sparkSession.sparkContext.broadcast
    sides = share(_range_sides(ranges, k, totals, len(kinds)))
    found = ranges.mapInPandas(_knn_sums(sides, k, totals, len(kinds)), "f int, j int, n double, s double, m long, at int, up double, at2 int, low double").checkpoint(eager=True)
    asked = found.where("at is not null or at2 is not null").withColumn("id", F.monotonically_increasing_id()).checkpoint(eager=True)
    places: dict[int, list] = {}
    for r in asked.select("id", "f", "j", "at", "up", "at2", "low").toLocalIterator():
        for where, v, side in ((r["at"], r["up"], 1), (r["at2"], r["low"], -1)):
            if where is not None:
                places.setdefault(where, []).append((r["id"], r["f"], r["j"], v, side))
    before = ranges.mapInPandas(_rows_before(share(places), sides, len(kinds), totals), "id long, m long").groupBy("id").agg(F.sum("m").alias("more"))
    open_sums = asked.join(before, "id").select("f", "j", "n", (F.col("s") - F.col("n") * digamma(F.col("m") + F.col("more"))).alias("s"))
    sums = found.where("at is null and at2 is null").select("f", "j", "n", "s").unionByName(open_sums).groupBy("f", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    mi = sums.select(F.array(*[F.lit(t) for t in targets])[F.col("j")].alias("target"), names[F.col("f")].alias("feature"),
                     F.greatest(digamma(F.col("n")) + F.col("s") / F.col("n"), F.lit(0.0)).alias("mi"))
    order = Window.partitionBy("target").orderBy(F.desc(F.rint(F.col("mi") * 1e9)), "feature")  # as many rows as features
    return mi.withColumn("rank", F.row_number().over(order)).withColumn("suspicious", (F.col("rank") <= top) & (F.col("mi") > flag))


def _values_by_feature(parts: Iterator):
    """(range, feature, values ascending, counts per kind) of the frames of one task."""
    import pandas as pd

    parts = list(parts)
    for (at, f), d in pd.concat(parts).groupby(["at", "f"], sort=True) if parts else ():
        d = d.sort_values("x")
        yield int(at), int(f), d["x"].to_numpy(), d[[c for c in d.columns if c.startswith("n")]].to_numpy()


def _range_sides(ranges: DataFrame, k: int, totals: dict, n_kinds: int) -> dict:
    """(range, feature) -> (``low``, ``high``: last value before and first value after it, or None;
    ``before``: rows of every kind before it; ``left`` and ``right``: the k nearest values outside
    of every kind with their counts), and feature -> (ranges, their first values)."""
    def ends(parts: Iterator) -> Iterator:
        import pandas as pd

        for at, f, x, n in _values_by_feature(parts):
            has = [n[:, c].nonzero()[0] for c in range(n_kinds)]
            cut = [[h[:k] for h in has], [h[-k:] for h in has]]
            yield pd.DataFrame({"at": [at], "f": [f], "lo": [x[0]], "hi": [x[-1]], "n": [n.sum(axis=0).tolist()],
                                **{f"{e}_x": [[x[h].tolist() for h in hs]] for e, hs in zip(("first", "last"), cut)},
                                **{f"{e}_n": [[n[h, c].tolist() for c, h in enumerate(hs)]] for e, hs in zip(("first", "last"), cut)}})

    schema = "at int, f int, lo double, hi double, n array<long>, " + ", ".join(f"{e}_{v} array<array<{t}>>" for e in ("first", "last") for v, t in (("x", "double"), ("n", "long")))
    rows = ranges.mapInPandas(ends, schema).collect()  # a row per range, and one more per feature at most
    out: dict = {}
    for f in totals:
        own = sorted((r for r in rows if r["f"] == f), key=lambda r: r["at"])
        before, near = [0] * n_kinds, [[] for _ in range(n_kinds)]
        for i, r in enumerate(own):
            out[r["at"], f] = {"low": own[i - 1]["hi"] if i else None, "high": own[i + 1]["lo"] if i + 1 < len(own) else None, "before": before, "left": near}
            before = [a + b for a, b in zip(before, r["n"])]
            near = [(a + list(zip(xs, ns)))[-k:] for a, xs, ns in zip(near, r["last_x"], r["last_n"])]
        near = [[] for _ in range(n_kinds)]
        for r in reversed(own):
            out[r["at"], f]["right"] = near
            near = [(list(zip(xs, ns)) + a)[:k] for a, xs, ns in zip(near, r["first_x"], r["first_n"])]
        out[f] = [r["at"] for r in own], [r["lo"] for r in own]
    return out


def _rows_up_to(n, before: list, j: int, total: list):
    """Rows of target j in the classes of two rows and more, before the first value, after the first, and so on."""
    import numpy as np

    own = [c for c in (2 * j, 2 * j + 1) if total[c] > 1]
    counts = n[:, own].sum(axis=1) if own else np.zeros(len(n), "int64")
    return counts, sum(before[c] for c in own) + np.concatenate([[0], np.cumsum(counts)])


def _knn_sums(sides, k: int, totals: dict, n_kinds: int):
    """Per range, feature and target: the rows, and the sum of p(k) - p(N_y) - p(m) over them;
    where m needs a place in another range, a row per value without p(m), with the part of m
    that is known and the ranges and places to ask for."""
    def psi(a):
        import numpy as np

        t = a + 6.0
        series = np.log(t) - 1 / (2 * t) - 1 / (12 * t**2) + 1 / (120 * t**4) - 1 / (252 * t**6) + 1 / (240 * t**8)
        return series - sum(1 / (a + float(i)) for i in range(6))

    def sums(parts: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for at, f, x, n in _values_by_feature(parts):
            side, (ats, los) = sides.value[at, f], sides.value[f]
            for j in range(n_kinds // 2):
                counts, cum = _rows_up_to(n, side["before"], j, totals[f])
                for c in (2 * j, 2 * j + 1):
                    here, size = n[:, c].nonzero()[0], totals[f][c]
                    if size < 2 or not len(here):
                        continue
                    kk, left, right = min(k, size - 1), side["left"][c], side["right"][c]
                    xs = np.concatenate([[-np.inf] * (k - len(left)), [v for v, _ in left], x[here], [v for v, _ in right], [np.inf] * (k - len(right))])
                    ns = np.concatenate([[0] * (k - len(left)), [w for _, w in left], n[here, c], [w for _, w in right], [0] * (k - len(right))]).astype("int64")
                    own, rows = x[here], n[here, c]
                    shifts = [s for s in range(-k, k + 1) if s]
                    with np.errstate(invalid="ignore"):
                        gap = np.stack([np.zeros(len(own))] + [np.abs(xs[k + s:k + s + len(own)] - own) for s in shifts], axis=1)
                        many = np.stack([rows - 1] + [ns[k + s:k + s + len(own)] for s in shifts], axis=1)
                        nearest = np.argsort(gap, axis=1, kind="stable")
                        enough = np.cumsum(np.take_along_axis(many, nearest, 1), axis=1) >= kk
                        d = np.take_along_axis(gap, np.take_along_axis(nearest, enough.argmax(axis=1)[:, None], 1), 1)[:, 0]
                        up, low = own + d, own - d
                    tied = d == 0
                    # rows before x + d and up to x - d, where no other range is needed
                    far_up = ~tied & ~(up <= side["high"]) if side["high"] is not None else np.zeros(len(own), bool)
                    far_low = ~tied & ~(low >= side["low"]) if side["low"] is not None else np.zeros(len(own), bool)
                    m = np.where(tied, counts[here], np.where(far_up, 0, cum[np.searchsorted(x, up, "left")]) - np.where(far_low, 0, cum[np.searchsorted(x, low, "right")]))
                    base, far = psi(float(kk)) - psi(float(size)), far_up | far_low
                    near = ~far
                    if near.any():
                        yield pd.DataFrame({"f": [f], "j": [j], "n": [float(rows[near].sum())], "s": [float((rows[near] * (base - psi(m[near].astype(float)))).sum())],
                                            "m": [0], "at": pd.array([None], "Int32"), "up": [0.0], "at2": pd.array([None], "Int32"), "low": [0.0]})
                    if far.any():
                        def ask(places, wanted):
                            i = np.searchsorted(los, places, "right") - 1  # the last range that begins at or before a place
                            return pd.array([ats[max(a, 0)] if w else None for a, w in zip(i, wanted)], "Int32")
                        yield pd.DataFrame({"f": f, "j": j, "n": rows[far].astype(float), "s": rows[far] * base, "m": m[far],
                                            "at": ask(up[far], far_up[far]), "up": up[far], "at2": ask(low[far], far_low[far]), "low": low[far]})
    return sums


def _rows_before(places, sides, n_kinds: int, totals: dict):
    """The rows before (side 1), or up to and with (side -1, negative) the places asked for."""
    def answers(parts: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for at, f, x, n in _values_by_feature(parts):
            for j in range(n_kinds // 2):
                wanted = [(i, v, s) for i, g, t, v, s in places.value.get(at, ()) if (g, t) == (f, j)]
                if wanted:
                    cum = _rows_up_to(n, sides.value[at, f]["before"], j, totals[f])[1]
                    m = [s * int(cum[np.searchsorted(x, v, "left" if s > 0 else "right")]) for _, v, s in wanted]
                    yield pd.DataFrame({"id": [w[0] for w in wanted], "m": m})
    return answers


def mutual_information(df: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGETS,
                       bins: int = 10, top: int = 5, flag: float = 0.5) -> DataFrame:
    """Binned mutual information (nats) of each feature with each target.

    Features are cut at their exact quantiles 1/bins ... (bins-1)/bins (one
    aggregate for all cut points); bin = number of cut points below the
    value.  Joint counts come from one ``groupBy``; marginals are windows over
    at most bins x 2 rows per (feature, target).  ``rank`` orders features
    per target; ``suspicious`` = rank <= top and mi > flag."""
    from tavola.functions.stats import quantile_struct

    probs = [i / bins for i in range(1, bins)]
    qs = quantile_struct(df, features, probs)
    cuts = F.struct(*[qs.getField(f"q{i}").alias(f"k{i}") for i in range(len(features))])
    # bin = number of cut points below the value: bins-1 comparisons per
    # feature, no lambda, so the projection stays in generated code.
    bins_cols = []
    for i, f in enumerate(features):
        x = F.col(q(f)).cast("double")
        b = sum((F.when(F.col(f"_cuts.k{i}")[j] < x, 1).otherwise(0) for j in range(bins - 1)), F.lit(0))
        bins_cols.append(F.when(x.isNotNull(), b).alias(f"_b{i}"))
    d = df.select(cuts.alias("_cuts"), *[F.col(q(f)) for f in features], *[F.col(t) for t in targets]) \
        .select(*bins_cols, *[F.col(t).cast("int").alias(f"_y{j}") for j, t in enumerate(targets)])
    # targets are 0/1: one row per feature, keyed by numbers; the class counts of
    # all targets are sums over it
    ys = [f"_y{j}" for j in range(len(targets))]
    rows = [F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("bin")) for i in range(len(features))]
    long = d.select(*ys, F.inline(F.array(*rows))).where(F.col("bin").isNotNull())
    sums = long.groupBy("f", "bin").agg(*[F.count(y).alias(f"n{y}") for y in ys], *[F.sum(y).alias(f"p{y}") for y in ys])
    cells = [F.struct(F.lit(t).alias("target"), F.lit(v).alias("y"), (F.col(f"p{y}") if v else F.col(f"n{y}") - F.col(f"p{y}")).alias("n_by"))
             for t, y in zip(targets, ys) for v in (0, 1)]
    names = F.array(*[F.lit(f) for f in features])
    joint = (sums.select(names[F.col("f")].alias("feature"), "bin", F.inline(F.array(*cells))).where("n_by > 0"))
    g = Window.partitionBy("feature", "target")
    # one projection for the three marginals (one analysis of the wide plan)
    joint = joint.select("*", F.sum("n_by").over(g).alias("n"),
                         F.sum("n_by").over(Window.partitionBy("feature", "target", "bin")).alias("n_b"),
                         F.sum("n_by").over(Window.partitionBy("feature", "target", "y")).alias("n_y"))
    term = (F.col("n_by") / F.col("n")) * F.log((F.col("n_by") * F.col("n")) / (F.col("n_b") * F.col("n_y")))
    mi = joint.groupBy("target", "feature").agg(F.sum(term).alias("mi"))
    # rank on mi rounded to 9 decimals: monotone transforms of one feature
    # (price_std, price_consistency) give the same bins and equal MI up to
    # float noise; ties then break by name on every engine.
    key = F.rint(F.col("mi") * 1e9)
    ranked = mi.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc(key), "feature")))
    return ranked.withColumn("suspicious", (F.col("rank") <= top) & (F.col("mi") > flag))


def suspicious_features(corr_flags: DataFrame, mi_scores: DataFrame) -> DataFrame:
    """Union of the correlation and MI flags, de-duplicated, by score."""
    a = corr_flags.where("suspicious").select("feature", F.col("max_abs_r").alias("score"),
                                               F.lit("correlation").alias("source"))
    b = mi_scores.where("suspicious").select("feature", F.col("mi").alias("score"),
                                              F.lit("mutual_information").alias("source"))
    return a.unionByName(b).distinct().orderBy(F.desc("score"), "feature")


def class_profile(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Mean of each feature for class 1 and class 0, class sizes (one pass)."""
    t = F.col(target)
    aggs = [F.count_if(t == 1).alias("n_1"), F.count_if(t == 0).alias("n_0")]
    for i, f in enumerate(features):
        x = F.col(q(f)).cast("double")
        aggs += [F.avg(F.when(t == 1, x)).alias(f"m1_{i}"), F.avg(F.when(t == 0, x)).alias(f"m0_{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"m1_{i}").alias("mean_1"), F.col(f"m0_{i}").alias("mean_0"),
                     (F.col(f"m1_{i}") - F.col(f"m0_{i}")).alias("difference"))
            for i, f in enumerate(features)]
    return wide.select(F.lit(target).alias("target"), "n_1", "n_0", F.inline(F.array(*rows)))


def find_binary_targets(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Integer/boolean columns with exactly two distinct values, or whose name
    contains 'target', 'label' or 'is_': positives (value 1) and % of rows.
    ``n_distinct`` is 0, 1, 2 or 3 (three or more): two values are a minimum, a
    maximum and none between, so two scans and no shuffle of values."""
    types = dict(df.dtypes)
    cols = [c for c in (cols or df.columns)
            if types[c] in ("boolean", "tinyint", "smallint", "int", "bigint")
            or any(s in c.lower() for s in ("target", "label", "is_"))]
    if not cols:
        return df.limit(0).select(F.lit("").alias("column_name"), F.lit(0).cast("long").alias("n_distinct"), F.lit(0).cast("long").alias("positives"),
                                  F.lit(0.0).alias("pct_positive"), F.lit(False).alias("name_match"))
    ends = df.agg(F.struct(*[a for i, c in enumerate(cols) for a in (F.min(q(c)).alias(f"lo{i}"), F.max(q(c)).alias(f"hi{i}"))]).alias("e")).scalar()
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(cols):
        x = F.col(q(c))
        lo, hi = F.col(f"_e.lo{i}"), F.col(f"_e.hi{i}")
        kinds = (F.when(F.max(lo).isNull(), 0).when(F.max(lo == hi), 1).when(F.count_if((x > lo) & (x < hi)) == 0, 2).otherwise(3))
        aggs += [kinds.cast("long").alias(f"d{i}"), F.count_if(x.cast("double") == 1).alias(f"p{i}")]
    wide = df.select(*[F.col(q(c)) for c in cols]).withColumn("_e", ends).agg(*aggs)
    named = [any(s in c.lower() for s in ("target", "label", "is_")) for c in cols]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("n_distinct"), F.col(f"p{i}").alias("positives"),
                     (F.col(f"p{i}") * 100.0 / F.col("_n")).alias("pct_positive"), F.lit(nm).alias("name_match"))
            for i, (c, nm) in enumerate(zip(cols, named))]
    long = wide.select(F.inline(F.array(*rows)))
    return long.where((F.col("n_distinct") == 2) | F.col("name_match"))


def feature_stats(df: DataFrame, exclude: Sequence[str] = TARGETS, cols: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean of the non-constant numeric non-target columns."""
    cols = [c for c in (cols or numeric_columns(df)) if c not in set(exclude)]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"),
                     F.col(f"av{i}").alias("mean")) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*rows))).where(F.col("min") < F.col("max"))
