"""Ranking helpers that never put a whole group into one task.

``Window.partitionBy(g).orderBy(...)`` sends every row of a group to one
task; with a group holding a third of all rows that task holds a third of
the data.  The helpers below keep per-task work bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column],
                    n: int, salt_buckets: int | None = None, rank_col: str = "rank") -> DataFrame:
    """Exact top ``n`` rows per group, ordered by ``order_cols`` (which must be
    a total order, e.g. end with a unique tie-break column).

    Two levels: rows are spread over ``salt_buckets`` sub-groups by a hash of
    the whole row, the top ``n`` of each sub-group are kept, then the top
    ``n`` of those per group.  The global top ``n`` is always inside the union
    of the sub-group tops, so the result is exact, and the second window sees
    at most ``n * salt_buckets`` rows per group.
    """
    group_cols = list(group_cols)
    if salt_buckets is None:
        salt_buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (df.withColumn("_salt", salt)
            .withColumn("_r1", F.row_number().over(w1))
            .where(F.col("_r1") <= n)
            .withColumn(rank_col, F.row_number().over(w2))
            .where(F.col(rank_col) <= n)
            .drop("_salt", "_r1"))


def global_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                out: str = "rank0", num_partitions: int | None = None) -> DataFrame:
    """0-based row number within ``group_cols`` ordered by ``order_cols``
    (a total order), without a per-group window.

    Rows are range-partitioned on (group, order) and sorted inside each
    partition; ``monotonically_increasing_id`` then encodes (partition,
    position).  Per (partition, group) the first position and row count form
    a table of at most partitions + groups rows; its running sums give each
    partition's offset, and rank = offset + position - first.  Every task
    handles one range partition, however large a group is.  The sorted,
    numbered rows are checkpointed (reliable checkpoint in the shared
    ``spark.checkpoint.dir``), so positions are fixed and lineage is cut.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    if num_partitions is None:
        num_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
    part = (df.repartitionByRange(num_partitions, *group_cols, *order_cols)
            .sortWithinPartitions(*group_cols, *order_cols)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id())
            .checkpoint(eager=True))
    # the ids rise within a partition: the position is the distance from its first
    start = part.groupBy("_pid").agg(F.min("_mid").alias("_start"))
    part = part.join(start, "_pid").withColumn("_pos", F.col("_mid") - F.col("_start")).drop("_start")
    # Partition-level summary: bounded by the number of partitions.
    summ = (part.groupBy("_pid", *group_cols)
            .agg(F.min("_pos").alias("_first"), F.count("*").alias("_cnt")))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # No forced broadcast: the summary has one row per (partition, group), so
    # AQE broadcasts it when it is small and shuffles it otherwise.
    joined = part.join(summ.select("_pid", *group_cols, "_first", "_off"),
                       on=["_pid", *group_cols], how="inner")
    return (joined.withColumn(out, F.col("_off") + F.col("_pos") - F.col("_first"))
            .drop("_mid", "_pid", "_pos", "_first", "_off"))


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order_col: str, sum_cols: Sequence[str],
                descending: bool = True, num_partitions: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Running sums of ``sum_cols`` within each group in ``order_col`` order
    (rows unbounded preceding .. current), with every task bounded.

    Rows are range-partitioned on (group, order); inside each range
    partition a window keyed by (partition id, group) gives local running
    sums; per (partition, group) totals (at most partitions + groups rows)
    give each partition's offset, added back by a join.  ``order_col`` must
    be unique within a group (aggregate to distinct values first)."""
    group_cols = list(group_cols)
    if num_partitions is None:
        num_partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    part = (df.repartitionByRange(num_partitions, *[F.col(g) for g in group_cols], o)
            .withColumn("_pid", F.spark_partition_id())
            .checkpoint(eager=True))
    w = (Window.partitionBy("_pid", *group_cols).orderBy(o)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = part.select("*", *[F.sum(c).over(w).alias(f"_l_{c}") for c in sum_cols])
    tot = part.groupBy("_pid", *group_cols).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    ow = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", *group_cols, *[F.coalesce(F.sum(f"_t_{c}").over(ow), F.lit(0)).alias(f"_o_{c}")
                                            for c in sum_cols])
    side = off.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)],
                      *[f"_o_{c}" for c in sum_cols])
    same = [F.col("_pid") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group_cols)]]
    out = local.join(side, on=same)  # a null group is a group
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{prefix}{c}") for c in sum_cols])
