"""Exact deduplication (operator 11): frequent digests split from the rest.

1. Every text becomes the SHA-256 digest of its normalised form (each run of
   white space one space); (id, row number, digest) is written once, so texts
   are read once and row numbers stay as they are.
2. Misra-Gries: each task keeps at most ``counters`` digests with lower counts
   and the error e it may have made.  The sums over tasks miss at most E, the
   sum of all e, and E <= N / (counters + 1).  Every digest of at least
   T = 2 N / (counters + 1) rows has a sum of at least T - E, and as the sums add
   up to N at most, no more than ``counters`` + 1 digests reach that: a proven bound.
3. These candidates are verified by exact counts, with the row that stays: an
   aggregate of at most one row per candidate and task.  Those of T rows or more are
   broadcast, and their copies are told in the map side, without a shuffle.
4. The remaining digests, each of fewer than T rows, are shuffled and ranked.

Two texts are equal when their 256-bit digests are.

Cases: a null text counts as empty; an empty text and one of white space only
(a single space) differ.  Null ids come after all others, so a row without an id
stays only where no row of its text has one; of rows that repeat an id and a
text one stays (which, does not show in id and text).  Other columns are
ignored or, with ``carry``, kept, whatever their names are.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.shared import written

COUNTERS = (1 << 14) - 1
RUN = 16_384  # rows that a task gathers before it updates its counters


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def misra_gries(state: pa.Table, more: pa.Table, counters: int) -> tuple[pa.Table, int]:
    """The summary (digest, n) of two summaries, and by how much counts fell."""
    both = pa.concat_tables([state, more]).group_by("digest").aggregate([("n", "sum")]).rename_columns(["digest", "n"])
    if both.num_rows <= counters:
        return both, 0
    n = both["n"].to_numpy()
    cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])  # the largest count beyond the counters
    both = both.set_column(1, "n", pc.subtract(both["n"], cut))
    return both.filter(pc.greater(both["n"], 0)), cut


def frequent(digests: DataFrame, counters: int = COUNTERS) -> tuple[DataFrame, float]:
    """(digest) of every digest with at least T rows, and some below it, at most
    ``counters`` + 1 in all; and T."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        state, error, held, rows = empty, 0, [], 0
        for b in batches:
            held.append(b.column(0))
            rows += b.num_rows
            if rows >= RUN:
                state, cut = misra_gries(state, _ones(held), counters)
                error, held, rows = error + cut, [], 0
        state, cut = misra_gries(state, _ones(held), counters)
        out = pa.concat_tables([state, pa.table({"digest": pa.array([None], pa.binary()), "n": pa.array([error + cut], pa.int64())})])
        yield from out.combine_chunks().to_batches()

    sums = written(digests.select("digest").mapInArrow(summaries, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")), "dedup-frequent")
    total = digests.count()
    missed = sums.where("digest is null").select(F.coalesce(F.sum("n"), F.lit(0)).alias("e")).first()["e"]
    least = 2 * total / (counters + 1)
    return sums.where(F.col("digest").isNotNull() & (F.col("n") >= max(least - missed, 1))).select("digest"), least


def _ones(held: list[pa.Array]) -> pa.Table:
    digest = pa.chunked_array(held, pa.binary())
    return pa.table({"digest": digest, "n": pa.array(np.ones(len(digest), np.int64))})


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (id of the row that stays),
    group_size, kept and text_sha256; with ``carry``, the row itself as ``row``."""
    rows = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
                               F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
                               *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else [])), "dedup-digests")
    candidates, least = frequent(rows, counters)
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid")).alias("winner")
    verified = (rows.select("digest", "doc_id", "rid").join(F.broadcast(candidates), "digest", "left_semi")
                .groupBy("digest").agg(winner, F.count("*").alias("group_size")).where(F.col("group_size") >= least))
    verified = written(verified, "dedup-winners")  # at most counters + 1 rows
    hot = rows.join(F.broadcast(verified), "digest")
    rest = rows.join(F.broadcast(verified.select("digest")), "digest", "left_anti")
    own = Window.partitionBy("digest")
    rest = rest.withColumn("winner", F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid")).over(own)).withColumn("group_size", F.count("*").over(own))
    return hot.unionByName(rest).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("winner.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *(["row"] if carry else []))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs, in its own columns, without copies of a text."""
    return exact_groups(docs, key, text, carry=True, counters=counters).where("kept").select("row.*")
