"""Hard-negative mining (operator 13): secondary-sort shuffle of packed scores.

1. Rows that take part are written once with a row number and dealt into groups
   of about ``group_rows`` rows by a hash of it; the anchors, a stated query set,
   into groups of about ``group_anchors``.  Every pair of groups meets in one task
   (blocks of a query set against all rows), where a matrix product scores it.
2. First sweep: a block's best positives of each anchor, merged by their rank to
   the anchor's first ``positives`` over all blocks.
3. Second sweep: a block's first ``negatives`` rows of another label in the score
   window of each positive.  A row that is not among the first of its block is not
   among the first of all, so nothing is lost and no block sends more than
   ``positives`` x ``negatives`` pairs per anchor.
4. Pairs are packed into byte keys (anchor, descending score, positives first, id)
   whose byte order is the wanted order, dealt by anchor and sorted by
   ``repartitionAndSortWithinPartitions`` (external, it spills).  One iterator
   reads the keys: a positive opens a window, a row of another label goes to every
   open window it fits, a window closes when it is full or the score falls below it.
   It holds the open windows of one anchor only.

Scores are exact integers: blocks are multiplied in double precision where no
sum can reach 2^53, else in Python integers.  Scores beyond 64 bits are held at
its ends.

Cases: rows with a null label, a null vector, or any null or non-finite component
take no part; a null id is never an anchor and comes after all ids; rows that
repeat an id are rows of their own, and an anchor is no partner of itself only as
a row; among equal scores and ids the order is that of the written rows, which the
result does not show.  Vectors of other lengths count as filled with zeros.  An
anchor without positives, and a positive without negatives in its window, give no
rows, as an empty table does.  Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.shared import written

GROUP_ROWS, GROUP_ANCHORS, CHUNK = 16_384, 8_192, 256
LOW, HIGH = -(1 << 63), (1 << 63) - 1
KEY = ">QQQ??QQ"  # anchor id and row, score, not a positive, null id, id and row
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(table: DataFrame, vec: str = "embedding") -> Column:
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("label").isNotNull() & F.col(vec).isNotNull() & ~bad


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of list rows, filled with zeros to ``width`` columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``, held within 64 bits."""
    top = (float(np.abs(a).max()) if a.size else 0.0) * (float(np.abs(b).max()) if b.size else 0.0) * max(a.shape[1], 1)
    if top < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(big(a) @ big(b).T, LOW, HIGH).astype(np.int64)


def _first(score: np.ndarray, order: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the columns ``at``, the first k by descending score and ascending order."""
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((order[at], -score[at]))][:k]


def window_bounds(p: int, low: int, den: int) -> tuple[int, int]:
    """Scores n with low * p <= den * n <= den * p; exact for any integers."""
    return -(-low * p // den), p


def blocks(rows: DataFrame, anchors: DataFrame, fn, schema: str, group_rows: int, group_anchors: int, n_rows: int, n_anchors: int) -> DataFrame:
    """fn over every pair of a group of rows and a group of anchors."""
    g, h = -(-n_rows // group_rows) or 1, -(-n_anchors // group_anchors) or 1
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return (deal(rows, "g", g, "h", h).groupBy("g", "h")
            .cogroup(deal(anchors, "h", h, "g", g).groupBy("g", "h")).applyInArrow(fn, schema))


class _Block:
    """The rows and anchors of one block, rows ascending by (null id, id, row)."""

    def __init__(self, rows: pa.Table, anchors: pa.Table) -> None:
        width = max([int(t["embedding"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) if t.num_rows else 0 for t in (rows, anchors)])
        self.null = rows["vec_id"].is_null().to_numpy()
        self.id = rows["vec_id"].fill_null(0).to_numpy()
        self.rid, self.label = rows["rid"].to_numpy(), rows["label"].to_numpy()
        self.order = np.empty(rows.num_rows, np.int64)
        self.order[np.lexsort((self.rid, self.id, self.null))] = np.arange(rows.num_rows)
        self.rows, self.anchors = matrix(rows["embedding"], width), matrix(anchors["embedding"], width)
        self.a_id, self.a_rid, self.a_label = (anchors[c].to_numpy() for c in ("vec_id", "rid", "label"))

    def scores(self) -> Iterator[tuple[int, np.ndarray]]:
        if len(self.id):
            for lo in range(0, len(self.anchors), CHUNK):
                yield from enumerate(products(self.anchors[lo: lo + CHUNK], self.rows), lo)


def mine(table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, den: int = 100, vec: str = "embedding",
         group_rows: int = GROUP_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """Hard negatives of table(vec_id, label, ``vec``) for the rows where ``anchor`` holds: for each
    of an anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other labels with
    low * positive_score <= den * negative_score <= den * positive_score."""
    rows = written(table.where(usable(table, vec)).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                                           F.col(vec).alias("embedding"), F.coalesce(anchor & F.col("vec_id").isNotNull(), F.lit(False)).alias("anchor")), "negatives-rows")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    sides = rows.drop("anchor"), rows.where("anchor").drop("anchor")

    def best(r: pa.Table, a: pa.Table) -> pa.Table:
        b, out = _Block(r, a), []
        for k, s in b.scores():
            at = _first(s, b.order, np.flatnonzero((b.label == b.a_label[k]) & (b.rid != b.a_rid[k])), positives)
            out += [(int(b.a_rid[k]), int(s[i]), None if b.null[i] else int(b.id[i]), int(b.rid[i])) for i in at]
        return _table(out, ["a_rid", "score", "id", "rid"])

    found = blocks(*sides, best, "a_rid long, score long, id long, rid long", group_rows, group_anchors, n_rows, n_anchors)
    first = Window.partitionBy("a_rid").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "rid")
    firsts = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    chosen = firsts.groupBy(F.col("a_rid").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("k", "score", "id", F.col("rid").alias("rid")))).alias("p"))
    asked = written(sides[1].join(chosen, "rid"), "negatives-anchors")

    def pairs(r: pa.Table, a: pa.Table) -> pa.Table:
        b, out, p = _Block(r, a), [], a["p"].to_pylist()
        for k, s in b.scores():
            other, took = b.label != b.a_label[k], set()
            for one in p[k]:
                least, most = window_bounds(one["score"], low, den)
                if least <= most:
                    took.update(_first(s, b.order, np.flatnonzero(other & (s >= max(least, LOW)) & (s <= most)), negatives).tolist())
            out += [struct.pack(KEY, int(b.a_id[k]) - LOW, int(b.a_rid[k]), HIGH - int(s[i]), True, bool(b.null[i]), int(b.id[i]) - LOW, int(b.rid[i])) for i in sorted(took)]
        return pa.table({"key": pa.array(out, pa.binary())})

    def positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [struct.pack(KEY, i - LOW, rid, HIGH - one["score"], False, one["id"] is None, (one["id"] or 0) - LOW, one["rid"])
                   for i, rid, p in zip(*(b.column(c).to_pylist() for c in ("vec_id", "rid", "p"))) for one in p]
            yield pa.record_batch({"key": pa.array(out, pa.binary())})

    packed = blocks(sides[0], asked, pairs, "key binary", group_rows, group_anchors, n_rows, n_anchors)
    packed = packed.unionByName(asked.select("vec_id", "rid", "p").mapInArrow(positive_keys, "key binary"))
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = packed.rdd.map(lambda r: (bytes(r[0]), None))
    dealt = keyed.repartitionAndSortWithinPartitions(parts, lambda key: int.from_bytes(key[8:16], "big") * 0x9E3779B97F4A7C15 % (1 << 64) >> 20)
    return spark.createDataFrame(dealt.mapPartitions(lambda it: stream((k for k, _ in it), negatives, low, den)), RESULT)


def stream(keys: Iterator[bytes], negatives: int, low: int, den: int) -> Iterator[tuple]:
    """Result rows of ascending keys; holds one anchor's open windows."""
    now, open_windows = None, []
    for key in keys:
        a, a_rid, score, negative, nameless, i, _ = struct.unpack(KEY, key)
        if (a, a_rid) != now:
            now, open_windows = (a, a_rid), []
        score, i = HIGH - score, None if nameless else i + LOW
        if not negative:
            open_windows.append([score, i, 0])
            continue
        for w in open_windows:
            if low * w[0] <= den * score <= den * w[0]:
                w[2] += 1
                yield a + LOW, w[1], w[2], i, w[0], score
        open_windows = [w for w in open_windows if w[2] < negatives and low * w[0] <= den * score]


def _table(out: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*out)) if out else [[]] * len(names)
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(names, cols)})
