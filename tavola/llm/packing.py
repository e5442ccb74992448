"""Packing (operator 3): cutting-stock column generation over the length
histogram of the documents' last pieces.

A document's token ids (and its end id) are cut into pieces of the full
capacity and one shorter rest.  Lengths are counted in classes of ``unit``
tokens.  On the histogram of classes (its size does not depend on the data) a
linear program over packing patterns is solved by column generation: a
knapsack dynamic program prices new patterns.  The rounded-down patterns and a
first-fit-decreasing plan for the rest give every class intervals of ranks;
Spark ranks the pieces of a class and looks their interval up.

Cases: a null or empty text is the end id alone; rows with a null or repeated
doc_id are packed each for itself; other columns are ignored; an empty table
gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm import blocks as B
from tavola.llm.shared import trimmed, written

CAPACITY = 2048
UNIT = 4
#: Words whose ids a worker keeps at hand (about 40 MB); beyond it they are encoded anew.
CACHE_WORDS = 1_000_000
BLOCK_BYTES = 3 << 20

PIECE = "doc_id long, doc_tokens long, start long, length long, ids binary"
_worker: dict = {}


class _Known:
    """Ids of words that a worker has encoded: sorted hashes, and where their ids lie."""

    def __init__(self) -> None:
        self.hash, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and whether they are there."""
        at = np.searchsorted(self.hash, h)
        there = at < len(self.hash)
        there[there] = self.hash[at[there]] == h[there]
        return at, there

    def add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(h)
        at = np.searchsorted(self.hash, h[order])
        start = len(self.ids) + np.cumsum(size) - size
        self.hash, self.start, self.size = (np.insert(old, at, new[order]) for old, new in ((self.hash, h), (self.start, start), (self.size, size.astype(np.int32))))
        self.ids = np.concatenate([self.ids, ids])


def _tokenizer(config: str):
    if _worker.get("config") != config:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(config)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        _worker.update(config=config, tokenizer=t, known=_Known())
    return _worker["tokenizer"]


def _word_ids(words: list[bytes], hashes: np.ndarray, config: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An array of ids, and where the ids of each distinct word begin there and how many it has."""
    tok = _tokenizer(config)
    at, there = _worker["known"].find(hashes)
    if len(_worker["known"].hash) + np.count_nonzero(~there) > CACHE_WORDS:
        _worker["known"], there = _Known(), np.zeros(len(words), bool)
    known, new = _worker["known"], np.flatnonzero(~there)
    if len(new):
        sizes, ids = [], []
        for lo in range(0, len(new), 10_000):
            got = [e.ids for e in tok.encode_batch_fast([words[i].decode("utf-8", "replace") for i in new[lo: lo + 10_000].tolist()], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        known.add(hashes[new], np.concatenate(sizes), np.concatenate(ids))
        at, _ = known.find(hashes)
    return known.ids, known.start[at], known.size[at].astype(np.int64)


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of every row of docs(doc_id, text); ``ids`` is a binary of
    little-endian unsigned 32-bit ids.  The tokenizer must be byte-level with
    the split pattern of ``textkernel.pretokens``; each distinct word of a block
    is encoded once."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.blocks(batches, "text", "pretokens", BLOCK_BYTES):
            flat, starts, lens = _word_ids(b.words, b.hashes, shared.value)
            doc = b.rows["doc_id"].combine_chunks()
            lo = 0
            while lo < len(doc):  # some rows at a time, about 250,000 words
                hi = min(max(lo + 1, int(np.searchsorted(b.begin, b.begin[lo] + 250_000, side="right")) - 1), len(doc))
                got, at = B.gather(flat, starts, lens, b.codes[b.begin[lo]: b.begin[hi]])
                first = at[b.begin[lo: hi + 1] - b.begin[lo]]
                ids = np.insert(got, first[1:], end_id)  # the end id after each text
                first = first + np.arange(hi - lo + 1)
                n = np.diff(first)
                k = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), k)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * capacity
                length = np.minimum(n[row] - start, capacity)
                cut = np.append(first[row] + start, first[-1])
                yield pa.record_batch([doc.slice(lo, hi - lo).take(pa.array(row)), pa.array(n[row]), pa.array(start), pa.array(length), B.binary_column(ids, cut)],
                                      names=["doc_id", "doc_tokens", "start", "length", "ids"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(rows), PIECE)


# --- cutting stock on the histogram ------------------------------------------

def _price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    good = value > 1e-12
    v, s, which = value[good], size[good], np.flatnonzero(good)
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], fits[c]
        if k:
            gain = v[:k] + best[c - s[:k]]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], pick[c] = gain[j], j
    pattern = np.zeros(len(value), np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[which[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[capacity]), pattern


def _first_basis(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: fill a pattern with the largest classes left and use it
    until one of them ends; later patterns lack that class, so the matrix is
    triangular."""
    left, m = demand.astype(float).copy(), len(size)
    a, x = np.zeros((m, m), np.int64), np.zeros(m)
    open_ = np.ones(m, bool)
    for k in range(m):
        room = capacity
        for i in np.flatnonzero(open_)[::-1]:
            if size[i] <= room:
                n = int(min(room // size[i], max(1, np.ceil(left[i]))))
                a[i, k] = n
                room -= n * size[i]
        used = np.flatnonzero(a[:, k])
        ratio = left[used] / a[used, k]
        x[k] = ratio.min()
        left[used] -= x[k] * a[used, k]
        last = used[ratio.argmin()]
        left[last] = 0
        open_[last] = False
    return a, x


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-3, most: int = 4_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts of the cutting-stock
    linear program min sum(x), A x = demand, ended when the volume bound or
    Farley's bound says the value is within ``tolerance`` of the optimum (or after
    ``most`` columns: every step is feasible).  ``size`` is ascending."""
    a, x = _first_basis(size, demand, capacity)
    inv = np.linalg.inv(a.astype(float))
    sound = a.copy(), x.copy()
    bound = size @ demand / capacity
    calm, weight = size / capacity, 0.9  # the duals if nothing were wasted; prices are drawn towards them
    for step in range(most):
        dual = inv.sum(axis=0)
        value, new = _price(weight * calm + (1 - weight) * dual, size, capacity)
        if dual @ new <= 1 + 1e-9:  # the drawn prices found nothing
            value, new = _price(dual, size, capacity)
            bound = max(bound, x.sum() / max(value, 1.0))
            calm, weight = dual / max(value, 1.0), weight * 0.8
            if value <= 1 + 1e-9:
                break
        if x.sum() <= (1 + tolerance) * bound:
            break
        way = inv @ new
        ratio = np.full(len(x), np.inf)
        ok = way > max(1e-9, 1e-7 * np.abs(way).max())
        ratio[ok] = np.maximum(x[ok], 0) / way[ok]
        close = np.flatnonzero(ratio <= ratio.min() * (1 + 1e-9) + 1e-9)
        out = int(close[way[close].argmax()])  # of equal steps the one with the largest pivot
        t = ratio[out]
        x -= t * way
        x[out] = t
        a[:, out] = new
        row = inv[out] / way[out]
        inv -= np.outer(way, row)
        inv[out] = row
        if step % 300 == 299:  # against rounding
            try:
                inv = np.linalg.inv(a.astype(float))
            except np.linalg.LinAlgError:  # rounding has spoilt the basis: the last sound one is feasible, too
                return sound[0], np.maximum(sound[1], 0)
            x = inv @ demand
            sound = a.copy(), x.copy()
    return a, np.maximum(x, 0)


def patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(number of each class, copies) that use every piece once: the program's
    patterns rounded down, then first fit decreasing for what is left."""
    a, x = column_generation(size, demand.astype(float), capacity)
    copies = np.floor(x + 1e-6).astype(np.int64)
    left = demand - a @ copies
    while (left < 0).any():  # a count rounded up by the margin above
        p = int(np.flatnonzero((a[left < 0] > 0).any(axis=0) & (copies > 0))[0])
        copies[p] -= 1
        left = demand - a @ copies
    out = [({int(size[i]): int(a[i, p]) for i in np.flatnonzero(a[:, p])}, int(copies[p])) for p in range(len(copies)) if copies[p]]
    bins: list[tuple[dict[int, int], int]] = []
    room: list[int] = []
    for i in np.argsort(-size):
        n, s = int(left[i]), int(size[i])
        for j in range(len(room)):
            if not n:
                break
            k = min(n, room[j] // s)
            if k:
                bins[j][0][s] = bins[j][0].get(s, 0) + k
                room[j] -= k * s
                n -= k
        while n:
            k = min(n, capacity // s)
            bins.append(({s: k}, 1))
            room.append(capacity - k * s)
            n -= k
    return out + bins


def assign(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """pieces(length, any other columns) with sequence_id and offset."""
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece's rank among its task's pieces of the same class."""
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity // unit + 2, np.int64)
        for b in batches:
            c = -(-b.column(b.schema.get_field_index("length")).to_numpy() // unit)
            order = np.argsort(c, kind="stable")
            rank = np.empty(len(c), np.int64)
            rank[order] = np.arange(len(c)) - np.searchsorted(c[order], c[order])
            rank += seen[c]
            seen += np.bincount(c, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c, pa.int32()), pa.array(np.full(len(c), task), pa.int32()), pa.array(rank)],
                                             [*b.schema.names, "_class", "_task", "_rank"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.select(*keep).dtypes)
    rows = written(pieces.select(*keep).mapInArrow(trimmed(ranked), kinds + ", _class int, _task int, _rank long"), "pieces")
    per_task = rows.groupBy("_class", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_class").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("_class", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    hist = sorted((r["_class"], r["n"]) for r in per_task.groupBy("_class").agg(F.sum("_n").alias("n")).collect())  # capacity / unit rows at most
    plan = patterns(np.array([c for c, _ in hist]), np.array([n for _, n in hist]), capacity // unit) if hist else []
    table: dict[int, list[tuple[int, int, int, int]]] = {c: [] for c, _ in hist}  # class: first rank, number in a sequence, first sequence, place
    done = dict.fromkeys(table, 0)
    sequence = 0
    for pattern, copies in plan:
        place = 0
        for c in sorted(pattern, reverse=True):
            table[c].append((done[c], pattern[c], sequence, place))
            done[c] += pattern[c] * copies
            place += pattern[c]
        sequence += copies
    lookup = {c: np.array(v, np.int64).T for c, v in table.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(lookup)  # patterns and classes do not grow with the data

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(b.schema.get_field_index("_class")).to_numpy()
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy() + b.column(b.schema.get_field_index("_before")).to_numpy()
            seq, place = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                at = np.flatnonzero(c == k)
                first, number, base, slot = shared.value[int(k)]
                j = np.searchsorted(first, rank[at], side="right") - 1
                r = rank[at] - first[j]
                seq[at] = base[j] + r // number[j]
                place[at] = slot[j] + r % number[j]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in key], b.column(b.schema.get_field_index("length")), pa.array(seq), pa.array(place)],
                                             [*key, "_length", "sequence_id", "_place"])

    # places are found on narrow rows; the pieces with their ids are shuffled once, to meet them
    key = ["_class", "_task", "_rank"]
    narrow = rows.select(*key, F.col("length").cast("long").alias("length")).join(offsets, ["_class", "_task"])
    out = narrow.mapInArrow(trimmed(placed), "_class int, _task int, _rank long, _length long, sequence_id long, _place long")
    earlier = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum("_length").over(earlier), F.lit(0)).cast("long")).select(*key, "sequence_id", "offset")
    return rows.join(out, key).select(*keep, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ids, their sequence and where they begin in it."""
    return assign(tokenize(docs, tokenizer_path, capacity), capacity)
