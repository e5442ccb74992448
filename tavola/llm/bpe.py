"""Byte-level BPE encoding and decoding (operator 8).

Encoding: texts become blocks of pre-tokens with their positions; every block
sends its distinct words through one global shuffle by word, each distinct
word is encoded once there, the ids join back to the blocks and are put
together again by position.  Decoding joins the token-byte table, whose size
is fixed by the vocabulary.

Cases: a null text is empty and has no ids; rows with a null or repeated
doc_id are encoded each for itself; any other column is ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tavola.llm import blocks as B
from tavola.llm import textkernel as K


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Buckets of words by hash; a bucket of a block is one row of the word shuffle.
BUCKETS = 512
#: Distinct words whose ids a task keeps at hand; beyond it words are encoded anew.
CACHE_WORDS = 400_000


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, B.Block]]:
    """Blocks with a key of task, ordinal and content, the same in every computation."""
    part = TaskContext.get().partitionId()
    for i, b in enumerate(B.blocks(batches, "text", "pretokens")):
        content = int(np.bitwise_xor.reduce(K.mix(b.codes.astype(np.uint64) * np.uint64(31) + np.arange(len(b.codes), dtype=np.uint64)), initial=0))
        key = 0
        for x in (part, i, len(b.codes), len(b.words), content):
            key = int(K.mix(np.array([key ^ x], np.uint64))[0])
        yield key - (1 << 63), b


def _by_bucket(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local codes in bucket order, and where each bucket begins."""
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(BUCKETS + 1))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of every block, exploded over the buckets."""
    for key, b in _keyed(batches):
        order, at = _by_bucket(b.hashes)
        order = order.tolist()
        out = [(k, B.pack_items([b.words[c] for c in order[at[k]: at[k + 1]]])) for k in range(BUCKETS) if at[k + 1] > at[k]]
        yield pa.record_batch({"block": pa.array(np.full(len(out), key)), "bucket": pa.array([k for k, _ in out], pa.int32()),
                               "words": pa.array([w for _, w in out], pa.binary())})


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions: the block's texts as sequences of local codes."""
    for key, b in _keyed(batches):
        order, at = _by_bucket(b.hashes)
        yield pa.record_batch({"block": pa.array([key]), "doc_ids": pa.array([b.rows["doc_id"].to_pylist()], pa.list_(pa.int64())),
                               "begin": pa.array([b.begin], pa.list_(pa.int64())), "codes": pa.array([B.pack_codes(b.codes)], pa.binary()),
                               "in_order": pa.array([B.pack_codes(order)], pa.binary()), "bucket_at": pa.array([at], pa.list_(pa.int64()))})


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id and ids, a binary of
    little-endian unsigned 32-bit token ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern)
        known: dict[bytes, list[int]] = {}
        now = None
        for b in batches:  # sorted by bucket: equal words meet in one task, one bucket after the other
            for block, bucket, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if bucket != now or len(known) > CACHE_WORDS:
                    now, known = bucket, {}
                ids, lens = [], []
                for w in B.unpack_items(packed):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = enc.encode_ordinary(w.decode("utf-8", "replace"))
                    ids += got
                    lens.append(len(got))
                yield pa.record_batch({"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()),
                                       "ids": pa.array([B.pack_codes(np.array(ids, np.int64))], pa.binary()),
                                       "lens": pa.array([B.pack_codes(np.array(lens, np.int64))], pa.binary())})

    coded = (docs.mapInArrow(_word_rows, "block long, bucket int, words binary")
             .repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(encode_words, "block long, bucket int, ids binary, lens binary"))
    seqs = docs.mapInArrow(_code_rows, "block long, doc_ids array<long>, begin array<long>, codes binary, in_order binary, bucket_at array<long>")
    return seqs.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_reassemble, "doc_id long, ids binary")


def _reassemble(seq: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's texts by position, from its codes and its buckets' ids."""
    changed = RuntimeError("a block and its dictionary do not match: the input's rows changed between two reads")
    if seq.num_rows != 1:
        raise changed
    order = B.unpack_codes(seq["in_order"][0].as_py())
    at = np.array(seq["bucket_at"][0].as_py(), np.int64)
    words = words.sort_by("bucket")
    if not np.array_equal(words["bucket"].to_numpy(), np.flatnonzero(np.diff(at))):
        raise changed
    ids = [B.unpack_codes(x).astype("<u4") for x in words["ids"].to_pylist()]
    lens = [B.unpack_codes(x) for x in words["lens"].to_pylist()]
    doc_ids, begin = seq["doc_ids"][0].as_py(), np.array(seq["begin"][0].as_py(), np.int64)
    del words
    if not len(order):
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": B.binary_column(np.zeros(0, "<u4"), np.zeros(len(begin), np.int64))})
    n = np.concatenate(lens)
    if len(n) != len(order):
        raise changed
    flat = np.concatenate(ids)
    starts, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    size[order] = n
    starts[order] = np.cumsum(n) - n
    codes = B.unpack_codes(seq["codes"][0].as_py())
    outs, ats, base = [], [np.zeros(1, np.int64)], 0
    for lo in range(0, len(codes), 250_000):
        got, a = B.gather(flat, starts, size, codes[lo: lo + 250_000])
        outs.append(got)
        ats.append(a[1:] + base)
        base += a[-1]
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": B.binary_column(np.concatenate(outs), np.concatenate(ats)[begin])})


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``, by joining the token-byte table
    (one entry per rank, so its size is fixed)."""
    spark: SparkSession = encoded.sparkSession
    size = max(ranks.values(), default=-1) + 1
    lens = np.zeros(size, np.int64)
    for w, i in ranks.items():
        lens[i] = len(w)
    starts = np.zeros(size, np.int64)
    np.cumsum(lens[:-1], out=starts[1:])
    table = np.zeros(int(lens.sum()), np.uint8)
    for w, i in ranks.items():
        table[starts[i]: starts[i] + len(w)] = np.frombuffer(w, np.uint8)
    shared = spark.sparkContext.broadcast((table, starts, lens))
    at_ids = encoded.columns.index("ids")

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab, st, ln = shared.value
        for b in batches:
            for lo, hi in _slices(b.column(at_ids)):
                part = b.slice(lo, hi - lo)
                col = part.column(at_ids).cast(pa.large_binary()).fill_null(b"")
                offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
                flat = np.frombuffer(col.buffers()[2], np.uint8)[offs[0]: offs[-1]].view("<u4") if offs[-1] > offs[0] else np.zeros(0, "<u4")
                got, at = B.gather(tab, st, ln, flat)
                yield pa.RecordBatch.from_arrays([*part.columns, B.binary_column(got, at[(offs - offs[0]) // 4])], [*part.schema.names, "decoded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary"
    return encoded.mapInArrow(join_bytes, schema)


def _slices(col: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc
    n = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
    lo, size = 0, 0
    for i, k in enumerate(n.tolist()):
        if size and size + k > limit:
            yield lo, i
            lo, size = i, 0
        size += k
    if lo < len(n):
        yield lo, len(n)
