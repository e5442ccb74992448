"""Blocks of documents with their own dictionary.

A block is a run of whole rows of one task (about ``block_bytes`` of text, one
row at least).  Its distinct words get local codes by falling frequency, so a
block is (dictionary, code sequence); only the dictionary takes part in global
shuffles and a word that fills a third of the corpus costs one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from tavola.llm import textkernel as K

BLOCK_BYTES = 5 << 20
CODEC = "zstd"


@dataclass
class Block:
    rows: pa.Table          # the other columns of the block's rows
    codes: np.ndarray       # local code of every word
    begin: np.ndarray       # first word of each row, and the end
    words: list[bytes]      # word of each local code
    hashes: np.ndarray      # and its hash


def _spans_pre(data, offs):
    return (data, *K.pretokens(data, offs))


def _spans_words(data, offs):
    w = K.Words(data, offs, lower=True)
    return w.data, w.starts, w.ends, w.hashes(), w.rows


#: How a text is cut: matches of the byte-level split pattern, or A-Z-lowered words.
SPANS: dict[str, Callable] = {"pretokens": _spans_pre, "words": _spans_words}


def blocks(batches: Iterator[pa.RecordBatch], text: str, cut: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a task's rows; null texts are empty."""
    held: list[tuple] = []
    size = 0

    def done() -> Block:
        begin = [np.zeros(1, np.int64)]
        n = 0
        for *_, rows in held:
            begin.append(rows[1:] + n)
            n += rows[-1]
        codes, uniq, first = _factorise(np.concatenate([h[4] for h in held]) if held else np.zeros(0, np.uint64))
        words: list[bytes] = [b""] * len(uniq)
        sizes = np.cumsum([0] + [len(h[4]) for h in held])
        part = np.searchsorted(sizes, first, side="right") - 1
        for i, (p, f) in enumerate(zip(part.tolist(), first.tolist())):
            _, data, starts, ends, _, _ = held[p]
            j = f - sizes[p]
            words[i] = data[starts[j]: ends[j]]
        return Block(pa.concat_tables([h[0] for h in held]), codes, np.concatenate(begin), words, uniq)

    for b in batches:
        t = pa.Table.from_batches([b])
        col, rest = t[text], t.drop_columns([text])
        for lo, hi, data, offs in K.text_chunks(col):
            d, starts, ends, h, rows = SPANS[cut](data, offs)
            held.append((rest.slice(lo, hi - lo), d.tobytes(), starts, ends, h, rows))
            size += len(data)
            if size >= block_bytes:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def _factorise(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by falling frequency, the hash of each code and where it first stands."""
    codes, uniq = pd.factorize(h)
    n = np.bincount(codes, minlength=len(uniq))
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(uniq), np.int64)
    rank[order] = np.arange(len(uniq))
    first = np.full(len(uniq), -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return rank[codes], np.asarray(uniq, np.uint64)[order], first[order]


def pack_codes(a: np.ndarray, width: int = 4) -> bytes:
    """Unsigned integers as compressed byte planes."""
    raw = np.ascontiguousarray(a.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=CODEC, asbytes=True) if raw else b""


def unpack_codes(b: bytes, width: int = 4) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    raw = pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec=CODEC, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of flat[starts[p]:starts[p] + lens[p]] for p in pick, and where each begins in it."""
    n = lens[pick]
    at = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    idx = np.repeat(starts[pick] - at[:-1], n)
    idx += np.arange(at[-1])
    return flat[idx], at


def binary_column(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values flat[at[i]:at[i + 1]] of an array of fixed-width items."""
    offs = pa.py_buffer((np.asarray(at, np.int64) * flat.itemsize).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, offs, pa.py_buffer(np.ascontiguousarray(flat).tobytes())]).cast(pa.binary())


def pack_items(items: list[bytes]) -> bytes:
    """Byte strings as one compressed value."""
    lens = np.array([len(x) for x in items], "<u4").tobytes()
    raw = len(items).to_bytes(4, "little") + lens + b"".join(items)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=CODEC, asbytes=True)


def unpack_items(b: bytes) -> list[bytes]:
    raw = pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec=CODEC, asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:e] for a, e in zip([4 + 4 * n, *ends[:-1]], ends)]
