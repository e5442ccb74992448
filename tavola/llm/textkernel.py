"""Vectorised text kernels used inside tasks: word and pre-token spans with
64-bit hashes, computed on whole Arrow string columns with numpy.

A column is cut into chunks of whole rows (about ``CHUNK_BYTES`` each, one row
at least), so temporary arrays stay small however long the column is; a row is
never cut.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n + 1 of each."""
    have = _powers.get("p")
    if have is None or len(have) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for every span; equal content gives an
    equal hash wherever it stands."""
    p, inv = _power(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets into them); null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offs[lo]: offs[hi]], offs[lo: hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk of rows: byte spans, the row of
    each word and its hash; ``rows`` gives the first word of each row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        word = np.zeros(n + 2, bool)
        word[1: n + 1] = ~_IS_SPACE[data]
        start = word[1: n + 1] & ~word[:n]
        end = word[1: n + 1] & ~word[2:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        start[cut] = word[1: n + 1][cut]
        end[cut - 1] = word[1: n + 1][cut - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.rows = np.searchsorted(self.starts, offs)  # word number where each row begins
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.rows))

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_CODE[self.data], self.starts, self.ends)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k]: self.ends[k]].tobytes()


def shingles(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a row, and the row of each."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out * _P + h[j: len(h) - n + 1 + j])
    inside = row[: len(h) - n + 1] == row[n - 1:]
    return out[inside], row[: len(h) - n + 1][inside]


# --- pre-tokens of the byte-level BPE split pattern -------------------------
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@cache
def _char_class() -> np.ndarray:
    """Class of every code point under the pattern's \\p{L}, \\p{N} and \\s."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    # fixed values: the White_Space property
    for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = _SPACE
    return table


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` in every row of a chunk: byte starts,
    byte ends, hashes, and the first token of each row.  The matches cover a
    row without gaps, so they are given by where they begin."""
    raw = data.tobytes()
    cp = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=at[1:])
    first = np.searchsorted(at, offs)  # code point where each row begins
    kind = _char_class()[cp]
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    doc = np.zeros(n + 1, bool)
    doc[first] = True
    run |= doc[:n]
    rs = np.flatnonzero(run)
    re_ = np.append(rs[1:], n)
    rk = kind[rs]
    # a run of white space that a non-space follows: its last character stands
    # alone or, if it is a blank, begins the next token
    follows = np.zeros(len(rs), bool)
    follows[:-1] = ~doc[rs[1:]]
    gap = (rk == _SPACE) & follows
    begin = run
    begin[re_[gap] - 1] = True
    blank = gap.copy()
    blank[gap] = cp[re_[gap] - 1] == 0x20
    begin[re_[blank]] = False
    # contractions: an apostrophe that begins a token, then s t m d re ve ll
    apo = (rk == _OTHER) & (re_ - rs == 1) & follows & (cp[rs] == 0x27) & begin[rs]
    apo[:-1] &= rk[1:] == _LETTER
    if apo.any():
        k = np.flatnonzero(apo)
        s, letters = rs[k], re_[k + 1] - rs[k + 1]
        one = cp[s + 1]
        two = np.where(letters > 1, cp[np.minimum(s + 2, n - 1)], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begin[s[short | long] + 1] = False
        begin[s[short & (letters > 1)] + 2] = True
        begin[s[long & (letters > 2)] + 3] = True
    ts = np.flatnonzero(begin)
    te = np.append(ts[1:], n)
    codes = cp.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    return at[ts], at[te], span_hashes(codes, ts, te), np.searchsorted(ts, first)
