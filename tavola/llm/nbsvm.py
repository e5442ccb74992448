"""Quality classifier (operator 9): support vectors over n-gram indicators
scaled by naive-Bayes log-count ratios.

A word becomes a symbol of its form: letter case, ending, length, marks, and
whether the three words from it stood earlier in the text.  Indicators say that
an n-gram of symbols (orders 1 to 3, three alphabets) fills at least a given
share of the text; hashed into ``FORM_DIM`` columns.  Beside them, indicators
say which words (letters and digits, lower-case) and pairs of neighbouring
words occur; hashed into the other columns of ``DIM``.  Spark counts each
indicator by class over all labelled training rows; the log-count ratios scale
the indicators (those of words are smoothed towards 0, so that rare words weigh
little), and a linear hinge-loss model is fitted by dual coordinate descent
on at most ``fit_rows`` labelled rows (a documented bound) and calibrated by a
logistic curve over margins of rows that the margin's model has not seen.

Cases: null and empty texts have only the indicator of emptiness; rows whose
doc_id is null or repeated are scored each for itself; without labels of both
classes every score is the share of label 1 in training (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm import textkernel as K
from tavola.llm.shared import bounded_sample, labelled, trimmed, written

FORM_DIM, DIM = 1 << 18, 1 << 20
#: Columns are kept as their lower 16 bits and the number of columns for each value of the upper ones.
HIGHS = DIM >> 16
#: Log of the places of the filter of labelled ids (8 MB at most); with more labels more rows pass it, none is lost.
FILTER_BITS = 26
#: Shares of a text's n-grams from which on an indicator is set (0: it occurs).
SHARES = np.array([0.0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 15 / 16])
_MARKS = np.zeros(256, np.int64)
_MARKS[[ord(x) for x in "#*$%&|<>{}[]^~_=@\\/"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1
_WORD = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() or _c >= 128:
        _WORD[_c] = _c + 32 if 65 <= _c <= 90 else _c
_END = np.full(256, 3)
_END[[ord(x) for x in ".,;:"]] = 1
_END[[ord(x) for x in "!?"]] = 2
_END[_LETTER == 1] = 0
_END[48:58] = 4


def seen_before(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether an equal hash stands earlier in the same row."""
    order = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    a, b = order[:-1], order[1:]
    same[b] = (h[a] == h[b]) & (row[a] == row[b])  # lexsort is stable
    return same


def _symbols(w: K.Words) -> list[np.ndarray]:
    """Three alphabets, from fine to coarse."""
    n = len(w.starts)
    h = w.hashes()
    again = np.zeros(n, bool)
    if n >= 3:
        tri, _ = K.shingles(h, np.zeros(n, np.int64), 3)
        ok = w.row[:-2] == w.row[2:]
        seen = seen_before(tri, w.row[:-2]) & ok
        again[:-2] |= seen
        again[1:-1] |= seen
        again[2:] |= seen
    add = lambda t: np.add.reduceat(t[w.data], w.starts)  # noqa: E731  white space adds nothing
    upper, letters, marks = add(_UPPER), add(_LETTER), add(_MARKS) > 0
    case = np.where(letters == 0, 0, np.where((upper == letters) & (letters > 1), 1, np.where(_UPPER[w.data[w.starts]] == 1, 2, 3)))
    end = _END[w.data[w.ends - 1]]
    length = np.digitize(w.ends - w.starts, [2, 5, 9, 17])
    fine = (((case * 5 + end) * 5 + length) * 2 + marks) * 2 + again
    mid = (case * 2 + marks) * 2 + again
    return [fine.astype(np.uint64), mid.astype(np.uint64), again.astype(np.uint64)]


def _orders(symbols: list[np.ndarray], row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, (s, most) in enumerate(zip(symbols, (2, 3, 1))):
        g = np.zeros(len(s), np.uint64)
        for n in range(1, most + 1):
            if len(s) < n:
                break
            g = g[: len(s) - n + 1] * np.uint64(512) + s[n - 1:] + np.uint64(1)
            ok = row[: len(s) - n + 1] == row[n - 1:]
            yield (g * np.uint64(4) + np.uint64(a))[ok], row[: len(s) - n + 1][ok]


def indicators(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted columns of the indicators of every row of a chunk, and the first of each row."""
    rows = len(offs) - 1
    w = K.Words(data, offs)
    keys, cols = [np.arange(rows)], [np.zeros(rows, np.int64)]  # column 0: the intercept
    if len(w.starts):
        for g, r in _orders(_symbols(w), w.row):
            total = np.bincount(r, minlength=rows)
            order = np.lexsort((g, r))
            g, r = g[order], r[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            if not len(at):
                continue
            share = np.diff(np.append(at, len(g))) / total[r[at]]
            for j, s in enumerate(SHARES):
                k = at[share >= s] if s else at
                keys.append(r[k])
                cols.append((1 + K.mix(g[k] * np.uint64(16) + np.uint64(j + 1)) % np.uint64(FORM_DIM - 1)).astype(np.int64))
    w = K.Words(_WORD[data], offs)
    if len(w.starts):
        h = w.hashes()
        for n in (1, 2):
            g, r = K.shingles(h, w.row, n)
            keys.append(r)
            cols.append((FORM_DIM + K.mix(g + np.uint64(n)) % np.uint64(DIM - FORM_DIM)).astype(np.int64))
    key = np.unique(np.concatenate(keys) * DIM + np.concatenate(cols))
    return key % DIM, np.searchsorted(key, np.arange(rows + 1) * DIM)


def _marked(labels: DataFrame, spot: F.Column, bits: int) -> np.ndarray:
    """A bit for the place of every label's id, in 64-bit words."""
    words = (labels.where("doc_id is not null").select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / 64).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("mask")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.view(np.uint64)


def _indicator_rows(batches: Iterator[pa.RecordBatch], marked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Indicators of the rows whose id's place is marked: all labelled rows and few others."""
    for b in batches:
        spot = b.column(2).to_numpy().astype(np.uint64)
        b = b.filter(pa.array((marked[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1))
        if not b.num_rows:
            continue
        for lo, hi, data, offs in K.text_chunks(b.column(1)):
            cols, at = indicators(data, offs)
            row = np.repeat(np.arange(hi - lo), np.diff(at))
            highs = np.bincount(row * HIGHS + (cols >> 16), minlength=(hi - lo) * HIGHS)
            yield pa.record_batch({"doc_id": b.column(0).slice(lo, hi - lo), "lows": _binary((cols & 0xFFFF).astype("<u2"), at),
                                   "highs": _binary(highs.astype("<i4"), np.arange(hi - lo + 1) * HIGHS)})


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value for the values of each row."""
    offsets = pa.py_buffer((at * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def _joined(values: pa.Array | pa.ChunkedArray) -> bytes:
    """All bytes of a binary column, without an object for each value."""
    chunks = values.chunks if isinstance(values, pa.ChunkedArray) else [values]
    out = []
    for c in chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset: c.offset + len(c) + 1] if len(c) else [0]
        out.append(memoryview(c.buffers()[2])[at[0]: at[-1]] if len(c) and at[-1] > at[0] else b"")
    return b"".join(out)


def _columns(lows: pa.Array, highs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Columns of all rows, and how many each row has."""
    low = np.frombuffer(_joined(lows), "<u2").astype(np.int32)
    n = np.frombuffer(_joined(highs), "<i4")
    first = np.concatenate([[0], np.cumsum(n.reshape(-1, HIGHS).sum(axis=1))])
    for a in range(0, len(lows), 256):  # some rows at a time: no second array of all columns
        b = min(a + 256, len(lows))
        low[first[a]: first[b]] |= np.repeat(np.tile(np.arange(HIGHS, dtype=np.int32) << 16, b - a), n[a * HIGHS: b * HIGHS])
    return low, n.reshape(-1, HIGHS).sum(axis=1)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class by column, summed over a task's rows before the shuffle."""
    n = np.zeros((2, DIM), np.int64)
    for b in batches:
        flat, size = _columns(b.column(0), b.column(1))
        y = b.column(2).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            n[c] += np.bincount(flat[np.repeat(y == c, size)], minlength=DIM)
    k = np.flatnonzero(n.sum(axis=0))
    if len(k):
        yield pa.record_batch({"column": pa.array(k, pa.int32()), "n0": pa.array(n[0][k]), "n1": pa.array(n[1][k])})


def dual_coordinate_descent(x: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 1.0,
                            epochs: int = 30, tol: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge loss; rows are unit-length scaled indicators.
    Each class has half the total cost."""
    rng = np.random.default_rng(seed)
    w = np.zeros(len(scale))
    alpha = np.zeros(len(y))
    norm = [max(np.sqrt(np.sum(scale[c] ** 2)), 1e-12) for c in x]
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    upper = np.where(y > 0, cost * 0.5 / share[1], cost * 0.5 / share[0])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            c = x[i]
            v = scale[c] / norm[i]
            g = y[i] * (w[c] @ v) - 1.0
            a = alpha[i]
            pg = min(g, 0.0) if a <= 0 else max(g, 0.0) if a >= upper[i] else g
            worst = max(worst, abs(pg))
            if abs(pg) > 1e-12:
                alpha[i] = min(max(a - g, 0.0), upper[i])  # unit-length rows: the curvature is 1
                w[c] += (alpha[i] - a) * y[i] * v
        if worst < tol:
            break
    return w


def _logistic_curve(m: np.ndarray, y01: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the label's probability given the margin."""
    n1, n0 = y01.sum(), len(y01) - y01.sum()
    t = np.where(y01 == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # smoothed targets
    ab = np.array([1.0, 0.0])
    x = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t))
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def _ratios(n: np.ndarray, smooth: float) -> np.ndarray:
    """Log-count ratios of the columns, of forms and of words each over their own totals."""
    words = n[:, FORM_DIM:]
    share = words.sum(axis=1, keepdims=True) / max(words.sum(), 1)
    p = np.concatenate([n[:, :FORM_DIM] + smooth, words + 2 * smooth * np.maximum(share, 1e-9)], axis=1)  # a word of no row has ratio 0
    for part in (p[:, :FORM_DIM], p[:, FORM_DIM:]):
        part /= part.sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    ratio[0] = 1.0
    return ratio


def _margins(x: list[np.ndarray], w: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.array([(w[c] * ratio[c]).sum() / max(np.sqrt((ratio[c] ** 2).sum()), 1e-12) for c in x])


def _trained(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, cost: float) -> Iterator[pa.RecordBatch]:
    """A row with the weights and the calibration learned from all of a task's rows; none without both classes."""
    batches = list(batches)
    if not batches:
        return
    picked = pa.Table.from_batches(batches)
    picked = picked.sort_by([(c, "ascending") for c in ("doc_id", "lows", "highs")])  # the same model whatever order the rows come in
    y = picked["label"].to_numpy().copy()
    flat, width = _columns(picked["lows"], picked["highs"])
    del picked, batches
    x = np.split(flat, np.cumsum(width)[:-1])
    if len(set(y.tolist())) < 2:
        return
    sign = np.where(y == 1, 1.0, -1.0)
    w = dual_coordinate_descent(x, ratio, sign, cost)
    half = np.arange(len(y)) % 2
    m = _margins(x, w, ratio)
    if all(len(set(y[half == k].tolist())) == 2 for k in (0, 1)):
        for k in (0, 1):
            mine, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
            m[mine] = _margins([x[i] for i in mine], dual_coordinate_descent([x[i] for i in other], ratio, sign[other], cost), ratio)
    slope, offset = _logistic_curve(m, y)
    yield pa.record_batch({"weight": pa.array([w.tobytes()], pa.binary()), "slope": [slope], "offset": [offset]})


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None, fit_rows: int = 12_000, smooth: float = 1.0, cost: float = 1.0) -> dict:
    """Model of ``labels.quality`` from the rows of docs(doc_id, text) that ``train`` keeps."""
    rows = docs if train is None else docs.where(train)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = 1 << min(FILTER_BITS, max(16, (16 * labels.count()).bit_length()))
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    marked = docs.sparkSession.sparkContext.broadcast(_marked(labels, spot, bits))
    rows = rows.withColumn("spot", spot)
    # only ids and columns are shuffled to meet the labels, never the texts
    known = written(labelled(rows.mapInArrow(trimmed(lambda batches: _indicator_rows(batches, marked.value)), "doc_id long, lows binary, highs binary"), labels), "nbsvm-train")
    size = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(size.values())
    if len(size) < 2:
        return {"share": size.get(1, 0) / n if n else 0.5}
    counts = (known.select("lows", "highs", "label").mapInArrow(trimmed(_class_counts), "column int, n0 long, n1 long")
              .groupBy("column").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())  # DIM rows at most
    n_by = np.zeros((2, DIM))
    for c in (0, 1):
        n_by[c][counts["column"].to_numpy()] = counts[f"n{c}"].to_numpy()
    ratio = _ratios(n_by, smooth)
    del counts, n_by
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    # the bounded sample is fitted in a task: the driver gets weights, never rows
    found = (bounded_sample(known, "doc_id", n, fit_rows).select("doc_id", "lows", "highs", "label").repartition(1)
             .mapInArrow(trimmed(lambda batches: _trained(batches, shared.value, cost)), "weight binary, slope double, offset double").toArrow())
    shared.unpersist()
    if not found.num_rows:
        return {"share": size.get(1, 0) / n}
    w = np.frombuffer(found["weight"][0].as_buffer(), np.float64)
    return {"weight": w * ratio, "square": ratio ** 2, "curve": (found["slope"][0].as_py(), found["offset"][0].as_py())}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with ``score``, the probability of label 1; every row, whole texts.
    Only texts go to Python and only scores come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights

    def probability(texts: pa.Array) -> np.ndarray:
        m = shared.value
        if "share" in m:
            return np.full(len(texts), m["share"])
        slope, offset = m["curve"]
        out = [np.zeros(0)]
        for _, _, data, offs in K.text_chunks(texts):
            c, first = indicators(data, offs)
            dot = np.add.reduceat(m["weight"][c], first[:-1])  # every row has the intercept
            norm = np.sqrt(np.add.reduceat(m["square"][c], first[:-1]))
            out.append(1 / (1 + np.exp(-np.clip(slope * dot / norm + offset, -30, 30))))
        return np.concatenate(out)

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(lambda batches: (pa.array(probability(t)) for t in batches))(texts)

    # nondeterministic: a filter on the score does not run it again
    judge = F.arrow_udf(scores, "double").asNondeterministic()
    return docs.withColumn("score", judge(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """docs with score and predicted (1 from ``threshold`` on)."""
    return score(docs, fit(docs, labels, **how)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


__all__ = ["classify", "dual_coordinate_descent", "fit", "indicators", "score", "written"]
