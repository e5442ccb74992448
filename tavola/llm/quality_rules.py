"""Quality rules (operator 2): exact base rules, then gradient-boosted trees
over document statistics with monotonic constraints, flattened into node arrays
and scored for all rows of a batch at once.

The trees learn ``labels.quality`` from at most ``fit_rows`` labelled rows (a
documented bound, picked by a hash of the id); statistics and verdicts cover
every row and whole texts.

Cases: null and empty texts have no words and fail the base; rows with a null
or repeated doc_id are judged each for itself; other columns pass through,
those named like a result column are replaced; without labels of both classes
the trees reject nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm import textkernel as K
from tavola.llm.shared import bounded_sample, labelled, trimmed, written

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Inputs of the trees, and how the quality may move with each: -1 never up, 1 never down, 0 freely.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": 0, "repeat_share": -1, "mark_word_share": -1,
            "upper_share": -1, "digit_share": 0, "letter_share": 0, "end_mark_share": 0, "distinct_share": 0, "short_word_share": 0,
            "long_word_share": 0, "mean_line": 0, "bare_mark_share": -1}


def _flag(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[[ord(c) for c in chars]] = 1
    return t


_SYMBOLS = _flag("#*$%&|<>")
_LETTERS = _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTERS[192:] = 1  # first bytes of other letters
_UPPER = _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _flag("0123456789")
_MARKS = _flag("!?#*$%&|<>")
_HEAD = np.ones(256, np.int64)
_HEAD[128:192] = 0


def equal_neighbours(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item: whether an equal one stands in its row, and whether one stands earlier."""
    order = np.lexsort((h, row))
    a, b = order[:-1], order[1:]
    same = (h[a] == h[b]) & (row[a] == row[b])
    some, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    some[a[same]] = True
    some[b[same]] = True
    later[b[same]] = True
    return some, later


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows x 5) and tree inputs (rows x len(FEATURES)) of a chunk."""
    rows = len(offs) - 1
    w = K.Words(data, offs)
    n = np.diff(w.rows)
    space = K._IS_SPACE[data]

    def per_row(flags: np.ndarray) -> np.ndarray:
        s = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=s[1:])
        return s[offs[1:]] - s[offs[:-1]]

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(w.row, weights=flags, minlength=rows)

    chars = per_row(_HEAD[data] * ~space)
    symbols = per_row(_SYMBOLS[data])
    h = w.hashes()
    repeats = np.zeros(len(h), bool)
    if len(h) >= 3:
        tri, _ = K.shingles(h, np.zeros(len(h), np.int64), 3)
        inside = np.flatnonzero(w.row[:-2] == w.row[2:])
        some, _ = equal_neighbours(tri[inside], w.row[inside])
        for j in range(3):
            repeats[inside[some] + j] = True
    _, seen = equal_neighbours(h, w.row)
    # lines: cut at every \n and at row ends
    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offs[:-1], newline + 1]))
    starts = starts[starts < len(data)]
    line_row = np.searchsorted(offs, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), offs[line_row + 1])
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10))
    has_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    lines = np.flatnonzero(has_word)
    lh = K.span_hashes(K._BYTE_CODE[data], starts[lines], ends[lines])
    _, dup = equal_neighbours(lh, line_row[lines])
    n_lines = np.bincount(line_row[lines], minlength=rows)
    n_dup = np.bincount(line_row[lines], weights=dup, minlength=rows)
    n_rep = of_words(repeats)
    base = np.stack([n, chars, symbols, n_dup.astype(np.int64), n_rep.astype(np.int64)], axis=1).astype(np.int64)

    size = w.ends - w.starts
    add = lambda t: np.add.reduceat(t[w.data], w.starts) if len(w.starts) else np.zeros(0)
    letters = add(_LETTERS)
    last = w.data[w.ends - 1]
    per_word, per_char = np.maximum(n, 1), np.maximum(chars, 1)
    x = np.stack([np.log1p(n), chars / per_word, symbols / per_char, n_dup / np.maximum(n_lines, 1), n_rep / per_word,
                  of_words(add(_SYMBOLS) > 0) / per_word, of_words((add(_UPPER) > 1) & (add(_UPPER) == letters)) / per_word,
                  per_row(_DIGITS[data]) / per_char, per_row(_LETTERS[data]) / per_char, of_words(_MARKS[last] > 0) / per_word,
                  1 - of_words(seen) / per_word, of_words(size <= 3) / per_word, of_words(size >= 14) / per_word,
                  n / np.maximum(n_lines, 1), of_words(letters == 0) / per_word], axis=1)
    return base, x


class Trees:
    """Boosted regression trees for a 0/1 label, logistic loss, as flat node
    arrays: feature (-1 at a leaf), threshold, left child, right child, value."""

    def __init__(self, feature, threshold, left, right, value, roots, start):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.roots, self.start = roots, start

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, monotonic: list[int], rounds: int = 80, depth: int = 4, rate: float = 0.15,
            bins: int = 64, least: float = 2.0, l2: float = 1.0) -> Trees:
        rows, width = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # code <= k: x <= cuts[k]
        sign = np.array(monotonic)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        start = float(np.log(share / (1 - share)))
        margin = np.full(rows, start)
        nodes: list[list] = []  # feature, threshold, left, right, value
        roots = []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0.0, -1, -1, -g.sum() / (h.sum() + l2)])
            place = np.full(rows, roots[-1])
            edge = {roots[-1]: (-np.inf, np.inf)}  # values allowed below a node
            for _ in range(depth):
                grown = {}
                for node, (lo, hi) in edge.items():
                    own = np.flatnonzero(place == node)
                    best = None
                    for j in range(width):
                        if not len(cuts[j]):
                            continue
                        gs = np.cumsum(np.bincount(code[own, j], weights=g[own], minlength=len(cuts[j]) + 1))
                        hs = np.cumsum(np.bincount(code[own, j], weights=h[own], minlength=len(cuts[j]) + 1))
                        gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                        vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
                        gain = -(gl * vl + 0.5 * (hl + l2) * vl ** 2) - (gr * vr + 0.5 * (hr + l2) * vr ** 2)
                        gain[(hl < least) | (hr < least) | (sign[j] * (vr - vl) < 0)] = -np.inf
                        k = int(gain.argmax())
                        if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k, vl[k], vr[k])
                    now = nodes[node][4]
                    if best is None or best[0] <= -(g[own].sum() * now + 0.5 * (h[own].sum() + l2) * now ** 2) + 1e-6:
                        continue
                    _, j, k, vl, vr = best
                    left, right = len(nodes), len(nodes) + 1
                    nodes[node][:4] = [j, float(cuts[j][k]), left, right]
                    nodes += [[-1, 0.0, -1, -1, vl], [-1, 0.0, -1, -1, vr]]
                    mid = (vl + vr) / 2
                    grown[left] = (lo, mid) if sign[j] > 0 else (mid, hi) if sign[j] < 0 else (lo, hi)
                    grown[right] = (mid, hi) if sign[j] > 0 else (lo, mid) if sign[j] < 0 else (lo, hi)
                    goes = code[own, j] <= k
                    place[own[goes]], place[own[~goes]] = left, right
                if not grown:
                    break
                edge = grown
            values = np.array([v[4] for v in nodes])
            margin += rate * values[place]
        f, t, left, right, v = zip(*nodes)
        return cls(np.array(f), np.array(t), np.array(left), np.array(right), rate * np.array(v), np.array(roots), start)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All trees of all rows, one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes = x[row, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
        return 1 / (1 + np.exp(-np.clip(self.start + self.value[at].sum(axis=1), -30, 30)))


def _input_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in K.text_chunks(b.column(1)):
            _, x = statistics(data, offs)
            yield pa.record_batch({"doc_id": b.column(0).slice(lo, hi - lo), "x": pa.array(list(x), pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, **how) -> Trees | None:
    """Trees for labels.quality; None without labels of both classes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = written(labelled(rows.mapInArrow(trimmed(_input_rows), "doc_id long, x array<double>"), labels), "quality-train")
    picked = bounded_sample(known, "doc_id", known.count(), fit_rows).toArrow()
    y = picked["label"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array(picked["x"].to_pylist())
    order = np.lexsort((*x.T, picked["doc_id"].to_numpy()))  # the same trees whatever order the rows come in
    return Trees.fit(x[order], y[order], list(FEATURES.values()), **how)


def judge(docs: DataFrame, trees: Trees | None, threshold: float = 0.3) -> DataFrame:
    """docs with the base counts, base_failed, quality (the trees' probability) and kept.
    Only texts go to Python and only these come back."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    added = [*BASE, "base_failed", "quality", "kept"]

    def verdict(texts: pa.Array) -> pa.Array:
        got = [statistics(data, offs) for _, _, data, offs in K.text_chunks(texts)]
        base = np.concatenate([g[0] for g in got]) if got else np.zeros((0, len(BASE)), np.int64)
        x = np.concatenate([g[1] for g in got]) if got else np.zeros((0, len(FEATURES)))
        n, repeat = base[:, 0], base[:, 4]
        failed = (n < 50) | (100 * repeat > 50 * n)
        p = shared.value.probability(x) if shared.value is not None else np.ones(len(x))
        return pa.StructArray.from_arrays([*[pa.array(base[:, j]) for j in range(len(BASE))], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], added)

    def verdicts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(lambda batches: map(verdict, batches))(texts)

    kinds = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, quality double, kept boolean"
    # nondeterministic: a filter on the verdict does not run it again
    found = docs.withColumn("_verdict", F.arrow_udf(verdicts, kinds).asNondeterministic()(F.col("text").cast("string")))
    return found.withColumns({c: F.col(f"_verdict.{c}") for c in added}).drop("_verdict")
