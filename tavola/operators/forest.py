"""Deep random forests, grown in tasks and kept as a table of trees.

MLlib keeps every node of every tree as objects in the driver, and each of its passes
sends the statistics of all nodes of the pass from every task: deep trees of many rows
fill the driver and the network with mostly empty cells.  Here

1. features are binned once (``THRESHOLDS`` cut points of all rows) and stored as blocks
   of bytes, and a row's weight in a tree is Poisson(1), drawn from tree and block;
2. nodes of more than ``local_rows`` rows are split level by level from histograms that
   tasks add up, as MLlib does;
3. the rows of every smaller node are shuffled to one task by (tree, node), which grows
   the subtree below it;
4. subtrees are put together per tree and written.  The driver has the cut points, the
   nodes above the subtrees, and one importance per tree and feature.

The method is MLlib's: a fresh subset of features for every node, gini gain, at least
``min_instances`` weighted rows in a child, siblings that predict alike merged.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.session import scratch_path, ship_package

#: Cut points of a feature at most (MLlib's maxBins less one).
THRESHOLDS = 31
BINS = THRESHOLDS + 1
#: Weighted rows of a node whose subtree one task grows.
LOCAL_ROWS = 1_000_000
#: Rows of a block of bins.
BLOCK_ROWS = 16_384
#: Nodes of a level whose histograms are held at once.
NODES_AT_ONCE = 1_024

TREE = "tree int, node int, feature binary, cut binary, left binary, neg binary, pos binary"
STORED = "tree int, nodes int, feature binary, cut binary, left binary, p binary, importance binary, weight double"


def _prepare(spark: SparkSession) -> None:
    """Modules for the tasks; cells are blocks, so a batch is bounded by its bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def _slots(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"forest/{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def thresholds(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Ascending cut points of every column, x <= cut on the left: between all of its
    values if they are few, else at its quantiles over all rows."""
    columns = list(columns)
    ps = F.array(*[F.lit((i + 1) / BINS) for i in range(THRESHOLDS)])
    cols = [F.col(f"`{c}`").cast("double") for c in columns]
    row = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)],
                 *[F.percentile_approx(c, ps, 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(len(columns)) if row[f"d{i}"] <= 2 * BINS]
    sets = df.agg(*[F.collect_set(cols[i]).alias(f"v{i}") for i in few]).first() if few else None
    out = []
    for i in range(len(columns)):
        values = sorted(v for v in sets[f"v{i}"] if v == v) if i in few else None
        if values is not None and len(values) <= BINS:
            between = [(a + b) / 2 for a, b in zip(values, values[1:])]
            out.append([m if a <= m < b else a for a, b, m in zip(values, values[1:], between)])
        else:
            out.append(sorted({v for v in row[f"q{i}"] or [] if v == v}))
    return out


def _binned(batch: pa.RecordBatch, cuts: list[np.ndarray], first: int = 0) -> np.ndarray:
    out = np.empty((batch.num_rows, len(cuts)), np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, batch.column(first + i).to_numpy(zero_copy_only=False), side="left")
    return out


def _train_blocks(train: DataFrame, columns: Sequence[str], label: str, cuts: list[list[float]]) -> DataFrame:
    """(block, bins, label): rows in an order of their own, so that a block's number is its content's."""
    edges = [np.array(c, float) for c in cuts]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            flat = np.ascontiguousarray(np.concatenate(held))
            flat = flat[np.argsort(flat.view(f"V{flat.shape[1]}").ravel(), kind="stable")] if len(flat) else flat
            return pa.record_batch({"block": pa.array([zlib.crc32(flat.tobytes())], pa.int64()), "bins": pa.array([np.ascontiguousarray(flat[:, :-1]).tobytes()], pa.binary()),
                                    "label": pa.array([flat[:, -1].tobytes()], pa.binary())})
        for b in batches:
            y = b.column(len(edges))
            if y.null_count or not np.isin(y.to_numpy(zero_copy_only=False), (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            both = np.column_stack([_binned(b, edges), y.to_numpy(zero_copy_only=False).astype(np.uint8)])
            for part in (both[k: k + BLOCK_ROWS] for k in range(0, len(both), BLOCK_ROWS)):
                if held and size + len(part) > BLOCK_ROWS:
                    yield block()
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield block()
    return _stored(train.select(*[F.col(f"`{c}`").cast("double") for c in columns], F.col(f"`{label}`").cast("double")).mapInArrow(rows, "block long, bins binary, label binary"), "blocks")


#: Poisson(1) by sixteen random bits.
_POISSON = np.repeat(np.arange(9), np.diff(np.append(0, np.round(65536 * np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 9)])))).astype(int))).astype(np.uint8)


def weights(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often the rows of a block are in the sample of a tree."""
    return _POISSON[np.random.default_rng([seed, tree, block]).integers(0, len(_POISSON), n)]


def _subsets(rng: np.random.Generator, nodes: int, features: int, k: int) -> np.ndarray:
    return rng.random((nodes, features)).argpartition(min(k, features) - 1, axis=1)[:, :k]


def histograms(flat: np.ndarray, begin: np.ndarray, label: np.ndarray, weight: np.ndarray, node: np.ndarray, subset: np.ndarray) -> np.ndarray:
    """(nodes, features of the subset, bins, classes) summed weights of the rows that
    ``begin`` at these places of the flat bins, with their node's number."""
    nodes, k = subset.shape
    cell = node * (2 * BINS) + label
    out = np.empty((nodes, k, BINS, 2))
    for j in range(k):
        at = flat.take(begin + subset[:, j].take(node)).astype(np.int64)
        at *= 2
        at += cell
        out[:, j] = np.bincount(at, weight, nodes * BINS * 2).reshape(nodes, BINS, 2)
    return out


def best_splits(hist: np.ndarray, subset: np.ndarray, min_instances: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every node: the feature (-1 if no split gains), its cut, and the class weights on the left."""
    nodes, k = subset.shape
    left = hist.cumsum(axis=2)[:, :, :-1]
    total = hist[:, 0].sum(axis=1)
    l0, l1 = left[..., 0], left[..., 1]
    r0, r1 = total[:, None, None, 0] - l0, total[:, None, None, 1] - l1
    nl, nr = l0 + l1, r0 + r1
    pure = (l0 * l0 + l1 * l1) / np.maximum(nl, 1) + (r0 * r0 + r1 * r1) / np.maximum(nr, 1)
    pure[(nl < min_instances) | (nr < min_instances)] = -1
    best = pure.reshape(nodes, -1).argmax(axis=1)
    at = np.arange(nodes)
    j, cut = best // (BINS - 1), best % (BINS - 1)
    n = np.maximum(total.sum(axis=1), 1)
    gain = pure[at, j, cut] / n - (total * total).sum(axis=1) / (n * n)
    return np.where(gain > 1e-12, subset[at, j], -1), cut, left[at, j, cut]


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, depth: int, max_depth: int, min_instances: int, k: int,
         rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The subtree of these rows, level by level: feature (-1: leaf), cut, number of the
    left child (the right one follows it), class weights."""
    flat, begin = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    label, weight = label.astype(np.int64), weight.astype(float)
    count = np.bincount(label, weight, 2)[None, :]
    child = np.zeros(len(bins), np.int64)  # of each row, which node of the level it is in; ascending
    levels, before = [], 0
    while True:
        n = len(count)
        feature, cut, left = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.full(n, -1, np.int32)
        levels.append((feature, cut, left, count))
        may = (count > 0).all(axis=1) & (count.sum(axis=1) >= 2 * min_instances) if depth < max_depth else np.zeros(n, bool)
        tried = np.flatnonzero(may)
        if not len(tried):
            break
        if len(tried) < n:
            here = np.flatnonzero(may.take(child))
            begin, label, weight, child = begin.take(here), label.take(here), weight.take(here), child.take(here)
        node = (np.cumsum(may) - 1).take(child)
        ends = np.searchsorted(node, np.arange(len(tried) + 1))
        lefts = np.zeros((len(tried), 2))
        for lo in range(0, len(tried), NODES_AT_ONCE):
            hi = min(lo + NODES_AT_ONCE, len(tried))
            mine = slice(ends[lo], ends[hi])
            subset = _subsets(rng, hi - lo, bins.shape[1], k)
            hist = histograms(flat, begin[mine], label[mine], weight[mine], node[mine] - lo, subset)
            feature[tried[lo:hi]], cut[tried[lo:hi]], lefts[lo:hi] = best_splits(hist, subset, min_instances)
        split = feature[tried] >= 0
        if not split.any():
            break
        before += n
        number = np.cumsum(split) - 1
        left[tried[split]] = before + 2 * number[split]
        right = flat.take(begin + np.maximum(feature, 0).astype(np.int64).take(child)) > cut.take(child)
        child = np.where(split, 2 * number, 2 * len(split)).take(node) + right
        order = np.argsort(child, kind="stable")
        order = order[: np.searchsorted(child.take(order), 2 * len(split))]  # rows of nodes that did not split are done
        begin, label, weight, child = begin.take(order), label.take(order), weight.take(order), child.take(order)
        parts = lefts[split]
        count = np.stack([parts, count[tried[split]] - parts], axis=1).reshape(-1, 2)
        depth += 1
    feature, cut, left, count = (np.concatenate(x) for x in zip(*levels))
    return {"feature": feature, "cut": cut, "left": left, "neg": count[:, 0], "pos": count[:, 1]}


def route(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    leaf = feature < 0
    own = np.arange(len(feature), dtype=np.int64)
    to, by, at = np.where(leaf, own, left), np.where(leaf, 0, feature).astype(np.int64), np.where(leaf, BINS, cut)
    flat, begin = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    node = np.zeros(len(bins), np.int64)
    while True:
        last = node
        node = to[node] + (flat[begin + by[node]] > at[node])
        if np.array_equal(node, last):
            return node


def pruned(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sibling leaves that predict alike become their parent's leaf, bottom up; nodes
    that none points to any more are dropped."""
    feature, left = tree["feature"].copy(), tree["left"]
    says = tree["pos"] > tree["neg"]
    while True:
        inner = np.flatnonzero(feature >= 0)
        a, b = left[inner], left[inner] + 1
        same = (feature[a] < 0) & (feature[b] < 0) & (says[a] == says[b])
        if not same.any():
            break
        feature[inner[same]] = -1
    live = np.zeros(len(feature), bool)
    level = np.array([0])
    while len(level):
        live[level] = True
        inner = level[feature[level] >= 0]
        level = np.concatenate([left[inner], left[inner] + 1])
    number = np.cumsum(live) - 1
    out = {c: tree[c][live] for c in ("cut", "neg", "pos")}
    out["feature"] = feature[live]
    out["left"] = np.where(feature[live] >= 0, number[left[live]], -1).astype(np.int32)
    return out


def importances(tree: dict[str, np.ndarray], features: int) -> np.ndarray:
    """Gains weighted by rows, per feature, to the sum of 1 (zeros of a tree without a split)."""
    def impure(i: np.ndarray) -> np.ndarray:  # weighted gini impurity
        a, b = tree["neg"][i], tree["pos"][i]
        return 2 * a * b / np.maximum(a + b, 1)
    inner = np.flatnonzero(tree["feature"] >= 0)
    gain = impure(inner) - impure(tree["left"][inner]) - impure(tree["left"][inner] + 1)
    out = np.bincount(tree["feature"][inner], gain, features)
    return out / out.sum() if out.sum() > 0 else out


_TYPES = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "neg": np.float64, "pos": np.float64}


def _join(top: dict[str, np.ndarray], parts: list[tuple[int, dict[str, np.ndarray]]]) -> dict[str, np.ndarray]:
    """The nodes above the subtrees, then the subtrees: every one's first node is a node above."""
    size = len(top["feature"])
    head = {c: top[c].astype(t) for c, t in _TYPES.items()}
    tail = []
    for node, sub in parts:
        moved = np.where(sub["feature"] >= 0, sub["left"] + size - 1, -1).astype(np.int32)
        for c in _TYPES:
            head[c][node] = moved[0] if c == "left" else sub[c][0]
        tail.append({**{c: sub[c][1:] for c in _TYPES}, "left": moved[1:]})
        size += len(moved) - 1
    return {c: np.concatenate([head[c], *[t[c] for t in tail]]) for c in _TYPES}


def _top(count: tuple[float, float]) -> dict[str, list]:
    return {"feature": [-1], "cut": [0], "left": [-1], "neg": [count[0]], "pos": [count[1]], "depth": [0]}


def _arrays(top: dict[str, list]) -> dict[str, np.ndarray]:
    return {c: np.array(v, _TYPES.get(c, np.int64)) for c, v in top.items()}


def _split_large(blocks: DataFrame, tops: dict[int, dict], todo: dict[int, list[int]], features: int, min_instances: int, k: int, seed: int) -> dict[tuple[int, int], tuple]:
    """One level of the nodes of ``todo``, from histograms over all blocks:
    {(tree, node): (feature, cut, class weights left and right)}."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(({t: _arrays(tops[t]) for t in todo}, {t: np.array(v) for t, v in todo.items()}))

    def subset_of(tree: int, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([_subsets(np.random.default_rng([seed, tree, int(x), 1]), 1, features, k) for x in nodes])

    def hist_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, asked = shared.value
        subsets = {t: subset_of(t, v) for t, v in asked.items()}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, bins, label in zip(*(c.to_pylist() for c in b.columns)):
                y = np.frombuffer(label, np.uint8).astype(np.int64)
                x = np.frombuffer(bins, np.uint8).reshape(len(y), features)
                for t, nodes in asked.items():
                    number = np.full(len(above[t]["feature"]), -1)
                    number[nodes] = np.arange(len(nodes))
                    w = weights(seed, t, block, len(y))
                    node = number[route(x, above[t]["feature"], above[t]["cut"], above[t]["left"])]
                    pick = np.flatnonzero((node >= 0) & (w > 0))
                    h = histograms(x.ravel(), pick * features, y[pick], w[pick].astype(float), node[pick], subsets[t])
                    sums[t] = sums[t] + h if t in sums else h
        yield pa.record_batch({"tree": pa.array(list(sums), pa.int32()), "hist": pa.array([h.tobytes() for h in sums.values()], pa.binary())})

    def best_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value[1]

        def done(t: int, h: np.ndarray) -> pa.RecordBatch:
            subset = subset_of(t, asked[t])
            feature, cut, lefts = best_splits(h, subset, min_instances)
            rights = h[:, 0].sum(axis=1) - lefts
            return pa.record_batch({"tree": pa.array([t] * len(subset), pa.int32()), "node": pa.array(asked[t], pa.int32()), "feature": pa.array(feature, pa.int32()), "cut": pa.array(cut, pa.int32()),
                                    **{c: pa.array(v, pa.float64()) for c, v in zip(("l0", "l1", "r0", "r1"), (*lefts.T, *rights.T))}})
        now, total = None, None
        for b in batches:
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.frombuffer(h, float).reshape(len(asked[t]), min(k, features), BINS, 2)
                if t != now:
                    if now is not None:
                        yield done(now, total)
                    now, total = t, h
                else:
                    total = total + h
        if now is not None:
            yield done(now, total)
    got = (blocks.mapInArrow(hist_rows, "tree int, hist binary").repartition(_slots(spark), "tree").sortWithinPartitions("tree")
           .mapInArrow(best_rows, "tree int, node int, feature int, cut int, l0 double, l1 double, r0 double, r1 double").collect())
    shared.unpersist()
    return {(r["tree"], r["node"]): tuple(r)[2:] for r in got}


def _grow_large(blocks: DataFrame, n: int, trees: int, features: int, max_depth: int, min_instances: int, k: int, seed: int,
                local_rows: int) -> dict[int, dict[str, list]]:
    """The nodes of every tree above those of ``local_rows`` rows; 'open' names the latter."""
    tops = {t: {**_top((0.0, 0.0)), "open": [0]} for t in range(trees)}
    todo = {t: [0] for t in tops} if n > local_rows else {}
    while todo:
        found = _split_large(blocks, tops, todo, features, min_instances, k, seed)
        after: dict[int, list[int]] = {}
        for (t, node), (feature, cut, l0, l1, r0, r1) in sorted(found.items()):
            top = tops[t]
            top["open"].remove(node)
            if node == 0:
                top["neg"][0], top["pos"][0] = l0 + r0, l1 + r1
            if feature < 0:
                continue
            top["feature"][node], top["cut"][node], top["left"][node] = feature, cut, len(top["feature"])
            depth = top["depth"][node] + 1
            for neg, pos in ((l0, l1), (r0, r1)):
                child = len(top["feature"])
                for c, v in (("feature", -1), ("cut", 0), ("left", -1), ("neg", neg), ("pos", pos), ("depth", depth)):
                    top[c].append(v)
                if neg and pos and depth < max_depth:
                    top["open"].append(child)
                    if neg + pos > local_rows:
                        after.setdefault(t, []).append(child)
        todo = after
    return tops


def fit_forest(train: DataFrame, columns: Sequence[str], label: str, trees: int, max_depth: int, min_instances: int, seed: int,
               local_rows: int | None = None) -> ForestModel:
    """A forest of ``trees`` trees over the numeric ``columns`` (no nulls) and a label of 0 and 1."""
    spark = train.sparkSession
    _prepare(spark)
    columns, local_rows = list(columns), local_rows or LOCAL_ROWS
    features, k = len(columns), int(np.ceil(np.sqrt(len(columns))))
    cuts = thresholds(train, columns)
    blocks = _train_blocks(train, columns, label, cuts)
    n = blocks.agg(F.sum(F.octet_length("label"))).first()[0]
    if not n:
        raise ValueError("a forest needs rows to learn from")
    tops = _grow_large(blocks, n, trees, features, max_depth, min_instances, k, seed, local_rows)
    shared = spark.sparkContext.broadcast({t: (_arrays({c: v for c, v in top.items() if c != "open"}), top["open"]) for t, top in tops.items()})

    def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, bins, y in zip(*(c.to_pylist() for c in b.columns)):
                y = np.frombuffer(y, np.uint8)
                x = np.frombuffer(bins, np.uint8).reshape(len(y), features)
                for t, (top, below) in shared.value.items():
                    if not below:
                        continue
                    w = weights(seed, t, block, len(y))
                    node = route(x, top["feature"], top["cut"], top["left"])
                    order = np.argsort(node, kind="stable")
                    order = order[w[order] > 0]
                    found = node[order]
                    picks = [order[lo:hi] for lo, hi in zip(np.searchsorted(found, below), np.searchsorted(found, below, side="right"))]
                    yield pa.record_batch({"tree": pa.array([t] * len(below), pa.int32()), "node": pa.array(below, pa.int32()), "bins": pa.array([x[p].tobytes() for p in picks], pa.binary()),
                                           "label": pa.array([y[p].tobytes() for p in picks], pa.binary()), "weight": pa.array([w[p].tobytes() for p in picks], pa.binary())})

    def grow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
            y = np.frombuffer(b"".join(h[1] for h in held), np.uint8).astype(np.int64)
            x = np.frombuffer(b"".join(h[0] for h in held), np.uint8).reshape(len(y), features)
            w = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
            t, node = key
            depth = int(shared.value[t][0]["depth"][node])
            sub = grow(x, y, w, depth, max_depth, min_instances, k, np.random.default_rng([seed, t, node, 2]))
            return pa.record_batch({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), **{c: pa.array([sub[c].astype(d).tobytes()], pa.binary()) for c, d in _TYPES.items()}})
        now, held = None, []
        for b in batches:
            for t, node, *piece in zip(*(c.to_pylist() for c in b.columns)):
                if (t, node) != now:
                    if now is not None:
                        yield done(now, held)
                    now, held = (t, node), []
                held.append(piece)
        if now is not None:
            yield done(now, held)

    def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: int, parts: list[tuple]) -> pa.RecordBatch:
            tree = pruned(_join(shared.value[t][0], parts))
            weight = tree["neg"] + tree["pos"]
            p = tree["pos"] / np.maximum(weight, 1)
            return pa.record_batch({"tree": pa.array([t], pa.int32()), "nodes": pa.array([len(p)], pa.int32()), "feature": pa.array([tree["feature"].tobytes()], pa.binary()), "cut": pa.array([tree["cut"].tobytes()], pa.binary()),
                                    "left": pa.array([tree["left"].tobytes()], pa.binary()), "p": pa.array([p.tobytes()], pa.binary()), "importance": pa.array([importances(tree, features).tobytes()], pa.binary()), "weight": pa.array([float(weight[0])])})
        now, parts = None, []
        for b in batches:
            for t, node, *arrays in zip(*(c.to_pylist() for c in b.columns)):
                if t != now:
                    if now is not None:
                        yield done(now, parts)
                    now, parts = t, []
                if node is not None:
                    parts.append((node, {c: np.frombuffer(a, d) for (c, d), a in zip(_TYPES.items(), arrays)}))
        if now is not None:
            yield done(now, parts)

    slots = max(_slots(spark), min(trees, 200))
    sample = blocks.repartition(_slots(spark), "block").mapInArrow(sample_rows, "tree int, node int, bins binary, label binary, weight binary")
    subs = sample.repartition(slots, "tree", "node").sortWithinPartitions("tree", "node").mapInArrow(grow_rows, TREE)
    # every tree has a row, also one whose nodes are all above
    every = spark.range(trees).select(F.col("id").cast("int").alias("tree"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in TREE.split(", ")[1:])])
    table = _stored(subs.unionByName(every).repartition(_slots(spark), "tree").sortWithinPartitions("tree", "node").mapInArrow(whole_rows, STORED), "trees")
    got = table.select("importance", "weight").collect()
    by_tree = np.sum([np.frombuffer(r["importance"], float) for r in got], axis=0)
    model = ForestModel(columns, cuts, (by_tree / by_tree.sum() if by_tree.sum() > 0 else by_tree).tolist(), len(got), sum(r["weight"] > 0 for r in got))
    model.trees = table
    return model


class ForestModel(Model, MLWritable, MLReadable):
    """Cut points in the driver, trees in a table.  ``transform`` adds ``probability`` and ``prediction``."""

    def __init__(self, columns: Sequence[str] = (), cuts: Sequence[Sequence[float]] = (), importance: Sequence[float] = (), trees: int = 0, voting: int = 0):
        super().__init__()
        self.columns, self.cuts, self.importance, self.getNumTrees, self.voting = list(columns), [list(c) for c in cuts], list(importance), trees, voting
        self.trees: DataFrame | None = None

    @property
    def numFeatures(self) -> int:
        return len(self.columns)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importance)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Rows go in blocks, their bins to each group of trees; a block's probabilities
        are added up over the groups and come back to its rows."""
        spark = df.sparkSession
        _prepare(spark)
        edges, voting, features = [np.array(c, float) for c in self.cuts], max(self.voting, 1), self.numFeatures
        carried = [c for c in df.columns if c not in self.columns]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(lo, BLOCK_ROWS)
                    rows = pa.RecordBatch.from_arrays(part.columns[features:], names=[f"c{i}" for i in range(len(carried))])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rows.schema) as w:
                        w.write_batch(rows)
                    yield pa.record_batch({"block": pa.array([uuid.uuid4().hex]), "bins": pa.array([_binned(part, edges).tobytes()], pa.binary()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        blocks = _stored(df.select(*[F.col(f"`{c}`").cast("double") for c in self.columns], *[F.col(f"`{c}`") for c in carried]).mapInArrow(pack, "block string, bins binary, rows binary"), "scored")
        groups = min(self.getNumTrees, _slots(spark))
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("feature", "cut", "left", "p")]
        asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block", "bins", *nothing)
        trees = self.trees.select((F.col("tree") % groups).alias("g"), F.lit(None).cast("string").alias("block"), F.lit(None).cast("binary").alias("bins"), "feature", "cut", "left", "p")

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for b in batches:
                for g, block, bins, *tree in zip(*(c.to_pylist() for c in b.columns)):
                    if g != now:
                        now, held = g, []
                    if block is None:
                        held.append([np.frombuffer(a, d) for a, d in zip(tree, (np.int16, np.uint8, np.int32, np.float64))])
                        continue
                    x = np.frombuffer(bins, np.uint8).reshape(-1, features)
                    total = np.zeros(len(x))
                    for feature, cut, left, p in held:
                        total += p[route(x, feature, cut, left)]
                    yield pa.record_batch({"block": pa.array([block]), "g": pa.array([g], pa.int32()), "p": pa.array([total.tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, None
            for b in batches:
                for block, _g, p in zip(*(c.to_pylist() for c in b.columns)):
                    if block != now:
                        if now is not None:
                            yield pa.record_batch({"block": pa.array([now]), "p": pa.array([total.tobytes()], pa.binary())})
                        now, total = block, np.frombuffer(p, float)
                    else:
                        total = total + np.frombuffer(p, float)
            if now is not None:
                yield pa.record_batch({"block": pa.array([now]), "p": pa.array([total.tobytes()], pa.binary())})

        # a group's trees come before its blocks
        votes = trees.unionByName(asked).repartition(groups, "g").sortWithinPartitions("g", F.col("block").asc_nulls_first()).mapInArrow(vote, "block string, g int, p binary")
        sums = votes.repartition(_slots(spark), "block").sortWithinPartitions("block", "g").mapInArrow(add, "block string, p binary")
        out = df.select(*[F.col(f"`{c}`") for c in carried]).schema

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows, p in zip(*(c.to_pylist() for c in b.columns)):
                    table = pa.ipc.open_stream(rows).read_all().combine_chunks()
                    for r in table.to_batches():
                        yield pa.RecordBatch.from_arrays([*r.columns, pa.array(np.frombuffer(p, float) / voting)], names=[*carried, "_p"])
        scored = blocks.select("block", "rows").join(sums, "block").select("rows", "p").mapInArrow(unpack, out.add("_p", "double"))
        return (scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
                .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        what = {"columns": m.columns, "cuts": m.cuts, "importance": m.importance, "trees": m.getNumTrees, "voting": m.voting}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"forest": json.loads(json.dumps(what))})
        m.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        what = meta["forest"]
        model = ForestModel(what["columns"], what["cuts"], what["importance"], what["trees"], what["voting"])
        model._resetUid(meta["uid"])
        model.trees = self.sparkSession.read.schema(STORED).parquet(f"{path}/trees")
        return model
