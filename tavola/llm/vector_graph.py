"""Embedding near-dedup (operator 4): a robust-pruned flat graph.

1. Equal vectors of a label collapse to one class with a size.
2. Classes are dealt to overlapping cluster shards: cells too large for a task
   are split again and again by centroids of a bounded sample of the cell; a
   vector joins its nearest centroid's cell and those nearly as near.  A cell
   that does not split (a dense core) is dealt out as blocks, and its queries
   go to every block, so no pair is lost.
3. Each shard builds neighbour lists by robust pruning; the lists of a vector
   from all its shards are united.  Where a shard's graph falls into components
   (a group of near copies fills its members' candidates), each is joined to
   its nearest node outside.
4. In its own cell, every vector is a query: greedy beam search from its own
   node and the medoid of each component, then range expansion through all
   neighbours in reach.  Links are verified by cosine in double precision.
5. Recall is audited against brute force for a bounded sample of queries over
   all vectors, per query, and for queries with few links apart; below ``recall`` the shards are searched exactly, then dealt anew
   with more overlap; a recall that stays below is an error, not a result.

Returned per row: n_links counts other rows, copies included.  Pairs are never
expanded: a shard returns counts and a spanning set of links.

Cases: a vector that is null, zero or holds null or non-finite parts, or whose
label is null, links with nothing; vectors of different lengths never link;
repeated rows are copies of each other; a null vec_id names a component only
if all its members' ids are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm.components import components
from tavola.llm.shared import written

MAX_ROWS = 1500       # rows of a shard
SAMPLE_ROWS = 2048    # rows of a cell that its centroids are made from
MOST_CELLS = 32       # parts that a cell is split into at once
DEGREE, BEAM = 24, 32
AUDIT_ROWS = 1024
FEW = 4               # links up to which the audit counts a query apart


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small parts stay in range
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means from far-apart seeds, the same for the same rows in any order."""
    x = x[np.lexsort(x.T[::-1])]
    k = min(k, len(x))
    pick, near = [0], x @ x[0]
    for _ in range(k - 1):
        i = int(near.argmin())
        pick.append(i)
        near = np.maximum(near, x @ x[i])
    c = x[pick]
    for _ in range(steps):
        own = (x @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, s / np.maximum(norm, 1e-12), c)
    return c


def _split(classes: DataFrame, overlap: float, most: int) -> DataFrame:
    """(cell, part, parts, c, v, size, own) of every class in every cell it joins;
    cells over MAX_ROWS that no longer shrink are cut into parts."""
    rows = classes.select(F.concat_ws("/", F.col("label").cast("string"), F.size("v").cast("string")).alias("cell"), "c", "v", "size", F.lit(True).alias("own"))
    done, level = None, 0
    while True:
        rows = written(rows, f"cells-{level}")
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("n_own"))
        stuck = (F.col("n_own") * 4 > F.col("before") * 3) if level else F.lit(False)
        if level:
            sizes = sizes.join(parents, "cell")  # noqa: F821
        sizes = written(sizes.withColumn("large", F.col("n") > MAX_ROWS).withColumn("stuck", F.col("large") & stuck), f"cell-sizes-{level}")
        ready = rows.join(sizes.where("not large or stuck").select("cell", F.ceil(F.col("n") / MAX_ROWS).cast("int").alias("parts")), "cell")
        ready = ready.withColumn("part", F.pmod(F.xxhash64("c", F.lit("part")), F.col("parts")).cast("int"))
        done = ready if done is None else done.unionByName(ready)
        large = sizes.where("large and not stuck").select("cell", "n", "n_own")
        if large.isEmpty():
            return written(done, "shards")
        space = 1 << 30
        picked = (rows.join(large, "cell").where(F.pmod(F.xxhash64("c", F.lit(level)), F.lit(space)) < F.least(F.lit(1.0), SAMPLE_ROWS / F.col("n")) * space))

        def make(t: pa.Table) -> pa.Table:
            n = t["n"][0].as_py()
            c = centroids(_unit(_matrix(t["v"])), int(min(MOST_CELLS, max(2, -(-n // (MAX_ROWS // 3))))))
            return pa.table({"cell": [t["cell"][0].as_py()], "centres": pa.array([c.ravel()], pa.list_(pa.float64())), "n_own": pa.array([t["n_own"][0].as_py()], pa.int64())})

        centres = picked.select("cell", "v", "n", "n_own").groupBy("cell").applyInArrow(make, "cell string, centres array<double>, n_own long")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells, out = np.array(b.column(0).to_pylist(), object), []
                for cell in dict.fromkeys(cells.tolist()):
                    at = np.flatnonzero(cells == cell)
                    x = _unit(_matrix(b.column(2).take(pa.array(at))))
                    c = np.array(b.column(5)[int(at[0])].as_py()).reshape(-1, x.shape[1])
                    s = x @ c.T
                    best = s.max(axis=1, keepdims=True)
                    rank = (-s).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                    r, k = np.nonzero((s >= best - overlap) & (rank < most))
                    out.append((at[r], k, rank[r, k] == 0))
                if not out:
                    continue
                pick, k = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                first = np.concatenate([o[2] for o in out])
                take = pa.array(pick)
                own = b.column(4).take(take).to_numpy(zero_copy_only=False) & first
                name = [f"{c}/{j}" for c, j in zip(cells[pick].tolist(), k.tolist())]
                yield pa.record_batch([pa.array(name, pa.string()), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(own), b.column(6).take(take)],
                                      names=["cell", "c", "v", "size", "own", "before"])

        dealt = rows.join(centres, "cell").select("cell", "c", "v", "size", "own", "centres", "n_own")
        dealt = written(dealt.mapInArrow(deal, "cell string, c long, v array<double>, size long, own boolean, before long"), f"dealt-{level}")
        parents = dealt.groupBy("cell").agg(F.first("before").alias("before"))  # noqa: F841
        rows = dealt.drop("before")
        level += 1


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = 1.2, pool: int = 64) -> np.ndarray:
    """Neighbour lists (-1: none): each node takes its nearest candidate, drops
    those that this one is ``alpha`` times nearer to than the node, and goes on."""
    n = len(x)
    pool = min(pool, n - 1)
    if pool < 1:
        return np.full((n, 1), -1)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    cand = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
    row = np.arange(n)[:, None]
    cand = cand[row, np.argsort(-s[row, cand], axis=1, kind="stable")]
    mine = np.maximum(1 - s[row, cand], 0)  # squared distances, halved
    open_ = np.ones(cand.shape, bool)
    out = np.full((n, min(degree, pool)), -1)
    for k in range(out.shape[1]):
        first = open_.argmax(axis=1)
        has = open_[np.arange(n), first]
        if not has.any():
            break
        star = cand[np.arange(n), first]
        out[has, k] = star[has]
        open_[np.arange(n), first] = False
        open_ &= alpha ** 2 * np.maximum(1 - s[star[:, None], cand], 0) > mine
    return out


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component under the edges a-b."""
    part = np.arange(n)
    while True:
        low = part.copy()
        np.minimum.at(low, a, part[b])
        np.minimum.at(low, b, part[a])
        low = low[low]
        if (low == part).all():
            return part
        part = low


def join_parts(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges a-b, and from each component to its nearest node outside until one
    is left; the medoids of all nodes and of the components, where searches start."""
    n = len(x)
    part = _parts(n, a, b)
    starts = [int((x @ x.mean(axis=0)).argmax())]
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        starts.append(int(at[(x[at] @ x[at].mean(axis=0)).argmax()]))
    s = x @ x.T if part.any() else None
    while part.any():
        out = np.where(part[:, None] == part[None, :], -np.inf, s)
        to = out.argmax(axis=1)
        order = np.lexsort((out[np.arange(n), to], part))
        best = order[np.append(np.flatnonzero(np.diff(part[order])), n - 1)]  # of each component
        a, b = np.concatenate([a, best, to[best]]), np.concatenate([b, to[best], best])
        part = _parts(n, a, b)
    return a, b, np.unique(starts)


def range_search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, reach: float, starts: np.ndarray, own: np.ndarray,
                 beam: int = BEAM, slack: float = 0.1) -> np.ndarray:
    """Boolean queries x nodes: cosine of at least ``reach``, found by greedy beam search from
    ``starts`` and each query's ``own`` node (-1: none) and expansion of everything within ``reach - slack``."""
    nq, n = len(queries), len(x)
    row = np.arange(nq)[:, None]
    own = np.where(np.isin(own, starts), -1, own)
    nodes = np.concatenate([np.broadcast_to(starts, (nq, len(starts))), own[:, None]], axis=1)
    sim = np.concatenate([queries @ x[starts].T, np.einsum("ij,ij->i", queries, x[own])[:, None]], axis=1)
    sim[nodes < 0] = -np.inf
    top = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
    width = top.shape[1]
    ids = np.full((nq, beam), -1)
    sims = np.full((nq, beam), -np.inf)
    ids[:, :width], sims[:, :width] = nodes[row, top], sim[row, top]
    open_ = ids >= 0
    visited, found = np.zeros((nq, n), bool), np.zeros((nq, n), bool)
    r, k = np.nonzero(nodes >= 0)
    visited[r, nodes[r, k]] = True
    found[r, nodes[r, k]] = sim[r, k] >= reach
    r, k = np.nonzero(sim >= reach - slack)
    near_q, near_n = [r], [nodes[r, k]]  # pairs within reach - slack

    def look(q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New (query, neighbour) pairs of (query, node) pairs, with their cosine."""
        a = adj[nodes]
        qq = np.repeat(q, a.shape[1])
        nn = a.ravel()
        keep = nn >= 0
        qq, nn = qq[keep], nn[keep]
        keep = ~visited[qq, nn]
        key = np.unique(qq[keep] * n + nn[keep])
        qq, nn = key // n, key % n
        visited[qq, nn] = True
        s = np.einsum("ij,ij->i", queries[qq], x[nn])
        hit = s >= reach
        found[qq[hit], nn[hit]] = True
        close = s >= reach - slack
        near_q.append(qq[close])
        near_n.append(nn[close])
        return qq, nn, s

    while True:
        value = np.where(open_, sims, -np.inf)
        best = value.argmax(axis=1)
        q = np.flatnonzero(open_[np.arange(nq), best])
        if not len(q):
            break
        open_[q, best[q]] = False
        qq, nn, s = look(q, ids[q, best[q]])
        if not len(qq):
            continue
        first = np.searchsorted(qq, np.arange(nq + 1))
        width = int(np.diff(first).max())
        more = np.full((nq, width), -1)
        more_s = np.full((nq, width), -np.inf)
        col = np.arange(len(qq)) - first[qq]
        more[qq, col], more_s[qq, col] = nn, s
        all_s = np.concatenate([sims, more_s], axis=1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids, sims = np.concatenate([ids, more], axis=1)[row, top], all_s[row, top]
        open_ = np.concatenate([open_, more >= 0], axis=1)[row, top]
    expanded = np.zeros((nq, n), bool)
    while near_q:
        q, nodes = np.concatenate(near_q), np.concatenate(near_n)
        near_q.clear()
        near_n.clear()
        new = ~expanded[q, nodes]
        q, nodes = q[new], nodes[new]
        expanded[q, nodes] = True
        if not len(q):
            break
        for lo in range(0, len(q), 50_000):
            look(q[lo: lo + 50_000], nodes[lo: lo + 50_000])
    return found


def _build(t: pa.Table) -> pa.Table:
    x = _unit(_matrix(t["v"]))
    c = t["c"].to_numpy()
    adj = robust_prune(x)
    r, k = np.nonzero(adj >= 0)
    at = np.searchsorted(r, np.arange(len(c) + 1))
    return pa.table({"c": pa.array(c), "near": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(c[adj[r, k]]))})


def _searcher(reach: float, exact: bool):
    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        """Per query the rows and classes it links with in this shard; links that connect them."""
        c, x, size = index["c"].to_numpy(), _matrix(index["v"]), index["size"].to_numpy()
        qc, q = asked["q_c"].to_numpy(), _matrix(asked["q_v"])
        none = pa.table({"c": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "mates": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not len(c) or not len(qc):
            return none
        x, q = _unit(x), _unit(q)
        order = np.argsort(c)
        near = index["near"].combine_chunks()
        flat, offs = near.flatten().to_numpy(zero_copy_only=False), near.offsets.to_numpy() - near.offsets[0].as_py()
        owner = np.repeat(np.arange(len(c)), np.diff(offs))
        at = np.minimum(np.searchsorted(c[order], flat), len(c) - 1)
        inside = c[order][at] == flat  # united lists also name classes of other shards
        a, b = owner[inside], order[at[inside]]
        key = np.unique(np.concatenate([a * len(c) + b, b * len(c) + a]))  # searched in both directions
        a, b = key // len(c), key % len(c)
        starts = None
        if not exact:
            a, b, starts = join_parts(x, a, b)
            by = np.argsort(a, kind="stable")
            a, b = a[by], b[by]
        first = np.searchsorted(a, np.arange(len(c) + 1))
        adj = np.full((len(c), max(1, int(np.diff(first).max(initial=0)))), -1)
        adj[a, np.arange(len(a)) - first[a]] = b
        group = np.arange(len(c))
        where = np.minimum(np.searchsorted(c[order], qc), len(c) - 1)
        own = np.where(c[order[where]] == qc, order[where], -1)
        links, n_mates, us, vs = [], [], [], []
        for lo in range(0, len(qc), 512):
            part = q[lo: lo + 512]
            found = part @ x.T >= reach - 1e-9 if exact else range_search(x, adj, part, reach, starts, own[lo: lo + 512])
            found &= c[None, :] != qc[lo: lo + 512, None]
            r, k = np.nonzero(found)
            holds = np.einsum("ij,ij->i", part[r], x[k]) >= reach
            r, k = r[holds], k[holds]
            links.append(np.bincount(r, weights=size[k], minlength=len(part)).astype(np.int64))
            n_mates.append(np.bincount(r, minlength=len(part)))
            for i in np.unique(r).tolist():
                mates = k[r == i]
                if own[lo + i] >= 0:  # the query stands in this shard: only what it newly connects
                    mine = group[own[lo + i]]
                    new = np.unique(group[mates])
                    new = new[new != mine]
                    if len(new):
                        reps = np.array([mates[group[mates] == g][0] for g in new])
                        us += [int(qc[lo + i])] * len(reps)
                        vs += c[reps].tolist()
                        group[np.isin(group, new)] = mine
                else:
                    reps = np.array([mates[group[mates] == g][0] for g in np.unique(group[mates])])
                    us += [int(qc[lo + i])] * len(reps)
                    vs += c[reps].tolist()
        n = len(us)
        return pa.table({"c": pa.array([*qc.tolist(), *[None] * n], pa.int64()), "links": pa.array([*np.concatenate(links).tolist(), *[None] * n], pa.int64()),
                         "mates": pa.array([*np.concatenate(n_mates).tolist(), *[None] * n], pa.int64()),
                         "u": pa.array([*[None] * len(qc), *us], pa.int64()), "v": pa.array([*[None] * len(qc), *vs], pa.int64())})
    return search


def _search(shards: DataFrame, reach: float, exact: bool) -> DataFrame:
    near = shards.select("cell", "part", "c", "v").groupBy("cell", "part").applyInArrow(_build, "c long, near array<long>")
    united = near.groupBy("c").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # degree x shards of one vector
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    listed = shards.withColumn("near", F.array().cast("array<long>")) if exact else shards.join(united, "c")
    index = listed.withColumn("ask", every).select("cell", "part", "ask", "c", "v", "size", "near")
    asked = shards.where("own").withColumn("ask", F.col("part")).withColumn("part", every).select("cell", "part", "ask", "c", "v")
    # columns of the two sides have names of their own: both come from the same table
    asked = asked.select(*[F.col(n).alias(f"q_{n}") for n in ("cell", "part", "ask", "c", "v")])
    got = index.groupBy("cell", "part", "ask").cogroup(asked.groupBy("q_cell", "q_part", "q_ask")).applyInArrow(_searcher(reach, exact), "c long, links long, mates long, u long, v long")
    return written(got, "vector-links")


def audit(classes: DataFrame, found: DataFrame, reach: float, rows: int = AUDIT_ROWS) -> float:
    """Share of its linked classes that a query finds, for at most ``rows`` classes
    picked by hash and compared with every class by brute force: the mean over all
    queries with links or over those with at most ``FEW``, whichever is less.
    Copies and large groups weigh no more than a pair."""
    n = classes.count()
    space = 1 << 30
    sample = classes.where(F.pmod(F.xxhash64("c", F.lit("audit")), F.lit(space)) < int(space * min(1.0, rows / max(n, 1)))).limit(rows).select("c", "label", "v").toArrow()
    if not sample.num_rows:
        return 1.0
    groups: dict = {}
    for c, label, v in zip(*(sample[k].to_pylist() for k in ("c", "label", "v"))):
        groups.setdefault((label, len(v)), []).append((c, v))
    shared = classes.sparkSession.sparkContext.broadcast({k: (np.array([c for c, _ in g]), _unit(np.array([v for _, v in g], float))) for k, g in groups.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = np.array(b.column(1).to_pylist(), object)
            width = np.diff(b.column(2).offsets.to_numpy())
            for key, (ids, q) in shared.value.items():
                at = np.flatnonzero((label == key[0]) & (width == key[1]))
                if len(at):
                    hit = _unit(_matrix(b.column(2).take(pa.array(at)))) @ q.T >= reach
                    hit &= b.column(0).to_numpy()[at][:, None] != ids[None, :]
                    yield pa.record_batch({"c": pa.array(ids), "n": pa.array(hit.sum(axis=0))})

    true = classes.select("c", "label", "v").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    mine = found.where("c is not null").groupBy("c").agg(F.sum("mates").alias("mates"))
    share = F.least("n", F.coalesce("mates", F.lit(0))) / F.col("n")
    r = true.where("n > 0").join(mine, "c", "left").agg(F.avg(share).alias("every"), F.avg(F.when(F.col("n") <= FEW, share)).alias("few")).first()
    return min((x for x in r if x is not None), default=1.0)


def _audited(classes: DataFrame, reach: float, recall: float) -> DataFrame:
    """Links of the first search that passes the audit."""
    overlap, most = 0.1, 3
    while True:
        shards = _split(classes, overlap, most)
        for exact in (False, True):
            found = _search(shards, reach, exact)
            got = audit(classes, found, reach)
            if got >= recall:
                return found
        if most > MOST_CELLS:
            raise RuntimeError(f"link recall {got:.4f} is below {recall} with the widest overlap")
        overlap, most = overlap * 2, most * 3


def near_duplicates(vectors: DataFrame, reach: float = 0.93, recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label)."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fit &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"), F.coalesce(fit, F.lit(False)).alias("fit"))
    good = rows.where("fit")
    grouped = good.groupBy("label", "v").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = written(grouped.withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    found = _audited(classes, reach, recall)
    links = found.where("c is not null").groupBy("c").agg(F.sum("links").alias("links"))
    joined = components(found.where("u is not null").select("u", "v"), "vector-components")
    named = classes.join(links, "c", "left").join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("label", "v", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    out = good.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
