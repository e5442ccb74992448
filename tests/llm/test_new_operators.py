"""Exact dedup, conversation repair and hard negatives against brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

SMALL = "/root/testdata/sf0.001"
COLS = "vec_id long, embedding array<float>, label int, p string, key int"


@pytest.fixture(scope="module")
def oracle():
    """Rows of a registered query's SQL on the small tables."""
    import duckdb

    from tavola.llm.queries import SQL
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")

    def run(name):
        cur = con.execute(SQL[name])
        return [c[0] for c in cur.description], cur.fetchall()
    return run


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_conversations", "op13_hard_negatives"])
def test_query_equals_sql(llm, oracle, name):
    from tavola.llm.queries import QUERIES
    cols, want = oracle(name)
    got = [tuple(r) for r in QUERIES[name](llm, SMALL).select(cols).collect()]
    assert sorted(got) == sorted(want) and got


# exact dedup

def norm_hash(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_exact_groups_with_nulls_repeats_and_clashing_names(llm):
    from tavola.llm.exact_dedup import drop_copies, exact_groups
    rows = [(5, "a b", "x"), (3, "a\t\n b", "y"), (3, "a b", "z"), (None, "a b", "n"), (None, "only", "n"), (None, "only", "m"), (7, None, ""), (8, "", ""),
            (9, " ", ""), (10, " a b", ""), (11, "long " * 50_000, ""), (12, "long  " * 50_000, "")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, kept string").withColumnRenamed("kept", "rid")
    got = exact_groups(docs, counters=3).collect()
    by = {}
    for i, t, _ in rows:
        by.setdefault(norm_hash(t), []).append(i)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id or 0, r.group_size, r.text_sha256) for r in got) == sorted(
        (i is None, i or 0, min([x for x in by[norm_hash(t)] if x is not None], default=0), len(by[norm_hash(t)]), norm_hash(t)) for i, t, _ in rows)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(by) and all(r.doc_id == r.keep_id for r in kept)
    left = drop_copies(docs, counters=3)
    assert left.columns == docs.columns and sorted(norm_hash(r.text) for r in left.collect()) == sorted(by)
    assert exact_groups(docs.where("false")).count() == 0 == drop_copies(docs.where("false")).count()


def test_frequent_digests_are_all_candidates_and_few(llm):
    from tavola.llm.exact_dedup import exact_groups, frequent
    rng = random.Random(3)
    texts = ["hot"] * 700 + [f"warm {k % 7}" for k in range(500)] + [f"own {k}" for k in range(900)]
    rng.shuffle(texts)
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    digests = docs.selectExpr("unhex(sha2(text, 256)) digest")
    found, least = frequent(digests, counters=15)
    found = {bytes(r[0]) for r in found.collect()}
    assert least == 2 * 2100 / 16 and hashlib.sha256(b"hot").digest() in found and len(found) <= 16
    sizes = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_groups(docs, counters=15).collect()}
    for i, t in enumerate(texts):
        first = texts.index(t)
        assert sizes[i] == (first, texts.count(t), i == first)


def test_misra_gries_errors_are_bounded():
    from tavola.llm.exact_dedup import misra_gries
    rng = np.random.default_rng(0)
    state, error, true = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())}), 0, {}
    for _ in range(30):
        ids = rng.zipf(1.4, 200) % 500
        for i in ids:
            true[b"%d" % i] = true.get(b"%d" % i, 0) + 1
        state, cut = misra_gries(state, pa.table({"digest": pa.array([b"%d" % i for i in ids], pa.binary()), "n": pa.array(np.ones(200, np.int64))}), 20)
        error += cut
    assert state.num_rows <= 20 and error <= 6000 / 21
    kept = dict(zip(state["digest"].to_pylist(), state["n"].to_pylist()))
    assert all(true[d] - error <= kept.get(d, 0) <= true[d] for d in true)


# conversations

def cheapest(code):
    """Least (cost, audit) of rows of (class + 4 fault), by trying all edits."""
    @lru_cache(None)
    def f(i, state, inserted):
        ways = [(0, "")] if i == len(code) and state in (0, 3) else []
        add = 3 if state == 2 else 2
        if inserted < 2:
            c, a = f(i, add, inserted + 1)
            ways.append((c + 5, "I" + a))
        if i < len(code):
            role, fault = code[i] % 4, code[i] // 4
            c, a = f(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if fault in (0, 3):
                c, a = f(i + 1, add, 0)
                ways.append((c + 1 + 5 * (fault == 3), "R" + a))
                to = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((role, state))
                if to:
                    c, a = f(i + 1, to, 0)
                    ways.append((c + 5 * (fault == 3), "K" + a))
        return min(ways, default=(10 ** 9, ""))
    return f(0, 0, 0)


def test_audits_equal_trying_all_edits():
    from tavola.llm.conversations import solve
    rng = random.Random(1)
    codes = [np.array([rng.randrange(16) if rng.random() < .3 else rng.choice([1, 2, 1, 2, 0, 9, 13, 14]) for _ in range(rng.randrange(14))], np.uint8) for _ in range(1500)]
    want = [cheapest(tuple(int(x) for x in c)) for c in codes]
    assert solve(codes) == want
    assert [solve([c], run=3)[0] for c in codes[:200]] == want[:200]  # in pieces


def repair(rows):
    """(facts, repaired lines) of one conversation's (turn, role, text) rows."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    codes, seen = [], set()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not shown else 2 if (role, text) in seen else 0 if shown[-1] in ".!?" else 3
        seen.add((role, text))
        codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * fault)
    cost, audit = cheapest(tuple(codes))
    turns = [t for t, _, _ in rows if t is not None]
    lines, it, last = [], iter(rows), ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(it)[1:]
        if edit in "IR":
            role = "assistant" if last == "u" else "user"
        if edit != "D":
            lines.append((role, text))
            last = role[0]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(c // 4 == f for c in codes) for f in (1, 2, 3)],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit), lines


def test_report_and_repaired_rows(llm):
    from tavola.llm.conversations import FACTS, repaired, report
    rng = random.Random(5)
    convs = {k: [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
                  rng.choice(["Yes.", "No", "Why?", "", " \t", None, "é!", "x" * 9 + " \n", "Fine! "])) for _ in range(rng.randrange(1, 9))] for k in [*range(60), None]}
    convs[1000] = [(t, "user", "Same.") for t in [4, 4, 4, 7]]
    convs[1001] = [(t, "user" if t % 2 == 0 else "assistant", "w" * 30 + str(t) + ".") for t in range(150)]
    rows = [(k, *r, "clash") for k, v in convs.items() for r in v]
    rng.shuffle(rows)
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string")
    got = {r.conv_id: r for r in report(df).collect()}
    lines = {}
    for r in repaired(df).orderBy("position").collect():
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(convs)
    for k, v in convs.items():
        facts, want = repair(v)
        assert tuple(got[k][c] for c in [*FACTS, "audit"]) == facts, k
        assert lines.get(k, []) == want, k
        assert got[k].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want).encode()).hexdigest()
    assert report(df.where("false")).count() == 0
    from pyspark.sql import functions as F
    gone = report(df.where("conv_id = 1000"), F.lit(False)).collect()
    assert [tuple(r) for r in gone] == [(1000, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage_follows_the_hash_of_the_place(llm):
    from tavola.llm.queries import damaged
    rows = [(c, t, "system", "Hi! Ho.") for c in [*range(40), None] for t in [0, 1, None]]
    got = damaged(llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("present").collect()
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [(c, t, "user" if k == 4 else role, "" if k == 1 else "Hi Ho" if k == 2 else text)] * (0 if k == 0 else 2 if k == 3 else 1)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted([(r.conv_id, r.turn, r.role, r.text) for r in got], key=key) == sorted(want, key=key)


# hard negatives

def brute_negatives(rows, is_anchor, positives=5, negatives=5):
    live = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, v, l in rows
            if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (a, la, va) in enumerate(live):
        if a is None or not is_anchor(a):
            continue
        ranked = sorted(((-sum(x * y for x, y in zip(va, v)), i is None, i or 0, l) for j, (i, l, v) in enumerate(live) if j != k))
        for s, none, p, _ in [r for r in ranked if r[3] == la][:positives]:
            fit = [r for r in ranked if r[3] != la and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(a, None if none else p, n, None if r[1] else r[2], -s, -r[0]) for n, r in enumerate(fit, 1)]
    return out


def test_negatives_equal_brute_force(llm):
    from pyspark.sql import functions as F

    from tavola.llm.hard_negatives import mine
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=4), 1)], int(rng.integers(3))) for i in range(200)]
    rows += [(20, rows[20][1], 0), (None, rows[7][1], 1), (None, rows[7][1], 1), (300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [float("nan")] * 4, 2), (303, [float("inf")] * 4, 2),
             (304, [1.0] * 4, None), (305, [], 1), (310, [1.0, 1.0], 0), (311, [0.5, 0.5, 0.5, 0.5, 9.0], 1), (320, [1e6, 1.0, 0.0, 0.0], 2), (321, [1e6, 0.9, 0.0, 0.0], 1)]
    df = llm.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], COLS)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    want = brute_negatives(exact, lambda i: i % 10 == 0)
    order = lambda rs: sorted(rs, key=lambda r: tuple((x is None, x or 0) for x in r))
    for sizes in ((16_384, 8_192), (37, 5)):
        got = mine(df.repartition(5), F.col("vec_id") % 10 == 0, group_rows=sizes[0], group_anchors=sizes[1])
        assert order([tuple(r) for r in got.collect()]) == order(want) and len(want) > 100
    assert mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(df.where("vec_id = 10"), F.col("vec_id") % 10 == 0).count() == 0


def test_products_are_exact_at_any_size():
    from tavola.llm.hard_negatives import HIGH, LOW, products
    a = np.array([[2.0 ** 27 + 1, 3.0], [-(2.0 ** 70), 1.0]])
    b = np.array([[2.0 ** 27 - 1, 5.0], [2.0 ** 60, 0.0]])
    assert products(a, b).tolist() == [[(2 ** 27 + 1) * (2 ** 27 - 1) + 15, HIGH], [LOW, LOW]]


def test_stream_opens_windows_before_equal_scores():
    import struct

    from tavola.llm.hard_negatives import HIGH, KEY, LOW, stream
    key = lambda score, neg, i: struct.pack(KEY, 100 - LOW, 1, HIGH - score, neg, False, i - LOW, i)
    keys = sorted([key(10, True, 1), key(10, False, 50), key(8, True, 2), key(7, True, 3), key(8, False, 51), key(11, True, 4)])
    assert list(stream(iter(keys), 5, 80, 100)) == [(100, 50, 1, 1, 10, 10), (100, 50, 2, 2, 10, 8), (100, 51, 1, 2, 8, 8), (100, 51, 2, 3, 8, 7)]
