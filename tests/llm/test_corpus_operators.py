"""Operators 1, 4, 6, 7 and 9 and the pipeline against brute force."""

import collections
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def jaccard_groups(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k: k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    g = Groups()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if c and den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                    g.join(a, b)
    return {i: (len(sets[i]), g.find(i)) for i in ids}


def near_copy_rows(rng):
    vocabulary = ["w%d" % k for k in range(400)] + ["the", "of", "and"] * 30
    rows = []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 60, 200, 400]))]
        for copy in range(rng.choice([1, 2, 5, 12])):
            t = list(text)
            for _ in range(int(len(t) * rng.choice([0, 0, 0.01, 0.02, 0.05, 0.1]))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\n", "  "]).join(t)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(len(rows) * 3 + 1 + k, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(30)]
    return rows + [(100000, None), (100001, ""), (100002, "A b"), (100003, "a B"), (100004, "a"), (100005, "x " * 20000), (100006, "X " * 30000)]


@pytest.mark.parametrize("n,num,shard_rows", [(3, 90, 1000), (5, 80, 1000), (3, 90, 4)])
def test_ngram_join_equals_brute_force(llm, docs_of, n, num, shard_rows):
    from tavola.llm.ngram_join import ngram_components
    rows = near_copy_rows(random.Random(n * num))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs_of(rows), n, num, 100, shard_rows).collect()}
    assert got == jaccard_groups(rows, n, num, 100)


def test_ngram_join_of_repeated_and_nameless_rows(llm, docs_of):
    from tavola.llm.ngram_join import ngram_components
    rows = [(7, "a b c d")] * 3 + [(None, "a b c d"), (None, "q r s t"), (5, "a b c d"), (9, None)]
    got = ngram_components(docs_of(rows), 3, 90, 100).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted(
        [("7", "5")] * 3 + [("None", "5"), ("None", "None"), ("5", "5"), ("9", "9")])
    assert ngram_components(docs_of([]), 3, 90, 100).count() == 0


def test_prefix_lengths_lose_no_pair():
    from tavola.llm.ngram_join import prefix_lengths
    for num in (80, 90):
        n = np.arange(1, 400)
        length, need = prefix_lengths(n, num, 100)
        for a, la, na in zip(n, length, need):
            t = -(-num * a // 100)
            assert 1 <= na <= la - (a - t) and la <= a
            for b in range(t, a + 1):  # a smaller set that may link
                d = b - -(-num * b // 100)
                assert d // 2 + 1 >= na and length[b - 1] == min(b, d + d // 2 + 1)


def test_components_of_chains_and_stars(llm):
    from tavola.llm.components import components
    rng = random.Random(4)
    g, edges = Groups(), []
    for k in range(150):
        a, b = (k, k + 1) if k < 60 else (200, 201 + k) if k < 110 else (rng.randrange(500, 560), rng.randrange(500, 560))
        edges.append((a, b) if rng.random() < 0.5 else (b, a))
        g.join(a, b)
    got = {r["node"]: r["component"] for r in components(llm.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: g.find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want
    assert components(llm.createDataFrame([], "u long, v long")).count() == 0


def vectors_of(llm, rows):
    return llm.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, "x") for i, v, c in rows],
                               "vec_id long, embedding array<float>, label int, kept string")


def brute_vectors(rows, reach=0.93):
    unit = {}
    for i, v, c in rows:
        x = None if v is None or any(a is None for a in v) else np.array(v, np.float32).astype(float)
        ok = c is not None and x is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
        unit[i] = x / np.linalg.norm(x) if ok else None
    g, n = Groups(), collections.Counter()
    for i, _, c in rows:
        g.find(i)
        for j, _, d in rows:
            if i < j and c == d and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= reach:
                g.join(i, j)
                n[i] += 1
                n[j] += 1
    return {i: (n[i], g.find(i)) for i, _, _ in rows}


def test_vector_graph_equals_brute_force(llm, monkeypatch):
    from tavola.llm import vector_graph as V
    rng = np.random.default_rng(6)
    rows = []
    for k in range(420):
        base = rng.normal(size=16)
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            rows.append((len(rows) * 2, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])).round(3).tolist(), int(rng.choice([0, 0, 0, 1, 2]))))
    same = rng.normal(size=16).round(3).tolist()
    rows += [(10000 + k, same, 0) for k in range(80)] + [(11000, [2 * x for x in same], 0), (11001, same, 1), (11002, same, None), (11003, None, 0), (11004, [0.0] * 16, 0),
             (11005, [math.nan] * 16, 0), (11006, [None] * 16, 0), (11007, [], 0), (11008, same[:8], 0), (11009, [1e30] * 16, 0), (11010, [1e-30] * 16, 0), (11011, [math.inf] * 16, 0)]
    monkeypatch.setattr(V, "MAX_ROWS", 150)  # several levels of cells, and cores that do not split
    got = {r["vec_id"]: r for r in V.near_duplicates(vectors_of(llm, rows)).collect()}
    want = brute_vectors(rows)
    assert set(got) == set(want)
    links, found = sum(n for n, _ in want.values()), sum(min(got[i]["n_links"], n) for i, (n, _) in want.items())
    assert found >= 0.98 * links and all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert sum(got[i]["component_id"] != c for i, (_, c) in want.items()) <= 0.02 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_vector_graph_of_few_rows(llm):
    from tavola.llm import vector_graph as V
    assert V.near_duplicates(vectors_of(llm, [])).count() == 0
    rows = [(1, [1, 0], 0), (None, [1, 0], 0), (1, [1, 0], 0), (3, [0, 1], 0)]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in V.near_duplicates(vectors_of(llm, rows)).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("3", 0, "3", True), ("None", 2, "1", False)]


def test_language_model_base_is_exact_and_score_better(llm, docs_of):
    from tavola.llm import language_model as L
    from tavola.llm.shared import crc_mod
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()] + [(90001, None), (90002, ""), (90003, "never-seen-word")]
    tokens = {i: words(t) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in L.score(docs_of(rows), crc_mod("doc_id", 7) == 2).collect()}
    assert set(got) == set(tokens)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * len(t) and r["score"] < 0
    out = [i for i in tokens if held[i]]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out) + 0.1 * sum(len(tokens[i]) for i in out)


def test_language_model_is_normalised():
    from tavola.llm.language_model import LogBilinear
    share = np.random.default_rng(0).dirichlet(np.ones(40))
    m = LogBilinear(share)
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 40, 20_000)
    tokens[1::2] = (tokens[::2] + 1) % 40  # every second token follows from the one before
    one, two = np.append(0, tokens[:-1]), np.append([0, 0], tokens[:-2])
    m.start()
    for k in range(12):
        m.train(tokens, one, two, rng, 0.2)
    every = np.arange(40)
    assert abs((10 ** m.log10_probability(every, np.full(40, 3), np.full(40, 5))).sum() - 1) < 1e-4
    assert m.log10_probability(tokens, one, two).mean() > np.log10(share[tokens]).mean() + 0.3


def test_language_model_without_training_rows(llm, docs_of):
    from tavola.llm import language_model as L
    got = L.score(docs_of([(1, "a b"), (None, None)]), F.lit(True)).collect()
    assert len(got) == 2 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in got)
    assert L.score(docs_of([]), F.lit(False)).count() == 0


def test_html_text_of_the_pages(llm):
    from tavola.llm import html_text as H
    pages = llm.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_html_text_leaves_out_what_stands_aside(llm):
    from tavola.llm import html_text as H
    para = "<p>Long running text number %d with <b>bold</b> parts &amp; a&nbsp;reference &#233; that goes on for quite some time, to be told from menus.</p>"
    page = ("<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body class='with-sidebar'><header><p>Site name of the day</p></header><nav><a href=x>menu</a></nav>"
            "<div class='cookie-notice'><p>We use cookies for a better experience on this site and more</p></div><div id=content7 class='post main'><h1>Title %d</h1>" + para * 3 +
            "<div class='ad-box'><p>Buy now</p></div><form><p>Your mail <input></p></form><ul><li>point<li>other</ul></div><div class=comments><p>First! %d</p></div><aside>side</aside>"
            "<footer>foot</footer></body>")
    rows = [(k, "http://Host.example:80/%d" % k, page % (k, k, k, k, k)) for k in range(5)]
    rows += [(10, None, None), (11, "http://host.example/x", ""), (12, "notaurl", "plain text\n only"), (13, "http://other.example/", "<p>unclosed <i>words</p><p>two"), (1, "http://host.example/1", page % (1, 1, 1, 1, 1))]
    df = llm.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"]) for r in H.extract(df).collect()), key=lambda x: x[0])
    want = lambda k: "\n".join([f"Title {k}", *[f"Long running text number {k} with bold parts & a reference é that goes on for quite some time, to be told from menus."] * 3, "point", "other"])
    assert [t for _, t in got[:6]] == [want(0), want(1), want(1), want(2), want(3), want(4)]
    assert dict(got)[10] == "" and dict(got)[11] == ""
    assert H.extract(df.limit(0)).count() == 0


def test_classifier_learns_only_from_training_rows(llm, docs_of):
    from tavola.llm import nbsvm
    from tavola.llm.shared import crc_mod
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 5) == 0
    scored = nbsvm.classify(docs, labels, train=~held)
    r = (scored.join(labels, "doc_id").where(held).agg(F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("predicted"))).alias("bad"))).first()
    assert r["good"] > 0.97 and r["bad"] < 0.25
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x["doc_id"]: x["score"] for x in nbsvm.classify(docs, flipped, train=~held).select("doc_id", "score").collect()}
    assert all(abs(x["score"] - again[x["doc_id"]]) < 1e-9 for x in scored.select("doc_id", "score").collect())


def test_classifier_of_odd_rows(llm, docs_of):
    from tavola.llm import nbsvm
    rows = [(1, None), (2, ""), (None, "words here"), (4, "x" * 100_000), (1, None)]
    labels = llm.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = nbsvm.classify(docs_of(rows), labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["kept"] == "x" for r in got)
    assert nbsvm.classify(docs_of([]), labels.limit(0)).count() == 0


def test_pipeline_stage_by_stage(llm):
    import corpus_pipeline as P

    from tavola.llm import nbsvm, pii, quality_rules
    from tavola.llm.shared import crc_mod
    sf = "/root/testdata/sf0.001"
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    labels = llm.read.parquet(f"{sf}/labels.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(llm, docs, sf)
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality_classifier":
            want = {r["doc_id"] for r in nbsvm.classify(docs, labels, train=crc_mod("doc_id", 5) != 0).where("predicted = 1").collect()}
        elif name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.judge(docs, quality_rules.fit(docs, labels)).where("kept").collect()}
            assert all(r["doc_id"] not in want for r in docs.collect() if len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) < 50)
        elif name == "ngram_join":
            want = {c for _, c in jaccard_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100).values()}
        else:
            want = {r["doc_id"] for r in docs.collect()}
            assert out.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
            assert out.where("n_chars != char_length(text)").count() == 0 and pii.redact(docs).count() == docs.count()
        assert ids == want
        kept[name] = len(ids)
        docs = out.checkpoint()
    assert kept["ngram_join"] > 0
    pieces = P.STAGES[-1][1](llm, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == ids
    run = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in P.run(llm, sf).collect()}
    assert run == {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pieces.collect()}


def test_pipeline_near_duplicates_of_odd_rows(llm, docs_of):
    import corpus_pipeline as P
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, "z y"), (None, "z y"), (3, None), (4, None)]
    got = P.near_duplicates(llm, docs_of(rows), "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [("1", "a b c d e f"), ("3", "None"), ("4", "None"), ("None", "z y")]


def test_pipeline_near_duplicates_without_ids_and_with_repeated_ids(llm, docs_of):
    import corpus_pipeline as P
    near = [" ".join(["w%d" % k for k in range(40)] + [x]) for x in ("a", "b", "c")]
    rows = [(None, near[0]), (None, near[1]), (None, near[2]), (0, "b b b b b b"), (1, "a a a a a a"), (1, "b b b b b b"), (5, ""), (5, ""), (5, " "), (None, ""), (None, "")]
    got = sorted((str(r["doc_id"]), r["text"] if r["text"] not in near else "near") for r in P.near_duplicates(llm, docs_of(rows), "").collect())
    assert got == sorted([("None", "near"), ("0", "b b b b b b"), ("1", "a a a a a a"), ("5", ""), ("5", " "), ("None", "")])


def test_pipeline_stages_of_no_rows_and_of_clashing_names(llm, docs_of):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    clash = docs.withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "quality": F.lit("q"), "kept": F.lit("k"), "_number": F.lit("n"), "base_failed": F.lit("b")})
    for name, stage in P.STAGES[:-1]:
        none = stage(llm, docs.where("false"), sf)
        assert none.columns == docs.columns and none.count() == 0, name
        plain, odd = stage(llm, docs, sf), stage(llm, clash, sf)
        assert odd.columns == clash.columns
        assert sorted(r.doc_id for r in odd.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect()), name
        assert odd.select("score", "predicted", "quality", "kept", "_number", "base_failed").distinct().collect() == [("s", "p", "q", "k", "n", "b")], name
    assert P.STAGES[-1][1](llm, docs.where("false"), sf).count() == 0


def test_classifier_scores_do_not_depend_on_partitions(llm):
    from tavola.llm import nbsvm
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = llm.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one, other = ({r.doc_id: r.score for r in nbsvm.classify(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == other


def near_copy_groups(rng, sizes, dim=64, noise=0.02):
    """(vec_id, vector, label) of groups of distinct near copies around far-apart centres."""
    rows = []
    for n in sizes:
        base = rng.normal(size=dim)
        rows += [(len(rows) + k, (base + rng.normal(size=dim) * noise).tolist(), 0) for k in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [[70] * 20, [300] * 4])
def test_vector_graph_links_groups_larger_than_the_candidates(llm, monkeypatch, sizes):
    from tavola.llm import vector_graph as V
    rows = near_copy_groups(np.random.default_rng(3), sizes)
    recalls = []
    audit = V.audit
    monkeypatch.setattr(V, "audit", lambda *a: recalls.append(audit(*a)) or recalls[-1])
    got = {r["vec_id"]: r for r in V.near_duplicates(vectors_of(llm, rows)).collect()}
    want = brute_vectors(rows)
    assert len(recalls) == 1  # by the graph, without a second search
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want


def test_vector_graph_searches_exactly_or_fails_where_the_audit_does(llm, monkeypatch):
    from tavola.llm import vector_graph as V
    rows = near_copy_groups(np.random.default_rng(4), [3, 2, 2])
    monkeypatch.setattr(V, "range_search", lambda x, adj, q, *a: np.zeros((len(q), len(x)), bool))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_duplicates(vectors_of(llm, rows)).collect()}
    assert got == brute_vectors(rows)
    monkeypatch.setattr(V, "audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="recall"):
        V.near_duplicates(vectors_of(llm, rows))


def test_vector_audit_sees_lost_pairs_beside_a_hot_group(llm, monkeypatch):
    from tavola.llm import vector_graph as V
    rng = np.random.default_rng(5)
    rows = near_copy_groups(rng, [300, *[2] * 60])
    rows += [(10000 + k, rows[0][1], 0) for k in range(1200)]  # copies of one of the group
    recalls = []
    audit, search = V.audit, V.range_search
    monkeypatch.setattr(V, "audit", lambda *a: recalls.append(audit(*a)) or recalls[-1])

    def without_some_pairs(x, adj, q, *a):
        found = search(x, adj, q, *a)
        found[(found.sum(axis=1) <= 2) & (np.arange(len(q)) % 4 == 0)] = False
        return found
    monkeypatch.setattr(V, "range_search", without_some_pairs)
    got = {r["vec_id"]: r["n_links"] for r in V.near_duplicates(vectors_of(llm, rows)).collect()}
    assert recalls[0] < 0.98 and recalls[-1] == 1.0
    assert all(got[300 + k] == 1 for k in range(120)) and got[10000] == 1499


def test_nbsvm_learns_words_of_equal_typography(llm, docs_of):
    from tavola.llm import nbsvm
    rng = random.Random(8)
    kinds = [["abra", "kado", "lima", "mora", "nelo", "pira"], ["sefa", "tulo", "vena", "wiko", "xeta", "zoru"]]
    both = ["bena", "cifo", "dalu", "fero", "gima", "hoku"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2] + both) for _ in range(40))) for i in range(400)]
    labels = llm.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in nbsvm.classify(docs_of(rows), labels).collect()}
    right = sum((got[i] >= 0.5) == (i % 2 == 1) for i in range(300, 400))
    assert right >= 95
