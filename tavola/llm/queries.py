"""Registered queries of the training-data operators; each applies one
operator with its production parameters to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm.shared import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import bpe
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import nbsvm
    from tavola.llm.shared import crc_mod
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 5) == 0
    scored = nbsvm.classify(docs, table(spark, sf_dir, "labels"), train=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import packing
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.assign(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import quality_rules
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import ngram_join
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import html_text
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import pii
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.listed({k: F.col(k) for k in pii.KINDS}), 256).alias("base_sha256"), pii.listed(pii.all_spans()).alias("spans"))


@query
def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import vector_graph
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import license_scan
    shown = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("coverage"), F.array_join(shown, ",").alias("spans"))


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import language_model
    from tavola.llm.shared import crc_mod
    return language_model.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import exact_dedup
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


SQL["op11_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
             row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept
      FROM t WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import hard_negatives
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL["op13_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows damaged by the hash of their place; ``present`` is false for dropped ones."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
            .withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": text, "present": F.col("kind") != 0,
                          "again": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))}))


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tavola.llm import conversations
    return conversations.report(damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def _state(after: str, keep: str) -> str:
    """Cheapest (cost, audit, text) in ``after`` by deleting, keeping or a new role; ``keep``: state that keeping leads to."""
    to, role = ("h3", "assistant") if after == "h2" else ("h2", "user")
    line = "CASE WHEN {0}.t = '' THEN {1} ELSE {1} || chr(10) || {0}.t END"
    ways = [f"{{'c': {after}.c + 2, 'a': 'D' || {after}.a, 't': {after}.t}}",
            f"CASE WHEN fault IN (0, 3) THEN {{'c': {to}.c + 1 + unfit, 'a': 'R' || {to}.a, 't': {line.format(to, repr(role + ':') + ' || text')}}} END"]
    for initial, target in {"u": "h2", "a": "h3", "s": "h1"}.items():
        if initial in keep:
            kept = line.format(target, "role || ':' || text")
            ways.append(f"CASE WHEN fault IN (0, 3) AND left(role, 1) = '{initial}' THEN {{'c': {target}.c + unfit, 'a': 'K' || {target}.a, 't': {kept}}} END")
    return f"list_min([{', '.join(ways)}])"


def _inserted(own: str, to: str, role: str) -> str:
    """The cheaper of ``own`` and a row of ``role`` put before ``to``."""
    text = f"CASE WHEN {to}.t = '' THEN '{role}:' ELSE '{role}:' || chr(10) || {to}.t END"
    return f"list_min([{own}, {{'c': {to}.c + 5, 'a': 'I' || {to}.a, 't': {text}}}])"


#: From the last row of each conversation to the first: h0 to h3 hold the cheapest
#: (cost, audit, repaired text) from the states start, after s, after u, after a.
SQL["op12_conversations"] = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
crc AS (SELECT DISTINCT place, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(place, ''), lambda x: ord(x)::BIGINT)),
                 lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT for _ in range(8)]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM o),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM o JOIN crc USING (place) JOIN (VALUES (0), (1)) v(again) ON again = 0 OR kind = 3 WHERE kind <> 0),
p AS (SELECT *, row_number() OVER place AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             left(lag(role) OVER place, 1) || left(role, 1) AS pair, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
      FROM d WINDOW place AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS copied FROM p),
j AS (SELECT *, CASE WHEN shown = '' THEN 1 WHEN copied THEN 2 WHEN right(shown, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
             CASE WHEN shown <> '' AND NOT copied AND right(shown, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS unfit FROM f),
walk AS (SELECT conv_id, n + 1 AS k, {{'c': 0, 'a': '', 't': ''}} AS h0, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS h1,
                {{'c': 5, 'a': 'I', 't': 'assistant:'}} AS h2, {{'c': 0, 'a': '', 't': ''}} AS h3 FROM j WHERE k = n
         UNION ALL
         SELECT conv_id, k, {_inserted('g0', 'i2', 'user')}, {_inserted('g1', 'i2', 'user')}, i2, i3
         FROM (SELECT *, {_inserted('g2', 'g3', 'assistant')} AS i2, {_inserted('g3', 'g2', 'user')} AS i3
               FROM (SELECT j.conv_id, j.k, {_state('h0', 'su')} AS g0, {_state('h1', 'u')} AS g1, {_state('h2', 'a')} AS g2, {_state('h3', 'u')} AS g3
                     FROM walk JOIN j ON j.conv_id IS NOT DISTINCT FROM walk.conv_id AND j.k = walk.k - 1))),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1)::BIGINT AS blank, count_if(fault = 2)::BIGINT AS duplicate,
                 count_if(fault = 3)::BIGINT AS truncated, count_if(k > 1 AND pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM j GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(h0.c, 0)::BIGINT AS cost, coalesce(h0.a, '') AS audit, sha256(coalesce(h0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM o) o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM o.conv_id AND walk.k = 1
"""
