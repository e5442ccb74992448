"""Corpus pipeline: five stages over ``documents``, each one operator of
``tavola.llm``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from tavola.llm import nbsvm, ngram_join, packing, pii, quality_rules  # noqa: E402
from tavola.llm.shared import crc_mod, ship_package, written  # noqa: E402

#: The stages train models and align numbers; SQL cannot express them.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _verdicts(docs: DataFrame) -> DataFrame:
    """docs as ids and texts, with each whole row beside them: no name of a column
    of docs meets one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 9) predicts to be of quality 1;
    labels of held-out documents are never learned from."""
    ship_package(spark)
    model = nbsvm.fit(docs.select("doc_id", "text"), _labels(spark, sf_dir), train=crc_mod("doc_id", 5) != 0)
    return nbsvm.score(_verdicts(docs), model).where("score >= 0.3").select("_row.*")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees (operator 2)."""
    ship_package(spark)
    trees = quality_rules.fit(docs.select("doc_id", "text"), _labels(spark, sf_dir))
    return quality_rules.judge(_verdicts(docs), trees).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 1, five words, similarity
    0.8): the one with the smallest id, rows without an id last, of rows that repeat
    an id one.  Empty texts link with nothing; of those, rows that repeat an id and a
    text are one document.  Every row gets a number, written once, and joins its group
    by it, with an id or without."""
    ship_package(spark)
    numbered = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_number")), "pipeline-numbered")
    groups = ngram_join.ngram_components(numbered.select(F.col("_number").alias("doc_id"), F.col("_row.text").alias("text")), n=5, num=80, den=100)
    named = numbered.select("_number", F.col("_row.doc_id").alias("id"), F.xxhash64(F.coalesce("_row.text", F.lit(""))).alias("h"))
    placed = groups.withColumnRenamed("doc_id", "_number").join(named, "_number")
    empty = F.col("n_shingles") == 0
    group = [F.when(~empty, F.col("component_id")).alias("g"), F.when(empty, F.col("id")).alias("i"), F.when(empty, F.col("h")).alias("t")]
    first = placed.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "_number")).alias("first")).select("first._number")
    return numbered.join(first, "_number", "left_semi").select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data (operator 5) replaced by its kind; n_chars follows the text."""
    ship_package(spark)
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences (operator 3)."""
    ship_package(spark)
    pieces = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.assign(pieces.withColumn("ids_crc32", F.crc32("ids")))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules_stage), ("ngram_join", near_duplicates), ("pii", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
