"""Helpers of the training-data operators: written stages and labelled rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the folder that spark.checkpoint.dir
    names, and read again: computed once, lineage cut, safe when executors go."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


#: Shuffle files go when the execution that wrote them ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions begun in here leave no shuffle files: for those whose rows are kept elsewhere."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a frame that ``written`` made, when nothing will read it any more."""
    spark = df.sparkSession
    top = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/"
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.makeQualified(path).getParent().equals(fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(top))):
            fs.delete(path, True)


def labelled(features: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Rows of features (keyed by doc_id) with ``label`` 0 or 1.  Null ids and
    other labels count as absent; of several labels of an id the smallest holds."""
    one = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label")))
    return features.join(one, "doc_id")


def bounded_sample(rows: DataFrame, key: str, n: int, limit: int) -> DataFrame:
    """About ``limit`` of ``n`` rows, at most that many, picked by a hash of ``key``."""
    if n <= limit:
        return rows
    space = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(space)) < int(space * 0.97 * limit / n)).limit(limit)


def crc_mod(key: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def trimmed(task):
    """A task function over batches that, at its end, gives the memory it has freed back
    to the system: idle Python workers hold little, however many stages they served."""
    import functools

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()
    return run


def give_back() -> None:
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


#: Texts reach Python in small batches, so a worker's memory does not depend on their number.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship_package(spark) -> None:
    """The package's modules on the executors (``session.ship_package``), and small batches."""
    from tavola import session
    for k, v in ARROW.items():
        spark.conf.set(k, v)
    session.ship_package(spark)
