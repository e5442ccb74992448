"""Readers and writers.  Schemas are fixed on read (no inference)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

# Default raw item schema (raw headers) and the missing-value
# tokens a pandas CSV reader maps to null.
RAW_ITEM_SCHEMA = ("`State` string, `City` string, `Restaurant Name` string, `Location` string, "
                   "`Category` string, `Dish Name` string, `Price (INR)` double, `Rating` double, "
                   "`Rating Count` int")
#: Column for CSV records that do not fit their header (kept whole, never dropped).
CORRUPT = "_corrupt_record"
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

LOG_SCHEMA = ("timestamp timestamp, model string, features map<string,double>, "
              "prediction struct<prediction:int,probability:double,confidence:string>, "
              "response_time double, success boolean, feature_count int")


def _header_groups(spark: SparkSession, path: str | Sequence[str], options: Mapping[str, object]) -> dict[tuple[str, ...], list[str]]:
    """Files by their headers.  Listing reads no content; of each file Spark's CSV reader
    takes the header record, some files at a time."""
    paths = [path] if isinstance(path, str) else list(path)
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(paths).select("path").collect())
    with ThreadPoolExecutor(max_workers=8) as ex:
        headers = list(ex.map(lambda f: tuple(spark.read.options(**options).csv(f).columns), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for f, names in zip(files, headers):
        groups.setdefault(names, []).append(f)
    return groups


def read_items(spark: SparkSession, path: str | Sequence[str], schema: str = RAW_ITEM_SCHEMA, fmt: str = "csv",
               na_tokens: Sequence[str] = NA_TOKENS, report_corrupt: bool = False, multi_line: bool = True) -> DataFrame:
    """Raw item table with the columns and types of ``schema``.

    CSV columns are found by header name: files with the same header are read
    together, and the groups are united by name (columns that ``schema`` lacks are left
    out, absent ones are null, files without a header give no rows).  A quoted cell may
    hold line breaks; that needs ``multi_line``, with which a file is read by one task, so
    large files come as many, and without which a large file is split.  Missing-value
    tokens become null in every column; numbers are read as doubles first, so a count
    written ``5.0`` is 5, and NaN is null.  No record is dropped; with
    ``report_corrupt`` one more column, ``_corrupt_record``, has the whole record
    where it does not fit its header or a cell is no number, else null."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        return df.select(*_typed(df, df.columns, want, na_tokens)[0])
    opts = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    out = None
    for names, files in sorted(_header_groups(spark, path, opts | {"inferSchema": False}).items()):
        if not names:
            continue
        text = StructType([StructField(n, StringType()) for n in names] + [StructField(CORRUPT, StringType())])
        df = spark.read.schema(text).options(**opts, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=False).csv(files)
        columns, bad = _typed(df, names, want, na_tokens)
        whole = F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]))
        part = df.select(*columns, F.coalesce(F.col(CORRUPT), F.when(bad, whole)).alias(CORRUPT))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], StructType([*want.fields, StructField(CORRUPT, StringType())]))
    return out if report_corrupt else out.drop(CORRUPT)


def _typed(df: DataFrame, names: Sequence[str], want: StructType, na_tokens: Sequence[str]) -> tuple[list[Column], Column]:
    """The wanted columns, and whether a cell is no number where one is wanted."""
    out, bad = [], F.lit(False)
    for f in want.fields:
        if f.name not in names:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        given = F.when(~c.cast("string").isin(list(na_tokens)), c)
        if isinstance(f.dataType, StringType):
            out.append(given.cast("string").alias(f.name))
        elif isinstance(f.dataType, NumericType):
            x = F.trim(given.cast("string")).try_cast("double")
            bad |= given.isNotNull() & x.isNull()
            out.append(F.when(~F.isnan(x), x).try_cast(f.dataType).alias(f.name))
        else:
            out.append(given.try_cast(f.dataType).alias(f.name))
    return out, bad


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # keep padding: the CSV writer trims by default
        (w.option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)  # without a schema all columns are text
    return r.format(fmt).load(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Metric/insight reports as CSV (header), check/monitor reports as JSON
    lines.  The last stage writes as many files as it has tasks; adaptive
    execution makes that one for a small report."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_metadata(spark: SparkSession, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (task, position, feature)."""
    rows = [(t, i, f) for t, fs in sets.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "task string, position int, feature string")


def save_feature_metadata(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").parquet(path)


def read_feature_metadata(spark: SparkSession, path: str) -> dict[str, list[str]]:
    rows = spark.read.parquet(path).orderBy("task", "position").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["task"], []).append(r["feature"])
    return out


def read_prediction_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Records appended to the folder and those of committed stream batches in it."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def commit_batch(records: DataFrame, path: str, batch_id: int) -> bool:
    """Append a stream's micro-batch to the log in ``path`` exactly once.

    The batch id is the transaction: records go to a hidden folder, which is renamed
    to ``batch-<id>`` when all are written.  A batch that was committed before (the
    stream stopped before it could note so) is left as it is; what an attempt that
    did not end has left is never read.  Returns whether this call committed it."""
    spark = records.sparkSession
    done = f"{path.rstrip('/')}/batch-{batch_id:09d}"
    attempt = f"{path.rstrip('/')}/_attempt-{batch_id:09d}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(done).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(done)):
        return False
    records.write.json(attempt)
    if not fs.rename(hadoop(attempt), hadoop(done)):
        raise OSError(f"cannot commit {done}")
    return True


def append_prediction_log(records: DataFrame, path: str) -> None:
    """Append log records, stamping ``feature_count`` from the feature map
    and defaulting ``success`` to true."""
    out = records
    if "feature_count" not in out.columns:
        out = out.withColumn("feature_count", F.size("features"))
    if "success" not in out.columns:
        out = out.withColumn("success", F.lit(True))
    out.select("timestamp", "model", "features", "prediction", "response_time", "success",
               "feature_count").write.mode("append").json(path)


def read_prediction_log_stream(spark: SparkSession, path: str, schema: str = LOG_SCHEMA,
                               max_files_per_trigger: int | None = None) -> DataFrame:
    """The JSON prediction log as a stream (new files are picked up as they
    are appended)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)
