"""Query catalog: every registered query runs a library operator over the
fixture views built from the driver's tables, with an equivalent DuckDB SQL
oracle where the operator is SQL-expressible.

Double columns are rounded to 6 decimals on both engines with the same binary
operation, rint(round(x, 9) * 1e6) / 1e6 (last-digit float differences
between engines are not semantic)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.plans.oracle import build


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    dbl: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Entry] = {}


def register(name: str, body: str | None = None, ctes: tuple[str, ...] = (), dbl: tuple[str, ...] = ()):
    def deco(fn):
        sql = build(body, *ctes, round_cols=dbl) if body else None
        REGISTRY[name] = Entry(fn, sql, tuple(dbl))
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    scale = float(10 ** digits)
    # pre-round to 9 decimals so that summation-order noise cannot flip an
    # exact half-way value (e.g. a mean of 4.1546875) between engines
    cols = {n: F.rint(F.round(F.col(f"`{n}`"), 9) * scale) / scale for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(cols) if cols else df


# Runtime SQL settings the queries rely on (a session created elsewhere, e.g.
# by the driver, gets them on first use).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # medians and category sets of an entity are small buffers: hash many of them before
    # a task starts to sort its rows
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
}


def _prepare(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def wrap(e: Entry):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _prepare(spark)
            return round_doubles(e.fn(spark, sf_dir))
        return run
    return {k: wrap(e) for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql}


def _load() -> None:
    # Importing the query modules fills REGISTRY.
    from tavola.plans import (  # noqa: F401
        queries_core, queries_diagnose, queries_eda, queries_eval, queries_features, queries_profile,
        queries_ml, queries_monitor, queries_score, queries_sources, queries_stream,
    )
