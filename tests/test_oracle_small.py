"""Every registered query with a SQL oracle must equal DuckDB on sf0.001
(the driver checks the same at sf0.01); queries without one must run."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tavola.plans import catalog
from tavola.fixtures import BASE_TABLES

SMALL = "/root/testdata/sf0.001"

QUERIES = catalog.queries()  # the training-data queries have tests of their own
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    sp = df.toPandas()
    if name not in ORACLES:
        assert len(sp.columns) > 0
        return
    dk = con.sql(ORACLES[name]).df()
    cols = sorted(sp.columns)
    assert cols == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert _rows(sp, cols) == _rows(dk, cols)


def test_double_columns_are_declared(spark):
    """The oracle rounds exactly the double columns the Spark side rounds."""
    from tavola.plans.catalog import REGISTRY
    for name, e in REGISTRY.items():
        if not e.sql:
            continue
        df = e.fn(spark, SMALL)
        doubles = {n for n, t in df.dtypes if t in ("double", "float")}
        assert doubles <= set(e.dbl), (name, doubles - set(e.dbl))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "is_premium" in df.columns


@pytest.mark.parametrize("name", ["clean_items", "cap_outliers_iqr", "rollup_entities", "price_by_category",
                                  "log_metrics", "mutual_information", "impute_median"])
def test_distributed_exact_paths_match_oracle(spark, con, name):
    """Force the distributed exact-quantile / median paths (tiny distinct
    limit) and compare with the same DuckDB oracle."""
    spark.conf.set("tavola.quantile.exactDistinctLimit", "5")
    try:
        sp = QUERIES[name](spark, SMALL).toPandas()
    finally:
        spark.conf.unset("tavola.quantile.exactDistinctLimit")
    dk = con.sql(ORACLES[name]).df()
    cols = sorted(sp.columns)
    assert cols == sorted(dk.columns)
    assert _rows(sp, cols) == _rows(dk, cols)
