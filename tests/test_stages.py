"""Stages of the pipeline are compressed tables whose scans read the columns they need."""

import uuid

from tavola.plans import venue


def test_a_stage_is_a_pruned_parquet_scan(spark):
    sf = f"stages-{uuid.uuid4().hex}"
    d = venue.stage(spark, sf, "wide", lambda: spark.range(1000).selectExpr("id", "repeat('x', 100) AS text", "id % 3 AS n"))
    assert d.inputFiles() and all(f.endswith(".parquet") for f in d.inputFiles())
    plan = d.groupBy("n").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n:bigint>" in plan
    assert venue.stage(spark, sf, "wide", lambda: None) is d and d.count() == 1000


def test_cleaned_items_are_read_from_the_written_text_stage(spark):
    from tavola.plans import venue
    files = venue.clean(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/items_text-" in f for f in files)


def test_capped_prices_are_read_from_the_text_stage_only(spark, monkeypatch):
    """De-duplicated once: neither the bounds nor the prices repeat its shuffle."""
    from tavola.plans import queries_core as Q

    monkeypatch.setattr(venue, "raw_items", lambda *_: 1 / 0)
    d = Q.q_cap_outliers_iqr(spark, "/root/testdata/sf0.001")
    assert d.inputFiles() and all("/items_text-" in f for f in d.inputFiles())
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<price:double>" in plan and "dish_name" not in plan
