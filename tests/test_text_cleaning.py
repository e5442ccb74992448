"""Text cleaning without patterns where none is needed, and raw items that are not written for it."""

import re
import uuid

from pyspark.sql import functions as F

from tavola import fixtures
from tavola.functions.exprs import clean_text_col
from tavola.plans import venue

BLANK = r"[\t-\r \x85\xa0  -     　]"
TEXTS = [None, "", " ", "   ", "abc", "  ABC  d ", "a  b   c", "NaN", " none ", "None\t", "\tnan", "no\nne", "a\x0bb\x0c", "\r x \r", "a\x1cb \x1f",
         " CafÉ  x", "　nan　", "Ä  Ö", "x\u0085y", " ", "it's  100%", "​ a", "\x00 a", "na n", " no  ne "]


def test_every_text_is_cleaned_as_by_the_patterns(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", clean_text_col("t").alias("c")).collect()
    for r in got:
        t = TEXTS[r.i]
        t = t if t is None else re.sub(f"^{BLANK}+|{BLANK}+$", "", t).lower()
        assert r.c == (None if t in (None, "nan", "none") else re.sub(f"{BLANK}+", " ", t)), TEXTS[r.i]


def test_plain_texts_meet_no_unicode_pattern(spark):
    cleaned = spark.range(1).select(F.lit("a b").alias("t")).select(clean_text_col("t").alias("c"))
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()  # constants are folded along the branch that holds
    assert "(?U)" not in plan and cleaned.first().c == "a b"
    text = spark.range(1).select(F.col("id").cast("string").alias("t")).select(clean_text_col("t").alias("c"))
    plan = text._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("octet_length") < plan.index("(?U)")


def test_text_stage_does_not_write_the_raw_items(spark, monkeypatch):
    sf, rows = f"raw-{uuid.uuid4().hex}", [("s", " C  c", "N", "l", "None", "d", 1.0, 4.0, 3)] * 2
    raw = spark.createDataFrame(rows, "state string, city string, restaurant_name string, location string, category string, dish_name string, price double, rating double, rating_count int")
    monkeypatch.setattr(fixtures, "fx_items", lambda *_: raw)
    assert [tuple(r) for r in venue.items_text(spark, sf).collect()] == [("s", "c c", "n", "l", None, "d", 1.0, 4.0, 3)]
    assert (spark.sparkContext.applicationId, sf, "raw_items") not in venue._STAGES
