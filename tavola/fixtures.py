"""Test views over the driver's tables (see FIXTURES.md).

The view text is plain SQL accepted unchanged by Spark SQL and DuckDB, so the
Spark side and the DuckDB oracle read exactly the same input.  The views only
reshape the given tables; they never subset them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Raw item table: restaurant = customer, city = nation (half of them under the
# names of cities that the serving layouts know, with aliases), location = market
# segment, dish = part.  Padding/case noise, 'None', null keys, null prices and
# ratings, price outliers and exact duplicates are injected on purpose.
FX_ITEMS_SQL = """
WITH base AS (
  SELECT r_name AS state,
         CASE WHEN l_orderkey % 10 = 0 THEN concat('  ', lower(place), ' ') ELSE place END AS city,
         CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE c_name END AS restaurant_name,
         c_mktsegment AS location,
         CASE WHEN l_partkey % 50 = 0 THEN 'None' WHEN l_partkey % 50 = 1 THEN NULL ELSE p_type END AS category,
         CASE WHEN l_partkey % 7 = 0 THEN upper(replace(p_name, ' ', '   ')) ELSE p_name END AS dish_name,
         CASE WHEN l_partkey % 101 = 0 THEN NULL
              WHEN l_partkey % 97 = 0 THEN l_extendedprice / 100 * 5
              ELSE l_extendedprice / 100 END AS price,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE round(CAST(3.3 AS DOUBLE) + l_quantity / 30, 1) END AS rating,
         CAST(CASE WHEN l_orderkey % 11 = 0 THEN l_orderkey % 150 ELSE l_orderkey % 6 END AS INT) AS rating_count,
         l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey
                JOIN (SELECT *, CASE n_nationkey WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Bangalore' WHEN 2 THEN 'Delhi' WHEN 3 THEN 'Pune'
                                     WHEN 4 THEN 'Chennai' WHEN 5 THEN 'Kolkata' WHEN 6 THEN 'Hyderabad' WHEN 7 THEN 'Ahmedabad'
                                     WHEN 8 THEN 'Jaipur' WHEN 9 THEN 'Lucknow' WHEN 10 THEN 'Chandigarh' WHEN 11 THEN 'Bengaluru'
                                     WHEN 12 THEN 'New Delhi' ELSE n_name END AS place
                      FROM nation) AS places ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey
                JOIN part ON l_partkey = p_partkey)
SELECT state, city, restaurant_name, location, category, dish_name, price, rating, rating_count FROM base
UNION ALL
SELECT state, city, restaurant_name, location, category, dish_name, price, rating, rating_count FROM base WHERE l_orderkey % 100 = 3
"""

# Raw headers of the item table (input of the rename operator).
FX_ITEMS_RAW_SQL = """
SELECT state AS "State", city AS "City", restaurant_name AS "Restaurant Name", location AS "Location",
       category AS "Category", dish_name AS "Dish Name", price AS "Price (INR)", rating AS "Rating",
       rating_count AS "Rating Count"
FROM fx_items
"""

# Prediction log: one record per event.
FX_LOG_SQL = """
SELECT event_id AS log_id, ts,
       CASE WHEN event_type = 'view' THEN 'popular' WHEN event_type = 'purchase' THEN 'premium'
            WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'popular'
            WHEN event_type = 'error' AND user_id % 3 = 2 THEN 'premium' ELSE 'high_rated' END AS model,
       CAST(value / 100 AS DOUBLE) AS response_time,
       event_type <> 'error' AS success,
       13 AS feature_count,
       CASE WHEN user_id % 3 = 0 THEN 'standard' WHEN user_id % 3 = 1 THEN 'premium' ELSE 'budget' END AS scenario
FROM events
"""

# Scored table with ties, input of the evaluation operators.
FX_SCORED_SQL = """
SELECT c_custkey AS id, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS y,
       round(CAST((c_custkey * 37) % 71 AS DOUBLE) / 100 + CASE WHEN c_acctbal > 4500 THEN 0.25 ELSE 0 END, 4) AS p
FROM customer
"""

_VIEW_TABLES = {
    "fx_items": ("lineitem", "orders", "customer", "nation", "region", "part"),
    "fx_log": ("events",),
    "fx_scored": ("customer",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _register(spark: SparkSession, sf_dir: str, names) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def fx_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw item table with the snake_case schema."""
    _register(spark, sf_dir, _VIEW_TABLES["fx_items"])
    return spark.sql(FX_ITEMS_SQL)


def fx_items_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw item table with the original (spaced, capitalised) headers."""
    fx_items(spark, sf_dir).createOrReplaceTempView("fx_items")
    return spark.sql(FX_ITEMS_RAW_SQL.replace('"', "`"))


def fx_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log; ``ts`` is cast to a session-zone TIMESTAMP (UTC)."""
    _register(spark, sf_dir, _VIEW_TABLES["fx_log"])
    df = spark.sql(FX_LOG_SQL)
    return df.withColumn("ts", df["ts"].cast("timestamp"))


def fx_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir, _VIEW_TABLES["fx_scored"])
    return spark.sql(FX_SCORED_SQL)
