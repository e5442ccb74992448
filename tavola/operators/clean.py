"""Cleaning of the raw item table: rename, de-duplicate, text, outliers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions.exprs import clean_text_col, present
from tavola.functions.stats import quantiles

# Raw header -> snake_case name of the default item schema.
DEFAULT_RENAME = {
    "State": "state",
    "City": "city",
    "Restaurant Name": "restaurant_name",
    "Location": "location",
    "Category": "category",
    "Dish Name": "dish_name",
    "Price (INR)": "price",
    "Rating": "rating",
    "Rating Count": "rating_count",
}

TEXT_COLUMNS = ("state", "city", "restaurant_name", "location", "category", "dish_name")


def standardize_columns(df: DataFrame, mapping: Mapping[str, str] = DEFAULT_RENAME) -> DataFrame:
    """Rename known headers; unknown columns are kept as they are."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Keep one copy of rows equal on every column (nulls compare equal).

    One shuffle on all columns; map-side partial aggregation collapses heavy
    duplicate groups before the exchange.
    """
    return df.dropDuplicates()


def clean_text(df: DataFrame, cols: Iterable[str] = TEXT_COLUMNS) -> DataFrame:
    """strip, lower, 'nan'/'none' -> null, whitespace runs -> one space."""
    return df.withColumns({c: clean_text_col(c) for c in present(df, cols)})


def cap_outliers_iqr(df: DataFrame, column: str = "price", k: float = 1.5,
                     method: str = "auto") -> DataFrame:
    """Clip ``column`` to [Q1 - k*IQR, Q3 + k*IQR]; nulls stay null.

    Bounds come from linear-interpolated quantiles of the whole column,
    evaluated once as a scalar subquery (no join).  ``method`` selects the
    quantile strategy (see ``tavola.functions.stats.quantiles``).
    """
    if column not in df.columns:
        return df
    qs = quantiles(df, column, [0.25, 0.75], method=method)
    q1, q3 = F.col("_q").getItem(0), F.col("_q").getItem(1)
    lo = q1 - F.lit(k) * (q3 - q1)
    hi = q3 + F.lit(k) * (q3 - q1)
    c = F.col(column)
    return (df.withColumn("_q", qs)
            .withColumn(column, F.when(c < lo, lo).when(c > hi, hi).otherwise(c))
            .drop("_q"))


def log_transform(df: DataFrame, column: str = "rating_count", out: str | None = None) -> DataFrame:
    """``out = ln(1 + column)`` (default name ``<column>_log``)."""
    if column not in df.columns:
        return df
    return df.withColumn(out or f"{column}_log", F.log1p(F.col(column).cast("double")))


def clean_items(df: DataFrame, mapping: Mapping[str, str] = DEFAULT_RENAME,
                text_cols: Iterable[str] = TEXT_COLUMNS, cap_column: str = "price",
                log_column: str = "rating_count", quantile_method: str = "auto") -> DataFrame:
    """rename -> de-duplicate -> clean text -> cap outliers -> log column.

    De-duplication runs before text cleaning, so rows that only become equal
    after cleaning are all kept (the reference's order).
    """
    return (df.transform(standardize_columns, mapping)
              .transform(drop_exact_duplicates)
              .transform(clean_text, text_cols)
              .transform(cap_outliers_iqr, cap_column, 1.5, quantile_method)
              .transform(log_transform, log_column))


def validate_cleaning(items: DataFrame, entities: DataFrame) -> DataFrame:
    """rows, entities, mean items per entity, null cells left, duplicates left.

    One row; the entity count and the distinct-row count are scalar
    subqueries, so the whole report is one lazy plan.
    """
    null_cells = sum((F.count_if(F.col(c).isNull()) for c in items.columns), F.lit(0))
    n_entities = entities.agg(F.count("*")).scalar()
    n_distinct = items.distinct().agg(F.count("*")).scalar()
    return (items.agg(F.count("*").alias("rows"), null_cells.cast("long").alias("missing_cells"))
            .select("rows", n_entities.alias("entities"),
                    F.try_divide(F.col("rows").cast("double"), n_entities).alias("items_per_entity"),
                    "missing_cells", (F.col("rows") - n_distinct).alias("duplicates")))
