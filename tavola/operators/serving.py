"""Serving of raw requests: a vocabulary stage that is saved with the model,
requests filled up to the fields that the models know, and records of the
prediction log for every task in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.operators.features import ratio_features
from tavola.operators.score import CITY_ALIASES, REQUEST_FIELDS, by_task, rule_scores, score_batch, score_tasks


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Vocabulary:
    """The values of a text column that a model knows, and the columns it makes of them.

    A value is trimmed, lower-cased and replaced by its alias; what is not known
    (null included) counts as ``other``.  ``stage`` is the pipeline stage that adds the
    known value as ``<column>__known``; ``input_sql`` is the 0/1 input of one of ``names``."""

    values: tuple[str, ...]
    column: str = "city"
    aliases: Mapping[str, str] = field(default_factory=lambda: dict(CITY_ALIASES))
    other: str = "other"

    @property
    def names(self) -> list[str]:
        return [f"{self.column}_{v}" for v in (*self.values, self.other)]

    @property
    def known(self) -> str:
        return f"{self.column}__known"

    def known_sql(self) -> str:
        low = f"lower(trim(CAST(`{self.column}` AS STRING)))"
        cases = " ".join(f"WHEN {_sql_text(a)} THEN {_sql_text(v)}" for a, v in self.aliases.items())
        named = f"CASE {low} {cases} ELSE {low} END" if cases else low
        if not self.values:
            return _sql_text(self.other)
        return f"CASE WHEN {named} IN ({', '.join(map(_sql_text, self.values))}) THEN {named} ELSE {_sql_text(self.other)} END"

    def stage(self) -> SQLTransformer:
        return SQLTransformer(statement=f"SELECT *, {self.known_sql()} AS `{self.known}` FROM __THIS__")

    def input_sql(self, name: str) -> str:
        return f"CAST(`{self.known}` = {_sql_text(name[len(self.column) + 1:])} AS DOUBLE)"

    def encoded(self, df: DataFrame) -> DataFrame:
        """df with the 0/1 columns themselves, as a training table shows them."""
        known = df.withColumn(self.known, F.expr(self.known_sql()))
        return known.withColumns({n: F.expr(self.input_sql(n)).cast("int") for n in self.names}).drop(self.known)


def learn_vocabulary(train: DataFrame, column: str = "city", k: int = 10, aliases: Mapping[str, str] = CITY_ALIASES,
                     other: str = "other") -> Vocabulary:
    """The k most frequent values after aliases (ties by value); only k rows reach the driver."""
    whole = Vocabulary((), column, dict(aliases), other)
    low = F.lower(F.trim(F.col(column).cast("string")))
    named = low if not whole.aliases else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in whole.aliases.items() for x in kv]), low), low)
    top = (train.select(named.alias("v")).where(F.col("v").isNotNull() & (F.col("v") != other)).groupBy("v").count()
           .orderBy(F.desc("count"), "v").limit(k).collect())
    return Vocabulary(tuple(r["v"] for r in top), column, dict(aliases), other)


def complete_request(requests: DataFrame, fields: Sequence[str] = REQUEST_FIELDS, mode: str = "train") -> DataFrame:
    """Requests with all ``fields``: one that is missing, as a column or a value, is derived
    from the others where it is a ratio of them, else null (the models impute it)."""
    df = requests.withColumns({f: F.lit(None).cast("string" if f == "city" else "double") for f in fields if f not in requests.columns})
    derived = [f for f in ("price_to_dish_ratio", "rating_count_per_dish", "price_volatility") if f in fields]
    given = {f: f"_given_{f}" for f in derived}
    df = ratio_features(df.withColumnsRenamed(given), mode)
    return df.withColumns({f: F.coalesce(F.col(g), F.col(f)) for f, g in given.items()}).drop(*given.values())


def score_requests(requests: DataFrame, models: Mapping[str, object], keys: Sequence[str]) -> DataFrame:
    """``score_batch`` of raw 13-field requests: city texts as they come, fields left out."""
    return score_batch(complete_request(requests), models, keys)


def prediction_records(requests: DataFrame, models: Mapping[str, object] | None, keys: Sequence[str], timestamp: Column,
                       fields: Sequence[str] = REQUEST_FIELDS) -> DataFrame:
    """keys and the prediction log's record (without response_time) of every request and
    task, in one pass over the requests; without ``models`` the rules score.  ``features``
    holds the numeric fields; a record without a probability is no success."""
    numeric = [f for f in fields if f in requests.columns and dict(requests.dtypes)[f] != "string"]
    features = F.create_map(*[x for f in numeric for x in (F.lit(f), F.col(f"`{f}`").cast("double"))])
    shown = requests.withColumns({"_features": features, "_timestamp": timestamp.cast("timestamp")})
    if models is None:
        each = rule_scores(shown, [*keys, "_timestamp", "_features"])
    else:
        scored = score_tasks(complete_request(shown), models, [*keys, "_timestamp", "_features"])
        each = scored.select(*keys, "_timestamp", "_features", by_task(models))
    return each.select(*keys, F.col("_timestamp").alias("timestamp"), F.col("task").alias("model"), F.col("_features").alias("features"),
                       F.struct(F.col("prediction").cast("int").alias("prediction"), F.col("probability").cast("double").alias("probability"), "confidence").alias("prediction"),
                       F.col("probability").isNotNull().alias("success"), F.size("_features").alias("feature_count"))
