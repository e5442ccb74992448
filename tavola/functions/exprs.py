"""Scalar column expressions shared by the operators.

All helpers return ``Column`` objects made of built-in functions, so they stay
inside whole-stage code generation; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rint_round(c, digits: int = 2) -> Column:
    """Round half to even on the binary value, as numpy's ``round``.

    ``rint(x * 10^d) / 10^d``; differs from ``bround`` (decimal based) for
    values such as 2.675.  The value is first rounded to 9 decimals so that
    summation-order noise (which differs between engines and partitionings)
    cannot flip a half-way case: a mean of 4.145 computed as 4.14499999 on
    one plan and 4.14500001 on another rounds the same way.
    """
    scale = float(10 ** digits)
    return F.rint(F.round(col(c), 9) * F.lit(scale)) / F.lit(scale)


def nan_to_null(c) -> Column:
    """NaN becomes null (the package never carries NaN)."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


#: White space of ASCII besides the space.
_CONTROLS = "\t\n\x0b\x0c\r"


def clean_text_col(c) -> Column:
    """strip -> lower -> 'nan'/'none' to null -> collapse whitespace runs.

    ``(?U)`` makes ``\\s`` match Unicode blanks such as U+00A0, as Python's
    ``str.strip`` does.  These patterns test every character; ASCII text whose only
    blanks are spaces needs none, and one only where two spaces meet.
    """
    c = col(c)
    plain = F.octet_length(c) == F.length(c)
    for blank in _CONTROLS:
        plain &= ~F.contains(c, F.lit(blank))
    simple = F.lower(F.trim(c))
    stripped = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    null = F.lit(None).cast("string")
    return (F.when(plain, F.when(simple.isin("nan", "none"), null)
                   .when(F.contains(simple, F.lit("  ")), F.regexp_replace(simple, "  +", " ")).otherwise(simple))
            .when(stripped.isin("nan", "none"), null)
            .otherwise(F.regexp_replace(stripped, r"(?U)\s+", " ")))


def safe_ratio(num, den) -> Column:
    """num / den, 0 when the denominator is 0 or null (zero-division rule)."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(0.0))


def when_chain(cases: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """Build ``CASE WHEN c1 THEN v1 ... ELSE otherwise END``."""
    expr = None
    for cond, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    if otherwise is not None:
        expr = expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
    return expr


def present(df, cols: Iterable[str]) -> list[str]:
    """Columns of ``cols`` that exist in ``df`` (order kept)."""
    have = set(df.columns)
    return [c for c in cols if c in have]


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [n for n, t in df.dtypes if (t in NUMERIC_TYPES or t.startswith("decimal")) and n not in ex]


def string_columns(df) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def stack_expr(pairs: Sequence[tuple[str, str]], key: str = "column", value: str = "value") -> Column:
    """``stack(n, 'name1', expr1, ...)`` turning one wide row into long rows."""
    parts = ", ".join(f"'{name}', {expr}" for name, expr in pairs)
    return F.expr(f"stack({len(pairs)}, {parts}) AS ({key}, {value})")


def q(name: str) -> str:
    """Back-quote a column name for SQL expression strings."""
    return "`" + name.replace("`", "``") + "`"


def digamma(n: Column) -> Column:
    """Digamma of numbers of 1 and more (error below 1e-10): the asymptotic series six
    further on, less the reciprocals in between."""
    x = n.cast("double") + 6
    x2 = x * x
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x2) + 1 / (120 * x2 * x2) - 1 / (252 * x2 * x2 * x2) + 1 / (240 * x2 * x2 * x2 * x2)
    return series - sum((1 / (n.cast("double") + j) for j in range(6)), F.lit(0.0))
