"""Column-expression helpers (JVM-side, codegen-friendly)."""

from tavola.functions.exprs import (  # noqa: F401
    clean_text_col, nan_to_null, rint_round, safe_ratio, when_chain,
)
from tavola.functions.stats import quantiles, scalar_stats  # noqa: F401
