"""Numeric column helpers with engine-independent results.

Money is summed as DECIMAL(24,6) (exact for up to six decimals) and converted to
DOUBLE last, so partition order never changes a result.  Rounding is half away
from zero through ``floor`` on doubles, which every SQL engine evaluates with the
same IEEE operations; each helper has a SQL twin used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(24,6)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half(c, nd: int) -> Column:
    """Round half away from zero to ``nd`` decimals, DOUBLE result."""
    x = col(c).cast("double")
    scale = float(10 ** nd)
    pos = F.floor(x * scale + 0.5)
    neg = -F.floor(-x * scale + 0.5)
    return (F.when(x < 0, neg).otherwise(pos).cast("bigint") / F.lit(scale)).cast("double")


def sql_round(expr: str, nd: int) -> str:
    scale = f"1e{nd}"
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN {x} < 0 THEN -CAST(floor(-{x} * {scale} + 0.5) AS BIGINT) "
            f"ELSE CAST(floor({x} * {scale} + 0.5) AS BIGINT) END / {scale})")


def money_sum(c) -> Column:
    """Exact sum of 2-decimal money, returned as DOUBLE."""
    return F.sum(col(c).cast(MONEY)).cast("double")


def sql_money_sum(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(24,6))) AS DOUBLE)"


def money_avg(c) -> Column:
    """Mean of money: exact decimal sum over count, one IEEE division."""
    return F.sum(col(c).cast(MONEY)).cast("double") / F.nullif(F.count(col(c)).cast("double"), F.lit(0.0))


def sql_money_avg(expr: str) -> str:
    return (f"(CAST(SUM(CAST({expr} AS DECIMAL(24,6))) AS DOUBLE) / "
            f"NULLIF(CAST(COUNT({expr}) AS DOUBLE), 0.0))")


def ratio_pct(num, den) -> Column:
    """num * 100 / den as DOUBLE, NULL when den = 0."""
    return col(num).cast("double") * F.lit(100.0) / F.nullif(col(den).cast("double"), F.lit(0.0))


def sql_ratio_pct(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) * 100.0 / NULLIF(CAST({den} AS DOUBLE), 0.0))"


def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c).cast("double"), F.lit(float(lo))), F.lit(float(hi)))


def sql_clamp(expr: str, lo: float, hi: float) -> str:
    return f"least(greatest(CAST({expr} AS DOUBLE), {float(lo)!r}), {float(hi)!r})"


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def zero_if_not_finite(c) -> Column:
    """±inf and NaN -> NULL -> 0 (feature cleanup before training)."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


def safe_div(num, den) -> Column:
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))
