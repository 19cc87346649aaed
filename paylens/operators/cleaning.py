"""Cleaning and request checks (P-1, P-3, P-4, P-5, P-14, P-17, P-18, U-3)."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens import constants as C
from paylens.session import cut_lineage


#: keys with several rows that are broadcast at most
DUPLICATE_KEYS = 1 << 18
_FIXED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key (null is a key): the greatest ``order``, then every other column, wins.

    A hash aggregate of fixed-width values finds the keys with several rows and
    their largest first ``order`` column; only these keys are shuffled.  Rows of
    other keys pass straight through; of the rest only the rows at the largest
    value go on to ``max(struct(order..., rest...))``.  Partial aggregation keeps
    one candidate per key and map task, so a hot key never gathers in one task.
    The keys with several rows are written once; up to ``DUPLICATE_KEYS`` of them
    are broadcast, more are joined.
    """
    first = order[0] if isinstance(df.schema[order[0]].dataType, _FIXED) else None
    top = [F.max(first).alias("_top")] if first else []
    several = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *top).filter("_n > 1")
                          .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", *(["_top"] if first else [])))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    marked = df.join(F.broadcast(several) if several.count() <= DUPLICATE_KEYS else several, on, "left")
    single = marked.filter(F.col("_n").isNull()).select(*df.columns)
    ties = marked.filter(F.col("_n").isNotNull() & (F.col(first).eqNullSafe(F.col("_top")) if first else F.lit(True)))
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(c) for c in order + rest])).alias("_b")
    chosen = ties.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in order + rest])
    return single.union(chosen.select(*df.columns))


def dedupe_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """U-3: one row per key, see ``latest_per_key``; the choice is deterministic."""
    return latest_per_key(df, keys, order)


def clean_raw(raw: DataFrame, stamp: bool = True) -> DataFrame:
    """P-1: id and merchant present, amount > 0, every column cast to the declared
    schema (timestamp parsed), dedupe by id.

    Text fields are cast with ``try_cast`` so bad values become NULL instead of
    failing the job; the duplicate kept is the one with the latest timestamp.
    """
    from paylens import schemas
    typed = raw.select(*[F.col(f.name).cast("string").try_cast(f.dataType).alias(f.name)
                         if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in schemas.TRANSACTIONS.fields])
    cleaned = (typed.filter(F.col("transaction_id").isNotNull() & F.col("merchant_id").isNotNull())
               .filter(F.col("amount_aud") > 0))
    cleaned = dedupe_latest(cleaned, ["transaction_id"], ["timestamp"])
    if stamp:
        cleaned = cleaned.withColumn("processed_at", F.current_timestamp())
    return cleaned.withColumn("data_quality_flag", F.lit("PASSED"))


def coerce_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """P-3: unparseable timestamps -> NULL -> dropped (zoned strings keep their own clock hour)."""
    return (df.withColumn(column, F.col(column).cast("string").try_cast("timestamp_ntz"))
            .filter(F.col(column).isNotNull()))


def scoped(df: DataFrame, merchant_id: str, caller_merchant: str | None = None,
           dev_bypass: bool = False) -> DataFrame:
    """P-4: a tenant sees only its own rows; a caller for another merchant is refused."""
    if caller_merchant is not None and caller_merchant != merchant_id and not dev_bypass:
        raise PermissionError("Merchant scope mismatch")
    return df.filter(F.col("merchant_id") == merchant_id)


def last_days(df: DataFrame, days: int, as_of: date, column: str = "timestamp") -> DataFrame:
    """P-5: ``date(ts) >= as_of - days`` written on the raw column so it pushes to the scan."""
    start = datetime.combine(as_of - timedelta(days=days), datetime.min.time())
    from paylens.functions.timecols import ntz_literal
    return df.filter(F.col(column) >= ntz_literal(start))


def clamp_limit(limit: int, lo: int = 1, hi: int = 50) -> int:
    """P-17: parameter clamp before ``limit(n)``."""
    return max(lo, min(int(limit), hi))


def score_request_checks(df: DataFrame) -> DataFrame:
    """P-18 score requests: amount in (0, 500000], hour of day 0..23."""
    amt = F.col("amount_aud")
    hour = F.col("hour_of_day")
    reason = (F.when(amt.isNull() | (amt <= 0) | (amt > C.REQUEST_AMOUNT_MAX), F.lit("amount_out_of_range"))
              .when(hour.isNull() | (hour < 0) | (hour > 23), F.lit("hour_out_of_range")))
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def question_request_checks(df: DataFrame, column: str = "question") -> DataFrame:
    """P-18 agent requests: question length 3..500 characters."""
    n = F.length(F.col(column))
    reason = F.when(n.isNull() | (n < C.QUESTION_MIN_LEN) | (n > C.QUESTION_MAX_LEN), F.lit("question_length"))
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
