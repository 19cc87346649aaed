"""Seed dimensions, provenance-labelled source choice and reports (SRC-6, SRC-7, A-21, A-22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens import constants as C
from paylens import schemas


def merchant_population(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(C.STATES, C.STATE_WEIGHTS)), "state string, merchant_weight double")


def terminal_mix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(C.TERMINALS, C.TERMINAL_RATIOS)), "payment_terminal string, ratio double")


def card_type_mix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(C.CARD_TYPES, C.CARD_RATIOS)), "card_type string, ratio double")


def business_hours_profile(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.BUSINESS_HOURS, "merchant_category string, open_hour int, close_hour int")


def retail_trade_fallback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, v, "index", "M") for m, v in C.RETAIL_TRADE_FALLBACK],
                                 "TIME_PERIOD string, OBS_VALUE double, MEASURE string, FREQUENCY string")


def card_payments_fallback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.CARD_PAYMENTS_FALLBACK,
                                 "month string, contactless_ratio double, debit_ratio double, fraud_rate double")


def choose_source(name: str, landed: DataFrame | None, fallback: DataFrame,
                  error: str | None = None) -> tuple[DataFrame, dict]:
    """SRC-7 decision: ``live`` when the landed, parsed frame is non-empty, else ``fallback``.

    The emptiness test is ``limit(1).count()`` — one row at most reaches the driver.
    """
    attempted = landed is not None
    try:
        ok = attempted and landed.limit(1).count() > 0
    except Exception as exc:  # noqa: BLE001  (an unreadable landing is a fallback, with its error)
        ok, error = False, str(exc)
    if ok:
        return landed, dict(source=name, mode="live", live_attempted=True, live_success=True,
                            fallback_used=False, error=None)
    return fallback, dict(source=name, mode="fallback", live_attempted=attempted, live_success=False,
                          fallback_used=True, error=error or ("parsed empty" if attempted else "not landed"))


def source_counts(frames: list[DataFrame | None]) -> list[tuple[int, str | None]]:
    """(records, error) of each frame: one job for all; only if a frame cannot be read are they counted one by one."""
    there = [(i, f) for i, f in enumerate(frames) if f is not None]
    found: list[tuple[int, str | None]] = [(0, None) for _ in frames]
    if not there:
        return found
    try:
        tagged = reduce(DataFrame.union, [f.select(F.lit(i).alias("i")) for i, f in there])
        for r in tagged.groupBy("i").count().collect():  # a row per source
            found[r.i] = (r["count"], None)
    except Exception:  # noqa: BLE001  an unreadable source must turn into a row
        for i, f in there:
            try:
                found[i] = (f.count(), None)
            except Exception as exc:  # noqa: BLE001
                found[i] = (0, str(exc))
    return found


def provenance(spark: SparkSession, outcomes: list[tuple[DataFrame | None, dict]],
               output_root: str | None = None) -> DataFrame:
    """One provenance row per source (status, records, mode, flags, error)."""
    rows = []
    for (frame, meta), (n, error) in zip(outcomes, source_counts([f for f, _ in outcomes])):
        status = "success" if frame is not None and error is None else "failed"
        path = f"{output_root}/{meta['source']}.parquet" if output_root and status == "success" else ""
        rows.append((meta["source"], status, int(n), path, meta["mode"], meta["live_attempted"],
                     meta["live_success"], meta["fallback_used"], error or meta.get("error")))
    return spark.createDataFrame(rows, schemas.PROVENANCE)


def calibrated(name: str, frame: DataFrame) -> tuple[DataFrame, dict]:
    return frame, dict(source=name, mode="calibrated", live_attempted=False, live_success=False,
                       fallback_used=False, error=None)


def ingestion_report(prov: DataFrame) -> DataFrame:
    """A-21: counts by mode over successes; failed source names sorted."""
    ok = F.col("status") == "success"
    return prov.agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count(F.when(ok, 1)).alias("success_count"),
        F.count(F.when(ok & (F.col("mode") == "live"), 1)).alias("live_success_count"),
        F.count(F.when(ok & (F.col("mode") == "fallback"), 1)).alias("fallback_success_count"),
        F.count(F.when(ok & (F.col("mode") == "calibrated"), 1)).alias("calibrated_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.col("source")))), ",").alias("failed_sources"),
    )


def ingestion_metadata(prov: DataFrame, total_sources: int = 7) -> DataFrame:
    """A-22: counts by status and by mode (mode counted even when failed), fixed source count."""
    return prov.agg(
        F.count(F.when(F.col("status") == "success", 1)).alias("success_count"),
        F.count(F.when(F.col("mode") == "live", 1)).alias("live_success_count"),
        F.count(F.when(F.col("mode") == "fallback", 1)).alias("fallback_success_count"),
        F.count(F.when(F.col("mode") == "calibrated", 1)).alias("calibrated_count"),
    ).withColumn("source_count", F.lit(total_sources))
