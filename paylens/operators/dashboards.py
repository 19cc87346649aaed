"""Dashboard and per-merchant aggregates (A-1 … A-25, T-1 … T-5, W-14, J-4).

Every aggregate is a hash aggregate with a map-side partial phase, so only one
row per group and partition crosses the shuffle; a hot merchant or state is
pre-aggregated before it is shuffled.  Shares of a total use a scalar subquery
(one extra metadata-cheap pass) instead of an unpartitioned window or a cross
join.  Global ``orderBy().limit(n)`` plans as TakeOrderedAndProject (bounded
per-task heaps); per-group top-k as row_number <= k (WindowGroupLimit).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import (
    count_if, money_avg, money_sum, ratio_pct, round_half,
)
from paylens.operators.cleaning import last_days


def overview(tx: DataFrame) -> DataFrame:
    """A-1: global totals from one scan.

    The rows are first aggregated by (merchant, state) — a table far smaller
    than the rows — and every total, including both distinct counts, is taken
    from that aggregate, so the base table is read and shuffled once.
    """
    per = tx.groupBy("merchant_id", "state").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("amount_aud").cast("decimal(24,6)")).alias("s"),
        F.count("amount_aud").alias("na"),
        count_if(F.col("is_fraud")).alias("f"))
    tot = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_transactions"),
        F.count_distinct("merchant_id").alias("total_merchants"),
        F.sum("s").alias("_s"), F.sum("na").alias("_na"), F.sum("f").alias("_f"),
        F.count_distinct("state").alias("states_covered"))
    avg = F.col("_s").cast("double") / F.nullif(F.col("_na").cast("double"), F.lit(0.0))
    return tot.select(
        "total_transactions", "total_merchants",
        round_half(F.coalesce(F.col("_s").cast("double"), F.lit(0.0)), 2).alias("total_volume_aud"),
        round_half(F.coalesce(avg, F.lit(0.0)), 2).alias("avg_transaction_aud"),
        round_half(F.coalesce(ratio_pct("_f", "total_transactions"), F.lit(0.0)), 4).alias("fraud_rate_pct"),
        "states_covered")


def revenue_by_category(tx: DataFrame) -> DataFrame:
    """A-2."""
    return (tx.groupBy(F.col("merchant_category").alias("category"))
            .agg(round_half(money_sum("amount_aud"), 2).alias("total_revenue"),
                 F.count(F.lit(1)).alias("transaction_count"),
                 round_half(money_avg("amount_aud"), 2).alias("avg_ticket"))
            .orderBy(F.desc("total_revenue"), "category"))


def revenue_trend(tx: DataFrame) -> DataFrame:
    """A-3: daily revenue, count and fraud count."""
    return (tx.groupBy(F.to_date("timestamp").alias("date"))
            .agg(round_half(money_sum("amount_aud"), 2).alias("daily_revenue"),
                 F.count(F.lit(1)).alias("daily_transactions"),
                 count_if(F.col("is_fraud")).alias("daily_fraud_count"))
            .orderBy("date"))


def fraud_by_state(tx: DataFrame) -> DataFrame:
    """A-4."""
    return (tx.groupBy("state")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 count_if(F.col("is_fraud")).alias("fraud_count"),
                 money_sum(F.when(F.col("is_fraud"), F.col("amount_aud")).otherwise(F.lit(0.0))).alias("_fv"))
            .select("state", "total_transactions", "fraud_count",
                    round_half(ratio_pct("fraud_count", "total_transactions"), 4).alias("fraud_rate_pct"),
                    round_half("_fv", 2).alias("fraud_value_aud"))
            .orderBy(F.desc("fraud_count"), "state"))


def hourly_pattern(tx: DataFrame) -> DataFrame:
    """A-5."""
    return (tx.groupBy(F.hour("timestamp").alias("hour"))
            .agg(F.count(F.lit(1)).alias("transaction_count"),
                 round_half(money_avg("amount_aud"), 2).alias("avg_amount"),
                 count_if(F.col("is_fraud")).alias("fraud_count"))
            .orderBy("hour"))


def payment_methods(tx: DataFrame) -> DataFrame:
    """A-6 with W-14 share of total (total as a scalar subquery)."""
    total = tx.select(F.count(F.lit(1))).scalar()
    return (tx.groupBy("payment_terminal")
            .agg(F.count(F.lit(1)).alias("count"),
                 round_half(money_avg("amount_aud"), 2).alias("avg_amount"),
                 count_if(F.col("is_fraud")).alias("_fc"))
            .select("payment_terminal", "count",
                    round_half(ratio_pct(F.col("count"), total), 2).alias("percentage"),
                    "avg_amount",
                    round_half(ratio_pct("_fc", "count"), 4).alias("fraud_rate_pct"))
            .orderBy(F.desc("count"), "payment_terminal"))


def merchant_totals(tx: DataFrame) -> DataFrame:
    """A-7 input: per (merchant, category, state) totals."""
    return (tx.groupBy("merchant_id", "merchant_category", "state")
            .agg(F.count(F.lit(1)).alias("transaction_count"),
                 round_half(money_sum("amount_aud"), 2).alias("total_revenue"),
                 round_half(money_avg("amount_aud"), 2).alias("avg_ticket")))


def top_merchants(tx: DataFrame, limit: int = 10) -> DataFrame:
    """A-7 / T-1: top-n by revenue (limit clamped to 1..50, key tie-break)."""
    n = max(1, min(int(limit), 50))
    return (merchant_totals(tx)
            .orderBy(F.desc("total_revenue"), "merchant_id", "merchant_category", "state")
            .limit(n))


def feature_anomaly_summary(features: DataFrame) -> DataFrame:
    """A-8 over the training-feature table."""
    z = F.col("amount_zscore")
    return features.agg(
        F.count(F.lit(1)).alias("total_reviewed"),
        count_if(F.col("is_fraud")).alias("total_fraud"),
        round_half(F.avg(z), 4).alias("avg_zscore"),
        round_half(F.max(z), 4).alias("max_zscore"),
        round_half(F.avg(F.when(F.col("is_fraud"), z)), 4).alias("avg_fraud_zscore"),
    )


def spine_fill(rows: DataFrame, key: str, spine: list[str], sums: list[str]) -> DataFrame:
    """J-4: left-join a fixed key spine with zero fill, without a join.

    Rows outside the spine are filtered (pushed to the scan); one zero row per
    spine key is unioned in and the sums re-aggregated, which equals
    ``spine LEFT JOIN agg`` + ``fillna(0)`` but needs no join and no broadcast.
    """
    spark = rows.sparkSession
    zero = spark.createDataFrame([(k,) for k in spine], f"{key} string")
    for s in sums:
        zero = zero.withColumn(s, F.lit(0).cast(rows.schema[s].dataType))
    return (rows.filter(F.col(key).isin(spine)).select(key, *sums)
            .unionByName(zero).groupBy(key).agg(*[F.sum(s).alias(s) for s in sums]))


def threat_map(tx: DataFrame, days: int, as_of: date) -> DataFrame:
    """A-9: last-N-days per state over the fixed state spine, zero filled, with totals."""
    days = max(1, min(int(days), 365))
    recent = (last_days(tx, days, as_of)
              .select("state",
                      F.lit(1).cast("bigint").alias("transaction_count"),
                      F.when(F.col("is_fraud"), 1).otherwise(0).cast("bigint").alias("fraud_count"),
                      F.when(F.col("is_fraud"), F.col("amount_aud")).otherwise(F.lit(0.0))
                       .cast("decimal(24,6)").alias("fraud_value")))
    per_state = spine_fill(recent, "state", C.STATES,
                           ["transaction_count", "fraud_count", "fraud_value"])
    # the spine has exactly len(STATES) rows, so an unpartitioned window is bounded
    everything = Window.partitionBy()
    return (per_state.select(
        F.lit(days).alias("window_days"),
        "state", "transaction_count", "fraud_count",
        round_half(F.col("fraud_value").cast("double"), 2).alias("fraud_value_aud"),
        F.coalesce(round_half(ratio_pct("fraud_count", "transaction_count"), 4),
                   F.lit(0.0)).alias("fraud_rate_pct"),
        F.sum("fraud_count").over(everything).alias("total_fraud_count"),
        round_half(F.sum("fraud_value").over(everything).cast("double"), 2).alias("total_fraud_value_aud"),
    ).orderBy("state"))


def merchant_revenue(tx: DataFrame) -> DataFrame:
    """A-10 for every merchant at once."""
    return tx.groupBy("merchant_id").agg(
        round_half(money_sum("amount_aud"), 2).alias("total_revenue"),
        F.count(F.lit(1)).alias("transaction_count"),
        round_half(money_avg("amount_aud"), 2).alias("avg_transaction"))


def merchant_fraud(tx: DataFrame) -> DataFrame:
    """A-11."""
    return tx.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("is_fraud")).alias("fraud_count"),
        round_half(money_sum(F.when(F.col("is_fraud"), F.col("amount_aud")).otherwise(F.lit(0.0))), 2)
        .alias("fraud_value"))


def merchant_hour_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy("merchant_id", F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("txn_count"))


def merchant_peak_hours(tx: DataFrame, k: int = 3) -> DataFrame:
    """A-12 / T-3: busiest k hours per merchant (ties -> lower hour)."""
    w = Window.partitionBy("merchant_id").orderBy(F.desc("txn_count"), "hour")
    return (merchant_hour_counts(tx)
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def merchant_profile(tx: DataFrame) -> DataFrame:
    """A-13: every (merchant, category, state) group (the reference returns an arbitrary one)."""
    return tx.groupBy("merchant_id", "merchant_category", "state").agg(
        F.count(F.lit(1)).alias("txn_count"),
        round_half(money_sum("amount_aud"), 2).alias("total"))


def merchant_baseline(tx: DataFrame) -> DataFrame:
    """A-14: per-merchant mean, sample std and count (J-6 input)."""
    return tx.groupBy("merchant_id").agg(
        money_avg("amount_aud").alias("avg_amount"),
        F.stddev_samp("amount_aud").alias("std_amount"),
        F.count(F.lit(1)).alias("txn_count"))


def merchant_revenue_trend(tx: DataFrame, days: int, as_of: date) -> DataFrame:
    """A-15: daily revenue per merchant over the last ``days`` days."""
    return (last_days(tx, days, as_of)
            .groupBy("merchant_id", F.to_date("timestamp").alias("day"))
            .agg(round_half(money_sum("amount_aud"), 2).alias("revenue")))


def merchant_severity(tx: DataFrame) -> DataFrame:
    """A-16: fraud counts by amount band."""
    amt = F.col("amount_aud")
    return tx.groupBy("merchant_id").agg(
        count_if(F.col("is_fraud") & (amt >= C.SEVERITY_HIGH_AMOUNT)).alias("high"),
        count_if(F.col("is_fraud") & (amt >= C.SEVERITY_MEDIUM_AMOUNT) & (amt < C.SEVERITY_HIGH_AMOUNT)).alias("medium"),
        count_if(F.col("is_fraud") & (amt < C.SEVERITY_MEDIUM_AMOUNT)).alias("low"))


def merchant_payment_share(tx: DataFrame) -> DataFrame:
    """A-17: method share per merchant (window over <= 4 aggregated rows per merchant)."""
    w = Window.partitionBy("merchant_id")
    return (tx.groupBy("merchant_id", F.col("payment_terminal").alias("method"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("merchant_id", "method",
                    round_half(F.col("n").cast("double") / F.sum("n").over(w).cast("double"), 4)
                    .alias("share")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A-19: row count per loaded table (metadata-only scans for plain parquet)."""
    parts = [df.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def agent_daily_revenue(tx: DataFrame, days: int = 30) -> DataFrame:
    """A-20: latest ``days`` days having data, per merchant, newest first."""
    w = Window.partitionBy("merchant_id").orderBy(F.desc("day"))
    return (tx.groupBy("merchant_id", F.to_date("timestamp").alias("day"))
            .agg(money_sum("amount_aud").alias("total_revenue"))
            .withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= days).drop("rn"))


def agent_txn_count(tx: DataFrame) -> DataFrame:
    """A-20 count branch."""
    return tx.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("txn_count"))


def label_rate(tx: DataFrame) -> DataFrame:
    """A-23: mean of the boolean label."""
    return tx.agg((count_if(F.col("is_fraud")).cast("double") / F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0)))
                  .alias("fraud_rate"))


def class_weight(tx: DataFrame) -> DataFrame:
    """A-24: negatives / max(positives, 1)."""
    return tx.agg(count_if(~F.col("is_fraud")).alias("negatives"), count_if(F.col("is_fraud")).alias("positives")).select(
        "negatives", "positives",
        (F.col("negatives").cast("double") / F.greatest(F.col("positives"), F.lit(1)).cast("double"))
        .alias("scale_pos_weight"))


def state_merchants(tx: DataFrame) -> DataFrame:
    """A-25: distinct merchants per state."""
    return tx.groupBy("state").agg(F.count_distinct("merchant_id").alias("merchants"))
