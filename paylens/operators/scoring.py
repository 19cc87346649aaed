"""Scoring operators: live feed, heuristic / review / stream scores, explanations.

Per-merchant baselines are hash aggregates joined back on merchant_id; the
join strategy is left to the planner and AQE (runtime broadcast when the
baseline is small, skew-split sort-merge join when a merchant is hot).
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions import risk as R
from paylens.functions.numeric import money_avg, round_half
from paylens.operators.dashboards import merchant_baseline


def live_feed_base(tx: DataFrame, limit: int = 10) -> DataFrame:
    """W-13 / T-2: newest n rows beside their merchant's lifetime mean and population std.

    TakeOrderedAndProject picks the n newest rows (bounded heaps per task); the
    per-merchant statistics are aggregated only for merchants among those n rows
    (left-semi join against the n-row set, broadcast by its proven bound).
    """
    n = max(5, min(int(limit), 50))
    newest = (tx.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(n))
    ids = F.broadcast(newest.select("merchant_id").distinct())
    stats = (tx.join(ids, "merchant_id", "left_semi").groupBy("merchant_id")
             .agg(F.coalesce(money_avg("amount_aud"), F.lit(0.0)).alias("merchant_avg"),
                  F.coalesce(F.stddev_pop("amount_aud"), F.lit(0.0)).alias("merchant_std")))
    return newest.join(F.broadcast(stats), "merchant_id", "left").select(
        "transaction_id", "merchant_id", "merchant_category", "state", "amount_aud",
        "payment_terminal", "card_type", "timestamp", "merchant_avg", "merchant_std", "is_fraud")


def live_feed(tx: DataFrame, limit: int = 10, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """R-3: proxy anomaly score over the newest rows, flagged above threshold or if fraud."""
    base = live_feed_base(tx, limit)
    z = R.zscore("amount_aud", "merchant_avg", "merchant_std")
    score = R.feed_score(z, "payment_terminal", "card_type", "is_fraud")
    return (base.withColumn("_score", score).select(
        "transaction_id", "merchant_id", "merchant_category", "state",
        round_half("amount_aud", 2).alias("amount_aud"), "payment_terminal", "timestamp",
        round_half("_score", 4).alias("anomaly_score"),
        ((F.col("_score") > threshold) | F.coalesce(F.col("is_fraud"), F.lit(False))).alias("is_anomaly"),
        R.risk_level("_score").alias("risk_level"),
        F.lit(round(threshold, 4)).alias("threshold_used"))
        .orderBy(F.desc("timestamp"), F.desc("transaction_id")))


def baseline_scores(tx: DataFrame, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """R-4 with J-6: each transaction against its merchant's (avg, sample std, count)."""
    b = merchant_baseline(tx)
    z = R.zscore("amount_aud", "avg_amount", "std_amount")
    return (tx.join(b, "merchant_id", "left")
            .withColumn("amount_zscore", z)
            .withColumn("anomaly_score", R.heuristic_score("amount_zscore"))
            .withColumn("is_anomaly", F.col("anomaly_score") > threshold)
            .withColumn("risk_level", R.risk_level("anomaly_score"))
            .withColumn("recommended_action", R.recommended_action("anomaly_score"))
            .withColumn("known_merchant", F.col("txn_count").isNotNull()))


def anomaly_review(tx: DataFrame, days: int, as_of: date) -> DataFrame:
    """R-5: last-N-days rows scored clamp(z/10) (sign kept), flagged above .7, per merchant."""
    start = datetime.combine(as_of - timedelta(days=days), datetime.min.time())
    b = merchant_baseline(tx)
    from paylens.functions.timecols import ntz_literal
    recent = tx.filter(F.col("timestamp") >= ntz_literal(start))
    scored = (recent.join(b, "merchant_id", "left")
              .withColumn("_s", R.review_score(R.zscore("amount_aud", "avg_amount", "std_amount"))))
    return scored.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("total_reviewed"),
        F.count(F.when(F.col("_s") > C.REVIEW_CUTOFF, 1)).alias("total_flagged"),
        round_half(F.max(F.when(F.col("_s") > C.REVIEW_CUTOFF, F.col("_s"))), 3).alias("top_score"))


def stream_scores(tx: DataFrame) -> DataFrame:
    """R-6 over records: score = clamp(amount/5000), alert above .85."""
    s = R.stream_score("amount_aud")
    return tx.select("transaction_id", "merchant_id", s.alias("anomaly_score"),
                     (s > C.STREAM_ALERT_CUTOFF).alias("is_alert"))


def fraud_priors(tx: DataFrame) -> DataFrame:
    """R-8 per transaction."""
    return tx.select("transaction_id", "merchant_id", "is_fraud",
                     R.fraud_prior("amount_aud", "merchant_category", "payment_terminal",
                                   "card_type", "is_outside_business_hours").alias("fraud_prior"))


def explain(features: DataFrame) -> DataFrame:
    """R-7 over a feature table with amount_zscore, txn_velocity_1h, is_outside_business_hours."""
    cols = {k: F.col(k) for k in ("amount_zscore", "txn_velocity_1h", "is_outside_business_hours")}
    return features.withColumn("explanation", R.explain_topk(cols))


def score_requests(requests: DataFrame, tx: DataFrame, features: DataFrame | None = None, model=None,
                   threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """R-9 per request: score, level, mode and explanation; unknown merchants are rejected.

    ``requests`` has request_id, merchant_id, amount_aud and hour_of_day.  Each is
    held against its merchant's mean and sample deviation; ``features`` (W-17 per
    merchant) joins the other inputs for ``model`` (M-7: ``transform`` adds
    anomaly_score).  Without a model the score is the heuristic one.
    """
    base = merchant_baseline(tx)
    r = requests.join(base, "merchant_id", "left")
    known = F.coalesce(F.col("txn_count"), F.lit(0)) > 0
    avg, std = F.coalesce("avg_amount", F.lit(0.0)), F.coalesce("std_amount", F.lit(0.0))
    hour = F.col("hour_of_day")
    r = r.withColumn("_known", known).withColumn(
        "amount_zscore", (F.col("amount_aud") - avg) / F.greatest(std, F.lit(C.STD_FLOOR)))
    r = r.withColumn("is_outside_business_hours", ((hour < 8) | (hour > 20)).cast("double"))
    if model is not None:
        if features is not None:
            rest = [c for c in features.columns if c == "merchant_id" or c not in r.columns]
            r = r.join(features.select(*rest), "merchant_id", "left")
        r = model.transform(r)
        mode = F.lit("model")
    else:
        r = r.withColumn("anomaly_score", R.heuristic_score("amount_zscore"))
        mode = F.lit("heuristic")
    score = F.col("anomaly_score")
    explanation = F.struct(
        round_half("amount_zscore", 3).alias("amount_zscore"), hour.cast("int").alias("hour_of_day"),
        round_half(avg, 2).alias("merchant_avg"), round_half(std, 2).alias("merchant_std"),
        (F.col("is_outside_business_hours") >= 0.5).alias("is_outside_business_hours"))
    own = F.col("_known")
    return r.select(
        "request_id", "merchant_id", "amount_aud",
        F.when(own, F.lit("scored")).otherwise(F.lit("merchant_not_found")).alias("status"),
        F.when(own, round_half(score, 4)).alias("anomaly_score"), F.when(own, score > threshold).alias("is_anomaly"),
        F.when(own, R.risk_level(score)).alias("risk_level"), F.when(own, F.lit(round(threshold, 4))).alias("threshold_used"),
        F.when(own, mode).alias("scoring_mode"), F.when(own, explanation).alias("explanation"))


def score_transactions(features: DataFrame, model=None, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """R-9: features -> model (M-7) or heuristic -> score, level, action, explanation."""
    if model is not None:
        scored = model.transform(features)
        mode = F.lit("model")
    else:
        scored = features.withColumn("anomaly_score", R.heuristic_score("amount_zscore"))
        mode = F.lit("heuristic")
    return (explain(scored)
            .withColumn("is_anomaly", F.col("anomaly_score") > threshold)
            .withColumn("risk_level", R.risk_level("anomaly_score"))
            .withColumn("recommended_action", R.recommended_action("anomaly_score"))
            .withColumn("threshold_used", F.lit(threshold))
            .withColumn("scoring_mode", mode))


def feed_scores(tx: DataFrame, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """R-3 for every transaction: each row against its merchant's lifetime mean / population std."""
    stats = tx.groupBy("merchant_id").agg(
        F.coalesce(money_avg("amount_aud"), F.lit(0.0)).alias("merchant_avg"),
        F.coalesce(F.stddev_pop("amount_aud"), F.lit(0.0)).alias("merchant_std"))
    z = R.zscore("amount_aud", "merchant_avg", "merchant_std")
    s = R.feed_score(z, "payment_terminal", "card_type", "is_fraud")
    return (tx.join(stats, "merchant_id", "left").withColumn("anomaly_score", s)
            .withColumn("is_anomaly", (F.col("anomaly_score") > threshold)
                        | F.coalesce(F.col("is_fraud"), F.lit(False)))
            .withColumn("risk_level", R.risk_level("anomaly_score"))
            .withColumn("recommended_action", R.recommended_action("anomaly_score")))
