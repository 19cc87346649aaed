"""Bias evaluation and the governance gate (B-1, B-2, J-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens import constants as C

CHECK_SCHEMA = "name string, status string, value double"


def category_precision(df: DataFrame, score: str, label: str,
                       cutoff: float = C.BIAS_SCORE_CUTOFF) -> DataFrame:
    """B-1 per category: tp, fp, precision = tp / max(tp + fp, 1) at score >= cutoff.

    Rows without a category form no group.
    """
    pred = F.col(score) >= cutoff
    lab = F.col(label).cast("int") == 1
    return (df.filter(F.col("merchant_category").isNotNull()).groupBy("merchant_category").agg(
        F.count(F.when(pred & lab, 1)).alias("tp"), F.count(F.when(pred & ~lab, 1)).alias("fp"))
        .withColumn("precision", F.col("tp").cast("double")
                    / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)).cast("double")))


def scored_labels(scores: DataFrame, labels: DataFrame, key: str = "transaction_id") -> DataFrame:
    """J-9: scores beside their labels from a separate table (rows without a label are not evaluated)."""
    return scores.join(labels, key)


def category_bias(df: DataFrame, score: str, label: str) -> DataFrame:
    """B-1 summary: status and max precision gap (no_data / missing_category / no_groups / ok)."""
    if "merchant_category" not in df.columns:
        return df.sparkSession.createDataFrame([("missing_category", 0.0)],
                                               "status string, max_precision_gap double")
    per = category_precision(df, score, label)
    rows = df.select(F.count(F.lit(1))).scalar()
    return per.agg(F.count(F.lit(1)).alias("n"), (F.max("precision") - F.min("precision")).alias("gap")).select(
        F.when(rows == 0, F.lit("no_data")).when(F.col("n") == 0, F.lit("no_groups")).otherwise(F.lit("ok")).alias("status"),
        F.coalesce(F.col("gap"), F.lit(0.0)).alias("max_precision_gap"))


def governance_gate(bias: DataFrame, metrics: DataFrame, pii_fields: list[str],
                    pii_handling: str | None) -> DataFrame:
    """B-2: checks (bias gap, performance, PII handling) and the overall verdict.

    ``bias`` is a B-1 summary row; ``metrics`` an M-4 row; the PII config is a
    parameter.  Output (name, status, value): the gap, the AUC, the number of
    declared PII fields, and an ``overall`` row whose value is the failed count.
    """
    gap = F.col("max_precision_gap")
    bias_check = bias.select(
        F.lit("bias_detection").alias("name"),
        F.when(gap > C.BIAS_FAIL_GAP, "FAILED").when(gap > C.BIAS_WARN_GAP, "WARNING")
         .otherwise("PASSED").alias("status"),
        gap.alias("value"))
    auc = F.coalesce(F.col("roc_auc"), F.lit(0.0))
    perf = metrics.select(
        F.lit("performance_baseline").alias("name"),
        F.when(auc < C.MODEL_HEALTH_AUC, "FAILED").otherwise("PASSED").alias("status"),
        auc.alias("value"))
    if pii_fields and not pii_handling:
        pii = ("FAILED", float(len(pii_fields)))
    elif not pii_fields:
        pii = ("WARNING", 0.0)
    else:
        pii = ("PASSED", float(len(pii_fields)))
    spark = bias.sparkSession
    checks = bias_check.unionByName(perf).unionByName(
        spark.createDataFrame([("pii_handling",) + pii], CHECK_SCHEMA))
    overall = checks.agg(
        F.when(F.count(F.when(F.col("status") == "FAILED", 1)) == 0, "PASSED").otherwise("FAILED").alias("status"),
        F.count(F.when(F.col("status") == "FAILED", 1)).cast("double").alias("value"),
    ).select(F.lit("overall").alias("name"), "status", "value")
    return checks.unionByName(overall)
