"""Model evaluation (M-1, M-4, M-5, M-6, M-10) over (score, label) tables.

Every curve is computed from per-distinct-score (pos, neg) counts and the
G-1 global cumulative, never by sorting all rows in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.session import cut_lineage
from paylens.operators.ranking import global_cumulative, ordered_positions


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    lab = F.coalesce(F.col(label).cast("int"), F.lit(0))
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(lab).cast("bigint").alias("pos"), F.sum(1 - lab).cast("bigint").alias("neg"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct threshold t (predict score >= t): tp, fp, precision, recall, f1 (one read of ``df``)."""
    cum = cut_lineage(global_cumulative(score_counts(df, score, label), "score", ["pos", "neg"], descending=True))
    total_pos = cum.select(F.max("cum_pos")).scalar()
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(total_pos > 0, tp / total_pos.cast("double")).otherwise(F.lit(0.0))
    return (cum.withColumn("precision", precision).withColumn("recall", recall)
            .withColumn("f1", 2 * F.col("precision") * F.col("recall")
                        / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))))


def select_threshold(curve: DataFrame):
    """M-5 as a scalar Column: max F1, lowest threshold on ties, clamp [.05, .95], none -> .85."""
    best = curve.agg(F.max_by("score", F.struct(F.col("f1"), -F.col("score"))).alias("t"))
    t = best.select(F.least(F.greatest(F.col("t"), F.lit(0.05)), F.lit(0.95))).scalar()
    return F.coalesce(t, F.lit(C.DEFAULT_THRESHOLD))


def evaluate(df: DataFrame, score: str = "score", label: str = "label", threshold=None) -> DataFrame:
    """M-4: ROC AUC (ties count half), average precision, P/R/F1 at the threshold, counts.

    One aggregate over the curve (one row per distinct score): the counts above a
    threshold are the largest running counts of the scores from it on, so those
    of the best score and of the bounds it may be moved to come from the same pass.
    """
    curve = pr_curve(df, score, label)

    def above(t: float) -> list[Column]:
        """Positives and negatives with a score of at least ``t``."""
        return [F.coalesce(F.max(F.when(F.col("score") >= t, F.col(c))), F.lit(0)) for c in ("cum_pos", "cum_neg")]

    below_pos = F.col("cum_pos").cast("double") - F.col("pos").cast("double") / 2.0
    best = F.max_by(F.struct("score", "cum_pos", "cum_neg"), F.struct(F.col("f1"), -F.col("score")))
    bounds = {"lo": 0.05, "hi": 0.95, "fixed": C.DEFAULT_THRESHOLD if threshold is None else float(threshold)}
    m = curve.agg(
        F.sum(F.col("neg").cast("double") * below_pos).alias("_auc_num"),
        F.sum(F.col("pos").cast("double") * F.col("precision")).alias("_ap_num"),
        F.sum(F.col("pos") + F.col("neg")).cast("bigint").alias("total_samples"),
        F.sum("pos").cast("bigint").alias("fraud_samples"),
        F.sum("neg").cast("bigint").alias("_neg"), best.alias("_best"),
        *[F.struct(F.lit(t).alias("score"), *[a.alias(n) for a, n in zip(above(t), ("cum_pos", "cum_neg"))]).alias(f"_{name}")
          for name, t in bounds.items()])
    chosen = F.col("_fixed") if threshold is not None else \
        F.when(F.col("_best").isNull(), F.col("_fixed")).when(F.col("_best.score") < bounds["lo"], F.col("_lo")) \
        .when(F.col("_best.score") > bounds["hi"], F.col("_hi")).otherwise(F.col("_best"))
    m = m.withColumn("_at", chosen).withColumn("threshold", F.col("_at.score")) \
        .withColumn("_tp", F.col("_at.cum_pos").cast("double")).withColumn("_fp", F.col("_at.cum_neg").cast("double"))
    p = F.col("fraud_samples").cast("double")
    n = F.col("_neg").cast("double")
    m = m.select(
        (F.col("_auc_num") / F.nullif(p * n, F.lit(0.0))).alias("roc_auc"),
        (F.col("_ap_num") / F.nullif(p, F.lit(0.0))).alias("avg_precision"),
        F.when(F.col("_tp") + F.col("_fp") > 0, F.col("_tp") / (F.col("_tp") + F.col("_fp")))
         .otherwise(F.lit(0.0)).alias("precision_at_threshold"),
        F.when(p > 0, F.col("_tp") / p).otherwise(F.lit(0.0)).alias("recall_at_threshold"),
        "threshold", "total_samples", "fraud_samples")
    pr, rc = F.col("precision_at_threshold"), F.col("recall_at_threshold")
    return m.withColumn("f1_at_threshold",
                        F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0)))


HOUR_US = 3_600_000_000


def chronological_split(df: DataFrame, train_fraction: float = 0.8,
                        ts: str = "timestamp", key: str = "transaction_id") -> DataFrame:
    """M-1: the first ``floor(n * fraction)`` rows by (ts, key) are train, the rest test.

    Three reads and no shuffle of the rows: counts by hour give the hour in which
    the cut lies; the rows of that hour are ranked by (ts, key), in range
    partitions however many they are; every row is then compared with the cut
    row.  Rows that equal it in both columns are train; rows without a time are
    left out.
    """
    from paylens.functions.timecols import epoch_micros
    rows = df.withColumn("_us", epoch_micros(ts)).filter(F.col("_us").isNotNull())
    hour = F.floor(F.col("_us") / F.lit(HOUR_US))
    hours = cut_lineage(rows.groupBy(hour.alias("_hour")).agg(F.count(F.lit(1)).alias("c")))
    upto = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0)       # a row per hour of the table's time
    cum = hours.select("_hour", "c", F.sum("c").over(upto).alias("upto"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    k = F.floor(F.col("n").cast("double") * F.lit(float(train_fraction))).cast("bigint")
    cut = cum.filter(F.col("upto") >= k).orderBy("_hour").select("_hour", k.alias("k"), (F.col("upto") - F.col("c")).alias("before")).first()
    if cut is None or cut.k == 0:
        return rows.withColumn("split", F.lit("test")).drop("_us")
    within = rows.filter((F.col("_us") >= cut["_hour"] * HOUR_US) & (F.col("_us") < (cut["_hour"] + 1) * HOUR_US)).select("_us", key)
    last = ordered_positions(within, ["_us", key], out="_r").filter(F.col("_r") == cut.k - cut.before).first()
    name = F.lit(last[key])
    at_or_before = F.col(key).isNull() | (F.coalesce(F.col(key) <= name, F.lit(False)))     # null ids come first
    first = (F.col("_us") < last["_us"]) | ((F.col("_us") == last["_us"]) & at_or_before)
    return rows.withColumn("split", F.when(first, F.lit("train")).otherwise(F.lit("test"))).drop("_us")


def minmax_normalize(df: DataFrame, column: str, out: str) -> DataFrame:
    """M-6 helper: (x - min) / (max - min + 1e-9) with min/max as scalar subqueries."""
    lo = df.select(F.min(column)).scalar()
    hi = df.select(F.max(column)).scalar()
    return df.withColumn(out, (F.col(column) - lo) / (hi - lo + F.lit(1e-9)))


def ensemble(df: DataFrame, iso: str, clf: str, out: str = "anomaly_score") -> DataFrame:
    """M-6: .3 * minmax(iso) + .7 * clf over the scored set."""
    n = minmax_normalize(df, iso, "_iso_n")
    return n.withColumn(out, C.ENSEMBLE_ISO_WEIGHT * F.col("_iso_n") + C.ENSEMBLE_CLF_WEIGHT * F.col(clf)).drop("_iso_n")


def is_healthy(metrics: DataFrame) -> DataFrame:
    """M-10: AUC >= .8."""
    return metrics.withColumn("healthy", F.col("roc_auc") >= C.MODEL_HEALTH_AUC)
