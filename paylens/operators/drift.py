"""Drift monitoring (D-1, D-2, J-8, SNK-8 rows).

Per-period column statistics are one aggregation pass grouped by period and
unpivoted to (period, feature, stat) rows; reference and current statistics
meet in an equi join on the feature name (J-8) over a handful of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens import constants as C


def _unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def period_means(df: DataFrame, period: Column, cols: list[str]) -> DataFrame:
    """(period, feature, mean) with nulls as 0 (fillna(0).mean())."""
    agg = df.groupBy(period.alias("period")).agg(
        *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in cols])
    return _unpivot(agg, ["period"], cols, "feature", "mean")


def mean_shift_columns(df: DataFrame, is_current: Column, cols: list[str] | None = None) -> DataFrame:
    """J-8 + D-1 per column: min(|cur - ref| / max(|ref|, 1), 1).

    Reference and current means are aligned by feature name.  Both periods are
    averaged side by side in one aggregation (one row) and unpivoted, so the
    feature table is read once instead of once per side of a join.
    """
    cols = [c for c in (cols or C.DRIFT_COLUMNS) if c in df.columns]
    cur = F.coalesce(is_current, F.lit(False))

    def mean(c: str, current: bool) -> Column:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return F.avg(F.when(cur if current else ~cur, x))

    wide = df.agg(*[F.struct(mean(c, False).alias("ref_mean"), mean(c, True).alias("cur_mean")).alias(c)
                    for c in cols])
    long = wide.unpivot([], cols, "feature", "s").select("feature", "s.ref_mean", "s.cur_mean")
    both = F.col("ref_mean").isNotNull() & F.col("cur_mean").isNotNull()      # columns present in both
    return long.filter(both).withColumn(
        "shift", F.least(F.abs(F.col("cur_mean") - F.col("ref_mean"))
                         / F.greatest(F.abs(F.col("ref_mean")), F.lit(1.0)), F.lit(1.0)))


def mean_shift_drift(df: DataFrame, is_current: Column, cols: list[str] | None = None,
                     threshold: float = C.DRIFT_THRESHOLD) -> DataFrame:
    """D-1: score = mean shift over common columns (none -> 0); drift and action flags."""
    cols_df = mean_shift_columns(df, is_current, cols)
    score = F.coalesce(F.avg("shift"), F.lit(0.0))
    return cols_df.agg(score.alias("drift_score"), F.count(F.lit(1)).alias("columns_compared")).select(
        "drift_score", (F.col("drift_score") > threshold).alias("drift_detected"),
        F.when(F.col("drift_score") > threshold, F.lit("retraining_triggered")).otherwise(F.lit("none"))
        .alias("action_taken"), "columns_compared")


def psi_columns(df: DataFrame, is_current: Column, numeric: list[str], categorical: list[str],
                bins: int = 10, eps: float = 1e-4, psi_threshold: float = 0.2) -> DataFrame:
    """D-2 (our choice): population stability index per column.

    Numeric columns use ``bins`` equal-width bins over the reference range
    (min/max as scalar subqueries); categorical columns use their values.
    PSI = sum((c - r) * ln(c / r)) over bins with shares floored at ``eps``.
    """
    from paylens.session import cut_lineage
    tagged = cut_lineage(df.select(*numeric, *categorical, F.when(is_current, F.lit("current"))
                                   .otherwise(F.lit("reference")).alias("_period")))      # read twice below
    # numeric: long (feature, x) rows, reference ranges per feature (one row per column, a
    # bound set by the column list) joined back by broadcast
    num = tagged.select("_period", *[F.col(c).cast("double").alias(c) for c in numeric]) \
                .unpivot(["_period"], numeric, "feature", "x")
    ranges = (num.filter(F.col("_period") == "reference").groupBy("feature")
              .agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.greatest(F.floor((F.col("x") - F.col("lo")) / width), F.lit(0)),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("string")
    allp = (num.join(F.broadcast(ranges), "feature", "left")
            .select("feature", F.coalesce(b, F.lit("null")).alias("bin"), "_period"))
    if categorical:
        cat = tagged.select("_period", *[F.col(c).cast("string").alias(c) for c in categorical]) \
                    .unpivot(["_period"], categorical, "feature", "v") \
                    .select("feature", F.coalesce(F.col("v"), F.lit("null")).alias("bin"), "_period")
        allp = allp.unionByName(cat)
    counts = allp.groupBy("feature", "bin").agg(
        F.count(F.when(F.col("_period") == "reference", 1)).alias("r"),
        F.count(F.when(F.col("_period") == "current", 1)).alias("c"))
    per_feature = Window.partitionBy("feature")
    shares = counts.select(
        "feature", "bin",
        F.greatest(F.col("r").cast("double") / F.sum("r").over(per_feature).cast("double"), F.lit(eps)).alias("rs"),
        F.greatest(F.col("c").cast("double") / F.sum("c").over(per_feature).cast("double"), F.lit(eps)).alias("cs"))
    psi = shares.groupBy("feature").agg(F.sum((F.col("cs") - F.col("rs")) * F.log(F.col("cs") / F.col("rs"))).alias("psi"))
    return psi.withColumn("drifted", F.col("psi") > psi_threshold)


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> tuple[Column, Column]:
    """The scaled two-sample Kolmogorov-Smirnov statistic (to be named ``_lam``) and its asymptotic p-value."""
    lam = statistic * F.sqrt(n.cast("double") * m.cast("double") / (n + m).cast("double"))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(
        F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * F.col("_lam") * F.col("_lam")))
    return lam, F.when(F.col("_lam") < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * terms, F.lit(0.0)), F.lit(1.0)))


def chi_square_p(statistic: str, freedom: str) -> Column:
    """Upper tail of the chi-square distribution by the series of the incomplete gamma function (0 beyond 1400)."""
    a, x = F.col(freedom) / 2.0, F.col(statistic) / 2.0
    # ln Gamma(a + 1) of a half-integer: from Gamma(1) = 1 or Gamma(1/2) = sqrt(pi) upwards
    half = F.col(freedom) % 2 == 1
    low = F.when(half, F.lit(0.5)).otherwise(F.lit(1.0))
    start = F.when(half, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))
    steps = F.when(half, F.floor(a) + 1).otherwise(F.floor(a)).cast("int")
    gamma = start + F.aggregate(F.sequence(F.lit(0), steps), F.lit(0.0), lambda acc, k: acc + F.when(k < steps, F.log(low + k)).otherwise(0.0))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(2000)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                         lambda acc, k: F.struct((acc["t"] * x / (a + k)).alias("t"), (acc["s"] + acc["t"] * x / (a + k)).alias("s")),
                         lambda acc: acc["s"])
    lower = F.exp(a * F.log(x) - x - gamma) * series
    return F.when((F.col(freedom) < 1) | (F.col(statistic) <= 0), F.lit(1.0)).when(x > 700, F.lit(0.0)) \
        .otherwise(F.least(F.greatest(1.0 - lower, F.lit(0.0)), F.lit(1.0)))


def two_sample_columns(df: DataFrame, is_current: Column, numeric: list[str], categorical: list[str], alpha: float = 0.05) -> DataFrame:
    """D-2 per column: (feature, test, statistic, p_value, drifted) of reference against current rows.

    Numeric columns: the exact Kolmogorov-Smirnov statistic, the largest distance
    of the two distribution functions, from running counts per distinct value
    (G-1 within a column).  Categories (null is one): chi-square over the table
    of counts.  Both start from counts by value and period, which merge.
    """
    from paylens.operators.ranking import grouped_cumulative
    from paylens.session import cut_lineage
    tagged = cut_lineage(df.select(*numeric, *categorical, F.coalesce(is_current, F.lit(False)).alias("_cur")))
    flags = [(~F.col("_cur")).cast("long").alias("r"), F.col("_cur").cast("long").alias("c")]
    num = tagged.select("_cur", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(["_cur"], numeric, "feature", "x") \
        .filter("x is not null").select("feature", "x", *flags)
    cum = cut_lineage(grouped_cumulative(num, "feature", "x", ["r", "c"]))
    sizes = cum.groupBy("feature").agg(F.sum("r").alias("n"), F.sum("c").alias("m"))              # a row per column
    apart = F.abs(F.col("cum_r").cast("double") / F.col("n").cast("double") - F.col("cum_c").cast("double") / F.col("m").cast("double"))
    ks = cum.join(F.broadcast(sizes), "feature").groupBy("feature", "n", "m").agg(F.max(apart).alias("statistic"))
    lam, p = kolmogorov_p(F.col("statistic"), F.col("n"), F.col("m"))
    ks = ks.withColumn("_lam", lam).select("feature", F.lit("ks").alias("test"), "statistic", p.alias("p_value"))

    values = tagged.select("_cur", *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(["_cur"], categorical, "feature", "v") \
        .select("feature", F.coalesce("v", F.lit("null")).alias("v"), *flags).groupBy("feature", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    values = cut_lineage(values)
    totals = values.groupBy("feature").agg(F.sum("r").cast("double").alias("n"), F.sum("c").cast("double").alias("m"), F.count(F.lit(1)).alias("k"))
    both = (F.col("r") + F.col("c")).cast("double")
    exp_r, exp_c = both * F.col("n") / (F.col("n") + F.col("m")), both * F.col("m") / (F.col("n") + F.col("m"))
    cell = (F.col("r") - exp_r) * (F.col("r") - exp_r) / F.nullif(exp_r, F.lit(0.0)) + (F.col("c") - exp_c) * (F.col("c") - exp_c) / F.nullif(exp_c, F.lit(0.0))
    chi = values.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.coalesce(F.sum(cell), F.lit(0.0)).alias("statistic"), (F.max("k") - 1).cast("int").alias("_free"))
    chi = chi.select("feature", F.lit("chi2").alias("test"), "statistic", chi_square_p("statistic", "_free").alias("p_value"))
    return ks.unionByName(chi).withColumn("drifted", F.col("p_value") < alpha)


def two_sample_drift(columns: DataFrame, share_threshold: float = 0.5) -> DataFrame:
    """D-2 summary of per-column tests: share and number of drifted columns, dataset flag."""
    hits = F.count_if("drifted")
    share = hits.cast("double") / F.count(F.lit(1)).cast("double")
    return columns.agg(share.alias("share_of_drifted_columns"), hits.alias("number_of_drifted_columns"),
                       (share >= share_threshold).alias("dataset_drift"))


def distribution_drift(df: DataFrame, is_current: Column, numeric: list[str] | None = None,
                       categorical: list[str] | None = None, share_threshold: float = 0.5) -> DataFrame:
    """D-2 summary: share and number of drifted columns, dataset flag."""
    numeric = [c for c in (numeric or C.DRIFT_COLUMNS) if c in df.columns]
    categorical = [c for c in (categorical or ["merchant_category", "payment_terminal", "state"]) if c in df.columns]
    cols = psi_columns(df, is_current, numeric, categorical)
    return cols.agg(
        (F.count(F.when(F.col("drifted"), 1)).cast("double") / F.count(F.lit(1)).cast("double"))
        .alias("share_of_drifted_columns"),
        F.count(F.when(F.col("drifted"), 1)).alias("number_of_drifted_columns"),
    ).withColumn("dataset_drift", F.col("share_of_drifted_columns") >= share_threshold)


def metrics_rows(drift: DataFrame, model_name: str = "anomaly-detector",
                 environment: str = "production") -> DataFrame:
    """SNK-8: long metrics (name, value, unit, dimensions map) from a D-2 summary row."""
    long = drift.select(F.expr(
        "stack(3, 'data_drift_score', share_of_drifted_columns, "
        "'drifted_features_count', CAST(number_of_drifted_columns AS DOUBLE), "
        "'dataset_drift_detected', CASE WHEN dataset_drift THEN 1.0D ELSE 0.0D END) AS (metric_name, value)"))
    return long.select("metric_name", "value", F.lit("None").alias("unit"),
                       F.create_map(F.lit("ModelName"), F.lit(model_name),
                                    F.lit("Environment"), F.lit(environment)).alias("dimensions"))
