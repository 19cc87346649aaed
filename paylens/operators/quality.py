"""Data-quality checks (Q-1 … Q-4, U-5) as single-pass aggregates in long form.

Value rules are evaluated in one aggregation pass (one partial aggregate per
task, a single-row final); uniqueness is a hash aggregate on the id whose
duplicate groups are summed; rule rows are unpivoted with ``stack``.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import count_if, round_half

RULE_SCHEMA = "rule string, column string, violations bigint, nulls bigint"


def _long(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _stack(agg: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """rules: (rule, column, violations_col, nulls_col) over a one-row aggregate."""
    args = ", ".join(f"'{r}', '{c}', {v}, {n}" for r, c, v, n in rules)
    return agg.selectExpr(f"stack({len(rules)}, {args}) AS (rule, column, violations, nulls)")


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key value occurs more than once (U-3 input), counted per key."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def expectations(tx: DataFrame) -> DataFrame:
    """Q-1: 3 column-exists, amount in range, category/state in set, id unique."""
    spark = tx.sparkSession
    exists = [("column_exists", c, 0 if c in tx.columns else 1, 0)
              for c in ("transaction_id", "merchant_id", "amount_aud")]
    amt = F.col("amount_aud")
    cat, st = F.col("merchant_category"), F.col("state")
    agg = tx.agg(
        count_if(amt.isNotNull() & ((amt < C.AMOUNT_MIN) | (amt > C.AMOUNT_MAX))).alias("amt_v"),
        count_if(amt.isNull()).alias("amt_n"),
        count_if(cat.isNotNull() & ~cat.isin(C.CATEGORIES)).alias("cat_v"),
        count_if(cat.isNull()).alias("cat_n"),
        count_if(st.isNotNull() & ~st.isin(C.STATES)).alias("st_v"),
        count_if(st.isNull()).alias("st_n"),
        count_if(F.col("transaction_id").isNull()).alias("id_n"),
    )
    dup = duplicate_rows(tx, "transaction_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("dup"))
    values = _stack(agg, [("values_between", "amount_aud", "amt_v", "amt_n"),
                          ("values_in_set", "merchant_category", "cat_v", "cat_n"),
                          ("values_in_set", "state", "st_v", "st_n")])
    unique = dup.select(F.lit("values_unique").alias("rule"), F.lit("transaction_id").alias("column"),
                        F.col("dup").alias("violations"), agg.select("id_n").scalar().alias("nulls"))
    out = _long(spark, exists).unionByName(values).unionByName(unique)
    return out.withColumn("passed", F.col("violations") == 0)


def contract_check(tx: DataFrame) -> DataFrame:
    """Q-2: required columns, no null ids, positive amounts, allowed categories, currency."""
    spark = tx.sparkSession
    missing = [c for c in C.CONTRACT_COLUMNS if c not in tx.columns]
    schema_rows = [("required_columns", ",".join(missing), len(missing), 0)]
    agg = tx.agg(
        count_if(F.col("transaction_id").isNull()).alias("id_null"),
        count_if(~(F.coalesce(F.col("amount_aud"), F.lit(0.0)) > 0)).alias("amt_bad"),
        count_if(~F.coalesce(F.col("merchant_category").isin(C.CATEGORIES), F.lit(False))).alias("cat_bad"),
        count_if(~F.coalesce(F.col("currency") == C.CURRENCY, F.lit(False))).alias("cur_bad"),
    )
    checks = agg.selectExpr(
        "stack(4, 'no_null_ids', 'transaction_id', id_null, 0L, 'positive_amounts', 'amount_aud', amt_bad, 0L, "
        "'allowed_categories', 'merchant_category', cat_bad, 0L, 'currency_aud', 'currency', cur_bad, 0L) "
        "AS (rule, column, violations, nulls)")
    return (_long(spark, schema_rows).unionByName(checks)
            .withColumn("passed", F.col("violations") == 0).drop("nulls"))


def unexpected_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """U-5: actual - allowed as a left-anti join against the (fixed, small) allowed set."""
    allowed_df = df.sparkSession.createDataFrame([(a,) for a in allowed], f"{column} string")
    return (df.select(column).filter(F.col(column).isNotNull()).distinct()
            .join(F.broadcast(allowed_df), column, "left_anti"))


def calibration_check(tx: DataFrame) -> DataFrame:
    """Q-3: observed shares vs prior tables, plus the fraud-rate and tap-share bounds.

    One read with grouping sets counts every dimension and the table; observed
    and prior rows are unioned and aggregated (no join).
    """
    from paylens.session import cut_lineage
    spark = tx.sparkSession
    dims = ["state", "payment_terminal", "card_type"]
    counted = cut_lineage(tx.groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), count_if(F.col("is_fraud")).alias("fraud"),
        count_if(F.col("payment_terminal") == "tap_and_go").alias("tap")))
    whole = counted.filter("gid = 7")
    total = whole.select("n").scalar()
    priors = ([("state", s, w) for s, w in zip(C.STATES, C.STATE_WEIGHTS)]
              + [("payment_terminal", t, r) for t, r in zip(C.TERMINALS, C.TERMINAL_RATIOS)]
              + [("card_type", c, r) for c, r in zip(C.CARD_TYPES, C.CARD_RATIOS)])
    prior_df = spark.createDataFrame([(d, v, p, 0) for d, v, p in priors],
                                     "dimension string, value string, prior_share double, n bigint")
    obs = None
    for i, d in enumerate(dims):
        part = counted.filter(F.col("gid") == 7 - (4 >> i)).select(
            F.lit(d).alias("dimension"), F.col(d).alias("value"), F.lit(None).cast("double").alias("prior_share"), "n")
        obs = part if obs is None else obs.unionByName(part)
    shares = (obs.unionByName(prior_df).groupBy("dimension", "value")
              .agg(F.sum("n").alias("n"), F.max("prior_share").alias("prior_share"))
              .select("dimension", "value",
                      round_half(F.col("n").cast("double") / total.cast("double"), 6).alias("observed_share"),
                      "prior_share",
                      round_half(F.abs(F.col("n").cast("double") / total.cast("double")
                                       - F.coalesce("prior_share", F.lit(0.0))), 6).alias("abs_gap"),
                      F.lit(None).cast("boolean").alias("within_bounds")))
    share = lambda c: F.col(c).cast("double") / F.nullif(F.col("n"), F.lit(0)).cast("double")
    bounds = whole.select(share("fraud").alias("fr"), share("tap").alias("tap")).selectExpr(
        "stack(2, 'bound', 'fraud_rate', fr, (fr > 0.0005 AND fr < 0.005), "
        "'bound', 'tap_share', tap, (tap > 0.85 AND tap < 0.98)) AS (dimension, value, observed_share, within_bounds)"
    ).select("dimension", "value", round_half("observed_share", 6).alias("observed_share"),
             F.lit(None).cast("double").alias("prior_share"), F.lit(None).cast("double").alias("abs_gap"),
             "within_bounds")
    return shares.unionByName(bounds)


def table_health(tx: DataFrame, scores: DataFrame, as_of: date) -> DataFrame:
    """Q-4: freshness, null rate per column, daily row counts, score histogram, prediction count, pass rate of Q-1.

    Long table (metric, key, value); ``scores`` has an ``anomaly_score`` column.
    """
    end = datetime.combine(as_of + timedelta(days=1), datetime.min.time())
    from paylens.functions.timecols import epoch_micros, ntz_literal
    from paylens.session import cut_lineage
    wide = cut_lineage(tx.agg(                                                     # one row, one read
        ((epoch_micros(ntz_literal(end)) / 1_000_000).cast("long")
         - epoch_micros(F.max("timestamp")) / 1_000_000).cast("double").alias("_fresh"),
        *[(count_if(F.col(c).isNull()).cast("double") / F.count(F.lit(1)).cast("double")).alias(c) for c in tx.columns]))
    fresh = wide.select(F.col("_fresh").alias("v"))
    fresh = fresh.select(F.lit("freshness_seconds").alias("metric"), F.lit("").alias("key"), F.col("v").alias("value"))
    alarm = fresh.select(F.lit("freshness_alarm").alias("metric"), F.lit("").alias("key"),
                         (F.col("value") > C.FRESHNESS_ALARM_SECONDS).cast("double").alias("value"))
    nulls = wide.selectExpr(f"stack({len(tx.columns)}, " + ", ".join(f"'{c}', `{c}`" for c in tx.columns)
                             + ") AS (key, value)").select(F.lit("null_rate").alias("metric"), "key", "value")
    daily = (tx.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("key"))
             .agg(F.count(F.lit(1)).cast("double").alias("value"))
             .select(F.lit("daily_rows").alias("metric"), "key", "value"))
    bucket = F.least(F.floor(F.col("anomaly_score") * 10), F.lit(9)).cast("int")
    hist = (cut_lineage(scores.groupBy(F.format_string("%d", bucket).alias("key"))
                        .agg(F.count(F.lit(1)).cast("double").alias("value")))
            .select(F.lit("score_histogram").alias("metric"), "key", "value"))
    preds = hist.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")) \
                  .select(F.lit("prediction_count").alias("metric"), F.lit("").alias("key"), "value")
    rate = expectations(tx).agg(F.avg(F.col("passed").cast("double")).alias("value")) \
                           .select(F.lit("check_pass_rate").alias("metric"), F.lit("").alias("key"), "value")
    preds = preds.unionByName(rate)
    return fresh.unionByName(alarm).unionByName(nulls).unionByName(daily).unionByName(hist).unionByName(preds)
