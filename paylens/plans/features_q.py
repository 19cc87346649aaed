"""Rolling-feature queries (W-*, G-1, J-3, SRC-8) and DuckDB oracles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import round_half
from paylens.functions.numeric import sql_money_avg as AVG
from paylens.functions.numeric import sql_round as R
from paylens.operators import features as FT
from paylens.operators import ranking as RK
from paylens.plans.registry import register
from paylens.sources.tables import TRANSACTION_COLUMNS, transactions, with_transactions

TX_COLS = [c for c in TRANSACTION_COLUMNS if c not in C.FEATURE_COLUMNS]


def _q(c: str) -> str:
    return '"timestamp"' if c == "timestamp" else c


def _frame(us: int, closed: bool = False) -> str:
    lo = us if closed else us - 1
    return f"(PARTITION BY merchant_id ORDER BY ts_us RANGE BETWEEN {lo} PRECEDING AND CURRENT ROW)"


def _finite(e: str) -> str:
    return f"(CASE WHEN isnan({e}) OR isinf({e}) THEN 0.0 ELSE COALESCE({e}, 0.0) END)"


TRAINING_FEATURES_CTES = [
    """base AS (SELECT *, epoch_us("timestamp") AS ts_us FROM transactions WHERE "timestamp" IS NOT NULL)""",
    f"""win AS (
      SELECT *,
        CAST(COUNT(transaction_id) OVER {_frame(FT.HOUR_US)} AS DOUBLE) AS txn_velocity_1h,
        CAST(COUNT(transaction_id) OVER {_frame(FT.DAY_US)} AS DOUBLE) AS txn_velocity_24h,
        AVG(amount_aud) OVER {_frame(7 * FT.DAY_US)} AS avg_amount_7d,
        COALESCE(STDDEV_SAMP(amount_aud) OVER {_frame(30 * FT.DAY_US)}, 0.0) AS stddev_amount_30d,
        MAX(amount_aud) OVER {_frame(7 * FT.DAY_US)} AS max_amount_7d,
        CAST(COUNT(DISTINCT COALESCE(customer_id, '{FT.NULL_CUSTOMER}')) OVER {_frame(FT.DAY_US)} AS DOUBLE)
          AS unique_customers_1d,
        COALESCE(AVG(CASE WHEN payment_terminal = 'tap_and_go' THEN 1.0 ELSE 0.0 END) OVER {_frame(7 * FT.DAY_US)}, 0.0)
          AS pct_tap_payments_7d,
        COALESCE(AVG(CASE WHEN card_type = 'debit' THEN 1.0 ELSE 0.0 END) OVER {_frame(7 * FT.DAY_US)}, 0.0)
          AS pct_debit_7d,
        COALESCE(AVG(CASE WHEN is_outside_business_hours THEN 1.0 ELSE 0.0 END) OVER {_frame(7 * FT.DAY_US)}, 0.0)
          AS off_hours_txn_ratio_7d
      FROM base)""",
    f"""st AS (SELECT state, {AVG('amount_aud')} AS state_avg FROM transactions GROUP BY state)""",
    """feat AS (
      SELECT w.*,
        CAST(hour(w."timestamp") AS DOUBLE) AS hour_of_day,
        CASE WHEN w.is_outside_business_hours THEN 1.0 ELSE 0.0 END AS off_flag,
        CASE WHEN w.payment_terminal = 'manual_entry' THEN 1.0 ELSE 0.0 END AS is_manual_entry,
        CASE WHEN w.payment_terminal = 'chip_and_pin' THEN 1.0 ELSE 0.0 END AS is_chip_and_pin,
        CASE WHEN w.card_type = 'credit' THEN 1.0 ELSE 0.0 END AS is_credit_card,
        (w.amount_aud - w.avg_amount_7d)
          / (CASE WHEN w.stddev_amount_30d = 0 THEN 0.01 ELSE w.stddev_amount_30d END) AS amount_zscore,
        w.amount_aud / greatest(w.avg_amount_7d, 1.0) AS amount_to_merchant_avg_7d,
        w.avg_amount_7d - st.state_avg AS state_avg_amount_deviation
      FROM win w LEFT JOIN st ON w.state = st.state)""",
]


def _feature_sql(c: str) -> str:
    src = "off_flag" if c == "is_outside_business_hours" else c
    return f"{R(_finite(src), 6)} AS {c}"


@register("training_features", "W-11", with_transactions(
    "SELECT " + ", ".join(_q(c) for c in TX_COLS) + ", "
    + ", ".join(_feature_sql(c) for c in C.FEATURE_COLUMNS) + " FROM feat",
    *TRAINING_FEATURES_CTES))
def q_training_features(spark, sf_dir):
    return rounded_training_features(spark, sf_dir)


DAY = date(2024, 1, 15)


@register("batch_day_features", "W-12", with_transactions(f"""
SELECT merchant_id, transaction_id, "timestamp",
       CAST(COUNT(*) OVER {_frame(FT.HOUR_US, True)} AS BIGINT) AS txn_velocity_1h,
       {R(f'AVG(amount_aud) OVER {_frame(7 * FT.DAY_US, True)}', 6)} AS avg_amount_7d,
       {R(f'STDDEV_SAMP(amount_aud) OVER {_frame(30 * FT.DAY_US, True)}', 6)} AS stddev_amount_30d,
       CAST(hour("timestamp") AS INTEGER) AS hour_of_day, is_fraud
FROM (SELECT *, epoch_us("timestamp") AS ts_us FROM transactions
      WHERE CAST("timestamp" AS DATE) = DATE '{DAY.isoformat()}') d"""))
def q_batch_day_features(spark, sf_dir):
    f = FT.batch_day_features(transactions(spark, sf_dir), DAY)
    return f.select("merchant_id", "transaction_id", "timestamp", "txn_velocity_1h",
                    round_half("avg_amount_7d", 6).alias("avg_amount_7d"),
                    round_half("stddev_amount_30d", 6).alias("stddev_amount_30d"),
                    "hour_of_day", "is_fraud")


@register("batch_day_lookback", "W-12", with_transactions(f"""
SELECT * FROM (
  SELECT merchant_id, transaction_id, "timestamp",
         CAST(COUNT(*) OVER {_frame(FT.HOUR_US, True)} AS BIGINT) AS txn_velocity_1h,
         {R(f'AVG(amount_aud) OVER {_frame(7 * FT.DAY_US, True)}', 6)} AS avg_amount_7d,
         {R(f'STDDEV_SAMP(amount_aud) OVER {_frame(30 * FT.DAY_US, True)}', 6)} AS stddev_amount_30d,
         CAST(hour("timestamp") AS INTEGER) AS hour_of_day, is_fraud
  FROM (SELECT *, epoch_us("timestamp") AS ts_us FROM transactions
        WHERE CAST("timestamp" AS DATE) BETWEEN DATE '{DAY.isoformat()}' - 30 AND DATE '{DAY.isoformat()}') d) f
WHERE CAST("timestamp" AS DATE) = DATE '{DAY.isoformat()}'"""))
def q_batch_day_lookback(spark, sf_dir):
    """The day's rows with frames that reach into the 30 days before it."""
    f = FT.batch_day_features(transactions(spark, sf_dir), DAY, lookback=True)
    return f.select("merchant_id", "transaction_id", "timestamp", "txn_velocity_1h",
                    round_half("avg_amount_7d", 6).alias("avg_amount_7d"),
                    round_half("stddev_amount_30d", 6).alias("stddev_amount_30d"),
                    "hour_of_day", "is_fraud")


@register("latest_snapshot", "W-16", with_transactions(
    "SELECT " + ", ".join(_q(c) for c in TRANSACTION_COLUMNS) + """ FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY "timestamp" DESC, transaction_id DESC) AS rn
  FROM transactions) t WHERE rn = 1"""))
def q_latest_snapshot(spark, sf_dir):
    return FT.latest_snapshot(transactions(spark, sf_dir)).select(*TRANSACTION_COLUMNS)


@register("merchant_history", "SRC-8", with_transactions(
    "SELECT " + ", ".join(_q(c) for c in TRANSACTION_COLUMNS) + f""" FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY "timestamp" DESC, transaction_id DESC) AS rn
  FROM transactions) t WHERE rn <= {C.HISTORY_LIMIT}"""))
def q_merchant_history(spark, sf_dir):
    return FT.merchant_history(transactions(spark, sf_dir), C.HISTORY_LIMIT).select(*TRANSACTION_COLUMNS)


def _rt_cond(key: str) -> str:
    return f"ts_us >= anchor - {FT.WINDOW_US[key]}"


REALTIME_SQL = with_transactions(f"""
SELECT g.merchant_id,
  {R('COALESCE(v1h, 0.0)', 6)} AS txn_velocity_1h,
  {R('COALESCE(v24h, 0.0)', 6)} AS txn_velocity_24h,
  {R('COALESCE(a7, 0.0)', 6)} AS avg_amount_7d,
  {R('COALESCE(s30, 0.0)', 6)} AS stddev_amount_30d,
  {R('(c.amount_aud - COALESCE(a7, 0.0)) / greatest(COALESCE(s30, 0.0), 0.01)', 6)} AS amount_zscore,
  {R('COALESCE(m7, 0.0)', 6)} AS max_amount_7d,
  {R('COALESCE(u1d, 0.0)', 6)} AS unique_customers_1d,
  {R('COALESCE(tap7, 0.0)', 6)} AS pct_tap_payments_7d,
  CAST(hour(c."timestamp") AS DOUBLE) AS hour_of_day,
  CAST(CASE WHEN hour(c."timestamp") < 8 OR hour(c."timestamp") > 20 THEN 1 ELSE 0 END AS DOUBLE) AS is_outside_business_hours,
  {R('COALESCE(deb7, 0.0)', 6)} AS pct_debit_7d,
  {R('COALESCE(off7, 0.0)', 6)} AS off_hours_txn_ratio_7d,
  {R('COALESCE(a30 - COALESCE(sa.state_avg, a30), 0.0)', 6)} AS state_avg_amount_deviation
FROM g
JOIN cur c ON c.merchant_id = g.merchant_id
LEFT JOIN (
  SELECT h.merchant_id, AVG(h.amount_aud) AS state_avg
  FROM h JOIN cur c2 ON c2.merchant_id = h.merchant_id AND h.state = c2.state
  WHERE h.{_rt_cond('30D')} GROUP BY h.merchant_id) sa ON sa.merchant_id = g.merchant_id""",
    """h AS (SELECT *, max(ts_us) OVER (PARTITION BY merchant_id) AS anchor FROM (
        SELECT *, epoch_us("timestamp") AS ts_us,
               row_number() OVER (PARTITION BY merchant_id ORDER BY "timestamp" DESC, transaction_id DESC) AS rn
        FROM transactions) x WHERE rn <= 2000)""",
    """cur AS (SELECT merchant_id, amount_aud, state, "timestamp" FROM h WHERE rn = 1)""",
    f"""g AS (SELECT merchant_id,
        CAST(COUNT(CASE WHEN {_rt_cond('1H')} THEN 1 END) AS DOUBLE) AS v1h,
        CAST(COUNT(CASE WHEN {_rt_cond('24H')} THEN 1 END) AS DOUBLE) AS v24h,
        AVG(CASE WHEN {_rt_cond('7D')} THEN amount_aud END) AS a7,
        STDDEV_POP(CASE WHEN {_rt_cond('30D')} THEN amount_aud END) AS s30,
        MAX(CASE WHEN {_rt_cond('7D')} THEN amount_aud END) AS m7,
        CAST(COUNT(DISTINCT CASE WHEN {_rt_cond('1D')} THEN COALESCE(customer_id, '{FT.NULL_CUSTOMER}') END) AS DOUBLE) AS u1d,
        AVG(CASE WHEN {_rt_cond('7D')} THEN (CASE WHEN payment_terminal = 'tap_and_go' THEN 1.0 ELSE 0.0 END) END) AS tap7,
        AVG(CASE WHEN {_rt_cond('7D')} THEN (CASE WHEN card_type = 'debit' THEN 1.0 ELSE 0.0 END) END) AS deb7,
        AVG(CASE WHEN {_rt_cond('7D')} THEN (CASE WHEN is_outside_business_hours THEN 1.0 ELSE 0.0 END) END) AS off7,
        AVG(CASE WHEN {_rt_cond('30D')} THEN amount_aud END) AS a30
      FROM h GROUP BY merchant_id)""")


@register("realtime_features", "W-17", REALTIME_SQL)
def q_realtime_features(spark, sf_dir):
    f = FT.realtime_features(transactions(spark, sf_dir))
    return f.select("merchant_id", *[round_half(c, 6).alias(c) if c not in ("hour_of_day", "is_outside_business_hours")
                                     else F.col(c) for c in [x for x, _, _ in C.FEATURE_REGISTRY]])


@register("merchant_percentile", "W-15", with_transactions(f"""
SELECT m.merchant_id,
       {R('100.0 * CAST((SELECT COUNT(*) FROM ms m2 WHERE m2.avg_ticket <= m.avg_ticket) AS DOUBLE) / CAST((SELECT COUNT(*) FROM ms) AS DOUBLE)', 2)} AS state_percentile
FROM ms m""", f"ms AS (SELECT merchant_id, {AVG('amount_aud')} AS avg_ticket FROM transactions GROUP BY merchant_id)"))
def q_merchant_percentile(spark, sf_dir):
    return RK.merchant_percentile(transactions(spark, sf_dir))


@register("global_cumulative", "G-1", with_transactions("""
SELECT amount_aud, n, CAST(SUM(n) OVER (ORDER BY amount_aud ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_n
FROM (SELECT amount_aud, COUNT(*) AS n FROM transactions GROUP BY amount_aud) a"""))
def q_global_cumulative(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("amount_aud", F.lit(1).cast("bigint").alias("n"))
    return RK.global_cumulative(tx, "amount_aud", ["n"])


ROUNDED_FEATURES_CTE = ("tf AS (SELECT " + ", ".join(_q(c) for c in TX_COLS) + ", "
                        + ", ".join(_feature_sql(c) for c in C.FEATURE_COLUMNS) + " FROM feat)")


def rounded_training_features(spark, sf_dir, beside=TX_COLS):
    """W-11 output rounded to 6 decimals (the feature table other queries read); ``beside``: the transaction columns in it."""
    f = FT.training_features(transactions(spark, sf_dir), beside=beside)
    return f.select(*beside, *[round_half(c, 6).alias(c) for c in C.FEATURE_COLUMNS])
