"""Dashboard / per-merchant queries and their DuckDB oracles."""

from __future__ import annotations

from paylens import constants as C
from paylens.functions.numeric import sql_money_avg as AVG
from paylens.functions.numeric import sql_money_sum as SUM
from paylens.functions.numeric import sql_ratio_pct as PCT
from paylens.functions.numeric import sql_round as R
from paylens.operators import dashboards as D
from paylens.plans.registry import register
from paylens.sources.tables import TABLE_NAMES, read_table, transactions, with_transactions

FRAUD_N = "CAST(SUM(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT)"
FRAUD_V = "CASE WHEN is_fraud THEN amount_aud ELSE 0.0 END"
AS_OF = f"DATE '{C.AS_OF.isoformat()}'"


@register("overview", "A-1", with_transactions(f"""
SELECT COUNT(*) AS total_transactions,
       COUNT(DISTINCT merchant_id) AS total_merchants,
       {R(f"COALESCE({SUM('amount_aud')}, 0.0)", 2)} AS total_volume_aud,
       {R(f"COALESCE({AVG('amount_aud')}, 0.0)", 2)} AS avg_transaction_aud,
       {R(f"COALESCE({PCT(FRAUD_N, 'COUNT(*)')}, 0.0)", 4)} AS fraud_rate_pct,
       COUNT(DISTINCT state) AS states_covered
FROM transactions"""))
def q_overview(spark, sf_dir):
    return D.overview(transactions(spark, sf_dir))


@register("revenue_by_category", "A-2", with_transactions(f"""
SELECT merchant_category AS category,
       {R(SUM('amount_aud'), 2)} AS total_revenue,
       COUNT(*) AS transaction_count,
       {R(AVG('amount_aud'), 2)} AS avg_ticket
FROM transactions GROUP BY merchant_category ORDER BY total_revenue DESC"""))
def q_revenue_by_category(spark, sf_dir):
    return D.revenue_by_category(transactions(spark, sf_dir))


@register("revenue_trend", "A-3", with_transactions(f"""
SELECT CAST("timestamp" AS DATE) AS date,
       {R(SUM('amount_aud'), 2)} AS daily_revenue,
       COUNT(*) AS daily_transactions,
       {FRAUD_N} AS daily_fraud_count
FROM transactions GROUP BY CAST("timestamp" AS DATE) ORDER BY date"""))
def q_revenue_trend(spark, sf_dir):
    return D.revenue_trend(transactions(spark, sf_dir))


@register("fraud_by_state", "A-4", with_transactions(f"""
SELECT state,
       COUNT(*) AS total_transactions,
       {FRAUD_N} AS fraud_count,
       {R(PCT(FRAUD_N, 'COUNT(*)'), 4)} AS fraud_rate_pct,
       {R(SUM(FRAUD_V), 2)} AS fraud_value_aud
FROM transactions GROUP BY state ORDER BY fraud_count DESC"""))
def q_fraud_by_state(spark, sf_dir):
    return D.fraud_by_state(transactions(spark, sf_dir))


@register("hourly_pattern", "A-5", with_transactions(f"""
SELECT CAST(hour("timestamp") AS INTEGER) AS hour,
       COUNT(*) AS transaction_count,
       {R(AVG('amount_aud'), 2)} AS avg_amount,
       {FRAUD_N} AS fraud_count
FROM transactions GROUP BY 1 ORDER BY hour"""))
def q_hourly_pattern(spark, sf_dir):
    return D.hourly_pattern(transactions(spark, sf_dir))


@register("payment_methods", "A-6", with_transactions(f"""
SELECT payment_terminal,
       COUNT(*) AS count,
       {R(PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()'), 2)} AS percentage,
       {R(AVG('amount_aud'), 2)} AS avg_amount,
       {R(PCT(FRAUD_N, 'COUNT(*)'), 4)} AS fraud_rate_pct
FROM transactions GROUP BY payment_terminal ORDER BY count DESC"""))
def q_payment_methods(spark, sf_dir):
    return D.payment_methods(transactions(spark, sf_dir))


@register("top_merchants", "A-7", with_transactions(f"""
SELECT merchant_id, merchant_category, state,
       COUNT(*) AS transaction_count,
       {R(SUM('amount_aud'), 2)} AS total_revenue,
       {R(AVG('amount_aud'), 2)} AS avg_ticket
FROM transactions GROUP BY merchant_id, merchant_category, state
ORDER BY total_revenue DESC, merchant_id, merchant_category, state LIMIT 10"""))
def q_top_merchants(spark, sf_dir):
    return D.top_merchants(transactions(spark, sf_dir), 10)


_spine = ", ".join(f"('{s}')" for s in C.STATES)


@register("threat_map", "A-9", with_transactions(f"""
SELECT 30 AS window_days, s.state,
       COALESCE(a.transaction_count, 0) AS transaction_count,
       COALESCE(a.fraud_count, 0) AS fraud_count,
       {R('COALESCE(a.fraud_value, 0)', 2)} AS fraud_value_aud,
       COALESCE({R(PCT('a.fraud_count', 'a.transaction_count'), 4)}, 0.0) AS fraud_rate_pct,
       CAST(SUM(COALESCE(a.fraud_count, 0)) OVER () AS BIGINT) AS total_fraud_count,
       {R('SUM(COALESCE(a.fraud_value, 0)) OVER ()', 2)} AS total_fraud_value_aud
FROM (VALUES {_spine}) AS s(state)
LEFT JOIN (
  SELECT state, COUNT(*) AS transaction_count, {FRAUD_N} AS fraud_count,
         SUM(CAST({FRAUD_V} AS DECIMAL(24,6))) AS fraud_value
  FROM transactions
  WHERE CAST("timestamp" AS DATE) >= {AS_OF} - 30
  GROUP BY state) a ON a.state = s.state
ORDER BY s.state"""))
def q_threat_map(spark, sf_dir):
    return D.threat_map(transactions(spark, sf_dir), 30, C.AS_OF)


@register("merchant_revenue", "A-10", with_transactions(f"""
SELECT merchant_id, {R(SUM('amount_aud'), 2)} AS total_revenue, COUNT(*) AS transaction_count,
       {R(AVG('amount_aud'), 2)} AS avg_transaction
FROM transactions GROUP BY merchant_id"""))
def q_merchant_revenue(spark, sf_dir):
    return D.merchant_revenue(transactions(spark, sf_dir))


@register("merchant_fraud", "A-11", with_transactions(f"""
SELECT merchant_id, COUNT(*) AS total, {FRAUD_N} AS fraud_count,
       {R(SUM(FRAUD_V), 2)} AS fraud_value
FROM transactions GROUP BY merchant_id"""))
def q_merchant_fraud(spark, sf_dir):
    return D.merchant_fraud(transactions(spark, sf_dir))


@register("merchant_peak_hours", "A-12", with_transactions("""
SELECT merchant_id, hour, txn_count, rank FROM (
  SELECT merchant_id, hour, txn_count,
         CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY txn_count DESC, hour) AS INTEGER) AS rank
  FROM (SELECT merchant_id, CAST(hour("timestamp") AS INTEGER) AS hour, COUNT(*) AS txn_count
        FROM transactions GROUP BY 1, 2) h) r
WHERE rank <= 5"""))
def q_merchant_peak_hours(spark, sf_dir):
    return D.merchant_peak_hours(transactions(spark, sf_dir), 5)


@register("merchant_profile", "A-13", with_transactions(f"""
SELECT merchant_id, merchant_category, state, COUNT(*) AS txn_count, {R(SUM('amount_aud'), 2)} AS total
FROM transactions GROUP BY merchant_id, merchant_category, state"""))
def q_merchant_profile(spark, sf_dir):
    return D.merchant_profile(transactions(spark, sf_dir))


@register("merchant_baseline", "A-14", with_transactions(f"""
SELECT merchant_id, {R(AVG('amount_aud'), 6)} AS avg_amount,
       {R('stddev_samp(amount_aud)', 6)} AS std_amount, COUNT(*) AS txn_count
FROM transactions GROUP BY merchant_id"""))
def q_merchant_baseline(spark, sf_dir):
    from paylens.functions.numeric import round_half
    b = D.merchant_baseline(transactions(spark, sf_dir))
    return b.select("merchant_id", round_half("avg_amount", 6).alias("avg_amount"),
                    round_half("std_amount", 6).alias("std_amount"), "txn_count")


@register("merchant_revenue_trend", "A-15", with_transactions(f"""
SELECT merchant_id, CAST("timestamp" AS DATE) AS day, {R(SUM('amount_aud'), 2)} AS revenue
FROM transactions WHERE CAST("timestamp" AS DATE) >= {AS_OF} - 30
GROUP BY 1, 2"""))
def q_merchant_revenue_trend(spark, sf_dir):
    return D.merchant_revenue_trend(transactions(spark, sf_dir), 30, C.AS_OF)


@register("merchant_severity", "A-16", with_transactions(f"""
SELECT merchant_id,
  CAST(SUM(CASE WHEN is_fraud AND amount_aud >= {C.SEVERITY_HIGH_AMOUNT} THEN 1 ELSE 0 END) AS BIGINT) AS high,
  CAST(SUM(CASE WHEN is_fraud AND amount_aud >= {C.SEVERITY_MEDIUM_AMOUNT}
                 AND amount_aud < {C.SEVERITY_HIGH_AMOUNT} THEN 1 ELSE 0 END) AS BIGINT) AS medium,
  CAST(SUM(CASE WHEN is_fraud AND amount_aud < {C.SEVERITY_MEDIUM_AMOUNT} THEN 1 ELSE 0 END) AS BIGINT) AS low
FROM transactions GROUP BY merchant_id"""))
def q_merchant_severity(spark, sf_dir):
    return D.merchant_severity(transactions(spark, sf_dir))


@register("merchant_payment_share", "A-17", with_transactions(f"""
SELECT merchant_id, payment_terminal AS method,
       {R('CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER (PARTITION BY merchant_id) AS DOUBLE)', 4)} AS share
FROM transactions GROUP BY merchant_id, payment_terminal"""))
def q_merchant_payment_share(spark, sf_dir):
    return D.merchant_payment_share(transactions(spark, sf_dir))


@register("table_counts", "A-19", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLE_NAMES))
def q_table_counts(spark, sf_dir):
    return D.table_counts({t: read_table(spark, sf_dir, t) for t in TABLE_NAMES})


@register("agent_daily_revenue", "A-20", with_transactions(f"""
SELECT merchant_id, day, total_revenue FROM (
  SELECT merchant_id, CAST("timestamp" AS DATE) AS day, {SUM('amount_aud')} AS total_revenue,
         row_number() OVER (PARTITION BY merchant_id ORDER BY CAST("timestamp" AS DATE) DESC) AS rn
  FROM transactions GROUP BY merchant_id, CAST("timestamp" AS DATE)) d
WHERE rn <= 30"""))
def q_agent_daily_revenue(spark, sf_dir):
    return D.agent_daily_revenue(transactions(spark, sf_dir), 30)


@register("agent_txn_count", "A-20", with_transactions("""
SELECT merchant_id, COUNT(*) AS txn_count FROM transactions GROUP BY merchant_id"""))
def q_agent_txn_count(spark, sf_dir):
    return D.agent_txn_count(transactions(spark, sf_dir))


@register("label_rate", "A-23", with_transactions(f"""
SELECT CAST({FRAUD_N} AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0.0) AS fraud_rate
FROM transactions"""))
def q_label_rate(spark, sf_dir):
    return D.label_rate(transactions(spark, sf_dir))


@register("class_weight", "A-24", with_transactions("""
SELECT negatives, positives,
       CAST(negatives AS DOUBLE) / CAST(greatest(positives, 1) AS DOUBLE) AS scale_pos_weight
FROM (SELECT CAST(SUM(CASE WHEN NOT is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
             CAST(SUM(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS positives
      FROM transactions) t"""))
def q_class_weight(spark, sf_dir):
    return D.class_weight(transactions(spark, sf_dir))


@register("state_merchants", "A-25", with_transactions("""
SELECT state, COUNT(DISTINCT merchant_id) AS merchants FROM transactions GROUP BY state"""))
def q_state_merchants(spark, sf_dir):
    return D.state_merchants(transactions(spark, sf_dir))
