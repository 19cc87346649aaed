"""Scoring-rule queries (R-*, W-13, J-6) and DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import round_half
from paylens.functions.numeric import sql_money_avg as AVG
from paylens.functions.numeric import sql_round as R
from paylens.functions.risk import sql_fraud_prior, sql_recommended_action, sql_risk_level
from paylens.operators import features as FT
from paylens.operators import scoring as S
from paylens.plans.features_q import REALTIME_SQL
from paylens.plans.registry import register
from paylens.sources.tables import transactions, with_transactions

AS_OF = f"DATE '{C.AS_OF.isoformat()}'"


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _feed_score_sql(z: str) -> str:
    """Same terms, same order and the same DOUBLE constants as functions.risk.feed_score."""
    s = (f"({_d(C.FEED_BASE)} + least(abs({z}) / {_d(C.FEED_Z_DIVISOR)}, {_d(C.FEED_Z_CAP)})"
         f" + CASE WHEN payment_terminal = 'manual_entry' THEN {_d(C.FEED_MANUAL)} ELSE {_d(0.0)} END"
         f" + CASE WHEN card_type = 'credit' THEN {_d(C.FEED_CREDIT)} ELSE {_d(0.0)} END"
         f" + CASE WHEN COALESCE(is_fraud, FALSE) THEN {_d(C.FEED_FRAUD)} ELSE {_d(0.0)} END)")
    return f"least(greatest({s}, {_d(0.0)}), {_d(1.0)})"


FEED_STATS = (f"ms AS (SELECT merchant_id, COALESCE({AVG('amount_aud')}, 0.0) AS merchant_avg, "
              f"COALESCE(STDDEV_POP(amount_aud), 0.0) AS merchant_std FROM transactions GROUP BY merchant_id)")
FEED_Z = "((amount_aud - merchant_avg) / greatest(merchant_std, 0.01))"
FEED_ALL = ("scored AS (SELECT t.*, ms.merchant_avg, ms.merchant_std, "
            + _feed_score_sql(FEED_Z) + " AS anomaly_score FROM transactions t JOIN ms USING (merchant_id))")


@register("live_feed_base", "W-13", with_transactions(f"""
SELECT transaction_id, merchant_id, merchant_category, state, amount_aud, payment_terminal, card_type,
       "timestamp", {R('merchant_avg', 6)} AS merchant_avg, {R('merchant_std', 6)} AS merchant_std, is_fraud
FROM transactions JOIN ms USING (merchant_id)
ORDER BY "timestamp" DESC, transaction_id DESC LIMIT 10""", FEED_STATS))
def q_live_feed_base(spark, sf_dir):
    b = S.live_feed_base(transactions(spark, sf_dir), 10)
    return b.withColumn("merchant_avg", round_half("merchant_avg", 6)) \
            .withColumn("merchant_std", round_half("merchant_std", 6))


LIVE_FEED_SQL = with_transactions(f"""
SELECT transaction_id, merchant_id, merchant_category, state, {R('amount_aud', 2)} AS amount_aud,
       payment_terminal, "timestamp", {R('anomaly_score', 4)} AS anomaly_score,
       (anomaly_score > 0.85 OR COALESCE(is_fraud, FALSE)) AS is_anomaly,
       {sql_risk_level('anomaly_score')} AS risk_level, CAST(0.85 AS DOUBLE) AS threshold_used
FROM scored ORDER BY "timestamp" DESC, transaction_id DESC LIMIT 10""", FEED_STATS, FEED_ALL)


@register("live_feed", "R-3", LIVE_FEED_SQL)
def q_live_feed(spark, sf_dir):
    return S.live_feed(transactions(spark, sf_dir), 10)


@register("risk_level", "R-1", with_transactions(f"""
SELECT {sql_risk_level('anomaly_score')} AS risk_level, COUNT(*) AS n FROM scored GROUP BY 1""",
    FEED_STATS, FEED_ALL))
def q_risk_level(spark, sf_dir):
    return S.feed_scores(transactions(spark, sf_dir)).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@register("recommended_action", "R-2", with_transactions(f"""
SELECT {sql_recommended_action('anomaly_score')} AS recommended_action, COUNT(*) AS n FROM scored GROUP BY 1""",
    FEED_STATS, FEED_ALL))
def q_recommended_action(spark, sf_dir):
    return (S.feed_scores(transactions(spark, sf_dir))
            .groupBy("recommended_action").agg(F.count(F.lit(1)).alias("n")))


BASELINE = (f"b AS (SELECT merchant_id, {AVG('amount_aud')} AS avg_amount, STDDEV_SAMP(amount_aud) AS std_amount, "
            f"COUNT(*) AS txn_count FROM transactions GROUP BY merchant_id)")
BASE_Z = "((amount_aud - avg_amount) / greatest(COALESCE(std_amount, 0.0), 0.01))"


@register("score_heuristic", "R-4", with_transactions(f"""
SELECT transaction_id, merchant_id, {R(BASE_Z, 6)} AS amount_zscore,
       {R(f'least(greatest(abs({BASE_Z}) / 10.0, 0.0), 1.0)', 4)} AS anomaly_score,
       least(greatest(abs({BASE_Z}) / 10.0, 0.0), 1.0) > 0.85 AS is_anomaly,
       {sql_risk_level(f'least(greatest(abs({BASE_Z}) / 10.0, 0.0), 1.0)')} AS risk_level
FROM transactions JOIN b USING (merchant_id)""", BASELINE))
def q_score_heuristic(spark, sf_dir):
    s = S.baseline_scores(transactions(spark, sf_dir))
    return s.select("transaction_id", "merchant_id", round_half("amount_zscore", 6).alias("amount_zscore"),
                    round_half("anomaly_score", 4).alias("anomaly_score"), "is_anomaly", "risk_level")


@register("anomaly_review", "R-5", with_transactions(f"""
SELECT merchant_id, COUNT(*) AS total_reviewed,
       COUNT(CASE WHEN s > 0.7 THEN 1 END) AS total_flagged,
       {R('MAX(CASE WHEN s > 0.7 THEN s END)', 3)} AS top_score
FROM (SELECT merchant_id, least(greatest({BASE_Z} / 10.0, 0.0), 1.0) AS s
      FROM transactions JOIN b USING (merchant_id)
      WHERE "timestamp" >= CAST({AS_OF} - 7 AS TIMESTAMP)) r
GROUP BY merchant_id""", BASELINE))
def q_anomaly_review(spark, sf_dir):
    return S.anomaly_review(transactions(spark, sf_dir), 7, C.AS_OF)


@register("stream_score", "R-6", with_transactions("""
SELECT transaction_id, merchant_id, least(greatest(amount_aud / 5000.0, 0.0), 1.0) AS anomaly_score,
       least(greatest(amount_aud / 5000.0, 0.0), 1.0) > 0.85 AS is_alert
FROM transactions"""))
def q_stream_score(spark, sf_dir):
    return S.stream_scores(transactions(spark, sf_dir))


@register("fraud_prior", "R-8", with_transactions(f"""
SELECT transaction_id, merchant_id, is_fraud,
       {R(sql_fraud_prior('amount_aud', 'merchant_category', 'payment_terminal', 'card_type', 'is_outside_business_hours'), 6)}
         AS fraud_prior
FROM transactions"""))
def q_fraud_prior(spark, sf_dir):
    p = S.fraud_priors(transactions(spark, sf_dir))
    return p.withColumn("fraud_prior", round_half("fraud_prior", 6))


_EXPLAIN_FEATURES = ["amount_zscore", "txn_velocity_1h", "is_outside_business_hours"]
_unpivot = " UNION ALL ".join(
    f"SELECT merchant_id, {i} AS pos, '{f}' AS feature, {f} AS value FROM rt" for i, f in enumerate(_EXPLAIN_FEATURES))
_EXPLAIN_SQL = REALTIME_SQL.replace("\nSELECT g.merchant_id,", ",\n    rt AS (SELECT g.merchant_id,", 1)
_EXPLAIN_SQL = _EXPLAIN_SQL + f""")
SELECT merchant_id,
  MAX(CASE WHEN rk = 1 THEN feature END) AS feature_1, MAX(CASE WHEN rk = 1 THEN value END) AS value_1,
  MAX(CASE WHEN rk = 2 THEN feature END) AS feature_2, MAX(CASE WHEN rk = 2 THEN value END) AS value_2,
  MAX(CASE WHEN rk = 3 THEN feature END) AS feature_3, MAX(CASE WHEN rk = 3 THEN value END) AS value_3
FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY abs(value) DESC, pos) AS rk
      FROM ({_unpivot}) u) r
GROUP BY merchant_id"""


@register("explain_topk", "R-7", _EXPLAIN_SQL)
def q_explain_topk(spark, sf_dir):
    f = FT.realtime_features(transactions(spark, sf_dir))
    f = f.select("merchant_id", *[round_half(c, 6).alias(c) for c in _EXPLAIN_FEATURES])
    e = S.explain(f).select("merchant_id", "explanation")
    return e.select("merchant_id", *[x for i in range(3) for x in (
        F.col("explanation")[i]["feature"].alias(f"feature_{i + 1}"),
        F.col("explanation")[i]["value"].alias(f"value_{i + 1}"))])


_SCORE = "least(greatest(abs(amount_zscore) / 10.0, 0.0), 1.0)"
_SCORE_SQL = _EXPLAIN_SQL.replace("\nSELECT merchant_id,\n  MAX(CASE WHEN rk = 1", ", ex AS (\nSELECT merchant_id,\n  MAX(CASE WHEN rk = 1", 1) + f""")
SELECT rt.merchant_id, {R(_SCORE, 4)} AS anomaly_score, {_SCORE} > 0.85 AS is_anomaly,
       {sql_risk_level(_SCORE)} AS risk_level, {sql_recommended_action(_SCORE)} AS recommended_action,
       CAST(0.85 AS DOUBLE) AS threshold_used, 'heuristic' AS scoring_mode,
       ex.feature_1, ex.value_1, ex.feature_2, ex.value_2, ex.feature_3, ex.value_3
FROM rt JOIN ex ON ex.merchant_id = rt.merchant_id"""


@register("score_transactions", "R-9", _SCORE_SQL)
def q_score_transactions(spark, sf_dir):
    """Heuristic mode over the realtime features (model mode when a trained model is passed)."""
    f = FT.realtime_features(transactions(spark, sf_dir))
    f = f.select("merchant_id", *[round_half(c, 6).alias(c) for c in _EXPLAIN_FEATURES])
    s = S.score_transactions(f)
    return s.select("merchant_id", round_half("anomaly_score", 4).alias("anomaly_score"), "is_anomaly",
                    "risk_level", "recommended_action", "threshold_used", "scoring_mode",
                    *[x for i in range(3) for x in (
                        F.col("explanation")[i]["feature"].alias(f"feature_{i + 1}"),
                        F.col("explanation")[i]["value"].alias(f"value_{i + 1}"))])
