"""Quality, drift, governance and evaluation queries with DuckDB oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import round_half
from paylens.functions.numeric import sql_round as R
from paylens.functions.risk import sql_fraud_prior
from paylens.operators import dashboards as D
from paylens.operators import drift as DR
from paylens.operators import evaluation as EV
from paylens.operators import governance as G
from paylens.operators import quality as Q
from paylens.operators import scoring as S
from paylens.plans.features_q import ROUNDED_FEATURES_CTE, TRAINING_FEATURES_CTES, rounded_training_features
from paylens.plans.registry import register
from paylens.plans.scoring_q import FEED_ALL, FEED_STATS
from paylens.sources.tables import TRANSACTION_COLUMNS, transactions, with_transactions

CURRENT_FROM = datetime(2024, 1, 16)
CUR_SQL = f"\"timestamp\" >= TIMESTAMP '{CURRENT_FROM.isoformat(sep=' ')}'"


def _is_current():
    from paylens.functions.timecols import ntz_literal
    return F.col("timestamp") >= ntz_literal(CURRENT_FROM)


_cats = ", ".join(f"'{c}'" for c in C.CATEGORIES)
_states = ", ".join(f"'{s}'" for s in C.STATES)


@register("expectations", "Q-1", with_transactions(f"""
SELECT 'column_exists' AS rule, c AS column, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS nulls,
       TRUE AS passed
FROM (VALUES ('transaction_id'), ('merchant_id'), ('amount_aud')) v(c)
UNION ALL
SELECT 'values_between', 'amount_aud',
       COUNT(CASE WHEN amount_aud IS NOT NULL AND (amount_aud < {C.AMOUNT_MIN} OR amount_aud > {C.AMOUNT_MAX}) THEN 1 END),
       COUNT(CASE WHEN amount_aud IS NULL THEN 1 END),
       COUNT(CASE WHEN amount_aud IS NOT NULL AND (amount_aud < {C.AMOUNT_MIN} OR amount_aud > {C.AMOUNT_MAX}) THEN 1 END) = 0
FROM transactions
UNION ALL
SELECT 'values_in_set', 'merchant_category',
       COUNT(CASE WHEN merchant_category IS NOT NULL AND merchant_category NOT IN ({_cats}) THEN 1 END),
       COUNT(CASE WHEN merchant_category IS NULL THEN 1 END),
       COUNT(CASE WHEN merchant_category IS NOT NULL AND merchant_category NOT IN ({_cats}) THEN 1 END) = 0
FROM transactions
UNION ALL
SELECT 'values_in_set', 'state',
       COUNT(CASE WHEN state IS NOT NULL AND state NOT IN ({_states}) THEN 1 END),
       COUNT(CASE WHEN state IS NULL THEN 1 END),
       COUNT(CASE WHEN state IS NOT NULL AND state NOT IN ({_states}) THEN 1 END) = 0
FROM transactions
UNION ALL
SELECT 'values_unique', 'transaction_id', CAST(COALESCE(SUM(n), 0) AS BIGINT),
       (SELECT COUNT(*) FROM transactions WHERE transaction_id IS NULL), COALESCE(SUM(n), 0) = 0
FROM (SELECT transaction_id, COUNT(*) AS n FROM transactions WHERE transaction_id IS NOT NULL
      GROUP BY transaction_id HAVING COUNT(*) > 1) d"""))
def q_expectations(spark, sf_dir):
    return Q.expectations(transactions(spark, sf_dir))


@register("contract_check", "Q-2", with_transactions(f"""
SELECT 'required_columns' AS rule, '' AS column, CAST(0 AS BIGINT) AS violations, TRUE AS passed
UNION ALL SELECT 'no_null_ids', 'transaction_id', COUNT(CASE WHEN transaction_id IS NULL THEN 1 END),
       COUNT(CASE WHEN transaction_id IS NULL THEN 1 END) = 0 FROM transactions
UNION ALL SELECT 'positive_amounts', 'amount_aud', COUNT(CASE WHEN NOT (COALESCE(amount_aud, 0.0) > 0) THEN 1 END),
       COUNT(CASE WHEN NOT (COALESCE(amount_aud, 0.0) > 0) THEN 1 END) = 0 FROM transactions
UNION ALL SELECT 'allowed_categories', 'merchant_category',
       COUNT(CASE WHEN NOT COALESCE(merchant_category IN ({_cats}), FALSE) THEN 1 END),
       COUNT(CASE WHEN NOT COALESCE(merchant_category IN ({_cats}), FALSE) THEN 1 END) = 0 FROM transactions
UNION ALL SELECT 'currency_aud', 'currency', COUNT(CASE WHEN NOT COALESCE(currency = 'AUD', FALSE) THEN 1 END),
       COUNT(CASE WHEN NOT COALESCE(currency = 'AUD', FALSE) THEN 1 END) = 0 FROM transactions"""))
def q_contract_check(spark, sf_dir):
    return Q.contract_check(transactions(spark, sf_dir))


def _prior_values():
    rows = ([("state", s, w) for s, w in zip(C.STATES, C.STATE_WEIGHTS)]
            + [("payment_terminal", t, r) for t, r in zip(C.TERMINALS, C.TERMINAL_RATIOS)]
            + [("card_type", c, r) for c, r in zip(C.CARD_TYPES, C.CARD_RATIOS)])
    return ", ".join(f"('{d}', '{v}', CAST({p!r} AS DOUBLE))" for d, v, p in rows)


_TOTAL = "CAST((SELECT COUNT(*) FROM transactions) AS DOUBLE)"


@register("calibration_check", "Q-3", with_transactions(f"""
SELECT dimension, value,
       {R(f'CAST(COALESCE(n, 0) AS DOUBLE) / {_TOTAL}', 6)} AS observed_share,
       prior_share,
       {R(f'abs(CAST(COALESCE(n, 0) AS DOUBLE) / {_TOTAL} - COALESCE(prior_share, 0.0))', 6)} AS abs_gap,
       CAST(NULL AS BOOLEAN) AS within_bounds
FROM obs FULL OUTER JOIN (VALUES {_prior_values()}) p(dimension, value, prior_share) USING (dimension, value)
UNION ALL
SELECT 'bound', 'fraud_rate', {R('fr', 6)}, NULL, NULL, (fr > 0.0005 AND fr < 0.005) FROM b
UNION ALL
SELECT 'bound', 'tap_share', {R('tap', 6)}, NULL, NULL, (tap > 0.85 AND tap < 0.98) FROM b""",
    """obs AS (SELECT 'state' AS dimension, state AS value, COUNT(*) AS n FROM transactions GROUP BY state
      UNION ALL SELECT 'payment_terminal', payment_terminal, COUNT(*) FROM transactions GROUP BY payment_terminal
      UNION ALL SELECT 'card_type', card_type, COUNT(*) FROM transactions GROUP BY card_type)""",
    """b AS (SELECT CAST(COUNT(CASE WHEN is_fraud THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS fr,
            CAST(COUNT(CASE WHEN payment_terminal = 'tap_and_go' THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS tap
     FROM transactions)"""))
def q_calibration_check(spark, sf_dir):
    return Q.calibration_check(transactions(spark, sf_dir))


_nulls = " UNION ALL ".join(
    f"SELECT 'null_rate', '{c}', CAST(COUNT(CASE WHEN {('\"timestamp\"' if c == 'timestamp' else c)} IS NULL THEN 1 END) AS DOUBLE)"
    f" / CAST(COUNT(*) AS DOUBLE) FROM transactions" for c in TRANSACTION_COLUMNS)
_END = f"TIMESTAMP '{C.AS_OF.isoformat()} 00:00:00' + INTERVAL 1 DAY"
_PRIOR = sql_fraud_prior("amount_aud", "merchant_category", "payment_terminal", "card_type", "is_outside_business_hours")


@register("table_health", "Q-4", with_transactions(f"""
SELECT 'freshness_seconds' AS metric, '' AS key,
       CAST(epoch_us({_END}) / 1000000 - epoch_us(MAX("timestamp")) / 1000000.0 AS DOUBLE) AS value FROM transactions
UNION ALL
SELECT 'freshness_alarm', '', CASE WHEN epoch_us({_END}) / 1000000 - epoch_us(MAX("timestamp")) / 1000000.0
       > {C.FRESHNESS_ALARM_SECONDS} THEN 1.0 ELSE 0.0 END FROM transactions
UNION ALL {_nulls}
UNION ALL
SELECT 'daily_rows', strftime("timestamp", '%Y-%m-%d'), CAST(COUNT(*) AS DOUBLE) FROM transactions GROUP BY 2
UNION ALL
SELECT 'score_histogram', CAST(CAST(least(floor(p * 10), 9) AS INTEGER) AS VARCHAR), CAST(COUNT(*) AS DOUBLE)
FROM (SELECT {_PRIOR} AS p FROM transactions) s GROUP BY 2
UNION ALL
SELECT 'prediction_count', '', CAST(COUNT(*) AS DOUBLE) FROM transactions
UNION ALL
SELECT 'check_pass_rate', '', AVG(CASE WHEN passed THEN 1.0 ELSE 0.0 END) FROM (
  SELECT TRUE AS passed FROM (VALUES (1), (2), (3)) v(c)
  UNION ALL SELECT COUNT(CASE WHEN amount_aud < {C.AMOUNT_MIN} OR amount_aud > {C.AMOUNT_MAX} THEN 1 END) = 0 FROM transactions
  UNION ALL SELECT COUNT(CASE WHEN merchant_category NOT IN ({_cats}) THEN 1 END) = 0 FROM transactions
  UNION ALL SELECT COUNT(CASE WHEN state NOT IN ({_states}) THEN 1 END) = 0 FROM transactions
  UNION ALL SELECT COUNT(transaction_id) = COUNT(DISTINCT transaction_id) FROM transactions) q"""))
def q_table_health(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    scores = S.fraud_priors(tx).withColumnRenamed("fraud_prior", "anomaly_score")
    return Q.table_health(tx, scores, C.AS_OF)


_drift_means = ", ".join(f"AVG(COALESCE(CAST({c} AS DOUBLE), 0.0)) AS {c}" for c in C.DRIFT_COLUMNS)
_drift_unpivot = " UNION ALL ".join(
    f"SELECT r.period_dummy, '{c}' AS feature, r.{c} AS ref_mean, c.{c} AS cur_mean FROM pm r, pm c "
    f"WHERE r.period = 'reference' AND c.period = 'current'" for c in C.DRIFT_COLUMNS)
DRIFT_CTES = TRAINING_FEATURES_CTES + [
    ROUNDED_FEATURES_CTE,
    f"pm AS (SELECT CASE WHEN {CUR_SQL} THEN 'current' ELSE 'reference' END AS period, 0 AS period_dummy, "
    f"{_drift_means} FROM tf GROUP BY 1)",
    f"sh AS (SELECT feature, ref_mean, cur_mean, least(abs(cur_mean - ref_mean) / greatest(abs(ref_mean), 1.0), 1.0) "
    f"AS shift FROM ({_drift_unpivot}) u)",
]


@register("drift_columns", "J-8", with_transactions(f"""
SELECT feature, {R('ref_mean', 6)} AS ref_mean, {R('cur_mean', 6)} AS cur_mean, {R('shift', 6)} AS shift FROM sh""",
    *DRIFT_CTES))
def q_drift_columns(spark, sf_dir):
    f = rounded_training_features(spark, sf_dir)
    d = DR.mean_shift_columns(f, _is_current())
    return d.select("feature", *[round_half(c, 6).alias(c) for c in ("ref_mean", "cur_mean", "shift")])


@register("mean_shift_drift", "D-1", with_transactions(f"""
SELECT {R('COALESCE(AVG(shift), 0.0)', 6)} AS drift_score, COALESCE(AVG(shift), 0.0) > {C.DRIFT_THRESHOLD} AS drift_detected,
       CASE WHEN COALESCE(AVG(shift), 0.0) > {C.DRIFT_THRESHOLD} THEN 'retraining_triggered' ELSE 'none' END AS action_taken,
       COUNT(*) AS columns_compared FROM sh""", *DRIFT_CTES))
def q_mean_shift_drift(spark, sf_dir):
    f = rounded_training_features(spark, sf_dir)
    return DR.mean_shift_drift(f, _is_current()).withColumn("drift_score", round_half("drift_score", 6))


_CATEG = ["merchant_category", "payment_terminal", "state"]


def _psi_sql() -> list[str]:
    parts = []
    for c in C.DRIFT_COLUMNS:
        lo = f"(SELECT MIN(CAST({c} AS DOUBLE)) FROM tf WHERE NOT ({CUR_SQL}))"
        hi = f"(SELECT MAX(CAST({c} AS DOUBLE)) FROM tf WHERE NOT ({CUR_SQL}))"
        w = f"(({hi} - {lo}) / 10.0)"
        b = (f"CASE WHEN {w} > 0 THEN CAST(least(greatest(floor((CAST({c} AS DOUBLE) - {lo}) / {w}), 0), 9) AS BIGINT) "
             f"ELSE 0 END")
        parts.append(f"SELECT '{c}' AS feature, COALESCE(CAST({b} AS VARCHAR), 'null') AS bin, "
                     f"CASE WHEN {CUR_SQL} THEN 'current' ELSE 'reference' END AS period FROM tf")
    for c in _CATEG:
        parts.append(f"SELECT '{c}', COALESCE(CAST({c} AS VARCHAR), 'null'), "
                     f"CASE WHEN {CUR_SQL} THEN 'current' ELSE 'reference' END FROM tf")
    return [
        "bins AS (" + " UNION ALL ".join(parts) + ")",
        """cnt AS (SELECT feature, bin, COUNT(CASE WHEN period = 'reference' THEN 1 END) AS r,
                  COUNT(CASE WHEN period = 'current' THEN 1 END) AS c FROM bins GROUP BY feature, bin)""",
        """shr AS (SELECT feature,
                  greatest(CAST(r AS DOUBLE) / CAST(SUM(r) OVER (PARTITION BY feature) AS DOUBLE), 0.0001) AS rs,
                  greatest(CAST(c AS DOUBLE) / CAST(SUM(c) OVER (PARTITION BY feature) AS DOUBLE), 0.0001) AS cs
                  FROM cnt)""",
        "psi AS (SELECT feature, SUM((cs - rs) * ln(cs / rs)) AS psi FROM shr GROUP BY feature)",
    ]


@register("psi_columns", "D-2", with_transactions(f"""
SELECT feature, {R('psi', 6)} AS psi, psi > 0.2 AS drifted FROM psi""",
    *(TRAINING_FEATURES_CTES + [ROUNDED_FEATURES_CTE] + _psi_sql())))
def q_psi_columns(spark, sf_dir):
    f = rounded_training_features(spark, sf_dir)
    p = DR.psi_columns(f, _is_current(), C.DRIFT_COLUMNS, _CATEG)
    return p.select("feature", round_half("psi", 6).alias("psi"), "drifted")


@register("distribution_drift", "D-2", with_transactions("""
SELECT CAST(COUNT(CASE WHEN psi > 0.2 THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS share_of_drifted_columns,
       COUNT(CASE WHEN psi > 0.2 THEN 1 END) AS number_of_drifted_columns,
       CAST(COUNT(CASE WHEN psi > 0.2 THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) >= 0.5 AS dataset_drift
FROM psi""", *(TRAINING_FEATURES_CTES + [ROUNDED_FEATURES_CTE] + _psi_sql())))
def q_distribution_drift(spark, sf_dir):
    f = rounded_training_features(spark, sf_dir)
    return DR.distribution_drift(f, _is_current(), C.DRIFT_COLUMNS, _CATEG)


# a current period that has moved: features doubled and raised, half of the categories renamed
_MOVED = ", ".join([f"CASE WHEN {CUR_SQL} THEN CAST({c} AS DOUBLE) * 2 + 3 ELSE CAST({c} AS DOUBLE) END AS {c}" for c in C.DRIFT_COLUMNS]
                   + [f"CASE WHEN {CUR_SQL} AND hour_of_day >= 12 THEN 'new' ELSE {c} END AS {c}" for c in _CATEG])
_MOVED_CTE = f"tfm AS (SELECT * REPLACE ({_MOVED}) FROM tf)"


def _moved(f):
    """The feature table with its current period moved, as ``_MOVED`` says."""
    cur, late = _is_current(), F.col("hour_of_day") >= 12
    return f.withColumns({c: F.when(cur, F.col(c).cast("double") * 2 + 3).otherwise(F.col(c).cast("double")) for c in C.DRIFT_COLUMNS}
                         | {c: F.when(cur & late, F.lit("new")).otherwise(F.col(c)) for c in _CATEG})


def _of_moved(ctes: list[str]) -> list[str]:
    return TRAINING_FEATURES_CTES + [ROUNDED_FEATURES_CTE, _MOVED_CTE] + [c.replace("FROM tf", "FROM tfm") for c in ctes]


@register("mean_shift_drift_moved", "D-1", with_transactions(f"""
SELECT {R('AVG(shift)', 6)} AS drift_score, AVG(shift) > {C.DRIFT_THRESHOLD} AS drift_detected,
       CASE WHEN AVG(shift) > {C.DRIFT_THRESHOLD} THEN 'retraining_triggered' ELSE 'none' END AS action_taken,
       COUNT(*) AS columns_compared FROM sh""", *_of_moved(DRIFT_CTES[len(TRAINING_FEATURES_CTES) + 1:])))
def q_mean_shift_drift_moved(spark, sf_dir):
    """Means that have moved: drift is detected and retraining triggered."""
    return DR.mean_shift_drift(_moved(rounded_training_features(spark, sf_dir)), _is_current()) \
        .withColumn("drift_score", round_half("drift_score", 6))


@register("distribution_drift_moved", "D-2", with_transactions("""
SELECT CAST(COUNT(CASE WHEN psi > 0.2 THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS share_of_drifted_columns,
       COUNT(CASE WHEN psi > 0.2 THEN 1 END) AS number_of_drifted_columns,
       CAST(COUNT(CASE WHEN psi > 0.2 THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) >= 0.5 AS dataset_drift
FROM psi""", *_of_moved(_psi_sql())))
def q_distribution_drift_moved(spark, sf_dir):
    return DR.distribution_drift(_moved(rounded_training_features(spark, sf_dir)), _is_current(), C.DRIFT_COLUMNS, _CATEG)


def _tests_sql(table: str) -> list[str]:
    """Per-column tests in DuckDB: distribution functions by windows, p-values by lgamma."""
    num = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {CUR_SQL} AS cur FROM {table}" for c in C.DRIFT_COLUMNS)
    cat = " UNION ALL ".join(f"SELECT '{c}' AS feature, COALESCE({c}, 'null') AS v, {CUR_SQL} AS cur FROM {table}" for c in _CATEG)
    return [
        f"num AS (SELECT feature, x, COUNT(*) FILTER (WHERE NOT cur) AS r, COUNT(*) FILTER (WHERE cur) AS c FROM ({num}) a WHERE x IS NOT NULL GROUP BY 1, 2)",
        """ks AS (SELECT feature, MAX(abs(fr - fc)) AS statistic, any_value(n) AS n, any_value(m) AS m FROM (
          SELECT feature, SUM(r) OVER w / SUM(r) OVER (PARTITION BY feature) AS fr, SUM(c) OVER w / SUM(c) OVER (PARTITION BY feature) AS fc,
                 SUM(r) OVER (PARTITION BY feature) AS n, SUM(c) OVER (PARTITION BY feature) AS m
          FROM num WINDOW w AS (PARTITION BY feature ORDER BY x)) d GROUP BY feature)""",
        "ksl AS (SELECT *, statistic * sqrt(CAST(n AS DOUBLE) * CAST(m AS DOUBLE) / CAST(n + m AS DOUBLE)) AS lam FROM ks)",
        """ksp AS (SELECT feature, 'ks' AS test, statistic, CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(2 * (
          SELECT SUM((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k)), 0.0), 1.0) END AS p_value FROM ksl)""",
        f"cat AS (SELECT feature, v, COUNT(*) FILTER (WHERE NOT cur) AS r, COUNT(*) FILTER (WHERE cur) AS c FROM ({cat}) a GROUP BY 1, 2)",
        """chi AS (SELECT feature, SUM((r - er) * (r - er) / er + (c - ec) * (c - ec) / ec) AS statistic, COUNT(*) - 1 AS free FROM (
          SELECT *, CAST(r + c AS DOUBLE) * n / (n + m) AS er, CAST(r + c AS DOUBLE) * m / (n + m) AS ec FROM (
            SELECT *, CAST(SUM(r) OVER (PARTITION BY feature) AS DOUBLE) AS n, CAST(SUM(c) OVER (PARTITION BY feature) AS DOUBLE) AS m FROM cat) a) b GROUP BY feature)""",
        """chip AS (SELECT feature, 'chi2' AS test, statistic, CASE WHEN free < 1 OR statistic <= 0 THEN 1.0::DOUBLE WHEN statistic > 1400 THEN 0.0::DOUBLE
          ELSE least(greatest(1 - (SELECT SUM(exp(-statistic / 2 + (free / 2.0 + k) * ln(statistic / 2) - lgamma(free / 2.0 + k + 1))) FROM range(0, 2001) t(k)), 0.0), 1.0) END AS p_value FROM chi)""",
        "tests AS (SELECT * FROM ksp UNION ALL SELECT * FROM chip)"]


@register("two_sample_columns", "D-2", with_transactions(f"""
SELECT feature, test, {R('statistic', 6)} AS statistic, {R('p_value', 6)} AS p_value, p_value < 0.05 AS drifted FROM tests""",
    *(TRAINING_FEATURES_CTES + [ROUNDED_FEATURES_CTE] + _tests_sql("tf"))))
def q_two_sample_columns(spark, sf_dir):
    """Kolmogorov-Smirnov and chi-square tests of every monitored column between the two periods."""
    t = DR.two_sample_columns(rounded_training_features(spark, sf_dir), _is_current(), C.DRIFT_COLUMNS, _CATEG)
    return t.select("feature", "test", round_half("statistic", 6).alias("statistic"), round_half("p_value", 6).alias("p_value"), "drifted")


_SHARE = "CAST(COUNT(*) FILTER (WHERE p_value < 0.05) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)"


@register("two_sample_drift", "D-2", with_transactions(f"""
SELECT {_SHARE} AS share_of_drifted_columns, COUNT(*) FILTER (WHERE p_value < 0.05) AS number_of_drifted_columns, {_SHARE} >= 0.5 AS dataset_drift FROM tests""",
    *(TRAINING_FEATURES_CTES + [ROUNDED_FEATURES_CTE] + _tests_sql("tf"))))
def q_two_sample_drift(spark, sf_dir):
    return DR.two_sample_drift(DR.two_sample_columns(rounded_training_features(spark, sf_dir), _is_current(), C.DRIFT_COLUMNS, _CATEG))


@register("two_sample_drift_moved", "D-2", with_transactions(f"""
SELECT {_SHARE} AS share_of_drifted_columns, COUNT(*) FILTER (WHERE p_value < 0.05) AS number_of_drifted_columns, {_SHARE} >= 0.5 AS dataset_drift FROM tests""",
    *(TRAINING_FEATURES_CTES + [ROUNDED_FEATURES_CTE, _MOVED_CTE] + _tests_sql("tfm"))))
def q_two_sample_drift_moved(spark, sf_dir):
    return DR.two_sample_drift(DR.two_sample_columns(_moved(rounded_training_features(spark, sf_dir)), _is_current(), C.DRIFT_COLUMNS, _CATEG))


@register("feature_anomaly_summary", "A-8", with_transactions(f"""
SELECT COUNT(*) AS total_reviewed, CAST(SUM(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS total_fraud,
       {R('AVG(amount_zscore)', 4)} AS avg_zscore, {R('MAX(amount_zscore)', 4)} AS max_zscore,
       {R('AVG(CASE WHEN is_fraud THEN amount_zscore END)', 4)} AS avg_fraud_zscore
FROM tf""", *(TRAINING_FEATURES_CTES + [ROUNDED_FEATURES_CTE])))
def q_feature_anomaly_summary(spark, sf_dir):
    return D.feature_anomaly_summary(rounded_training_features(spark, sf_dir))


_BIAS_PER = """per AS (SELECT merchant_category,
      COUNT(CASE WHEN anomaly_score >= 0.85 AND is_fraud THEN 1 END) AS tp,
      COUNT(CASE WHEN anomaly_score >= 0.85 AND NOT is_fraud THEN 1 END) AS fp
    FROM scored WHERE merchant_category IS NOT NULL GROUP BY merchant_category)"""


@register("category_precision", "J-9", with_transactions(f"""
SELECT merchant_category, tp, fp, {R('CAST(tp AS DOUBLE) / CAST(greatest(tp + fp, 1) AS DOUBLE)', 6)} AS precision
FROM per""", FEED_STATS, FEED_ALL, _BIAS_PER))
def q_category_precision(spark, sf_dir):
    s = S.feed_scores(transactions(spark, sf_dir))
    return G.category_precision(s, "anomaly_score", "is_fraud").withColumn("precision", round_half("precision", 6))


@register("category_bias", "B-1", with_transactions(f"""
SELECT CASE WHEN COUNT(*) = 0 THEN 'no_data' ELSE 'ok' END AS status,
       {R('COALESCE(MAX(p) - MIN(p), 0.0)', 6)} AS max_precision_gap
FROM (SELECT CAST(tp AS DOUBLE) / CAST(greatest(tp + fp, 1) AS DOUBLE) AS p FROM per) x""",
    FEED_STATS, FEED_ALL, _BIAS_PER))
def q_category_bias(spark, sf_dir):
    s = S.feed_scores(transactions(spark, sf_dir))
    return G.category_bias(s, "anomaly_score", "is_fraud").withColumn(
        "max_precision_gap", round_half("max_precision_gap", 6))


def _curve_ctes(score_sql: str, source: str) -> list[str]:
    return [
        f"sc AS (SELECT CAST({score_sql} AS DOUBLE) AS score, CASE WHEN is_fraud THEN 1 ELSE 0 END AS label FROM {source})",
        "cnt AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM sc GROUP BY score)",
        """cum AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
                  SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
                  SUM(pos) OVER () AS p_tot, SUM(neg) OVER () AS n_tot FROM cnt)""",
        """curve AS (SELECT *,
             CASE WHEN cum_pos + cum_neg > 0 THEN CAST(cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE) ELSE 0.0 END AS prec,
             CASE WHEN p_tot > 0 THEN CAST(cum_pos AS DOUBLE) / CAST(p_tot AS DOUBLE) ELSE 0.0 END AS rec FROM cum)""",
        "curve2 AS (SELECT *, 2 * prec * rec / greatest(prec + rec, 1e-9) AS f1 FROM curve)",
        f"""thr AS (SELECT COALESCE((SELECT least(greatest(score, 0.05), 0.95) FROM curve2
                 ORDER BY f1 DESC, score ASC LIMIT 1), {C.DEFAULT_THRESHOLD}) AS t)""",
        """at_t AS (SELECT CAST(COALESCE(MAX(cum_pos), 0) AS DOUBLE) AS tp, CAST(COALESCE(MAX(cum_neg), 0) AS DOUBLE) AS fp
                 FROM curve2 WHERE score >= (SELECT t FROM thr))""",
    ]


_METRICS_SELECT = f"""
SELECT {R('SUM(CAST(neg AS DOUBLE) * (CAST(cum_pos AS DOUBLE) - CAST(pos AS DOUBLE) / 2.0)) / NULLIF(CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE), 0.0)', 9)} AS roc_auc,
       {R('SUM(CAST(pos AS DOUBLE) * prec) / NULLIF(CAST(SUM(pos) AS DOUBLE), 0.0)', 9)} AS avg_precision,
       {R('(SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END FROM at_t)', 9)} AS precision_at_threshold,
       {R('(SELECT CASE WHEN SUM(pos) > 0 THEN tp / CAST(SUM(pos) AS DOUBLE) ELSE 0.0 END FROM at_t)', 9)} AS recall_at_threshold,
       (SELECT t FROM thr) AS threshold,
       CAST(SUM(pos + neg) AS BIGINT) AS total_samples, CAST(SUM(pos) AS BIGINT) AS fraud_samples
FROM curve2"""


def _metrics_spark(m):
    return m.select(*[round_half(c, 9).alias(c) for c in ("roc_auc", "avg_precision", "precision_at_threshold",
                                                          "recall_at_threshold")],
                    "threshold", "total_samples", "fraud_samples")


@register("score_metrics", "M-4", with_transactions(_METRICS_SELECT, *_curve_ctes(_PRIOR, "transactions")))
def q_score_metrics(spark, sf_dir):
    p = S.fraud_priors(transactions(spark, sf_dir))
    return _metrics_spark(EV.evaluate(p, "fraud_prior", "is_fraud"))


@register("select_threshold", "M-5", with_transactions("SELECT t AS threshold FROM thr",
                                                       *_curve_ctes(_PRIOR, "transactions")))
def q_select_threshold(spark, sf_dir):
    p = S.fraud_priors(transactions(spark, sf_dir))
    curve = EV.pr_curve(p, "fraud_prior", "is_fraud")
    return spark.range(1).select(EV.select_threshold(curve).alias("threshold"))


@register("chronological_split", "M-1", with_transactions("""
SELECT transaction_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT transaction_id, row_number() OVER (ORDER BY "timestamp", transaction_id) AS rn,
             COUNT(*) OVER () AS n FROM transactions) r"""))
def q_chronological_split(spark, sf_dir):
    return EV.chronological_split(transactions(spark, sf_dir)).select("transaction_id", "split")


@register("governance_gate", "B-2", with_transactions(f"""
SELECT 'bias_detection' AS name,
       CASE WHEN g > {C.BIAS_FAIL_GAP} THEN 'FAILED' WHEN g > {C.BIAS_WARN_GAP} THEN 'WARNING' ELSE 'PASSED' END AS status,
       {R('g', 6)} AS value FROM bg
UNION ALL
SELECT 'performance_baseline', CASE WHEN COALESCE(roc_auc, 0.0) < {C.MODEL_HEALTH_AUC} THEN 'FAILED' ELSE 'PASSED' END,
       {R('COALESCE(roc_auc, 0.0)', 6)} FROM met
UNION ALL SELECT 'pii_handling', 'PASSED', {float(len(C.DEFAULT_PII_FIELDS))}
UNION ALL
SELECT 'overall', CASE WHEN f = 0 THEN 'PASSED' ELSE 'FAILED' END, CAST(f AS DOUBLE) FROM (
  SELECT (CASE WHEN (SELECT g FROM bg) > {C.BIAS_FAIL_GAP} THEN 1 ELSE 0 END)
       + (CASE WHEN (SELECT COALESCE(roc_auc, 0.0) FROM met) < {C.MODEL_HEALTH_AUC} THEN 1 ELSE 0 END) AS f) o""",
    FEED_STATS, FEED_ALL, _BIAS_PER,
    "bg AS (SELECT COALESCE(MAX(p) - MIN(p), 0.0) AS g FROM (SELECT CAST(tp AS DOUBLE) / CAST(greatest(tp + fp, 1) AS DOUBLE) AS p FROM per) x)",
    *[c.replace("FROM transactions)", "FROM scored)", 1) if i == 0 else c
      for i, c in enumerate(_curve_ctes("anomaly_score", "scored"))],
    f"met AS ({_METRICS_SELECT.replace(chr(10), ' ')})"))
def q_governance_gate(spark, sf_dir):
    s = S.feed_scores(transactions(spark, sf_dir))
    bias = G.category_bias(s, "anomaly_score", "is_fraud")
    metrics = EV.evaluate(s, "anomaly_score", "is_fraud")
    g = G.governance_gate(bias, metrics, C.DEFAULT_PII_FIELDS, C.DEFAULT_PII_HANDLING)
    return g.withColumn("value", round_half("value", 6))


#: transactions of at least so much, from all to few: the gaps between categories' fraud shares grow from passed to failed
_GATE_AMOUNTS = [0, 50, 100, 120, 130, 140, 145, 150]


@register("governance_outcomes", "B-2", with_transactions(" UNION ALL ".join(
    f"""SELECT {t} AS least_amount, CASE WHEN g > {C.BIAS_FAIL_GAP} THEN 'FAILED' WHEN g > {C.BIAS_WARN_GAP} THEN 'WARNING' ELSE 'PASSED' END AS status,
       {R('g', 6)} AS value FROM (SELECT COALESCE(MAX(p) - MIN(p), 0.0) AS g FROM (
  SELECT AVG(CASE WHEN is_fraud THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM transactions WHERE merchant_category IS NOT NULL AND amount_aud >= {t}
  GROUP BY merchant_category) a) b""" for t in _GATE_AMOUNTS)))
def q_governance_outcomes(spark, sf_dir):
    """The bias check where everything is flagged (precision is the fraud share), from many rows to few."""
    from functools import reduce
    tx = transactions(spark, sf_dir)
    metrics = spark.range(1).select(F.lit(0.9).alias("roc_auc"))
    out = []
    for t in _GATE_AMOUNTS:
        rows = tx.filter(F.col("amount_aud") >= t).withColumn("score", F.lit(1.0))
        gate = G.governance_gate(G.category_bias(rows, "score", "is_fraud"), metrics, C.DEFAULT_PII_FIELDS, "mask")
        out.append(gate.filter("name = 'bias_detection'").select(F.lit(t).alias("least_amount"), "status", round_half("value", 6).alias("value")))
    return reduce(lambda a, b: a.union(b), out)
