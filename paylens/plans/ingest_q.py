"""Ingestion, cleaning, codec and join queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import round_half
from paylens.functions.numeric import sql_money_avg as _AVG
from paylens.functions.numeric import sql_round as R
from paylens.operators import cleaning as CL
from paylens.operators import dashboards as D
from paylens.operators import drift as DR
from paylens.operators import features as FT
from paylens.operators import joins as J
from paylens.operators import quality as Q
from paylens.plans.features_q import REALTIME_SQL, ROUNDED_FEATURES_CTE, TRAINING_FEATURES_CTES, rounded_training_features
from paylens.plans.quality_q import _CATEG, _is_current, _psi_sql
from paylens.plans import dashboards as _dashboards  # noqa: F401  (its oracles are reused)
from paylens.plans.registry import ORACLES, register
from paylens.sources import payloads as PL
from paylens.sources import records as RC
from paylens.sources import seeds as SD
from paylens.sources.tables import TRANSACTION_COLUMNS, read_table, transactions, with_transactions

def _own(name: str) -> str:
    """The body of another query's oracle, without its table expressions."""
    body = ORACLES[name]
    return body[body.rindex("\nSELECT"):].strip()


TXC = ", ".join('"timestamp"' if c == "timestamp" else c for c in TRANSACTION_COLUMNS)


@register("curated_clean", "P-1", with_transactions(f"""
SELECT {TXC}, 'PASSED' AS data_quality_flag FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY "timestamp" DESC) AS rn
  FROM transactions WHERE transaction_id IS NOT NULL AND merchant_id IS NOT NULL AND amount_aud > 0) t
WHERE rn = 1"""))
def q_curated_clean(spark, sf_dir):
    return CL.clean_raw(transactions(spark, sf_dir), stamp=False)


_LI_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]


@register("dedupe_lineitem", "U-3", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_shipdate DESC, {', '.join(c + ' DESC' for c in _LI_REST)}) AS rn
  FROM lineitem) t WHERE rn = 1""")
def q_dedupe_lineitem(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return CL.dedupe_latest(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@register("stream_roundtrip", "SRC-9", with_transactions("""
SELECT merchant_id AS key, transaction_id, merchant_id, amount_aud, "timestamp", 0 AS n_missing, TRUE AS valid
FROM transactions"""))
def q_stream_roundtrip(spark, sf_dir):
    enc = RC.to_base64(RC.encode_records(transactions(spark, sf_dir)))
    dec = RC.decode_and_validate(enc)
    return dec.select("key", "parsed.transaction_id", "parsed.merchant_id", "parsed.amount_aud",
                      F.col("parsed.timestamp").try_cast("timestamp_ntz").alias("timestamp"),
                      F.size("missing_keys").alias("n_missing"), "valid")


def _daily_ratio_text(tx):
    """A landed ratio CSV derived from the data: percent text, plain ratio, per-10k rate."""
    n = F.count(F.lit(1)).cast("double")
    tap = F.count(F.when(F.col("payment_terminal") == "tap_and_go", 1)).cast("double") / n
    deb = F.count(F.when(F.col("card_type") == "debit", 1)).cast("double") / n
    fr = F.count(F.when(F.col("is_fraud"), 1)).cast("double") / n
    return (tx.groupBy(F.to_date("timestamp").alias("d")).agg(
        F.concat(round_half(tap * 100.0, 2).cast("string"), F.lit("%")).alias("Contactless share"),
        round_half(deb, 4).cast("string").alias("Debit ratio"),
        round_half(fr * 10000.0, 2).cast("string").alias("Fraud per 10k"))
        .select(F.date_format("d", "yyyy-MM-dd").alias("Reporting date"), "Contactless share", "Debit ratio",
                "Fraud per 10k"))


_DAILY = f"""daily AS (SELECT CAST("timestamp" AS DATE) AS d,
    {R("CAST(COUNT(CASE WHEN payment_terminal = 'tap_and_go' THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0", 2)} AS c,
    {R("CAST(COUNT(CASE WHEN card_type = 'debit' THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)", 4)} AS db,
    {R("CAST(COUNT(CASE WHEN is_fraud THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 10000.0", 2)} AS f
  FROM transactions GROUP BY 1)"""


@register("card_ratio_table", "SRC-5", with_transactions("""
SELECT month, contactless_ratio, debit_ratio, fraud_rate FROM (
  SELECT strftime(d, '%Y-%m') AS month,
    least(greatest(CASE WHEN (SELECT MAX(c) FROM daily) > 1.0 THEN c / 100.0 ELSE c END, 0.0), 1.0) AS contactless_ratio,
    least(greatest(CASE WHEN (SELECT MAX(db) FROM daily) > 1.0 THEN db / 100.0 ELSE db END, 0.0), 1.0) AS debit_ratio,
    least(greatest(CASE WHEN (SELECT MAX(f) FROM daily) > 100 THEN f / 10000.0
                        WHEN (SELECT MAX(f) FROM daily) > 1 THEN f / 100.0 ELSE f END, 0.0), 1.0) AS fraud_rate,
    row_number() OVER (PARTITION BY strftime(d, '%Y-%m') ORDER BY d) AS rn
  FROM daily) t WHERE rn = 1""", _DAILY))
def q_card_ratio_table(spark, sf_dir):
    landed = _daily_ratio_text(transactions(spark, sf_dir))
    return PL.parse_card_ratio_table(landed, order_col="Reporting date")


def _payloads(tx):
    """Statistical payloads derived from the data: one per month, list form and dict form."""
    daily = D.revenue_trend(tx).select(F.date_format("date", "yyyy-MM-dd").alias("p"),
                                       F.col("daily_revenue").alias("v"), F.date_format("date", "yyyy-MM").alias("m"))
    per_month = daily.groupBy("m").agg(F.collect_list(F.struct("p", "v")).alias("obs"))   # <= 31 per month
    as_list = per_month.select(F.to_json(F.struct(F.struct(F.transform("obs", lambda o: F.struct(
        o["p"].alias("TIME_PERIOD"), o["v"].alias("OBS_VALUE"))).alias("observations")).alias("data")))
        .alias("payload"))
    as_dict = per_month.select(F.to_json(F.struct(F.struct(F.map_from_entries(F.transform("obs", lambda o: F.struct(
        o["p"], o["v"].cast("string")))).alias("observations")).alias("data"))).alias("payload"))
    return as_list, as_dict


@register("statistical_payload", "SRC-4", with_transactions(f"""
SELECT form, strftime(CAST("timestamp" AS DATE), '%Y-%m-%d') AS TIME_PERIOD,
       {R("CAST(SUM(CAST(amount_aud AS DECIMAL(24,6))) AS DOUBLE)", 2)} AS OBS_VALUE,
       'index' AS MEASURE, 'M' AS FREQUENCY
FROM transactions, (VALUES ('list'), ('dict')) f(form)
GROUP BY form, CAST("timestamp" AS DATE)"""))
def q_statistical_payload(spark, sf_dir):
    as_list, as_dict = _payloads(transactions(spark, sf_dir))
    return (PL.parse_statistical_payload(as_list).withColumn("form", F.lit("list"))
            .unionByName(PL.parse_statistical_payload(as_dict).withColumn("form", F.lit("dict"))))


def _provenance(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    as_list, _ = _payloads(tx)
    abs_live = PL.parse_statistical_payload(as_list).drop("form")
    rba_live = PL.parse_card_ratio_table(_daily_ratio_text(tx), order_col="Reporting date")
    outcomes = [
        SD.choose_source("abs_retail_trade", abs_live, SD.retail_trade_fallback(spark)),
        SD.choose_source("rba_card_payments", rba_live, SD.card_payments_fallback(spark)),
        SD.calibrated("merchant_population", SD.merchant_population(spark)),
        SD.calibrated("terminal_mix", SD.terminal_mix(spark)),
        SD.calibrated("card_type_mix", SD.card_type_mix(spark)),
        SD.calibrated("business_hours_profile", SD.business_hours_profile(spark)),
    ]
    prov = SD.provenance(spark, outcomes)
    meta = SD.ingestion_metadata(prov)
    meta_row = SD.provenance(spark, [SD.calibrated("ingestion_metadata", meta)])
    return prov.unionByName(meta_row)


_PROV = f"""prov AS (
  SELECT 'abs_retail_trade' AS source, 'success' AS status,
         CASE WHEN n_days > 0 THEN n_days ELSE {len(C.RETAIL_TRADE_FALLBACK)} END AS records,
         CASE WHEN n_days > 0 THEN 'live' ELSE 'fallback' END AS mode FROM dd
  UNION ALL SELECT 'rba_card_payments', 'success',
         CASE WHEN n_months > 0 THEN n_months ELSE {len(C.CARD_PAYMENTS_FALLBACK)} END,
         CASE WHEN n_months > 0 THEN 'live' ELSE 'fallback' END FROM dd
  UNION ALL SELECT 'merchant_population', 'success', {len(C.STATES)}, 'calibrated'
  UNION ALL SELECT 'terminal_mix', 'success', {len(C.TERMINALS)}, 'calibrated'
  UNION ALL SELECT 'card_type_mix', 'success', {len(C.CARD_TYPES)}, 'calibrated'
  UNION ALL SELECT 'business_hours_profile', 'success', {len(C.BUSINESS_HOURS)}, 'calibrated'
  UNION ALL SELECT 'ingestion_metadata', 'success', 1, 'calibrated')"""
_DD = ("dd AS (SELECT COUNT(DISTINCT CAST(\"timestamp\" AS DATE)) AS n_days, "
       "COUNT(DISTINCT strftime(\"timestamp\", '%Y-%m')) AS n_months FROM transactions)")


@register("source_provenance", "SRC-7", with_transactions(
    "SELECT source, status, CAST(records AS BIGINT) AS records, mode FROM prov", _DD, _PROV))
def q_source_provenance(spark, sf_dir):
    return _provenance(spark, sf_dir).select("source", "status", "records", "mode")


@register("source_outcomes", "SRC-7", with_transactions(f"""
SELECT * FROM (VALUES
  ('live_feed', 'success', (SELECT COUNT(*) FROM transactions), 'live', TRUE, TRUE, FALSE, FALSE),
  ('not_landed', 'success', {len(C.RETAIL_TRADE_FALLBACK)}, 'fallback', FALSE, FALSE, TRUE, TRUE),
  ('parsed_empty', 'success', {len(C.CARD_PAYMENTS_FALLBACK)}, 'fallback', TRUE, FALSE, TRUE, TRUE),
  ('unreadable', 'success', {len(C.RETAIL_TRADE_FALLBACK)}, 'fallback', TRUE, FALSE, TRUE, TRUE),
  ('corrupt_file', 'success', {len(C.CARD_PAYMENTS_FALLBACK)}, 'fallback', TRUE, FALSE, TRUE, TRUE),
  ('no_fallback', 'failed', 0, 'fallback', TRUE, FALSE, TRUE, TRUE),
  ('broken_fallback', 'failed', 0, 'fallback', FALSE, FALSE, TRUE, TRUE),
  ('calibrated', 'success', {len(C.STATES)}, 'calibrated', FALSE, FALSE, FALSE, FALSE))
v(source, status, records, mode, live_attempted, live_success, fallback_used, has_error)"""))
def q_source_outcomes(spark, sf_dir):
    """Sources that are read live, replaced by their fallback for every reason, and failed."""
    from paylens.session import scratch_path
    tx = transactions(spark, sf_dir)
    root = scratch_path(spark, "corrupt")
    tx.limit(1).select(F.lit("no table").alias("value")).write.text(f"{root}/file.parquet")
    corrupt = spark.read.schema("value string").parquet(f"{root}/file.parquet")
    trade, cards = SD.retail_trade_fallback(spark), SD.card_payments_fallback(spark)
    broken = tx.select(F.raise_error(F.concat(F.lit("unreadable row "), "transaction_id")).cast("string").alias("x")).filter("x is null")
    lost = SD.choose_source("no_fallback", tx.filter("false"), trade)
    outcomes = [
        SD.choose_source("live_feed", tx, trade), SD.choose_source("not_landed", None, trade),
        SD.choose_source("parsed_empty", tx.filter("false"), cards), SD.choose_source("unreadable", broken, trade),
        SD.choose_source("corrupt_file", corrupt, cards), (None, lost[1]),
        SD.choose_source("broken_fallback", None, broken), SD.calibrated("calibrated", SD.merchant_population(spark))]
    return SD.provenance(spark, outcomes).select("source", "status", "records", "mode", "live_attempted", "live_success", "fallback_used",
                                                 F.col("error").isNotNull().alias("has_error"))


@register("ingestion_report", "A-21", with_transactions("""
SELECT COUNT(*) AS source_count, COUNT(CASE WHEN status = 'success' THEN 1 END) AS success_count,
       COUNT(CASE WHEN status = 'success' AND mode = 'live' THEN 1 END) AS live_success_count,
       COUNT(CASE WHEN status = 'success' AND mode = 'fallback' THEN 1 END) AS fallback_success_count,
       COUNT(CASE WHEN status = 'success' AND mode = 'calibrated' THEN 1 END) AS calibrated_count,
       COALESCE(string_agg(CASE WHEN status <> 'success' THEN source END, ',' ORDER BY source), '') AS failed_sources
FROM prov""", _DD, _PROV))
def q_ingestion_report(spark, sf_dir):
    return SD.ingestion_report(_provenance(spark, sf_dir))


@register("ingestion_metadata", "A-22", with_transactions("""
SELECT COUNT(CASE WHEN status = 'success' THEN 1 END) AS success_count,
       COUNT(CASE WHEN mode = 'live' THEN 1 END) AS live_success_count,
       COUNT(CASE WHEN mode = 'fallback' THEN 1 END) AS fallback_success_count,
       COUNT(CASE WHEN mode = 'calibrated' THEN 1 END) AS calibrated_count,
       7 AS source_count
FROM prov WHERE source <> 'ingestion_metadata'""", _DD, _PROV))
def q_ingestion_metadata(spark, sf_dir):
    prov = _provenance(spark, sf_dir).filter(F.col("source") != "ingestion_metadata")
    return SD.ingestion_metadata(prov)


@register("valid_requests", "P-18", with_transactions(f"""
SELECT 'score' AS request_type, transaction_id AS request_id,
       CASE WHEN amount_aud IS NULL OR amount_aud <= 0 OR amount_aud > {C.REQUEST_AMOUNT_MAX} THEN 'amount_out_of_range'
            WHEN hour("timestamp") IS NULL OR hour("timestamp") < 0 OR hour("timestamp") > 23 THEN 'hour_out_of_range' END AS reason,
       NOT (amount_aud IS NULL OR amount_aud <= 0 OR amount_aud > {C.REQUEST_AMOUNT_MAX}
            OR hour("timestamp") IS NULL OR hour("timestamp") < 0 OR hour("timestamp") > 23) AS accepted
FROM transactions
UNION ALL
SELECT 'question', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR),
       CASE WHEN length(text) < {C.QUESTION_MIN_LEN} OR length(text) > {C.QUESTION_MAX_LEN} THEN 'question_length' END,
       NOT (length(text) < {C.QUESTION_MIN_LEN} OR length(text) > {C.QUESTION_MAX_LEN})
FROM conversations WHERE role = 'user'"""))
def q_valid_requests(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    score = CL.score_request_checks(tx.select(F.lit("score").alias("request_type"),
                                              F.col("transaction_id").alias("request_id"), "amount_aud",
                                              F.hour("timestamp").alias("hour_of_day")))
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    ques = CL.question_request_checks(conv.select(
        F.lit("question").alias("request_type"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("request_id"),
        F.col("text").alias("question")))
    cols = ["request_type", "request_id", "reason", "accepted"]
    return score.select(*cols).unionByName(ques.select(*cols))


@register("business_hours_join", "J-1", with_transactions("""
SELECT transaction_id, merchant_category, is_outside_business_hours FROM transactions"""))
def q_business_hours_join(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return J.join_business_hours(tx, SD.business_hours_profile(spark)).select(
        "transaction_id", "merchant_category", "is_outside_business_hours")


@register("merchant_dimension", "J-2", with_transactions("""
SELECT dim.merchant_category AS dim_category, dim.state AS dim_state, COUNT(*) AS transactions,
       COUNT(DISTINCT f.merchant_id) AS merchants
FROM transactions f LEFT JOIN (
  SELECT merchant_id, merchant_category, state FROM (
    SELECT merchant_id, merchant_category, state,
           row_number() OVER (PARTITION BY merchant_id ORDER BY "timestamp" DESC, transaction_id DESC) AS rn
    FROM transactions) d WHERE rn = 1) dim ON dim.merchant_id = f.merchant_id
GROUP BY dim.merchant_category, dim.state"""))
def q_merchant_dimension(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    dim = J.merchant_dimension(tx).select("merchant_id", F.col("merchant_category").alias("dim_category"),
                                          F.col("state").alias("dim_state"))
    facts = J.attach_merchant_dim(tx.select("merchant_id"), dim)
    return facts.groupBy("dim_category", "dim_state").agg(F.count(F.lit(1)).alias("transactions"),
                                                  F.count_distinct("merchant_id").alias("merchants"))


_cats = ", ".join(f"('{c}')" for c in C.CATEGORIES)


@register("unexpected_values", "U-5", with_transactions(f"""
SELECT DISTINCT payment_terminal FROM transactions WHERE payment_terminal IS NOT NULL
EXCEPT SELECT * FROM (VALUES {', '.join(f"('{t}')" for t in C.TERMINALS)}) a(payment_terminal)"""))
def q_unexpected_values(spark, sf_dir):
    return Q.unexpected_values(transactions(spark, sf_dir), "payment_terminal", C.TERMINALS)


@register("drift_metrics", "SNK-8", with_transactions("""
SELECT metric_name, value, 'None' AS unit, 'anomaly-detector' AS model_name, 'production' AS environment FROM (
  SELECT 'data_drift_score' AS metric_name, share AS value FROM s
  UNION ALL SELECT 'drifted_features_count', CAST(cnt AS DOUBLE) FROM s
  UNION ALL SELECT 'dataset_drift_detected', CASE WHEN share >= 0.5 THEN 1.0 ELSE 0.0 END FROM s) m""",
    *(TRAINING_FEATURES_CTES + [ROUNDED_FEATURES_CTE] + _psi_sql()
      + ["s AS (SELECT CAST(COUNT(CASE WHEN psi > 0.2 THEN 1 END) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS share, "
         "COUNT(CASE WHEN psi > 0.2 THEN 1 END) AS cnt FROM psi)"])))
def q_drift_metrics(spark, sf_dir):
    f = rounded_training_features(spark, sf_dir)
    m = DR.metrics_rows(DR.distribution_drift(f, _is_current(), C.DRIFT_COLUMNS, _CATEG))
    return m.select("metric_name", "value", "unit", F.col("dimensions")["ModelName"].alias("model_name"),
                    F.col("dimensions")["Environment"].alias("environment"))


_RT_NAMES = [n for n, _, _ in C.FEATURE_REGISTRY]


@register("feature_records", "SNK-7", REALTIME_SQL.replace(
    "\nSELECT g.merchant_id,", ",\n    rt AS (SELECT g.merchant_id,", 1) + ")\n" + " UNION ALL ".join(
    f"SELECT merchant_id, '{n}' AS \"FeatureName\", printf('%.6f', {n}) AS \"ValueAsString\" FROM rt" for n in _RT_NAMES))
def q_feature_records(spark, sf_dir):
    """EAV projection of the realtime feature snapshot, values in fixed notation with six decimals."""
    from paylens.sinks.writers import feature_records
    f = FT.realtime_features(transactions(spark, sf_dir))
    return feature_records(f.select("merchant_id", *[F.format_string("%.6f", round_half(n, 6)).alias(n) for n in _RT_NAMES]))


_DASHBOARD_SQL = with_transactions("""
SELECT sev.merchant_id, sev.high, sev.medium, sev.low, pct.state_percentile, tr.trend_days, tr.trend, sh.methods, pk.peak_hours
FROM sev JOIN pct USING (merchant_id) LEFT JOIN tr USING (merchant_id) JOIN sh USING (merchant_id) JOIN pk USING (merchant_id)""",
    *[f"{name} AS ({sql})" for name, sql in (
        ("sev", _own("merchant_severity")), ("ms", f"SELECT merchant_id, {_AVG('amount_aud')} AS avg_ticket FROM transactions GROUP BY merchant_id"),
        ("pct", _own("merchant_percentile")), ("trd", _own("merchant_revenue_trend")), ("shd", _own("merchant_payment_share")),
        ("pkd", _own("merchant_peak_hours")),
        ("tr", "SELECT merchant_id, CAST(COUNT(*) AS INTEGER) AS trend_days, string_agg(strftime(day, '%Y-%m-%d') || '=' || printf('%.2f', revenue), ',' ORDER BY day) AS trend FROM trd GROUP BY merchant_id"),
        ("sh", "SELECT merchant_id, string_agg(method || '=' || printf('%.4f', share), ',' ORDER BY share DESC, method DESC) AS methods FROM shd GROUP BY merchant_id"),
        ("pk", "SELECT merchant_id, string_agg(CAST(hour AS VARCHAR), ',' ORDER BY rank) AS peak_hours FROM pkd GROUP BY merchant_id"))])


@register("merchant_dashboard", "A-18", _DASHBOARD_SQL)
def q_merchant_dashboard(spark, sf_dir):
    """The bundle's nested columns as text."""
    b = merchant_bundle(spark, sf_dir)
    join = lambda c, f: F.array_join(F.transform(c, f), ",")
    return b.select(
        "merchant_id", *[F.col(f"anomaly_summary.{c}").alias(c) for c in ("high", "medium", "low")],
        F.col("category_benchmark.state_percentile").alias("state_percentile"),
        F.when(F.col("revenue_trend_30d").isNotNull(), F.size("revenue_trend_30d")).alias("trend_days"),
        join("revenue_trend_30d", lambda x: F.concat(x["day"].cast("string"), F.lit("="), F.format_string("%.2f", x["revenue"])))
        .alias("trend"),
        join("top_payment_methods", lambda x: F.concat(x["method"], F.lit("="), F.format_string("%.4f", x["s"]))).alias("methods"),
        F.array_join(F.transform("peak_hours", lambda h: h.cast("string")), ",").alias("peak_hours"))


def merchant_bundle(spark, sf_dir):
    """Bundle of A-15, A-16, J-3, A-17, A-12 per merchant (nested)."""
    from paylens.operators.ranking import merchant_percentile
    tx = transactions(spark, sf_dir)
    trend = (D.merchant_revenue_trend(tx, 30, C.AS_OF).groupBy("merchant_id")
             .agg(F.array_sort(F.collect_list(F.struct("day", "revenue"))).alias("revenue_trend_30d")))  # <= 30+1
    sev = D.merchant_severity(tx).select("merchant_id", F.struct("high", "medium", "low").alias("anomaly_summary"))
    pct = merchant_percentile(tx).select("merchant_id", F.struct("state_percentile").alias("category_benchmark"))
    share = (D.merchant_payment_share(tx).groupBy("merchant_id")
             .agg(F.sort_array(F.collect_list(F.struct(F.col("share").alias("s"), "method")), False)
                  .alias("top_payment_methods")))                                                   # <= 4
    peaks = (D.merchant_peak_hours(tx, 5).groupBy("merchant_id")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hour"))), lambda x: x["hour"])
                  .alias("peak_hours")))                                                              # <= 5
    return (sev.join(trend, "merchant_id", "full").join(pct, "merchant_id", "full")
            .join(share, "merchant_id", "full").join(peaks, "merchant_id", "full"))


@register("nightly_curated", "SNK-1", with_transactions(f"""
SELECT {TXC}, 'PASSED' AS data_quality_flag FROM transactions
WHERE transaction_id IS NOT NULL AND merchant_id IS NOT NULL AND amount_aud > 0"""))
def q_nightly_curated(spark, sf_dir):
    """Landed raw JSON -> clean -> cleaned layer partitioned by category/state -> read back."""
    from paylens.session import scratch_path
    from paylens.sinks.writers import write_partitioned
    from paylens.sources.files import read_raw_json
    root = scratch_path(spark, "nightly")
    tx = transactions(spark, sf_dir)
    tx.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{root}/raw")
    curated = CL.clean_raw(read_raw_json(spark, f"{root}/raw"), stamp=False)
    write_partitioned(curated, f"{root}/cleaned", ["merchant_category", "state"])
    return spark.read.parquet(f"{root}/cleaned").select(*TRANSACTION_COLUMNS, "data_quality_flag")


@register("csv_dataset", "SRC-1", with_transactions(f"SELECT {TXC} FROM transactions"))
def q_csv_dataset(spark, sf_dir):
    """SNK-3 CSV write, then SRC-2/SRC-1: extension-resolved CSV read under the declared schema."""
    from paylens import schemas
    from paylens.session import scratch_path
    from paylens.sinks.writers import write_dataset
    from paylens.sources.files import read_dataset
    path = f"{scratch_path(spark, 'csv')}/transactions.csv"
    write_dataset(transactions(spark, sf_dir), path, fmt="csv")
    return read_dataset(spark, path, schemas.TRANSACTIONS)
