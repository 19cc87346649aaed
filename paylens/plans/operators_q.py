"""Queries for operators that no other query calls: scoping, clamps, appends, snapshots, audit rows,
vector storage, feature vectors, model scoring over a fixed forest, and scoring requests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import round_half
from paylens.functions.numeric import sql_money_avg as AVG
from paylens.functions.numeric import sql_round as R
from paylens.functions.risk import sql_fraud_prior, sql_risk_level
from paylens.operators import cleaning as CL
from paylens.operators import evaluation as EV
from paylens.operators import governance as G
from paylens.operators import ml as ML
from paylens.operators import questions as QA
from paylens.operators import retrieval as K
from paylens.operators import scoring as S
from paylens.plans.features_q import ROUNDED_FEATURES_CTE, TRAINING_FEATURES_CTES, rounded_training_features
from paylens.plans.registry import ORACLES, register
from paylens.plans.scoring_q import FEED_ALL, FEED_STATS
from paylens.session import scratch_path
from paylens.sinks import writers as W
from paylens.sources.tables import read_table, transactions, with_transactions

_N = "CAST(substr(transaction_id, 2) AS BIGINT)"


@register("coerced_timestamps", "P-3", with_transactions(f"""
SELECT transaction_id, "timestamp" FROM transactions WHERE {_N} % 11 <> 0"""))
def q_coerced_timestamps(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    text = F.when(F.expr(f"{_N} % 11 = 0"), F.lit("not a time")).otherwise(F.col("timestamp").cast("string"))
    return CL.coerce_timestamps(tx.select("transaction_id", text.alias("timestamp")))


CALLERS = [("M00001", "M00001", False), ("M00001", "M00002", False), ("M00001", "M00002", True), ("M00002", None, False)]


@register("tenant_scope", "P-4", with_transactions("""
SELECT c.merchant_id, c.caller, CASE WHEN c.denied THEN 'denied' ELSE 'allowed' END AS decision,
       CASE WHEN c.denied THEN 0 ELSE (SELECT COUNT(*) FROM transactions t WHERE t.merchant_id = c.merchant_id) END AS rows_read
FROM (VALUES ('M00001', 'M00001', FALSE), ('M00001', 'M00002', TRUE), ('M00001', 'M00002 (bypass)', FALSE),
             ('M00002', 'none', FALSE)) c(merchant_id, caller, denied)"""))
def q_tenant_scope(spark, sf_dir):
    """Callers against tenants: an own, a foreign, a bypassing and an internal one."""
    out = None
    for merchant, caller, bypass in CALLERS:
        name = (caller or "none") + (" (bypass)" if bypass else "")
        try:
            rows = CL.scoped(transactions(spark, sf_dir), merchant, caller, bypass)
            decision = "allowed"
        except PermissionError:
            rows, decision = transactions(spark, sf_dir).filter(F.lit(False)), "denied"
        one = rows.agg(F.count(F.lit(1)).alias("rows_read")).select(
            F.lit(merchant).alias("merchant_id"), F.lit(name).alias("caller"), F.lit(decision).alias("decision"), "rows_read")
        out = one if out is None else out.union(one)
    return out


@register("clamped_feed", "P-17", with_transactions("""
SELECT asked, transaction_id FROM (
  SELECT transaction_id, row_number() OVER (ORDER BY "timestamp" DESC, transaction_id DESC) AS rn FROM transactions) t,
  (VALUES (-3, 1), (7, 7), (900, 50)) l(asked, used) WHERE rn <= used"""))
def q_clamped_feed(spark, sf_dir):
    """The newest rows for limits below, inside and above the clamp."""
    out = None
    for asked in (-3, 7, 900):
        part = transactions(spark, sf_dir).orderBy(F.desc("timestamp"), F.desc("transaction_id")) \
            .limit(CL.clamp_limit(asked)).select(F.lit(asked).alias("asked"), "transaction_id")
        out = part if out is None else out.union(part)
    return out


@register("appended_table", "SNK-2", with_transactions("""
SELECT merchant_id, COUNT(*) AS row_count FROM (SELECT * FROM transactions UNION ALL SELECT * FROM transactions WHERE is_fraud) t
GROUP BY merchant_id"""))
def q_appended_table(spark, sf_dir):
    """Two appends to one catalog table, the second one retried; the table is dropped once its files are bound to the result."""
    name = f"tx_{uuid.uuid4().hex}"
    path, tx = f"{scratch_path(spark, 'tables')}/{name}", transactions(spark, sf_dir)
    try:
        W.append_table(tx, name, path, batch_id="all")
        for _ in range(2):
            W.append_table(tx.filter("is_fraud"), name, batch_id="fraud")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # an external table: its files stay until the process exits
    return spark.read.parquet(path).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("row_count"))


@register("registered_view", "SNK-4", with_transactions("""
SELECT merchant_id, COUNT(*) AS row_count, FALSE AS replaced_when_present FROM transactions GROUP BY merchant_id"""))
def q_registered_view(spark, sf_dir):
    """A view registered once; a second registration without ``replace`` is skipped."""
    name, tx = f"view_{uuid.uuid4().hex}", transactions(spark, sf_dir)
    W.register_table(spark, name, tx)
    again = W.register_table(spark, name, tx.filter("is_fraud"))
    found = spark.table(name).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("row_count")) \
        .withColumn("replaced_when_present", F.lit(again))
    spark.catalog.dropTempView(name)
    return found


@register("report_file", "SNK-9", ORACLES["ingestion_report"])
def q_report_file(spark, sf_dir):
    """The A-21 frame written as one JSON file and read back."""
    from paylens.plans.ingest_q import q_ingestion_report
    root, report = scratch_path(spark, "reports"), q_ingestion_report(spark, sf_dir)
    W.write_report(report, root)
    return spark.read.schema(report.schema).json(root)


@register("vector_store", "K-2", """
SELECT vec_id, 'vec-' || CAST(vec_id AS VARCHAR) AS source, CAST(len(embedding) AS INTEGER) AS dims,
       CAST(embedding[1] AS DOUBLE) AS first_value FROM embeddings""")
def q_vector_store(spark, sf_dir):
    root = scratch_path(spark, "vectors")
    K.write_vectors(read_table(spark, sf_dir, "embeddings"), root)
    return spark.read.parquet(root).select("vec_id", "source", F.size("embedding").alias("dims"),
                                           F.element_at("embedding", 1).cast("double").alias("first_value"))


@register("snapshot_upsert", "ST-6", with_transactions("""
SELECT merchant_id, transaction_id, amount_aud, state FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY "timestamp" DESC, transaction_id DESC) AS rn
  FROM transactions) t WHERE rn = 1"""))
def q_snapshot_upsert(spark, sf_dir):
    """Three batches out of order and a replay; the last version holds every merchant's newest row."""
    from paylens.streaming.snapshots import latest_version, upsert_snapshot
    root = scratch_path(spark, "snapshots")
    tx = transactions(spark, sf_dir).withColumn("event_ts", F.col("timestamp"))
    for batch, part in enumerate((2, 0, 1)):
        upsert_snapshot(tx.filter(F.expr(f"{_N} % 3 = {part}")), root, batch)
    upsert_snapshot(tx.filter(F.expr(f"{_N} % 3 = 1")), root, 2)
    return latest_version(spark, root).select("merchant_id", "transaction_id", "amount_aud", "state")


@register("stream_enriched", "J-7", with_transactions(f"""
SELECT transaction_id, t.merchant_id, {R('avg_amount', 6)} AS avg_amount, txn_count FROM transactions t JOIN (
  SELECT merchant_id, {AVG('amount_aud')} AS avg_amount, COUNT(*) AS txn_count FROM transactions GROUP BY merchant_id) b
  USING (merchant_id)"""))
def q_stream_enriched(spark, sf_dir):
    """The consumer with a static feature table joined to every event."""
    from paylens.operators.dashboards import merchant_baseline
    from paylens.sources.records import encode_records, to_base64
    from paylens.streaming import consumer as CS
    root, tx = scratch_path(spark, "enriched"), transactions(spark, sf_dir)
    to_base64(encode_records(tx)).write.json(f"{root}/landing")
    merchant_baseline(tx).select("merchant_id", "avg_amount", "txn_count").write.parquet(f"{root}/features")
    for q in CS.start_consumer(spark, CS.record_stream(spark, f"{root}/landing"), f"{root}/out", f"{root}/ckpt",
                               features=spark.read.parquet(f"{root}/features")):
        q.awaitTermination()
    return spark.read.parquet(f"{root}/out/scored").select(
        "transaction_id", "merchant_id", round_half("avg_amount", 6).alias("avg_amount"), "txn_count")


_ANSWERS = ORACLES["answer_questions"]
_AUDIT_SQL = _ANSWERS.replace("\nSELECT g.conv_id,", ",\n    ans AS (SELECT g.question, g.conv_id,", 1) + """)
SELECT CASE WHEN status = 'blocked' THEN 'query_blocked' ELSE 'agent_interaction' END AS event_type, merchant_id,
       CASE WHEN status = 'blocked' THEN query_snippet END AS query_snippet,
       CASE WHEN status = 'blocked' THEN reason END AS block_reason,
       CASE WHEN status = 'blocked' THEN 'HIGH' END AS severity,
       CASE WHEN status <> 'blocked' THEN CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) END AS request_id,
       CASE WHEN status <> 'blocked' THEN question END AS query, CASE WHEN status <> 'blocked' THEN CAST(0.9 AS DOUBLE) END AS confidence,
       CASE WHEN status <> 'blocked' THEN intent END AS intent_classified,
       CASE WHEN status <> 'blocked' THEN response_length END AS response_length FROM ans"""
# every fifth question asks for something that a guard stops
_ASKED = ["all merchants please", "1 UNION SELECT 2", "customer card numbers"]


def _varied_questions(q):
    words = F.element_at(F.array(*[F.lit(w) for w in _ASKED]), (F.pmod(F.col("conv_id"), F.lit(3)) + 1).cast("int"))
    return q.withColumn("question", F.when(F.col("conv_id") % 5 == 0, words).otherwise(F.col("question")))


_ASK_SQL = ("SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN (CASE conv_id % 3 "
            + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_ASKED)) + " END) ELSE text END AS question,")


@register("audit_events", "SNK-6", _AUDIT_SQL.replace("SELECT conv_id, turn, text AS question,", _ASK_SQL))
def q_audit_events(spark, sf_dir):
    """Agent interactions and blocked queries, written to the audit tree and read back."""
    root = scratch_path(spark, "audit")
    q = QA.questions_from_conversations(read_table(spark, sf_dir, "conversations"), read_table(spark, sf_dir, "events"))
    rows = W.audit_rows(QA.answer_questions(_varied_questions(q), transactions(spark, sf_dir)))
    W.write_audit(rows, root)
    back = spark.read.schema(rows.schema).json(root)
    return back.drop("timestamp", "year", "month", "day")


@register("query_guard_blocks", "X-4", _ANSWERS.replace("SELECT conv_id, turn, text AS question,", _ASK_SQL))
def q_query_guard_blocks(spark, sf_dir):
    """X-10 with questions that every guard group stops."""
    q = QA.questions_from_conversations(read_table(spark, sf_dir, "conversations"), read_table(spark, sf_dir, "events"))
    return QA.answer_questions(_varied_questions(q), transactions(spark, sf_dir)).drop("question")


_STATEMENTS = ["SELECT 1 FROM t WHERE m = ''", "DROP TABLE t", "  \n\tWITH a AS (SELECT 1) SELECT * FROM a",
               "DELETE FROM t", "select a from t; update t set a = 1", "EXPLAIN SELECT 1", ""]


@register("sql_guard_blocks", "X-5", """
WITH s AS (SELECT conv_id, turn, CASE conv_id % 7 """ + " ".join(
    "WHEN {} THEN '{}'".format(i, w.replace("'", "''")) for i, w in enumerate(_STATEMENTS)) + """ END AS sql,
  CASE WHEN turn % 2 = 0 THEN 'SELECT' ELSE 't' END AS merchant FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT contains(sql, merchant) THEN 'missing_merchant_filter' """ + " ".join(
    f"WHEN contains(upper(sql), '{k}') THEN 'dangerous:{k}'" for k in C.DANGEROUS_SQL_KEYWORDS) + """ END AS rejection,
  (regexp_matches(c, '^(select|with)') AND NOT (""" + " OR ".join(
    f"contains(' ' || c || ' ', '{t}')" for t in C.READONLY_BLOCKED_TOKENS) + """)) AS readonly
FROM (SELECT *, lower(trim(sql, ' ' || chr(9) || chr(10))) AS c FROM s) x""")
def q_sql_guard_blocks(spark, sf_dir):
    """Statements that every rule of X-5 and X-6 meets."""
    from paylens.functions import text as T
    c = read_table(spark, sf_dir, "conversations")
    sql = F.element_at(F.array(*[F.lit(w) for w in _STATEMENTS]), (F.col("conv_id") % 7 + 1).cast("int"))
    m = F.when(F.col("turn") % 2 == 0, F.lit("SELECT")).otherwise(F.lit("t"))
    s = c.select("conv_id", "turn", sql.alias("sql"), m.alias("merchant"))
    return s.select("conv_id", "turn", T.sql_guard_reason("sql", "merchant").alias("rejection"), T.is_readonly("sql").alias("readonly"))


_BASE = f"""b AS (SELECT merchant_id, COALESCE({AVG('amount_aud')}, 0.0) AS avg_amount,
  COALESCE(STDDEV_SAMP(amount_aud), 0.0) AS std_amount, COUNT(*) AS txn_count FROM transactions GROUP BY merchant_id)"""
_REQ = f"""req AS (SELECT transaction_id AS request_id, CASE WHEN {_N} % 9 = 0 THEN 'M99999' ELSE merchant_id END AS merchant_id,
  CASE WHEN {_N} % 4 = 0 THEN amount_aud * 16 ELSE amount_aud END AS amount_aud, CAST(hour("timestamp") AS INTEGER) AS hour_of_day FROM transactions)"""
_Z = "((r.amount_aud - COALESCE(b.avg_amount, 0.0)) / greatest(COALESCE(b.std_amount, 0.0), 0.01))"
_HEUR = f"least(greatest(abs({_Z}) / 10.0, 0.0), 1.0)"


def _known(e: str) -> str:
    return f"CASE WHEN b.txn_count IS NOT NULL THEN {e} END"


def _requests(tx):
    return tx.select(
        F.col("transaction_id").alias("request_id"),
        F.when(F.expr(f"{_N} % 9 = 0"), F.lit("M99999")).otherwise(F.col("merchant_id")).alias("merchant_id"),
        F.when(F.expr(f"{_N} % 4 = 0"), F.col("amount_aud") * 16).otherwise(F.col("amount_aud")).alias("amount_aud"),
        F.hour("timestamp").alias("hour_of_day"))


@register("score_requests", "R-9", with_transactions(f"""
SELECT r.request_id, r.merchant_id, r.amount_aud,
       CASE WHEN b.txn_count IS NULL THEN 'merchant_not_found' ELSE 'scored' END AS status,
       {_known(R(_HEUR, 4))} AS anomaly_score, {_known(f'{_HEUR} > 0.85')} AS is_anomaly,
       {_known(sql_risk_level(_HEUR))} AS risk_level, {_known('CAST(0.85 AS DOUBLE)')} AS threshold_used,
       {_known("'heuristic'")} AS scoring_mode, {_known(R(_Z, 3))} AS amount_zscore, {_known('r.hour_of_day')} AS hour_of_day,
       {_known(R('b.avg_amount', 2))} AS merchant_avg, {_known(R('b.std_amount', 2))} AS merchant_std,
       {_known('(r.hour_of_day < 8 OR r.hour_of_day > 20)')} AS is_outside_business_hours
FROM req r LEFT JOIN b USING (merchant_id)""", _BASE, _REQ))
def q_score_requests(spark, sf_dir):
    """Every transaction as a scoring request, some for an unknown merchant or of a large amount."""
    tx = transactions(spark, sf_dir)
    s = S.score_requests(_requests(tx), tx)
    return s.select(*[c for c in s.columns if c != "explanation"], "explanation.*")


@register("prediction_audit", "SNK-6", with_transactions(f"""
SELECT 'ml_prediction' AS event_type, r.request_id AS transaction_id, r.merchant_id, {R(_HEUR, 4)} AS anomaly_score,
       'heuristic-1' AS model_version, 'amount_zscore,hour_of_day' AS features_used, {R(_Z, 3)} AS amount_zscore
FROM req r JOIN b USING (merchant_id)""", _BASE, _REQ))
def q_prediction_audit(spark, sf_dir):
    """ml_prediction events of all scored requests, written to the audit tree and read back."""
    root, tx = scratch_path(spark, "audit"), transactions(spark, sf_dir)
    scored = S.score_requests(_requests(tx), tx).filter("status = 'scored'").withColumnRenamed("request_id", "transaction_id")
    rows = W.prediction_rows(scored, "heuristic-1", ["amount_zscore", "hour_of_day"])
    W.write_audit(rows, root)
    back = spark.read.schema(rows.schema).json(root)
    return back.select("event_type", "transaction_id", "merchant_id", "anomaly_score", "model_version",
                       F.array_join("features_used", ",").alias("features_used"),
                       F.col("explanation_summary.amount_zscore").alias("amount_zscore"))


@register("bias_from_tables", "J-9", with_transactions(f"""
SELECT merchant_category, tp, fp, {R('CAST(tp AS DOUBLE) / CAST(greatest(tp + fp, 1) AS DOUBLE)', 6)} AS precision FROM (
  SELECT merchant_category, COUNT(CASE WHEN anomaly_score >= 0.2 AND is_fraud THEN 1 END) AS tp,
         COUNT(CASE WHEN anomaly_score >= 0.2 AND NOT is_fraud THEN 1 END) AS fp
  FROM scored WHERE {_N} % 6 <> 0 GROUP BY merchant_category) p""", FEED_STATS, FEED_ALL))
def q_bias_from_tables(spark, sf_dir):
    """Scores and labels as separate tables joined on the transaction; a sixth of the rows has no label."""
    s = S.feed_scores(transactions(spark, sf_dir))
    labels = transactions(spark, sf_dir).filter(F.expr(f"{_N} % 6 <> 0")).select("transaction_id", "is_fraud")
    joined = G.scored_labels(s.select("transaction_id", "merchant_category", "anomaly_score"), labels)
    return G.category_precision(joined, "anomaly_score", "is_fraud", 0.2).withColumn("precision", round_half("precision", 6))


HISTORY = 20


@register("short_history", "SRC-8", ORACLES["merchant_history"].replace(f"rn <= {C.HISTORY_LIMIT}", f"rn <= {HISTORY}"))
def q_short_history(spark, sf_dir):
    """The history with a limit that most merchants exceed."""
    from paylens.operators.features import merchant_history
    from paylens.sources.tables import TRANSACTION_COLUMNS
    return merchant_history(transactions(spark, sf_dir), HISTORY).select(*TRANSACTION_COLUMNS)


# ---- models -----------------------------------------------------------------

_SUM = " + ".join(f"COALESCE({c}, 0.0)" for c in C.FEATURE_COLUMNS)


@register("feature_vectors", "M-8", with_transactions(
    f"SELECT transaction_id, {len(C.FEATURE_COLUMNS)} AS dims, {R(_SUM, 4)} AS total FROM tf",
    *TRAINING_FEATURES_CTES, ROUNDED_FEATURES_CTE))
def q_feature_vectors(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    v = ML.assemble(rounded_training_features(spark, sf_dir)).select("transaction_id", vector_to_array("features").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return v.select("transaction_id", F.size("v").alias("dims"), round_half(total, 4).alias("total"))


# a fixed forest: (tree, node, feature or -1, threshold, left, right, size)
FOREST = [
    (0, 0, 2, 90.0, 1, 2, 256), (0, 1, 0, 1.5, 3, 4, 200), (0, 2, -1, 0.0, -1, -1, 56), (0, 3, -1, 0.0, -1, -1, 180),
    (0, 4, -1, 0.0, -1, -1, 20), (1, 0, 8, 7.5, 1, 2, 256), (1, 1, -1, 0.0, -1, -1, 30), (1, 2, 3, 40.0, 3, 4, 226),
    (1, 3, -1, 0.0, -1, -1, 100), (1, 4, 5, 300.0, 5, 6, 126), (1, 5, -1, 0.0, -1, -1, 125), (1, 6, -1, 0.0, -1, -1, 1),
]


def _path_sql(tree: int, node: int, depth: int) -> str:
    f, threshold, left, right, size = next(x[2:] for x in FOREST if x[:2] == (tree, node))
    if f < 0:
        return f"CAST({depth + ML.c_factor(size)!r} AS DOUBLE)"
    return (f"CASE WHEN {C.FEATURE_COLUMNS[f]} < {threshold!r} THEN {_path_sql(tree, left, depth + 1)} "
            f"ELSE {_path_sql(tree, right, depth + 1)} END")


_MEAN_PATH = f"(({_path_sql(0, 0, 0)} + {_path_sql(1, 0, 0)}) / 2.0)"


@register("forest_scores", "M-2", with_transactions(
    f"SELECT transaction_id, {R(f'pow(2.0, -{_MEAN_PATH} / {ML.c_factor(256)!r})', 9)} AS iso_score FROM tf",
    *TRAINING_FEATURES_CTES, ROUNDED_FEATURES_CTE))
def q_forest_scores(spark, sf_dir):
    """Isolation scores of every transaction under a fixed forest."""
    nodes = spark.createDataFrame([(*x, x[2] < 0) for x in FOREST], ML.NODE_SCHEMA)
    model = ML.load_isolation_forest(nodes, psi=256)
    return model.transform(rounded_training_features(spark, sf_dir)).select("transaction_id", round_half("iso_score", 9).alias("iso_score"))


_PRIOR = sql_fraud_prior("amount_aud", "merchant_category", "payment_terminal", "card_type", "is_outside_business_hours")


@register("ensemble_of_scores", "M-6", with_transactions(f"""
SELECT transaction_id, {R(f'{C.ENSEMBLE_ISO_WEIGHT} * ((a - lo) / (hi - lo + 1e-9)) + {C.ENSEMBLE_CLF_WEIGHT} * p', 9)} AS anomaly_score
FROM (SELECT transaction_id, amount_aud AS a, {_PRIOR} AS p, MIN(amount_aud) OVER () AS lo, MAX(amount_aud) OVER () AS hi
      FROM transactions) s"""))
def q_ensemble_of_scores(spark, sf_dir):
    """The ensemble over two given score columns: the amount and the fraud prior."""
    tx = transactions(spark, sf_dir)
    p = S.fraud_priors(tx).select("transaction_id", "fraud_prior").join(tx.select("transaction_id", "amount_aud"), "transaction_id")
    return EV.ensemble(p, "amount_aud", "fraud_prior").select("transaction_id", round_half("anomaly_score", 9).alias("anomaly_score"))


@register("model_health", "M-10", ORACLES["score_metrics"].replace("AS fraud_samples\nFROM curve2", f"""AS fraud_samples,
  SUM(CAST(neg AS DOUBLE) * (CAST(cum_pos AS DOUBLE) - CAST(pos AS DOUBLE) / 2.0)) / NULLIF(CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE), 0.0) >= {C.MODEL_HEALTH_AUC} AS healthy
FROM curve2"""))
def q_model_health(spark, sf_dir):
    p = S.fraud_priors(transactions(spark, sf_dir))
    m = EV.is_healthy(EV.evaluate(p, "fraud_prior", "is_fraud"))
    return m.select(*[round_half(c, 9).alias(c) for c in ("roc_auc", "avg_precision", "precision_at_threshold", "recall_at_threshold")],
                    "threshold", "total_samples", "fraud_samples", "healthy")


@register("model_round_trip", "M-7", with_transactions("""
SELECT COUNT(*) AS scored, COUNT(*) AS in_range, COUNT(*) AS equal_after_reload, COUNT(*) AS audited FROM transactions"""))
def q_model_round_trip(spark, sf_dir):
    """M-7, M-9, R-9 in model mode: a small ensemble saved and loaded scores every transaction alike."""
    from paylens.session import cut_lineage
    root = scratch_path(spark, "models")
    f = cut_lineage(rounded_training_features(spark, sf_dir, ["transaction_id", "merchant_id", "amount_aud", "timestamp", "is_fraud"]))
    nodes = cut_lineage(ML.fit_isolation_forest(f, trees=20, psi=64))
    clf = ML.train_classifier(f, max_iter=5)
    ML.save_models(root, nodes, clf, EV.evaluate(f.withColumn("s", F.col("amount_zscore")), "s", "is_fraud"))
    iso2, clf2, _ = ML.load_models(spark, root, psi=64)
    model = ML.EnsembleModel(ML.load_isolation_forest(nodes, psi=64), clf)
    a = model.transform(f).select("transaction_id", "anomaly_score")
    b = ML.EnsembleModel(iso2, clf2).transform(f).select("transaction_id", F.col("anomaly_score").alias("again"))
    served = S.score_requests(f.select(F.col("transaction_id").alias("request_id"), "merchant_id", "amount_aud", "hour_of_day"),
                              transactions(spark, sf_dir), model=model)
    served = served.select(F.col("request_id").alias("transaction_id"), (F.col("scoring_mode") == "model").alias("by_model"))
    return a.join(b, "transaction_id").join(served, "transaction_id").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.col("anomaly_score").between(0, 1)).alias("in_range"),
        F.count_if(F.abs(F.col("anomaly_score") - F.col("again")) < 1e-12).alias("equal_after_reload"),
        F.count_if("by_model").alias("audited"))
