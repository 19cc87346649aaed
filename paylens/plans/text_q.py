"""Text, guardrail, question-answering and retrieval queries with DuckDB oracles.

The oracle regexes run on RE2, which has no look-around: the card rule's word
boundaries are written as capture groups and the replacement is applied twice
(adjacent cards share one separator), an independent formulation of the same
rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions import text as T
from paylens.functions.numeric import round_half
from paylens.functions.numeric import sql_round as R
from paylens.operators import questions as QA
from paylens.operators import retrieval as K
from paylens.plans.registry import register
from paylens.session import scratch_path
from paylens.sources.tables import read_table, transactions, with_transactions

SP = T.SPACE
NW = T.NOT_WORD
CARD_CORE = rf"\p{{Nd}}{{4}}[{SP[1:-1]}-]?\p{{Nd}}{{4}}[{SP[1:-1]}-]?\p{{Nd}}{{4}}[{SP[1:-1]}-]?\p{{Nd}}{{4}}"
CARD_RE2 = rf"(^|{NW}){CARD_CORE}($|{NW})"
EMAIL_RE2 = T.EMAIL_RE


def _re2_alt(patterns):
    return "(?i)" + "|".join(f"(?:{T.to_java(p)})" for p in patterns)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_REDACT_SQL = (f"regexp_replace(regexp_replace(regexp_replace(text, {_sql_str(CARD_RE2)}, "
               f"'\\1{C.CARD_TAG}\\2', 'g'), {_sql_str(CARD_RE2)}, '\\1{C.CARD_TAG}\\2', 'g'), "
               f"{_sql_str(EMAIL_RE2)}, '{C.EMAIL_TAG}', 'g')")


@register("redact_pii", "X-2", f"""
SELECT doc_id, {_REDACT_SQL} AS redacted, {_REDACT_SQL} <> text AS changed FROM documents""")
def q_redact_pii(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return (d.select("doc_id", "text", T.redact_pii("text").alias("redacted"))
            .select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed")))


_LOCAL = "split_part(email, '@', 1)"
_MASK_SQL = f"""CASE WHEN len(string_split(email, '@')) = 2 THEN
  (CASE WHEN length({_LOCAL}) <= 2 THEN repeat('*', length({_LOCAL}))
        ELSE left({_LOCAL}, 1) || repeat('*', length({_LOCAL}) - 2) || right({_LOCAL}, 1) END)
  || '@' || split_part(email, '@', 2) ELSE email END"""


@register("mask_email", "X-1", f"""
SELECT doc_id, email, {_MASK_SQL} AS masked
FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_sql_str(EMAIL_RE2)})) AS email FROM documents) e""")
def q_mask_email(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    e = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.EMAIL_RE), 0)).alias("email"))
    return e.select("doc_id", "email", T.mask_email("email").alias("masked"))


@register("response_guard", "X-3", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, {_sql_str(CARD_RE2)}) THEN '{C.RESPONSE_PII_REPLACEMENT}'
                    ELSE text END AS guarded,
       regexp_matches(text, {_sql_str(CARD_RE2)}) AS blocked
FROM documents""")
def q_response_guard(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", T.response_guard("text").alias("guarded"), T.has_card("text").alias("blocked"))


_GUARD_SQL = (f"CASE WHEN regexp_matches(text, {_sql_str(_re2_alt(C.CROSS_MERCHANT_PATTERNS))}) THEN 'cross_merchant' "
              f"WHEN regexp_matches(text, {_sql_str(_re2_alt(C.INJECTION_PATTERNS))}) THEN 'injection' "
              f"WHEN regexp_matches(text, {_sql_str(_re2_alt(C.PII_REQUEST_PATTERNS))}) THEN 'pii' END")


@register("query_guard", "X-4", f"""
SELECT conv_id, turn, {_GUARD_SQL} AS reason,
       CASE WHEN ({_GUARD_SQL}) IS NULL THEN 'allowed' ELSE 'blocked' END AS status
FROM conversations""")
def q_query_guard(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.query_guard_reason("text").alias("reason")).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("allowed")).otherwise(F.lit("blocked")))


def _intent_sql(intents, default):
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), {_sql_str(w)})" for w in words) + f" THEN '{name}'"
        for name, words in intents)
    return f"CASE {whens} ELSE '{default}' END"


@register("classify_intent", "X-8", f"""
SELECT conv_id, turn, {_intent_sql(C.ROUTER_INTENTS, C.ROUTER_DEFAULT)} AS intent FROM conversations""")
def q_classify_intent(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.keyword_intent("text", C.ROUTER_INTENTS, C.ROUTER_DEFAULT).alias("intent"))


@register("classify_chat_intent", "X-9", f"""
SELECT conv_id, turn, {_intent_sql(C.CHAT_INTENTS, C.CHAT_DEFAULT)} AS intent FROM conversations""")
def q_classify_chat_intent(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.keyword_intent("text", C.CHAT_INTENTS, C.CHAT_DEFAULT).alias("intent"))


_QUESTIONS = """questions AS (
  SELECT conv_id, turn, text AS question,
         'M' || lpad(CAST(((conv_id % (SELECT max(user_id) + 1 FROM events)) + (SELECT max(user_id) + 1 FROM events))
                          % (SELECT max(user_id) + 1 FROM events) AS VARCHAR), 5, '0') AS merchant_id
  FROM conversations WHERE role = 'user')"""
_TEMPLATE = ("CASE WHEN contains(lower(question), 'revenue') OR contains(lower(question), 'sales') THEN "
             "'SELECT DATE(timestamp) AS day, SUM(amount_aud) AS total_revenue FROM transactions WHERE merchant_id = ''' "
             "|| merchant_id || ''' GROUP BY DATE(timestamp) ORDER BY day DESC LIMIT 30' "
             "ELSE 'SELECT COUNT(*) AS txn_count FROM transactions WHERE merchant_id = ''' || merchant_id "
             "|| ''' LIMIT 1' END")
_SQLG = ("CASE WHEN NOT COALESCE(contains(sql, merchant_id), FALSE) THEN 'missing_merchant_filter' "
         + " ".join(f"WHEN contains(upper(sql), '{k}') THEN 'dangerous:{k}'" for k in C.DANGEROUS_SQL_KEYWORDS)
         + " END")
_RO = ("(length(lower(trim(sql))) > 0 AND (starts_with(lower(trim(sql)), 'select') OR starts_with(lower(trim(sql)), 'with')) "
       "AND NOT (" + " OR ".join(f"contains(' ' || lower(trim(sql)) || ' ', '{t}')" for t in C.READONLY_BLOCKED_TOKENS)
       + "))")


@register("sql_guard", "X-5", f"""
WITH {_QUESTIONS}, gen AS (SELECT conv_id, turn, merchant_id, {_TEMPLATE} AS sql FROM questions)
SELECT conv_id, turn, merchant_id, sql, {_SQLG} AS rejection, {_RO} AS readonly FROM gen""")
def q_sql_guard(spark, sf_dir):
    q = QA.questions_from_conversations(read_table(spark, sf_dir, "conversations"), read_table(spark, sf_dir, "events"))
    g = q.select("conv_id", "turn", "merchant_id", QA.template_sql(F.col("question"), F.col("merchant_id")).alias("sql"))
    return g.select("conv_id", "turn", "merchant_id", "sql",
                    T.sql_guard_reason("sql", "merchant_id").alias("rejection"),
                    T.is_readonly("sql").alias("readonly"))


@register("readonly_guard", "X-6", f"""
WITH {_QUESTIONS}, gen AS (SELECT conv_id, turn, {_TEMPLATE} AS sql FROM questions)
SELECT {_RO} AS readonly, COUNT(*) AS n FROM gen GROUP BY 1""")
def q_readonly_guard(spark, sf_dir):
    q = QA.questions_from_conversations(read_table(spark, sf_dir, "conversations"), read_table(spark, sf_dir, "events"))
    g = q.select(QA.template_sql(F.col("question"), F.col("merchant_id")).alias("sql"))
    return g.groupBy(T.is_readonly("sql").alias("readonly")).agg(F.count(F.lit(1)).alias("n"))


# X-7 is a single-tenant operator by definition (the scope is the feature): the checked
# statement runs for one merchant while the scan still covers the whole table.
SCOPED_MERCHANT = "M00001"


@register("scoped_sql", "X-7", with_transactions(f"""
SELECT CAST("timestamp" AS DATE) AS day, CAST(SUM(CAST(amount_aud AS DECIMAL(24,6))) AS DOUBLE) AS total_revenue
FROM transactions WHERE merchant_id = '{SCOPED_MERCHANT}'
GROUP BY CAST("timestamp" AS DATE) ORDER BY day DESC LIMIT 30"""))
def q_scoped_sql(spark, sf_dir):
    from paylens.operators.sqlscope import run_scoped_sql
    sql = ("SELECT DATE(timestamp) AS day, CAST(SUM(CAST(amount_aud AS DECIMAL(24,6))) AS DOUBLE) AS total_revenue "
           f"FROM transactions WHERE merchant_id = '{SCOPED_MERCHANT}' "
           "GROUP BY DATE(timestamp) ORDER BY day DESC LIMIT 30")
    return run_scoped_sql(spark, sql, SCOPED_MERCHANT, transactions(spark, sf_dir))


#: Statements of one caller: how many rows the accepted ones may count, in DuckDB's words (None: refused).
_SCOPE_OWN = "FROM transactions WHERE merchant_id = '{m}'"
SCOPED_STATEMENTS = [
    ("SELECT count(*) n FROM transactions WHERE merchant_id = '{m}'", f"SELECT count(*) {_SCOPE_OWN}"),
    ("SELECT count(*) n FROM Transactions t WHERE '{m}' <> t.customer_id", f"SELECT count(*) {_SCOPE_OWN}"),
    ("SELECT count(*) n FROM transactions WHERE merchant_id IN ('{m}', 'M00005') OR TRUE", f"SELECT count(*) {_SCOPE_OWN}"),
    ("WITH transactions AS (SELECT * FROM transactions WHERE merchant_id = '{m}' AND is_fraud) SELECT count(*) n FROM transactions",
     f"SELECT count(*) {_SCOPE_OWN} AND is_fraud"),
    ("SELECT max(n) n FROM (WITH a AS (SELECT state, count(*) n FROM transactions WHERE merchant_id = '{m}' GROUP BY state) SELECT * FROM a)",
     f"SELECT max(n) FROM (SELECT count(*) AS n {_SCOPE_OWN} GROUP BY state) q"),
    ("SELECT count(DISTINCT other.merchant_id) n FROM transactions t JOIN transactions other ON t.state = other.state WHERE t.merchant_id = '{m}'",
     f"SELECT count(DISTINCT merchant_id) {_SCOPE_OWN} AND state IS NOT NULL"),
    ("SELECT count(*) n FROM transactions t WHERE merchant_id = '{m}' AND amount_aud > (SELECT avg(amount_aud) FROM transactions)",
     f"SELECT count(*) {_SCOPE_OWN} AND amount_aud > (SELECT avg(amount_aud) {_SCOPE_OWN})"),
    ("SELECT count(*) n FROM transactions", None),
    ("WITH all_rows AS (SELECT * FROM all_rows) SELECT '{m}' m, count(*) n FROM all_rows", None),
    ("SELECT '{m}' m, (SELECT count(*) FROM all_rows) n FROM (WITH all_rows AS (SELECT 1 x) SELECT * FROM all_rows) a", None),
    ("WITH `parquet.{dir}/events.parquet` AS (SELECT 1 x) SELECT '{m}' m, count(*) n FROM parquet.`{dir}/events.parquet`", None),
    ("WITH a AS (SELECT * FROM all_rows), all_rows AS (SELECT 1 x) SELECT '{m}' m, count(*) n FROM a", None),
    ("SELECT '{m}' m, count(*) n FROM global_temp.all_rows", None),
    ("SELECT count(TRANSFORM(merchant_id) USING 'cat') n FROM transactions WHERE merchant_id = '{m}'", None),
    ("SELECT max(length(reflect('java.lang.System', 'lineSeparator'))) n FROM transactions WHERE merchant_id = '{m}'", None),
    ("DROP VIEW all_rows -- {m}", None),
]
_SCOPED_SQL = " UNION ALL ".join(
    f"SELECT {k} AS statement, '{m}' AS merchant_id, "
    + (f"TRUE AS accepted, CAST(({sql.format(m=m)}) AS BIGINT) AS n" if sql else "FALSE AS accepted, CAST(NULL AS BIGINT) AS n")
    for m in ("M00001", "M00002") for k, (_, sql) in enumerate(SCOPED_STATEMENTS))


@register("scoped_sql_statements", "X-7", with_transactions(_SCOPED_SQL))
def q_scoped_sql_statements(spark, sf_dir):
    """Two merchants' statements, accepted and refused, while views of all rows exist in the caller's session and globally."""
    from functools import reduce

    from paylens.operators.sqlscope import run_scoped_sql
    tx = transactions(spark, sf_dir)
    tx.createOrReplaceTempView("all_rows")
    tx.createOrReplaceGlobalTempView("all_rows")
    out = []
    try:
        for m in ("M00001", "M00002"):
            for k, (sql, _) in enumerate(SCOPED_STATEMENTS):
                try:
                    n = run_scoped_sql(spark, sql.format(m=m, dir=sf_dir), m, tx).agg(F.max(F.col("n").cast("long")).alias("n"))
                    accepted = True
                except ValueError:
                    n, accepted = spark.range(1).select(F.lit(None).cast("long").alias("n")), False
                out.append(n.select(F.lit(k).alias("statement"), F.lit(m).alias("merchant_id"), F.lit(accepted).alias("accepted"), "n"))
    finally:
        spark.catalog.dropTempView("all_rows")
        spark.catalog.dropGlobalTempView("all_rows")
    return reduce(lambda a, b: a.union(b), out)


_ANSWER_SQL = with_transactions(f"""
SELECT g.conv_id, g.turn, g.merchant_id, g.status, g.reason, g.intent, r.response,
       left(g.question, 100) AS query_snippet, CAST(length(r.response) AS INTEGER) AS response_length
FROM g JOIN (
  SELECT g2.conv_id, g2.turn,
    CASE WHEN g2.status = 'blocked' THEN
           CASE WHEN g2.reason = 'cross_merchant' THEN 'Cross-merchant data access denied. You can only query your own merchant data.'
                WHEN g2.reason = 'injection' THEN 'Potentially malicious query detected and blocked.'
                ELSE 'PII data cannot be retrieved through the query interface. This request has been logged for compliance review.' END
         ELSE (CASE WHEN regexp_matches(ans, {_sql_str(CARD_RE2)}) THEN '{C.RESPONSE_PII_REPLACEMENT}' ELSE ans END) END AS response
  FROM (SELECT g1.*,
          CASE WHEN intent = 'revenue' THEN printf('Merchant %s processed %d transactions with total revenue of %.2f AUD and average transaction %.2f AUD.', g1.merchant_id, rv.transaction_count, rv.total_revenue, rv.avg_transaction)
               WHEN intent = 'fraud' THEN printf('Merchant %s: %d suspicious transactions out of %d total, potential fraud value %.2f AUD.', g1.merchant_id, fr.fraud_count, fr.total, fr.fraud_value)
               WHEN intent = 'peak' THEN COALESCE('Peak hours for ' || g1.merchant_id || ': ' || pk.txt, 'No hourly data found for merchant ' || g1.merchant_id || '.')
               ELSE COALESCE(printf('Merchant %s is a %s business in %s with %d transactions totaling %.2f AUD.', g1.merchant_id, pf.merchant_category, pf.state, pf.txn_count, pf.total), 'No data found for merchant ' || g1.merchant_id || '.') END AS ans
        FROM g g1
        LEFT JOIN rv ON rv.merchant_id = g1.merchant_id LEFT JOIN fr ON fr.merchant_id = g1.merchant_id
        LEFT JOIN pk ON pk.merchant_id = g1.merchant_id LEFT JOIN pf ON pf.merchant_id = g1.merchant_id) g2
) r ON r.conv_id = g.conv_id AND r.turn = g.turn""",
    _QUESTIONS,
    f"""g AS (SELECT q.*, {_GUARD_SQL.replace('text', 'question')} AS reason,
            CASE WHEN ({_GUARD_SQL.replace('text', 'question')}) IS NULL THEN 'allowed' ELSE 'blocked' END AS status,
            {_intent_sql(C.CHAT_INTENTS, C.CHAT_DEFAULT).replace('text', 'question')} AS intent FROM questions q)""",
    f"""rv AS (SELECT merchant_id, {R("CAST(SUM(CAST(amount_aud AS DECIMAL(24,6))) AS DOUBLE)", 2)} AS total_revenue,
            COUNT(*) AS transaction_count,
            {R("CAST(SUM(CAST(amount_aud AS DECIMAL(24,6))) AS DOUBLE) / CAST(COUNT(amount_aud) AS DOUBLE)", 2)} AS avg_transaction
            FROM transactions GROUP BY merchant_id)""",
    f"""fr AS (SELECT merchant_id, COUNT(*) AS total, COUNT(CASE WHEN is_fraud THEN 1 END) AS fraud_count,
            {R("CAST(SUM(CAST(CASE WHEN is_fraud THEN amount_aud ELSE 0.0 END AS DECIMAL(24,6))) AS DOUBLE)", 2)} AS fraud_value
            FROM transactions GROUP BY merchant_id)""",
    """pk AS (SELECT merchant_id, string_agg(printf('%02d:00 (%d txns)', hour, txn_count), ', ' ORDER BY rk) AS txt FROM (
            SELECT merchant_id, hour, txn_count,
                   row_number() OVER (PARTITION BY merchant_id ORDER BY txn_count DESC, hour) AS rk
            FROM (SELECT merchant_id, hour("timestamp") AS hour, COUNT(*) AS txn_count FROM transactions GROUP BY 1, 2) h) x
            WHERE rk <= 3 GROUP BY merchant_id)""",
    f"""pf AS (SELECT merchant_id, merchant_category, state, txn_count, total FROM (
            SELECT merchant_id, merchant_category, state, COUNT(*) AS txn_count,
                   {R("CAST(SUM(CAST(amount_aud AS DECIMAL(24,6))) AS DOUBLE)", 2)} AS total,
                   row_number() OVER (PARTITION BY merchant_id ORDER BY merchant_category, state) AS rn
            FROM transactions GROUP BY 1, 2, 3) p WHERE rn = 1)""")


@register("answer_questions", "X-10", _ANSWER_SQL)
def q_answer_questions(spark, sf_dir):
    q = QA.questions_from_conversations(read_table(spark, sf_dir, "conversations"), read_table(spark, sf_dir, "events"))
    return QA.answer_questions(q, transactions(spark, sf_dir)).drop("question")


@register("request_scope_check", "X-11", f"""
WITH {_QUESTIONS}, req AS (
  SELECT conv_id, turn, merchant_id,
         'merchant:M' || lpad(CAST(((conv_id + turn) % (SELECT max(user_id) + 1 FROM events)) AS VARCHAR), 5, '0') AS token
  FROM questions)
SELECT conv_id, turn, merchant_id, token, regexp_extract(token, '^merchant:(.+)$', 1) AS token_merchant,
       CASE WHEN regexp_extract(token, '^merchant:(.+)$', 1) = '' THEN 'invalid_token'
            WHEN regexp_extract(token, '^merchant:(.+)$', 1) = merchant_id THEN 'allow' ELSE 'deny' END AS decision
FROM req""")
def q_request_scope_check(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    q = QA.questions_from_conversations(read_table(spark, sf_dir, "conversations"), events)
    n = events.select(F.max("user_id") + 1).scalar()
    req = q.select("conv_id", "turn", "merchant_id",
                   F.concat(F.lit("merchant:M"), F.lpad(F.pmod(F.col("conv_id") + F.col("turn"), n).cast("string"), 5, "0"))
                   .alias("token"))
    return QA.scope_check(req)


@register("chunk_documents", "K-1", f"""
SELECT doc_id, CAST(k AS INTEGER) AS chunk_id, CAST(k * {C.CHUNK_SIZE - C.CHUNK_OVERLAP} AS INTEGER) AS chunk_start,
       substring(text, k * {C.CHUNK_SIZE - C.CHUNK_OVERLAP} + 1, {C.CHUNK_SIZE}) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - {C.CHUNK_SIZE}) / {float(C.CHUNK_SIZE - C.CHUNK_OVERLAP)}) AS BIGINT), 0) + 1)) AS k
      FROM documents) d""")
def q_chunk_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.chunk_text(d).select("doc_id", "chunk_id", "chunk_start", "chunk")


@register("chunk_documents_breaks", "K-1")
def q_chunk_documents_breaks(spark, sf_dir):
    """Whole texts cut at paragraphs, lines and words."""
    return K.chunk_at_breaks(read_table(spark, sf_dir, "documents"))


_DIST = ("list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: "
         "(CAST(v.embedding[i] AS DOUBLE) - CAST(q.query_vec[i] AS DOUBLE)) * "
         "(CAST(v.embedding[i] AS DOUBLE) - CAST(q.query_vec[i] AS DOUBLE))))")
_KNN_CTE = f"""own AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
queries AS (
  SELECT vec_id AS query_id, embedding AS query_vec FROM own
  UNION ALL SELECT -1 - 2 * o.vec_id, list_transform(range(1, len(o.embedding) + 1),
                   lambda i: CAST((CAST(o.embedding[i] AS DOUBLE) + CAST(n.embedding[i] AS DOUBLE)) / 2 AS FLOAT))
            FROM own o JOIN embeddings n ON n.vec_id = o.vec_id + 1
  UNION ALL SELECT -2 - 2 * vec_id, list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) FROM own),
nn AS (
  SELECT query_id, vec_id, distance, rank FROM (
    SELECT q.query_id, v.vec_id, {_DIST} AS distance,
           CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY {_DIST}, v.vec_id) AS INTEGER) AS rank
    FROM embeddings v, queries q) s WHERE rank <= {C.KNN_K})"""


def query_vectors(e):
    """Every vector whose id is divisible by 20 (its id), the middle between it and its successor (-1 - 2 id), and
    a stretched copy of it, far from all vectors (-2 - 2 id)."""
    own = e.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    after = e.select((F.col("vec_id") - 1).cast("long").alias("vec_id"), F.col("embedding").alias("other"))
    middle = own.join(after, "vec_id").select(
        (-1 - 2 * F.col("vec_id")).alias("query_id"),
        F.zip_with("embedding", "other", lambda a, b: ((a.cast("double") + b.cast("double")) / 2).cast("float")).alias("query_vec"))
    far = own.select((-2 - 2 * F.col("vec_id")).alias("query_id"),
                     F.transform("embedding", lambda x: (x * 3).cast("float")).alias("query_vec"))
    return own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")).union(middle).union(far)


@register("knn_search", "K-3", f"""
WITH {_KNN_CTE} SELECT query_id, vec_id, {R('distance', 6)} AS distance, rank FROM nn""")
def q_knn_search(spark, sf_dir):
    """Every vector whose id is divisible by 20, and two queries derived from it, against all vectors."""
    e = read_table(spark, sf_dir, "embeddings")
    r = K.knn(e, query_vectors(e))
    return r.select("query_id", "vec_id", round_half("distance", 6).alias("distance"), "rank")


@register("retrieval_answer", "K-4", f"""
WITH {_KNN_CTE}
SELECT query_id,
       string_agg('vec-' || CAST(vec_id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS sources,
       {R('least(greatest(1.0 - least(MIN(distance), 1.0), 0.0), 1.0)', 6)} AS confidence,
       COALESCE(string_agg('[Source: vec-' || CAST(vec_id AS VARCHAR) || ']' || chr(10) || COALESCE(d.text, ''),
                           chr(10) || chr(10) ORDER BY rank) FILTER (WHERE distance < 0.8), '') AS context,
       CAST(COUNT(*) FILTER (WHERE distance < 0.8) AS INTEGER) AS context_hits
FROM nn LEFT JOIN documents d ON d.doc_id = nn.vec_id GROUP BY query_id""")
def q_retrieval_answer(spark, sf_dir):
    """The hits' whole documents as passages; queries with no, one and several hits in the context."""
    e = read_table(spark, sf_dir, "embeddings")
    tags = e.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("source"))
    passages = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("passage"))
    a = K.retrieval_answer(K.knn(e, query_vectors(e)), tags, passages)
    return a.select("query_id", F.array_join("sources", ",").alias("sources"),
                    round_half("confidence", 6).alias("confidence"), "context", "context_hits")


@register("corpus_chunks", "SRC-10", f"""
SELECT doc_id, CAST(k AS INTEGER) AS chunk_id, CAST(k * {C.CHUNK_SIZE - C.CHUNK_OVERLAP} AS INTEGER) AS chunk_start,
       substring(text, k * {C.CHUNK_SIZE - C.CHUNK_OVERLAP} + 1, {C.CHUNK_SIZE}) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - {C.CHUNK_SIZE}) / {float(C.CHUNK_SIZE - C.CHUNK_OVERLAP)}) AS BIGINT), 0) + 1)) AS k
      FROM documents) d""")
def q_corpus_chunks(spark, sf_dir):
    """Documents landed as Markdown files of many documents each, read back whole, split into documents, then chunked."""
    from paylens.sinks.writers import land_markdown
    from paylens.sources.files import read_landed_documents
    root = scratch_path(spark, "corpus")
    land_markdown(read_table(spark, sf_dir, "documents").select("doc_id", "text"), root)
    return K.chunk_text(read_landed_documents(spark, root)).select("doc_id", "chunk_id", "chunk_start", "chunk")
