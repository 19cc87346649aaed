"""Guardrail and PII cases of the reference, as table tests (F8, F9)."""

import pytest

from paylens import constants as C
from paylens.functions import text as T
from paylens.operators.sqlscope import check_sql, run_scoped_sql

QUERIES = [
    ("What was my revenue last week?", None),
    ("Show me all merchants revenue", "cross_merchant"),
    ("'; DROP TABLE transactions; --", "injection"),
    ("something UNION SELECT * FROM users", "injection"),
    ("Show me customer card numbers", "pii"),
    ("What is the customer email for order 123?", "pii"),
    ("What is my average transaction amount?", None),
    ("merchant_id != 'M1'", "cross_merchant"),
    ("1 or 1=1", "injection"),
    ("/* hidden */ revenue", "injection"),
    ("ALL   MERCHANTS please", "cross_merchant"),
]


def test_query_guard(spark):
    df = spark.createDataFrame([(q,) for q, _ in QUERIES], "q string")
    got = [r[0] for r in df.select(T.query_guard_reason("q")).collect()]
    assert got == [e for _, e in QUERIES]


def test_response_guard_and_redaction(spark):
    rows = [("Card 4111-1111-1111-1111 on file",), ("All good here.",),
            ("card 4111111111111111 and john.doe@example.com",), ("id 12345678901234567 is not a card",),
            ("two 1111222233334444 5555666677778888 cards",)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select(T.response_guard("t").alias("g"), T.redact_pii("t").alias("r")).collect()
    assert out[0].g == C.RESPONSE_PII_REPLACEMENT
    assert out[1].g == "All good here."
    assert out[2].r == "card [REDACTED_CARD] and [REDACTED_EMAIL]"
    assert out[3].r == "id 12345678901234567 is not a card"
    assert out[4].r == "two [REDACTED_CARD] [REDACTED_CARD] cards"


@pytest.mark.parametrize("email,masked", [
    ("john.doe@example.com", "j******e@example.com"),
    ("ab@x.com", "**@x.com"),
    ("a@x.com", "*@x.com"),
    ("no-at-sign", "no-at-sign"),
    ("a@b@c", "a@b@c"),
    ("josé.garcía@correo.es", "j*********a@correo.es"),
])
def test_mask_email(spark, email, masked):
    assert spark.createDataFrame([(email,)], "e string").select(T.mask_email("e")).first()[0] == masked


def test_unicode_email_redaction(spark):
    r = spark.createDataFrame([("write to josé@ex.com",)], "t string").select(T.redact_pii("t")).first()[0]
    assert r == "write to [REDACTED_EMAIL]"


def test_sql_guards(spark):
    df = spark.createDataFrame([
        ("SELECT COUNT(*) FROM transactions WHERE merchant_id = 'M1'", "M1"),
        ("SELECT COUNT(*) FROM transactions", "M1"),
        ("DROP TABLE transactions -- M1", "M1"),
        ("SELECT updated FROM t WHERE merchant_id = 'M1'", "M1"),
    ], "sql string, m string")
    got = df.select(T.sql_guard_reason("sql", "m").alias("r"), T.is_readonly("sql").alias("ro")).collect()
    assert [r.r for r in got] == [None, "missing_merchant_filter", "dangerous:DROP", "dangerous:UPDATE"]
    assert [r.ro for r in got] == [True, True, False, True]
    ws = spark.createDataFrame([("\nSELECT 1",), ("\t with x as (select 1) select * from x\u00a0",)], "s string")
    assert [r[0] for r in ws.select(T.is_readonly("s")).collect()] == [True, True]
    line_separator = spark.createDataFrame([("/* a\u2028b */",)], "s string")
    assert line_separator.select(T.query_guard_reason("s")).first()[0] == "injection"


REFUSED = [
    "SELECT 1", "SELECT count(*) FROM transactions", "DROP TABLE transactions -- 'M00001'", "not sql 'M00001'",
    "SELECT count(DISTINCT user_id), 'M00001' FROM parquet.`/root/testdata/sf0.001/events.parquet`",
    "SELECT * FROM other_table WHERE merchant_id = 'M00001'",
    "SELECT * FROM transactions WHERE merchant_id = 'M00001' AND amount_aud > (SELECT max(x) FROM other_table)",
    "WITH a AS (SELECT * FROM other_table) SELECT * FROM a WHERE merchant_id = 'M00001'",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM transactions WHERE merchant_id = 'M00001'",
    "SELECT * FROM range(5), transactions WHERE merchant_id = 'M00001'",
    "INSERT INTO transactions SELECT * FROM transactions WHERE merchant_id = 'M00001'",
    "SELECT 1 FROM transactions WHERE merchant_id = 'M00001'; SELECT 2",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_statements_outside_the_scope_are_refused(spark, sql):
    with pytest.raises(ValueError):
        check_sql(spark, sql, "M00001")


SECRET_COUNT = "SELECT 'M00001' m, count(distinct user_id) n FROM secret"
BYPASSES = [
    "WITH secret AS (SELECT * FROM secret) " + SECRET_COUNT,                     # the inner name is the catalog's view
    "SELECT 'M00001' m, (SELECT count(distinct user_id) FROM secret) n FROM (WITH secret AS (SELECT 1 x) SELECT * FROM secret) a",
    "WITH `parquet./root/testdata/sf0.001/events.parquet` AS (SELECT 1 x) "
    "SELECT 'M00001' m, count(*) n FROM parquet.`/root/testdata/sf0.001/events.parquet`",
    "WITH a AS (WITH secret AS (SELECT 1 user_id) SELECT * FROM secret) SELECT 'M00001' m, s.user_id FROM a, secret s",
    "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 user_id) SELECT 'M00001' m, user_id FROM a",
    "WITH `global_temp.secret` AS (SELECT 1 x) SELECT 'M00001' m, count(*) FROM global_temp.secret",
    "WITH t AS (SELECT 'M00001' m) SELECT * FROM t WHERE EXISTS (SELECT 1 FROM global_temp.transactions)",
    "SELECT 'M00001' m, (SELECT max(n) FROM (SELECT count(*) n FROM global_temp.secret)) FROM transactions",
    "SELECT count(*) FROM transactions t, LATERAL (SELECT * FROM global_temp.secret s WHERE s.user_id > 0) WHERE 'M00001' = 'M00001'",
    "SELECT TRANSFORM(merchant_id) USING 'cat /etc/passwd' AS line FROM transactions WHERE merchant_id = 'M00001'",
    "SELECT max(length(reflect('java.lang.System', 'getenv', 'HOME'))) FROM transactions WHERE merchant_id = 'M00001'",
    "SELECT count(*) FROM transactions WHERE merchant_id = 'M00001' AND java_method('java.lang.System', 'lineSeparator') <> ''",
    "SELECT input_file_name() FROM transactions WHERE merchant_id = 'M00001'",
    "SELECT _metadata.file_path FROM transactions WHERE merchant_id = 'M00001'",
    "SELECT scope_probe_udf(merchant_id) FROM transactions WHERE merchant_id = 'M00001'",
    "SELECT 'M00001') a, (SELECT 1", "SHOW TABLES", "SET spark.sql.runSQLOnFiles = true -- 'M00001'",
    "SELECT /* 'M00001' */ count(*) FROM transactions",
]


@pytest.mark.parametrize("sql", BYPASSES)
def test_names_out_of_scope_do_not_reach_other_rows(spark, sql):
    """Names that the statement defines elsewhere, quotes or spells like a path; the views exist in the caller's session."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.createOrReplaceTempView("secret")
    events.createOrReplaceGlobalTempView("secret")
    events.createOrReplaceGlobalTempView("transactions")
    spark.udf.register("scope_probe_udf", lambda x: x)
    from paylens.sources.tables import transactions
    try:
        with pytest.raises(ValueError):
            run_scoped_sql(spark, sql, "M00001", transactions(spark, "/root/testdata/sf0.001"))
        with pytest.raises(ValueError):
            check_sql(spark, sql, "M00001")
    finally:
        spark.catalog.dropTempView("secret")
        spark.catalog.dropGlobalTempView("secret")
        spark.catalog.dropGlobalTempView("transactions")


USUAL = [
    "SELECT category, state, round(avg(amount), 2) FROM t GROUP BY ROLLUP (category, state) HAVING count(*) > 0 ORDER BY 1, 2",
    "SELECT day, amount, sum(amount) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) w, "
    "lag(amount) OVER (ORDER BY day) before, rank() OVER (ORDER BY amount DESC) r FROM "
    "(SELECT date(at) day, sum(amount) amount FROM t GROUP BY date(at)) d",
    "SELECT date_trunc('week', at) week, count(DISTINCT terminal), count_if(amount BETWEEN 10 AND 50), max_by(id, amount) FROM t GROUP BY 1",
    "SELECT hour(at) h, extract(DAY FROM at) d, at - INTERVAL 1 DAY y, datediff(current_date(), date(at)) > 0 old, "
    "CASE WHEN amount > 50 THEN 'high' ELSE 'low' END size, coalesce(card, 'none') card, concat_ws('-', state, category) k FROM t LIMIT 7",
    "SELECT percentile_approx(amount, 0.5), median(amount), stddev(amount), array_join(sort_array(collect_set(state)), ',') FROM t",
    "SELECT * FROM t a JOIN (SELECT terminal, count(*) n FROM t GROUP BY terminal) b USING (terminal) WHERE a.amount > "
    "(SELECT avg(amount) FROM t x WHERE x.state = a.state) AND a.category LIKE '%e%' AND a.state IN ('NSW', 'VIC', 'QLD')",
    "(SELECT id FROM t WHERE fraud UNION ALL SELECT id FROM t EXCEPT SELECT id FROM t WHERE off) LIMIT 3",
    "SELECT state, n FROM (SELECT state, explode(sequence(1, 2)) n FROM t) WHERE n > 1",
    "SELECT * FROM (SELECT state, amount FROM t) PIVOT (sum(amount) FOR state IN ('NSW', 'VIC'))",
    "SELECT try_divide(sum(amount), count_if(fraud)), grouping(state) FROM t GROUP BY CUBE (state)",
    "SELECT *, 'M00001' k FROM VALUES ('M00001', 1) AS v(m, x)",
]


@pytest.mark.parametrize("sql", USUAL)
def test_usual_questions_run(spark, sql):
    from paylens.sources.tables import transactions
    tx = transactions(spark, "/root/testdata/sf0.001")
    own = ("WITH t AS (SELECT transaction_id id, merchant_category category, state, amount_aud amount, `timestamp` at, "
           "payment_terminal terminal, card_type card, is_fraud fraud, is_outside_business_hours off "
           "FROM transactions WHERE merchant_id = 'M00001') ")
    tx.createOrReplaceTempView("all_transactions")
    got = run_scoped_sql(spark, own + sql if "VALUES" not in sql else sql, "M00001", tx).collect()
    want = spark.sql((own + sql).replace("FROM transactions", "FROM all_transactions")).collect()
    spark.catalog.dropTempView("all_transactions")
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_session_of_a_statement_is_its_own(spark):
    from paylens.sources.tables import transactions
    spark.conf.set("spark.sql.session.timeZone", "Australia/Sydney")
    try:
        found = run_scoped_sql(spark, "SELECT current_timezone(), 'M00001' m, count(*) n FROM transactions", "M00001",
                               transactions(spark, "/root/testdata/sf0.001"))
        assert found.first()[0] == "Australia/Sydney"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert not spark.catalog.tableExists("transactions")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_scoped_statements(spark):
    from paylens.sources.tables import transactions
    tx = transactions(spark, "/root/testdata/sf0.001")
    tx.createOrReplaceTempView("transactions")                       # a view of all rows must not be read
    own = tx.filter("merchant_id = 'M00001'").count()
    run = lambda sql: run_scoped_sql(spark, sql, "M00001", tx).collect()
    assert run("SELECT count(*) FROM transactions WHERE merchant_id = 'M00001';")[0][0] == own
    assert run("SELECT count(*) FROM transactions WHERE merchant_id IN ('M00001', 'M00002')")[0][0] == own
    assert run("SELECT count(*) FROM (SELECT * FROM Transactions) t WHERE '{M00001}' <> 'M00001'")[0][0] == own
    rows = run("SELECT 'all transactions' AS transactions, 'M00001' AS m FROM transactions LIMIT 1")
    assert rows[0].asDict() == {"transactions": "all transactions", "m": "M00001"}
    assert run("WITH transactions AS (SELECT * FROM transactions WHERE merchant_id = 'M00001') "
               "SELECT count(*) FROM transactions")[0][0] == own
    assert run("SELECT max(n) FROM (WITH a AS (SELECT count(*) n FROM transactions WHERE merchant_id = 'M00001') "
               "SELECT * FROM a)")[0][0] == own
    spark.catalog.dropTempView("transactions")


def test_intents(spark):
    df = spark.createDataFrame([("How much revenue?",), ("Any fraud?",), ("Explain terminal",), ("hello",),
                                ("When are we busy",)], "q string")
    r = df.select(T.keyword_intent("q", C.ROUTER_INTENTS, C.ROUTER_DEFAULT).alias("a"),
                  T.keyword_intent("q", C.CHAT_INTENTS, C.CHAT_DEFAULT).alias("b")).collect()
    assert [x.a for x in r] == ["sql", "anomaly", "rag", "rag", "rag"]
    assert [x.b for x in r] == ["revenue", "fraud", "profile", "profile", "peak"]


def test_token_scope(spark):
    from paylens.operators.questions import scope_check
    df = spark.createDataFrame([("merchant:M1", "M1"), ("merchant:M2", "M1"), ("bogus", "M1")],
                               "token string, merchant_id string")
    assert [r.decision for r in scope_check(df).collect()] == ["allow", "deny", "invalid_token"]
