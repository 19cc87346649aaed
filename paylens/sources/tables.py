"""Driver tables and the canonical ``transactions`` view derived from ``events``.

The adapter is a pure projection (no join, no shuffle): dimension lookups over
fixed domains are literal map/CASE expressions that stay inside whole-stage
codegen and are pruned by Catalyst when a query does not use them.  Its DuckDB
twin (``TRANSACTIONS_SQL``) is generated from the same constants.
"""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens import constants as C

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

TRANSACTION_COLUMNS = [
    "transaction_id", "merchant_id", "merchant_abn", "customer_id", "amount_aud",
    "currency", "timestamp", "merchant_category", "state", "payment_terminal",
    "card_type", "is_fraud", "is_outside_business_hours",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return cached(spark, ("table", path), lambda: spark.read.parquet(path))


def _literal_map(pairs) -> Column:
    args = []
    for k, v in pairs:
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def _pick(index: Column, values: list[str]) -> Column:
    """values[pmod(index, len)] as a CASE chain (no array bounds errors under ANSI)."""
    i = F.pmod(index, F.lit(len(values)))
    out = None
    for pos, v in enumerate(values):
        out = F.when(i == pos, F.lit(v)) if out is None else out.when(i == pos, F.lit(v))
    return out


def off_hours_flag(category: Column, hour: Column) -> Column:
    """J-1 over the fixed hours profile: hour < open or hour > close, unknown 8/20."""
    opens = F.coalesce(_literal_map([(c, o) for c, o, _ in C.BUSINESS_HOURS])[category],
                       F.lit(C.DEFAULT_OPEN_HOUR))
    closes = F.coalesce(_literal_map([(c, h) for c, _, h in C.BUSINESS_HOURS])[category],
                        F.lit(C.DEFAULT_CLOSE_HOUR))
    return (hour < opens) | (hour > closes)


def _spark_case(expr: str, pairs) -> str:
    whens = " ".join(f"WHEN {k!r} THEN {v!r}" if isinstance(k, str) else f"WHEN {k} THEN {v!r}"
                     for k, v in pairs)
    return f"CASE {expr} {whens} END"


def _adapter_exprs() -> tuple[list[str], list[str]]:
    """The adapter as Spark SQL expression strings (parsed once on the JVM side)."""
    k = "get_json_object(props, '$.k')"
    first = [
        "concat('T', lpad(CAST(event_id AS STRING), 10, '0')) AS transaction_id",
        "concat('M', lpad(CAST(user_id AS STRING), 5, '0')) AS merchant_id",
        "lpad(CAST(10000000000L + user_id AS STRING), 11, '0') AS merchant_abn",
        f"concat('C', lpad({k}, 8, '0')) AS customer_id",
        "CAST(value AS DOUBLE) AS amount_aud",
        f"{C.CURRENCY!r} AS currency",
        "ts AS timestamp",
        _spark_case(f"pmod(user_id, {len(C.CATEGORIES)})", list(enumerate(C.CATEGORIES))) + " AS merchant_category",
        _spark_case(f"pmod(user_id, {len(C.STATES)})", list(enumerate(C.STATES))) + " AS state",
        _spark_case("event_type", C.EVENT_TERMINAL) + " AS payment_terminal",
        f"CASE WHEN pmod(CAST({k} AS BIGINT), 3) = 0 THEN 'credit' ELSE 'debit' END AS card_type",
        f"coalesce(event_type = {C.FRAUD_EVENT_TYPE!r} AND value > {C.FRAUD_MIN_VALUE!r}D, false) AS is_fraud",
    ]
    opens = _spark_case("merchant_category", [(c, o) for c, o, _ in C.BUSINESS_HOURS])
    closes = _spark_case("merchant_category", [(c, h) for c, _, h in C.BUSINESS_HOURS])
    second = [c for c in TRANSACTION_COLUMNS if c != "is_outside_business_hours"] + [
        f"(hour(timestamp) < coalesce({opens}, {C.DEFAULT_OPEN_HOUR}) OR "
        f"hour(timestamp) > coalesce({closes}, {C.DEFAULT_CLOSE_HOUR})) AS is_outside_business_hours"]
    return first, second


def events_to_transactions(events: DataFrame) -> DataFrame:
    """Map the driver ``events`` table onto the 13-column transactions schema."""
    first, second = _adapter_exprs()
    return events.selectExpr(*first).selectExpr(*second)


_CACHE: dict[tuple, DataFrame] = {}


def cached(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Per-session reuse of table definitions (lazy DataFrames; no data is cached)."""
    k = (id(spark), spark.sparkContext.applicationId) + key
    if k not in _CACHE:
        _CACHE[k] = build()
    return _CACHE[k]


# ---- varied twin: the same rows with the cases that the driver's events lack --------------

# Changes by event number n, as expressions that both engines read alike.
_N = "CAST(substr(transaction_id, 2) AS BIGINT)"
VARIED = {
    "amount_aud": f"CASE WHEN {_N} % 40 = 0 THEN amount_aud * 64 WHEN {_N} % 41 = 0 THEN NULL "
                  f"WHEN {_N} % 43 = 0 THEN -amount_aud WHEN {_N} % 37 = 0 THEN amount_aud * 8192 ELSE amount_aud END",
    "merchant_category": f"CASE WHEN {_N} % 47 = 0 THEN 'unknown' WHEN {_N} % 53 = 0 THEN NULL ELSE merchant_category END",
    "state": f"CASE WHEN {_N} % 59 = 0 THEN 'ZZ' ELSE state END",
    "payment_terminal": f"CASE WHEN {_N} % 61 = 0 THEN 'crypto' ELSE payment_terminal END",
    "currency": f"CASE WHEN {_N} % 67 = 0 THEN 'USD' ELSE currency END",
    "timestamp": f"CASE WHEN {_N} % 3 = 0 THEN \"timestamp\" + INTERVAL '45' DAY ELSE \"timestamp\" END",
    "transaction_id": f"CASE WHEN {_N} % 71 = 0 THEN NULL WHEN {_N} % 73 = 0 THEN 'T0000000001' ELSE transaction_id END",
}


def varied_transactions(tx: DataFrame) -> DataFrame:
    """Transactions with large, negative and null amounts, unknown and null categories, an unknown
    state and terminal, a second currency, rows 45 days later, and null and repeated ids."""
    return tx.selectExpr(*[f"{VARIED[c].replace(chr(34), chr(96))} AS `{c}`" if c in VARIED else f"`{c}`"
                           for c in tx.columns])


_variant = contextvars.ContextVar("transactions_variant", default="given")


@contextlib.contextmanager
def variant(name: str):
    """Within the context, :func:`transactions` gives the named variant ("given" or "varied")."""
    token = _variant.set(name)
    try:
        yield
    finally:
        _variant.reset(token)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = cached(spark, ("transactions", sf_dir),
                   lambda: events_to_transactions(read_table(spark, sf_dir, "events")))
    return varied_transactions(given) if _variant.get() == "varied" else given


# ---- DuckDB twin ----------------------------------------------------------------

def _sql_pick(expr: str, values: list[str]) -> str:
    n = len(values)
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ((({expr}) % {n}) + {n}) % {n} {whens} END"


def _sql_values(rows, names, alias="t") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(names)})"


def transactions_sql() -> str:
    terminal = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in C.EVENT_TERMINAL)
    hours = _sql_values(C.BUSINESS_HOURS, ["merchant_category", "open_hour", "close_hour"], "h")
    return f"""
    transactions AS (
      SELECT b.transaction_id, b.merchant_id, b.merchant_abn, b.customer_id, b.amount_aud,
             b.currency, b."timestamp", b.merchant_category, b.state, b.payment_terminal,
             b.card_type, b.is_fraud,
             (hour(b."timestamp") < COALESCE(h.open_hour, {C.DEFAULT_OPEN_HOUR})
              OR hour(b."timestamp") > COALESCE(h.close_hour, {C.DEFAULT_CLOSE_HOUR}))
               AS is_outside_business_hours
      FROM (
        SELECT
          'T' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS transaction_id,
          'M' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS merchant_id,
          lpad(CAST(10000000000 + user_id AS VARCHAR), 11, '0') AS merchant_abn,
          'C' || lpad(json_extract_string(props, '$.k'), 8, '0') AS customer_id,
          CAST(value AS DOUBLE) AS amount_aud,
          '{C.CURRENCY}' AS currency,
          ts AS "timestamp",
          {_sql_pick('user_id', C.CATEGORIES)} AS merchant_category,
          {_sql_pick('user_id', C.STATES)} AS state,
          CASE event_type {terminal} END AS payment_terminal,
          CASE WHEN ((CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) + 3) % 3 = 0
               THEN 'credit' ELSE 'debit' END AS card_type,
          COALESCE(event_type = '{C.FRAUD_EVENT_TYPE}' AND value > {C.FRAUD_MIN_VALUE}, FALSE) AS is_fraud
        FROM events
      ) b
      LEFT JOIN {hours} ON b.merchant_category = h.merchant_category
    )"""


TRANSACTIONS_SQL = transactions_sql()


def varied_sql(oracle: str) -> str:
    """An oracle over transactions, read over the varied twin."""
    given = TRANSACTIONS_SQL.strip()
    assert given in oracle
    columns = ", ".join((f"{VARIED[c]} AS " if c in VARIED else "") + (f'"{c}"' if c == "timestamp" else c)
                        for c in TRANSACTION_COLUMNS)
    renamed = given.replace("transactions AS (", "given_transactions AS (", 1)
    return oracle.replace(given, f"{renamed},\n    transactions AS (SELECT {columns} FROM given_transactions)")


def with_transactions(body: str, *ctes: str) -> str:
    """Prefix an oracle query with the adapter CTE (and optional further CTEs)."""
    extra = "".join(f",\n    {c}" for c in ctes)
    return f"WITH {TRANSACTIONS_SQL.strip()}{extra}\n{body}"
