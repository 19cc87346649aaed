"""Question answering over a questions table (X-4 … X-11, SNK-6 rows).

Each question row is guarded (X-4), classified (X-9), answered from per-merchant
aggregates joined on merchant_id (A-10 … A-13), output-guarded (X-3) and turned
into an audit row — one distributed join instead of one SQL call per question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions import text as T


def questions_from_conversations(conversations: DataFrame, events: DataFrame) -> DataFrame:
    """User turns as questions, each assigned a merchant that exists in ``events``."""
    n = events.select(F.max("user_id") + 1).scalar()
    return (conversations.filter(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("question"),
                    F.concat(F.lit("M"), F.lpad(F.pmod(F.col("conv_id"), n).cast("string"), 5, "0"))
                    .alias("merchant_id")))


def template_sql(question, merchant) -> F.Column:
    """The deterministic SQL answer template (revenue/sales -> daily revenue, else count)."""
    low = F.lower(question)
    rev = (F.instr(low, F.lit("revenue")) > 0) | (F.instr(low, F.lit("sales")) > 0)
    return F.when(rev, F.concat(
        F.lit("SELECT DATE(timestamp) AS day, SUM(amount_aud) AS total_revenue FROM transactions "
              "WHERE merchant_id = '"), merchant,
        F.lit("' GROUP BY DATE(timestamp) ORDER BY day DESC LIMIT 30"))).otherwise(F.concat(
            F.lit("SELECT COUNT(*) AS txn_count FROM transactions WHERE merchant_id = '"), merchant,
            F.lit("' LIMIT 1")))


def guard_questions(q: DataFrame) -> DataFrame:
    reason = T.query_guard_reason(F.col("question"))
    return (q.withColumn("reason", reason)
            .withColumn("status", F.when(F.col("reason").isNull(), F.lit("allowed")).otherwise(F.lit("blocked"))))


def merchant_answers(tx: DataFrame) -> DataFrame:
    """Per-merchant answer sentences for the four chat intents, from one scan.

    The rows are aggregated once by (merchant, category, state, hour); revenue,
    fraud, peak-hour and profile answers are all re-aggregations of that small
    table, so the transactions are read and shuffled a single time.
    """
    from paylens.functions.numeric import round_half
    cube = tx.groupBy("merchant_id", "merchant_category", "state", F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("amount_aud").cast("decimal(24,6)")).alias("s"),
        F.count("amount_aud").alias("na"),
        F.count(F.when(F.col("is_fraud"), 1)).alias("f"),
        F.sum(F.when(F.col("is_fraud"), F.col("amount_aud")).otherwise(F.lit(0.0)).cast("decimal(24,6)")).alias("fs"))
    per_m = cube.groupBy("merchant_id").agg(
        F.sum("n").alias("transaction_count"), F.sum("s").alias("_s"), F.sum("na").alias("_na"),
        F.sum("f").alias("fraud_count"), F.sum("fs").alias("_fs"))
    per_m = per_m.select(
        "merchant_id", "transaction_count", "fraud_count",
        round_half(F.col("_s").cast("double"), 2).alias("total_revenue"),
        round_half(F.col("_s").cast("double") / F.nullif(F.col("_na").cast("double"), F.lit(0.0)), 2)
        .alias("avg_transaction"),
        round_half(F.col("_fs").cast("double"), 2).alias("fraud_value"))
    hours = cube.groupBy("merchant_id", "hour").agg(F.sum("n").alias("txn_count"))
    rank = Window.partitionBy("merchant_id").orderBy(F.desc("txn_count"), "hour")          # <= 24 rows
    peaks = (hours.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= 3)
             .groupBy("merchant_id")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "hour", "txn_count"))).alias("_p")))   # <= 3
    prof = (cube.groupBy("merchant_id", "merchant_category", "state")
            .agg(F.sum("n").alias("profile_count"), F.sum("s").alias("_ps"))
            .withColumn("_r", F.row_number().over(Window.partitionBy("merchant_id")
                                                  .orderBy("merchant_category", "state")))
            .filter(F.col("_r") == 1)
            .select("merchant_id", "merchant_category", "state", "profile_count",
                    round_half(F.col("_ps").cast("double"), 2).alias("profile_total")))
    peak_text = F.array_join(F.transform("_p", lambda p: F.format_string(
        "%02d:00 (%d txns)", p["hour"], p["txn_count"])), ", ")
    m = per_m.join(peaks, "merchant_id", "left").join(prof, "merchant_id", "left")
    return m.select(
        "merchant_id",
        F.format_string("Merchant %s processed %d transactions with total revenue of %.2f AUD and average "
                        "transaction %.2f AUD.", "merchant_id", "transaction_count", "total_revenue",
                        "avg_transaction").alias("revenue_answer"),
        F.format_string("Merchant %s: %d suspicious transactions out of %d total, potential fraud value %.2f AUD.",
                        "merchant_id", "fraud_count", "transaction_count", "fraud_value").alias("fraud_answer"),
        F.concat(F.lit("Peak hours for "), F.col("merchant_id"), F.lit(": "), peak_text).alias("peak_answer"),
        F.format_string("Merchant %s is a %s business in %s with %d transactions totaling %.2f AUD.",
                        "merchant_id", "merchant_category", "state", "profile_count", "profile_total")
        .alias("profile_answer"))


def answer_questions(questions: DataFrame, tx: DataFrame) -> DataFrame:
    """X-10: guard -> intent -> answer -> output guard, one row per question (audit shape)."""
    g = guard_questions(questions).withColumn(
        "intent", T.keyword_intent(F.col("question"), C.CHAT_INTENTS, C.CHAT_DEFAULT))
    a = merchant_answers(tx)
    j = g.join(a, "merchant_id", "left")
    blocked_text = (F.when(F.col("reason") == "cross_merchant",
                           F.lit("Cross-merchant data access denied. You can only query your own merchant data."))
                    .when(F.col("reason") == "injection", F.lit("Potentially malicious query detected and blocked."))
                    .otherwise(F.lit("PII data cannot be retrieved through the query interface. "
                                     "This request has been logged for compliance review.")))
    no_data = F.concat(F.lit("No data found for merchant "), F.col("merchant_id"), F.lit("."))
    answer = (F.when(F.col("intent") == "revenue", F.col("revenue_answer"))
              .when(F.col("intent") == "fraud", F.col("fraud_answer"))
              .when(F.col("intent") == "peak", F.coalesce(
                  F.col("peak_answer"),
                  F.concat(F.lit("No hourly data found for merchant "), F.col("merchant_id"), F.lit("."))))
              .otherwise(F.coalesce(F.col("profile_answer"), no_data)))
    response = F.when(F.col("status") == "blocked", blocked_text).otherwise(T.response_guard(answer))
    return j.select("conv_id", "turn", "merchant_id", "status", "reason", "intent",
                    response.alias("response"),
                    F.left(F.col("question"), F.lit(100)).alias("query_snippet"), "question",
                    F.length(response).alias("response_length"))


def scope_check(requests: DataFrame, token_col: str = "token", merchant_col: str = "merchant_id") -> DataFrame:
    """X-11: allow when the token's merchant equals the requested merchant, else deny."""
    tok = T.token_merchant(F.col(token_col))
    return requests.withColumn("token_merchant", tok).withColumn(
        "decision", F.when(tok.isNull(), F.lit("invalid_token"))
        .when(tok == F.col(merchant_col), F.lit("allow")).otherwise(F.lit("deny")))
