"""Declared schemas (inference is never used; streaming requires it anyway)."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_abn", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("amount_aud", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("payment_terminal", T.StringType()),
    T.StructField("card_type", T.StringType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("is_outside_business_hours", T.BooleanType()),
])

# Raw landed JSON: everything as text, parsed and cast by the cleaning step.
RAW_TRANSACTIONS = T.StructType([
    T.StructField(f.name, T.StringType()) for f in TRANSACTIONS.fields
] + [T.StructField("_corrupt_record", T.StringType())])

OBSERVATION = T.StructType([
    T.StructField("TIME_PERIOD", T.StringType()),
    T.StructField("OBS_VALUE", T.DoubleType()),
])

PROVENANCE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("records", T.LongType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("live_attempted", T.BooleanType()),
    T.StructField("live_success", T.BooleanType()),
    T.StructField("fallback_used", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

STREAM_RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])
