"""Stream record codec (SNK-10, SRC-9) and key validation (P-2, U-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens import constants as C

RECORD_FIELDS = "transaction_id string, merchant_id string, amount_aud double, timestamp string"


def encode_records(tx: DataFrame) -> DataFrame:
    """SNK-10: key = merchant_id (partition key), value = JSON of the whole row."""
    cols = [F.col(c) for c in tx.columns]
    opts = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
            "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return tx.select(F.col("merchant_id").alias("key"), F.to_json(F.struct(*cols), opts).alias("value"))


def to_base64(records: DataFrame) -> DataFrame:
    return records.select("key", F.base64(F.encode(F.col("value"), "UTF-8")).alias("data"))


def decode_base64(data: Column) -> Column:
    """SRC-9: base64 -> UTF-8 text; undecodable input -> NULL (no task failure)."""
    return F.try_to_binary(data, F.lit("base64")).cast("string")


def missing_keys(value: Column) -> Column:
    """P-2 / U-4: sorted required keys absent from the JSON object (null values count as present)."""
    return absent_keys(F.json_object_keys(value))


def absent_keys(present: Column) -> Column:
    """Sorted required keys that are not among ``present``."""
    return F.array_sort(F.array_except(F.array(*[F.lit(k) for k in C.REQUIRED_STREAM_KEYS]),
                                       F.coalesce(present, F.array().cast("array<string>"))))


def decode_and_validate(records: DataFrame, data_col: str = "data") -> DataFrame:
    """Decode, parse and split: ``valid`` rows have every required key and parse as JSON."""
    text = decode_base64(F.col(data_col))
    return (records.withColumn("value", text)
            .withColumn("missing_keys", missing_keys(F.col("value")))
            .withColumn("parsed", F.from_json("value", RECORD_FIELDS))
            .withColumn("valid", F.col("value").isNotNull() & F.json_object_keys("value").isNotNull()
                        & (F.size("missing_keys") == 0)))


#: Begins each document of a landed file (an ASCII record separator).
DOCUMENT = "\x1e"


def escape_document(text: Column) -> Column:
    """``text`` without ``DOCUMENT``; every backslash is followed by its own mark, so nothing is lost."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit(DOCUMENT), F.lit("\\r"))


def unescape_document(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\r"), F.lit(DOCUMENT)), F.lit("\\s"), F.lit("\\"))
