"""File sources (SRC-1, SRC-2, SRC-3, SRC-10, SRC-11)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens import schemas
from paylens.sources import records


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-1: CSV with header under a declared schema (PERMISSIVE: bad fields -> NULL)."""
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE")
              .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-2: Parquet by extension or directory, CSV for ``.csv``; a missing
    ``x.parquet`` falls back to a sibling ``x.csv`` when that exists."""
    lower = path.lower()
    if lower.endswith(".csv"):
        return read_csv(spark, path, schema)
    if lower.endswith(".parquet") and not _exists(spark, path):
        alt = path[: -len(".parquet")] + ".csv"
        if _exists(spark, alt):
            return read_csv(spark, alt, schema)
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: landed raw JSON lines; malformed lines land in ``_corrupt_record``."""
    return (spark.read.schema(schemas.RAW_TRANSACTIONS)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path))


def read_markdown_corpus(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """SRC-10: every file matching ``pattern`` below ``root`` as one row (source path, whole text)."""
    return (spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
            .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")))


def read_landed_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents (doc_id, text) of the files that ``land_markdown`` wrote, each file read whole; null ids and texts come back null."""
    corpus = read_markdown_corpus(spark, root, pattern="*.txt")
    part = corpus.select(F.explode(F.split("text", records.DOCUMENT)).alias("p")).filter(F.col("p") != "")
    head, body = F.substring_index("p", "\n", 1), F.expr("substring(p, instr(p, chr(10)) + 1)")
    # the text writer ends each document with one line separator; drop exactly that one
    text = records.unescape_document(F.left(body, F.length(body) - 1))
    return part.select(F.nullif(F.substr(head, F.lit(2)), F.lit("")).cast("bigint").alias("doc_id"),
                       F.when(F.left(head, F.lit(1)) == "t", text).alias("text"))


def table_or_path(spark: SparkSession, name_or_path: str) -> DataFrame:
    """SRC-11: the same query against a catalog table or a path (name binding, no SQL rewrite)."""
    if os.sep in name_or_path or name_or_path.endswith((".parquet", ".csv")):
        return read_dataset(spark, name_or_path)
    return spark.table(name_or_path)
