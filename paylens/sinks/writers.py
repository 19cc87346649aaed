"""Sinks (SNK-1 … SNK-9): partitioned files, tables, snapshots, audit and metrics.

Writes are idempotent where the caller retries (whole-layer overwrite, versioned
snapshot directories and table partitions keyed by batch id), so a lost executor or a
re-run micro-batch never duplicates rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.sources.records import DOCUMENT, escape_document


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str], mode: str = "overwrite") -> None:
    """SNK-1: cleaned layer partitioned by (category, state); overwrite replaces the whole layer.

    Rows are rebalanced by the partition columns first, so each task writes few
    files per partition, and adaptive execution splits a partition that many
    rows share into as many tasks as its size needs.
    """
    (df.hint("rebalance", *[F.col(c) for c in partition_cols]).write.mode(mode)
     .option("partitionOverwriteMode", "static").partitionBy(*partition_cols).parquet(path))


def append_table(df: DataFrame, table: str, path: str | None = None, batch_id: str | None = None) -> None:
    """SNK-2: append to a catalog table (created on first write, at ``path`` if given).

    With ``batch_id`` the table is partitioned by that column and the write
    replaces the batch's own partition, so a retried append changes nothing; a
    table is written with batch ids always or never.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        rows = [c for c in spark.table(table).columns if batch_id is None or c != "batch_id"]
        if batch_id is None:
            df.select(*rows).write.mode("append").insertInto(table)
        else:
            quoted = batch_id.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch_id = '{quoted}') SELECT * FROM {{rows}}", rows=df.select(*rows))
    else:
        w = df.write if batch_id is None else df.withColumn("batch_id", F.lit(batch_id)).write.partitionBy("batch_id")
        w = w.mode("append")
        (w.option("path", path) if path else w).saveAsTable(table)


def land_markdown(docs: DataFrame, root: str, rows_per_file: int = 500) -> None:
    """SRC-10 landing: documents (doc_id, text) as text files of many documents each.

    A document is a separator, a line with ``t`` or ``n`` (null text) and its id,
    and its text, escaped where it holds the separator itself.
    """
    head = F.concat(F.lit(DOCUMENT), F.when(F.col("text").isNull(), F.lit("n")).otherwise(F.lit("t")),
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"))
    docs.select(F.concat(head, escape_document(F.coalesce("text", F.lit("")))).alias("value")) \
        .write.option("maxRecordsPerFile", rows_per_file).text(root)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK-3: write Parquet (or CSV with header when asked) — no silent fallback."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt}")


def register_table(spark: SparkSession, name: str, df: DataFrame, replace: bool = False) -> bool:
    """SNK-4: create-or-replace a view; skipped when it already exists unless ``replace``."""
    if not replace and spark.catalog.tableExists(name):
        return False
    df.createOrReplaceTempView(name)
    return True


def with_processing_partitions(df: DataFrame) -> DataFrame:
    """SNK-5: year/month/day/hour of the processing time as hive partition columns."""
    now = F.current_timestamp()
    return (df.withColumn("year", F.year(now)).withColumn("month", F.format_string("%02d", F.month(now)))
            .withColumn("day", F.format_string("%02d", F.dayofmonth(now)))
            .withColumn("hour", F.format_string("%02d", F.hour(now))))


def write_raw_json(df: DataFrame, path: str) -> None:
    """SNK-5 batch form: JSON lines under year=/month=/day=/hour= of processing time."""
    (with_processing_partitions(df).write.mode("append")
     .partitionBy("year", "month", "day", "hour").json(path))


def prediction_rows(scores: DataFrame, model_version: str, features_used: list[str]) -> DataFrame:
    """SNK-6 ml_prediction events of scored transactions (transaction_id, merchant_id, anomaly_score,
    explanation)."""
    now = F.current_timestamp()
    return scores.select(
        F.lit("ml_prediction").alias("event_type"), now.alias("timestamp"), "transaction_id", "merchant_id",
        "anomaly_score", F.lit(model_version).alias("model_version"),
        F.array(*[F.lit(f) for f in features_used]).alias("features_used"),
        F.col("explanation").alias("explanation_summary"),
        F.year(now).alias("year"), F.format_string("%02d", F.month(now)).alias("month"),
        F.format_string("%02d", F.dayofmonth(now)).alias("day"))


def audit_rows(answers: DataFrame, request_id: Column | None = None, confidence: float = 0.9) -> DataFrame:
    """SNK-6: one audit row per question (blocked or agent interaction), union schema.

    ``request_id`` defaults to conversation and turn; ``confidence`` is that of
    answers computed from the tables.
    """
    if request_id is None:
        request_id = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    now = F.current_timestamp()
    blocked = F.col("status") == "blocked"
    return answers.select(
        F.when(blocked, F.lit("query_blocked")).otherwise(F.lit("agent_interaction")).alias("event_type"),
        now.alias("timestamp"), "merchant_id",
        F.when(blocked, F.col("query_snippet")).alias("query_snippet"),
        F.when(blocked, F.col("reason")).alias("block_reason"),
        F.when(blocked, F.lit("HIGH")).alias("severity"),
        F.when(~blocked, request_id).alias("request_id"),
        F.when(~blocked, F.col("question")).alias("query"),
        F.when(~blocked, F.lit(confidence)).alias("confidence"),
        F.when(~blocked, F.col("intent")).alias("intent_classified"),
        F.when(~blocked, F.col("response_length")).alias("response_length"),
        F.year(now).alias("year"), F.format_string("%02d", F.month(now)).alias("month"),
        F.format_string("%02d", F.dayofmonth(now)).alias("day"))


def write_audit(rows: DataFrame, root: str) -> None:
    """SNK-6: append JSON under audit/event_type=/year=/month=/day=."""
    rows.write.mode("append").partitionBy("event_type", "year", "month", "day").json(root)


def write_snapshot(snapshot: DataFrame, root: str, version: int) -> str:
    """SNK-7: versioned snapshot directory (idempotent for a given version / batch id)."""
    path = f"{root}/version={int(version):012d}"
    snapshot.write.mode("overwrite").parquet(path)
    return path


def feature_records(snapshot: DataFrame, key: str = "merchant_id") -> DataFrame:
    """SNK-7 EAV projection: (key, FeatureName, ValueAsString) via explode of a map."""
    cols = [c for c in snapshot.columns if c != key]
    m = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])
    return snapshot.select(key, F.explode(m).alias("FeatureName", "ValueAsString"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    """SNK-8: append long metric rows."""
    metrics.withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """SNK-9: a report frame (A-21, one row) as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
