"""Intermediate tables in the cluster's shared checkpoint folder, and small helpers.

A table written here outlives the executors that made it, so it cuts lineage
without ``localCheckpoint``.  The folder is the one named in
``spark.checkpoint.dir``; a scratch folder is made only in local mode where the
setting is absent (tests).  Tables of a session are removed when it exits.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from paylens.session import shared_dir, ship_package

_WRITTEN: dict[str, SparkSession] = {}


def _remove_all() -> None:
    for path, spark in _WRITTEN.items():
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            conf = spark._jsc.hadoopConfiguration() if spark._jsc else jvm.org.apache.hadoop.conf.Configuration()
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    if not _WRITTEN:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(spark: SparkSession, parts, schema: str, name: str) -> DataFrame:
    """Write small frames one after the other to one table in the shared folder and read it back."""
    if not _WRITTEN:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*").write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(docs: DataFrame, columns: tuple[str, ...], text: str = "text") -> tuple[DataFrame, int, str]:
    """``columns`` and the text (sent once), the text's place among them, and the columns' schema."""
    ship_package(docs.sparkSession)
    sent = [F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in columns]
    if text not in columns:
        sent.append(F.col(text).cast("string").alias(text))
    rows = docs.select(*sent)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*columns).dtypes)
    return rows, rows.columns.index(text), schema


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0 (a null id counts as held out)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))
