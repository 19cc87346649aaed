"""ST-6 / SNK-7: latest-per-merchant feature snapshot as a log-structured store.

A micro-batch writes only its own latest rows per merchant, as a delta
``version=<batch id>`` in hash buckets; bytes written follow the batch, not the
number of merchants.  A reader merges the newest base with the deltas after it
(latest row per merchant).  When the deltas have grown to the size of the base
they are compacted into a new base ``base=<batch id>``, so each row is rewritten
a logarithmic number of times; bases and deltas that no kept version needs are
removed.

Writes are overwrites of directories named by the batch id, and a directory
counts once its ``_SUCCESS`` file is there: a replayed or half-written batch
changes nothing, and a version can be read as long as it is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.operators.features import latest_snapshot
from paylens.session import remove_path

SNAPSHOT_COLS = ["merchant_id", "event_ts", "transaction_id", "amount_aud", "state", "payment_terminal",
                 "card_type", "anomaly_score"]
ORDER = ("event_ts", "transaction_id")
#: hash buckets of the store, rows below which deltas are not compacted, and versions that stay readable
BUCKETS, LEAST_ROWS, KEPT_VERSIONS = 16, 100_000, 8


def _listed(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Ids of the complete directories ``kind=<id>`` below ``root``, ascending."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [(st.getPath(), st.getPath().getName()) for st in fs.listStatus(path)]
    return sorted(int(name.split("=", 1)[1]) for p, name in names
                  if name.startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _at(root: str, kind: str, number: int) -> str:
    return f"{root}/{kind}={number:012d}"


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("merchant_id"), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    """Rows by bucket, so that a reader of some merchants skips the other files and row groups by their bounds."""
    _bucketed(rows, buckets).repartition("bucket").sortWithinPartitions("bucket", "merchant_id").write.mode("overwrite").parquet(path)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Latest row per merchant of the parts."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return latest_snapshot(rows, "merchant_id", ORDER)


def _parts(spark: SparkSession, root: str, upto: int) -> tuple[int | None, list[int]]:
    """The newest base not after ``upto`` and the deltas from there to ``upto``."""
    base = max((b for b in _listed(spark, root, "base") if b <= upto), default=None)
    return base, [v for v in _listed(spark, root, "version") if v <= upto and (base is None or v > base)]


def version(spark: SparkSession, root: str, number: int, merchants: list[str] | None = None) -> DataFrame | None:
    """The snapshot after batch ``number`` (None: nothing written by then); with ``merchants`` only their buckets are read."""
    base, deltas = _parts(spark, root, number)
    paths = ([] if base is None else [_at(root, "base", base)]) + [_at(root, "version", v) for v in deltas]
    if not paths:
        return None
    parts = [spark.read.parquet(p) for p in paths]
    if merchants is not None:
        wanted = [r.b for r in _bucketed(spark.createDataFrame([(m,) for m in merchants], "merchant_id string"), BUCKETS)
                  .select(F.col("bucket").alias("b")).distinct().collect()]
        parts = [p.filter(F.col("bucket").isin(wanted) & F.col("merchant_id").isin(merchants)) for p in parts]
    return _merged([p.drop("bucket") for p in parts])


def latest_version(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest snapshot."""
    return version(spark, root, (1 << 62))


def compact(spark: SparkSession, root: str, upto: int, buckets: int = BUCKETS, kept: int = KEPT_VERSIONS) -> None:
    """Write the snapshot after batch ``upto`` as a base, and remove what no version from ``upto - kept`` on needs."""
    whole = version(spark, root, upto)
    if whole is None:
        return
    _write(whole, _at(root, "base", upto), buckets)
    oldest = max((b for b in _listed(spark, root, "base") if b <= upto - kept), default=None)
    if oldest is None:
        return
    for kind in ("base", "version"):
        for number in _listed(spark, root, kind):
            if number < oldest or kind == "version" and number == oldest:
                remove_path(spark, _at(root, kind, number))


def upsert_snapshot(batch: DataFrame, root: str, batch_id: int, buckets: int = BUCKETS, least_rows: int = LEAST_ROWS,
                    kept: int = KEPT_VERSIONS) -> None:
    """Add a micro-batch as a delta; compact once the deltas are as large as the base."""
    spark = batch.sparkSession
    base = max(_listed(spark, root, "base"), default=None)
    if base is not None and batch_id <= base:
        return  # a replay of a batch that the base already holds
    cur = batch.select(*[c for c in SNAPSHOT_COLS if c in batch.columns])
    _write(latest_snapshot(cur, "merchant_id", ORDER), _at(root, "version", batch_id), buckets)
    base, deltas = _parts(spark, root, batch_id)
    added = sum(spark.read.parquet(_at(root, "version", v)).count() for v in deltas)
    held = spark.read.parquet(_at(root, "base", base)).count() if base is not None else 0
    if added >= max(held, least_rows):
        compact(spark, root, batch_id, buckets, kept)
