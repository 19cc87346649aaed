"""G-1: ordered global running totals without a single-partition window.

1. pre-aggregate by the ordering key (a hot key collapses to one row): one read;
2. range-partition the distinct keys; the partitions are the buckets, as many as
   the size asks for, frozen with a reliable checkpoint (range bounds are
   sampled, so they must not be recomputed);
3. per-bucket totals -> exclusive prefix offsets (one row per partition, never
   data), joined back by broadcast;
4. a running sum inside each bucket (partitioned window) plus the offset.

Result: for each distinct key k, ``cum_<m>`` = sum of m over all keys <= k
(or >= k when ``descending``).  Exact; the ranges only balance the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions.numeric import round_half
from paylens.session import cut_lineage


#: bytes of the planner's size estimate that one bucket should hold, and the least number of buckets
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 64


def bucket_count(df: DataFrame) -> int:
    """Buckets for ``df`` from the planner's size estimate (no job is run); where it knows none, the
    session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return least if size >= 1 << 56 else max(least, size // BUCKET_BYTES)


def with_offsets(ranged: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Rows of range partitions (``_pid``) with ``_o_<name>``: the measures' totals of all partitions before."""
    totals = ranged.groupBy("_pid").agg(*[F.sum(m).alias(f"_t_{name}") for name, m in measures.items()])
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{name}").over(upto), F.lit(0)).alias(f"_o_{name}") for name in measures])
    return ranged.join(F.broadcast(offsets), "_pid")


def global_cumulative(df: DataFrame, key: str, measures: list[str], buckets: int | None = None,
                      descending: bool = False) -> DataFrame:
    k = F.col(key).cast("double")
    ordered = -k if descending else k
    per_key = df.groupBy(ordered.alias("_k")).agg(*[F.sum(m).alias(m) for m in measures])
    ranged = cut_lineage(per_key.repartitionByRange(buckets or bucket_count(df), "_k").withColumn("_pid", F.spark_partition_id()))
    running = Window.partitionBy("_pid").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return with_offsets(ranged, {m: F.col(m) for m in measures}).select(
        (-F.col("_k") if descending else F.col("_k")).alias(key),
        *measures,
        *[(F.col(f"_o_{m}") + F.sum(m).over(running)).alias(f"cum_{m}") for m in measures])


def grouped_cumulative(df: DataFrame, group: str, key: str, measures: list[str], buckets: int | None = None) -> DataFrame:
    """``global_cumulative`` within each ``group``: (group, key, measures, cum_*); a group of any size is many buckets."""
    per_key = df.groupBy(group, F.col(key).cast("double").alias("_k")).agg(*[F.sum(m).alias(m) for m in measures])
    ranged = cut_lineage(per_key.repartitionByRange(buckets or bucket_count(df), group, "_k").withColumn("_pid", F.spark_partition_id()))
    upto = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_pid", group).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])  # at most partitions + groups rows
    offsets = totals.select("_pid", group, *[F.coalesce(F.sum(f"_t_{m}").over(upto), F.lit(0)).alias(f"_o_{m}") for m in measures])
    running = Window.partitionBy("_pid", group).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(offsets), ["_pid", group]).select(
        group, F.col("_k").alias(key), *measures, *[(F.col(f"_o_{m}") + F.sum(m).over(running)).alias(f"cum_{m}") for m in measures])


def merchant_percentile(tx: DataFrame) -> DataFrame:
    """W-15 / J-3 for all merchants: % of merchants whose mean ticket <= own."""
    from paylens.functions.numeric import money_avg
    avg = cut_lineage(tx.groupBy("merchant_id").agg(money_avg("amount_aud").alias("avg_ticket")))   # one read of tx
    total = avg.select(F.count(F.lit(1))).scalar()
    # G-1 pre-aggregates by the key itself, so merchants sharing a mean collapse there
    cum = global_cumulative(avg.select("avg_ticket", F.lit(1).cast("bigint").alias("n")), "avg_ticket", ["n"])
    return (avg.join(cum.select("avg_ticket", "cum_n"), "avg_ticket", "left")
            .select("merchant_id",
                    round_half(F.lit(100.0) * F.col("cum_n").cast("double") / total.cast("double"), 2)
                    .alias("state_percentile")))


def ordered_positions(df: DataFrame, order_cols: list[str], partitions: int | None = None,
                      out: str = "_pos") -> DataFrame:
    """1-based global position by ``order_cols`` (any orderable types; make them unique).

    G-1 for keys that are not numbers: range-partition by the ordering, and add
    the partition's offset to a row number inside it.  No step gathers the rows
    in one task.
    """
    ranged = cut_lineage(df.repartitionByRange(partitions or bucket_count(df), *order_cols)
                         .withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid").orderBy(*order_cols)
    return with_offsets(ranged, {"n": F.lit(1).cast("long")}).withColumn(out, F.col("_o_n") + F.row_number().over(local)) \
        .drop("_pid", "_o_n")
