"""Uniform sharding by a hypergeometric communication matrix, in DataFrame functions only.

The rows lie in blocks (the input's partitions, cut at ``BLOCK_ROWS``).  How
many rows of each block go to each shard is drawn first: the counts of a
uniform shuffle with exact shard sizes follow a multivariate hypergeometric
law, drawn block by block from what the shards still need.  Then every block is
permuted locally and dealt out by its counts, the rows are exchanged by shard,
and every shard is permuted again: rows get random keys, the keys' ranges are
counted, and a row's slot is its range's offset plus its rank inside the range,
so a shard is as many tasks as it needs.

The driver reads the block sizes one after the other (one per ``BLOCK_ROWS``
rows or partition) and writes the matrix as a table, ``LINES`` lines at a time;
it holds neither as a whole, and rows never pass it.  Random keys are hashes of
a stored row number, so recomputed tasks agree.

The law is ``rows``: shard sizes differ by one row at most.  ``grown_shard`` is
null (it belongs to the ``key`` law).

Defined results: a null text has size 1 and the checksum of no bytes, 0; rows
that repeat get slots of their own; with fewer rows than shards some shards are
empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice, tee

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paylens.llm.store import appended, stored, table

BLOCK_ROWS, RANGE_ROWS, LEAST_RANGES, LINES = 1 << 20, 1 << 17, 8, 4096


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement from ``good + bad`` are good: inversion outward from the mode."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    weights, total = [(mode, 1.0)], 1.0
    for step in (1, -1):
        k, w = mode, 1.0
        while lo <= k + step <= hi and w > 1e-18:
            if step > 0:
                w *= (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))
            else:
                w *= k * (bad - n + k) / ((good - k + 1) * (n - k + 1))
            k += step
            weights.append((k, w))
            total += w
    u = rng.random() * total
    for k, w in weights:
        u -= w
        if u < 0:
            return k
    return mode


def communication_lines(sizes: Iterable[int], total: int, shards: int, seed: int) -> Iterator[list[int]]:
    """Rows to send from each block (``total`` in all) to each shard, block by block."""
    rng = random.Random(seed)
    need = [total // shards + (j < total % shards) for j in range(shards)]
    for size in sizes:
        left, rest, line = size, sum(need), []
        for j in range(shards):
            rest -= need[j]
            line.append(hypergeometric(rng, need[j], rest, left))
            left -= line[-1]
        need = [a - b for a, b in zip(need, line)]
        yield line


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows to send from each block to each shard; columns sum to the exact shard sizes."""
    return list(communication_lines(sizes, sum(sizes), shards, seed))


def _matrix_parts(spark: SparkSession, sizes: DataFrame, total: int, shards: int, seed: int) -> Iterator[DataFrame]:
    """The matrix as small frames (block, ends): a shard's last rank in each block's dealing order."""
    names, counts = tee(((r.block, r.n) for r in sizes.orderBy("block").toLocalIterator()))
    lines = zip((name for name, _ in names), communication_lines((n for _, n in counts), total, shards, seed))
    while part := [{"block": name, "ends": list(accumulate(line))} for name, line in islice(lines, LINES)]:
        yield spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(part)), "array<struct<block:string,ends:array<long>>>")))


def _uniform(key: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(key, 11) / float(1 << 53)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 9) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")
    at = F.col("row").bitwiseAND((1 << 33) - 1)
    block = F.concat_ws("-", F.shiftright("row", 33), F.floor(at / BLOCK_ROWS))
    rows = rows.withColumn("block", block)

    sizes = stored(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "shard-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    matrix = appended(spark, _matrix_parts(spark, sizes, total, shards, seed), "block string, ends array<long>", "shard-matrix")

    local = Window.partitionBy("block").orderBy(F.xxhash64("row", F.lit(seed), F.lit("local")), "row")
    dealt = rows.withColumn("rank", F.row_number().over(local)).join(matrix, "block")
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int")
    ranges = max(LEAST_RANGES, -(-total // (shards * RANGE_ROWS)))
    key = F.xxhash64("row", F.lit(seed), F.lit("shard"))
    dealt = stored(dealt.select("doc_id", "size", "text_crc32", "row", shard.alias("shard"), key.alias("key"),
                                F.floor(_uniform(key) * ranges).cast("long").alias("range")), "shard-dealt")

    counts = dealt.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    again = Window.partitionBy("shard", "range").orderBy(_uniform(F.col("key")), "row")
    return dealt.withColumn("rank", F.row_number().over(again)).join(offsets, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("offset") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
