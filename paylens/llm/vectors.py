"""Embedding near-duplicates by cross-polytope hashing.

A unit vector is rotated by random signs and fast Hadamard transforms (three
rounds); its nearest signed axis is one hash.  ``HASHES`` of them make a
table's code, and ``TABLES`` tables are probed at the code and at the codes
with one hash replaced by its second nearest axis, on both sides.  At a cosine
of 0.95 a pair of 64 dimensions shares a probed code in 0.67 of tables, so
eight tables miss it with a probability of about 1e-4 (measured recall: tests
and README).

Vectors of shared codes are verified in double precision.  Codes are merged by
their most popular member (the vector whose buckets are largest), so that the
many codes of a dense group become few groups, cut into blocks and compared
block against block; a pair in several groups is counted in the smallest.
Tasks return each vector's number of links and a spanning forest of the links,
never pairs.  Equal vectors are one node with a weight, so exact copies cost
one row.

Defined results: null, empty and zero vectors and such with null or non-finite
components link with nothing; vectors of different lengths never link; null
ids keep a null component and are kept; repeated rows are equal vectors (they
link with each other); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paylens.llm.components import components
from paylens.llm.minhash import _grouped, _root
from paylens.llm.store import stored, table
from paylens.session import ship_package

COSINE, TABLES, HASHES, ROUNDS, BLOCK = 0.95, 8, 3, 3, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row (their length is a power of two)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, seed: int = 8) -> np.ndarray:
    """Probed codes of unit row vectors: int64 [rows, TABLES * (HASHES + 1)]."""
    dim = x.shape[1]
    size = 1 << max(1, (dim - 1).bit_length())
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    padded, out = np.zeros((len(x), size)), []
    padded[:, :dim] = x
    for t in range(TABLES):
        first, second = [], []
        for _ in range(HASHES):
            y = padded
            for signs in rng.choice([-1.0, 1.0], (ROUNDS, size)):
                y = hadamard(y * signs)
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            turned = np.abs(np.take_along_axis(y, top[:, :1], 1)) < np.abs(np.take_along_axis(y, top[:, 1:], 1))
            top = np.where(turned, top[:, ::-1], top)
            axis = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            first.append(axis[:, 0])
            second.append(axis[:, 1])
        for swap in range(-1, HASHES):
            code = np.full(len(x), t + TABLES * dim, np.int64)
            for i in range(HASHES):
                code = code * (2 * size) + (second if i == swap else first)[i]
            out.append(code)
    return np.stack(out, 1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py():column.offsets[-1].as_py()]
    return values.reshape(len(column), -1)


def _code_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, vector) to (id, codes)."""
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for dim in np.unique(sizes):
            at = pa.array(np.flatnonzero(sizes == dim))
            x = _matrix(batch.column(1).take(at))
            x = x / np.abs(x).max(1, keepdims=True)
            c = codes(x / np.linalg.norm(x, axis=1, keepdims=True))
            offs = np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.ListArray.from_arrays(pa.array(offs), pa.array(c.ravel()))],
                                             names=["id", "codes"])


def _link_task(cosine: float):
    """Blocks (hub, i, j, block, id, weight, vector, hubs) to (id, links) counts and links of a spanning forest.

    Count rows have a null ``other``; forest rows have both ends and no count.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            t = t.combine_chunks()
            hub, i, j = (t.column(c)[0].as_py() for c in ("hub", "i", "j"))
            block, ids, weight = (t.column(c).to_numpy() for c in ("block", "id", "weight"))
            x = _matrix(t.column("vector").chunk(0))
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= block[:, None] != block
            if not linked.any():
                continue
            hubs = t.column("hubs").chunk(0)
            flat, sizes = hubs.values.to_numpy()[hubs.offsets[0].as_py():], np.diff(hubs.offsets.to_numpy())
            flat, owner = flat[:sizes.sum()], np.repeat(np.arange(len(t)), sizes)
            smaller = flat < hub
            if smaller.any():
                _, code = np.unique(flat[smaller], return_inverse=True)
                held = np.zeros((len(t), code.max() + 1), np.float32)
                held[owner[smaller], code] = 1
                linked &= held @ held.T == 0
            counts = linked @ weight
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            ends, root = [], {}
            for a in some:
                for b in np.flatnonzero(linked[a]):
                    u, v = _root(root, int(ids[a])), _root(root, int(ids[b]))
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        ends.append((int(ids[a]), int(ids[b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], np.array([a for a, _ in ends], np.int64)])),
                 pa.array([None] * len(some) + [b for _, b in ends], pa.int64()),
                 pa.array(np.concatenate([counts[some], np.zeros(len(ends), np.int64)]))], names=["id", "other", "links"])
    return task


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked by a cosine of at least ``cosine``."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) \
        & F.exists("vector", lambda v: v != 0) & F.col("vec_id").isNotNull()
    key = F.when(fine, F.struct(F.xxhash64(F.lit(1), "vector").alias("a"), F.xxhash64(F.lit(2), "vector").alias("b")))
    rows = rows.select("vec_id", "vector", key["a"].alias("ka"), key["b"].alias("kb"))
    nodes = stored(rows.filter("ka is not null").groupBy("ka", "kb").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")), "vectors-nodes")

    keys = stored(nodes.select("id", "vector").mapInArrow(_code_task, "id long, codes array<long>"), "vectors-codes") \
        .select("id", F.explode("codes").alias("key")).distinct()
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "vectors-buckets")
    members = stored(keys.join(sizes, "key"), "vectors-members")
    fame = stored(members.groupBy("id").agg(F.sum("size").alias("fame")), "vectors-fame")
    hubs = members.join(fame, "id").groupBy("key").agg(F.max(F.struct("fame", "id")).alias("top"))
    hubs = stored(hubs.select("key", F.col("top.id").alias("hub")), "vectors-hubs")
    groups = stored(members.select("key", "id").join(hubs, "key").select("hub", "id").distinct(), "vectors-groups")

    own = stored(groups.groupBy("id").agg(F.collect_set("hub").alias("hubs")), "vectors-own")
    blocks = stored(groups.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).select(
        "hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "vectors-blocks")
    dealt = groups.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))) \
        .select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
    full = dealt.join(nodes.select("id", "weight", "vector").join(own, "id"), "id").select(
        "hub", "i", "j", "block", "id", "weight", "vector", "hubs")
    found = stored(full.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
                   .mapInArrow(_link_task(cosine), "id long, other long, links long"), "vectors-links")

    links = found.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), "vectors-components")
    whole = stored(nodes.select("ka", "kb", "id", "weight").join(links, "id", "left").join(comp, "id", "left").select(
        "ka", "kb", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component")), "vectors-whole")
    return rows.select("vec_id", "ka", "kb").join(whole, ["ka", "kb"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
