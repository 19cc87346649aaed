"""MinHash near-duplicates by a multi-index Hamming join.

A text's word 5-shingles give 40 minimum hashes of 16 bits each, four to a
64-bit chunk.  Two signatures that differ in at most 19 of the 40 symbols
differ in at most one symbol of some chunk (pigeonhole: 10 chunks with two
errors each would be 20), so each chunk is indexed under the four keys that
leave one symbol out: every pair within that distance shares a bucket.  At a
Jaccard similarity of 0.75 a pair differs in 10 symbols on average, in 20 or
more with a probability of 5.7e-4, and shares no bucket with one of 1.5e-6;
only the last are missed.  Pairs that share a bucket are compared on their full
shingle sets whatever their distance.

Buckets are searched in two waves.  First every member is paired with two hubs
of its bucket, the smallest id and the most popular member (the one whose
buckets are largest: of a text and its edited copies, the text).  The
confirmed links' components leave few buckets with members of different
components.  These are merged by their popular hub, so that the up to 40
buckets of a group of copies become one, cut into blocks of ``BLOCK`` members,
and compared block against block: on signatures first, which names the
documents that still share a bucket with one in another component, then on
those documents' full sets.  Tasks return documents and links between components,
never pairs, so no row count grows with the square of a group.

Equal sets are one node from the start, so groups of copies cost one row.

Defined results: a null or wordless text has no shingles and links with
nothing (its component is its own id); rows with a null id keep a null
component and are kept; rows that repeat an id are one document; extra columns
are ignored by :func:`near_duplicates`.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from paylens.llm.components import components
from paylens.llm.store import stored
from paylens.llm.words import blocks, mix, row_shingles, span_hashes
from paylens.session import ship_package

CHUNKS, PER_CHUNK = 10, 4
SYMBOLS = CHUNKS * PER_CHUNK
#: signature distance within which every pair shares a bucket; no pair is dropped for a larger one
MAX_DISTANCE = 2 * CHUNKS - 1
#: members of a residual group that one task compares with as many others
BLOCK = 256

_rng = np.random.Generator(np.random.PCG64(75))
_A = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_X = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_SIG = [f"s{i}" for i in range(CHUNKS)]
_SIG_TYPE = "doc_id long, n_shingles long, fp binary, " + ", ".join(f"{s} long" for s in _SIG)


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chunks of the signatures of non-empty rows: int64 [rows, CHUNKS]."""
    out = np.zeros((len(starts), CHUNKS), np.uint64)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat(mix_one(hashes, k), starts)
        symbol = mix(least) >> np.uint64(48)
        out[:, k // PER_CHUNK] |= symbol << np.uint64(16 * (k % PER_CHUNK))
    return out.view(np.int64)


def mix_one(hashes: np.ndarray, k: int) -> np.ndarray:
    h = (hashes ^ _X[k]) * _A[k]
    return h ^ (h >> np.uint64(31))


def _signature_task(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                hashes = span_hashes(block.buf, block.starts, block.ends)
                vals, first = row_shingles(block, hashes, shingle)
                n = len(first) - 1
                size, fps, sig = np.zeros(n, np.int64), [None] * n, np.zeros((n, CHUNKS), np.int64)
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    sig[some] = signatures(vals, first[some])
                for r in some:
                    own = np.unique(vals[first[r]:first[r + 1]])
                    size[r], fps[r] = len(own), xxhash.xxh3_128_digest(own.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.lo, n), pa.array(size), pa.array(fps, pa.binary())]
                    + [pa.array(np.ascontiguousarray(sig[:, i])) for i in range(CHUNKS)],
                    names=["doc_id", "n_shingles", "fp", *_SIG])
    return task


def _set_task(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                hashes = span_hashes(block.buf, block.starts, block.ends)
                vals, first = row_shingles(block, hashes, shingle)
                sets = [np.unique(vals[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.lo, len(sets)), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                    names=["id", "shingles"])
    return task


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _keys() -> Column:
    """The 40 keys of a signature: each chunk without one of its four symbols."""
    def key(i: int, j: int) -> Column:
        kept = F.col(_SIG[i]).bitwiseAND(F.lit(~(0xFFFF << (16 * j)) if j < 3 else 0x0000FFFFFFFFFFFF).cast("long"))
        return F.xxhash64(F.lit(i * PER_CHUNK + j), kept)
    return F.array(*[key(i, j) for i in range(CHUNKS) for j in range(PER_CHUNK)])


def _near(a: str, b: str, percent: int) -> Column:
    """Size test that every pair over the similarity passes."""
    return F.least(a + "n", b + "n") * 100 >= F.greatest(a + "n", b + "n") * percent


def _sided(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("id").alias(side), F.col("n").alias(side + "n"))


def _sets(docs: DataFrame, ids: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    wanted = ids.select(F.col("id").alias("doc_id")).hint("merge")  # their number has no bound: never broadcast
    texts = _texts(docs, id_col, text_col).join(wanted, "doc_id", "leftsemi")
    return stored(texts.mapInArrow(_set_task(shingle), "id long, shingles array<long>"), "minhash-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").select(
        "a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    return both.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns; a run may span batches."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        new = np.zeros(len(t), bool)
        for i in range(keys):
            v = t.column(i).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cut = np.flatnonzero(new)
        for a, b in zip([0, *cut[:-1]] if len(cut) else [], cut):
            yield t.slice(a, b - a)
        rest = t.slice(cut[-1] if len(cut) else 0)
    if rest is not None and len(rest):
        yield rest


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in ("i", "j", "block", "id", "c", "n")}


def _open(v: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Pairs of a block task to compare: across its two blocks, in different components, of fitting sizes."""
    n, c = v["n"], v["c"]
    fit = np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * percent
    fit &= c[:, None] != c
    if v["i"][0] != v["j"][0]:
        fit &= (v["block"] == v["i"])[:, None] & (v["block"] == v["j"])
    return fit


def _near_task(percent: int):
    """Blocks of signatures to the ids that share a bucket with one in a different component."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            v = _columns(t)
            pairs = _open(v, percent)
            if not pairs.any():
                continue
            sig = np.stack([t.column(s).to_numpy() for s in _SIG], 1).view(np.uint16)
            meet = np.zeros(pairs.shape, bool)
            for k in range(0, SYMBOLS, PER_CHUNK):
                far = np.zeros(pairs.shape, np.uint8)
                for j in range(k, k + PER_CHUNK):
                    far += sig[:, j, None] != sig[:, j]
                meet |= far <= 1
            pairs &= meet
            found = pairs.any(1) | pairs.any(0)
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(v["id"][found]))], names=["id"])
    return task


def _link_task(percent: int):
    """Blocks of full sets to links between components (a spanning forest of the confirmed pairs)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 3):
            v = _columns(t)
            pairs = _open(v, percent)
            if not pairs.any():
                continue
            sets = t.column("shingles").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            offs = sets.offsets.to_numpy()
            flat = sets.values.to_numpy()[offs[0]:offs[-1]]
            _, code = np.unique(flat, return_inverse=True)
            owner = np.repeat(np.arange(len(t)), np.diff(offs))
            order = np.argsort(code, kind="stable")
            holder, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
            links, root = [], {}
            for x in np.flatnonzero(pairs.any(1)):
                own = code[offs[x] - offs[0]:offs[x + 1] - offs[0]]
                lo, size = first[own], first[own + 1] - first[own]
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                both = np.bincount(holder[at], minlength=len(t))
                ok = pairs[x] & (both * 100 >= (v["n"] + v["n"][x] - both) * percent)
                for y in np.flatnonzero(ok):
                    a, b = _root(root, int(v["c"][x])), _root(root, int(v["c"][y]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((int(v["c"][x]), int(v["c"][y])))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return task


def _root(root: dict[int, int], x: int) -> int:
    while x in root:
        x = root[x]
    return x


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (hub, id, c, ...) of hubs with members in different components, once for each block pair they are in."""
    sizes = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1")) \
        .filter("size > 1 and c0 < c1").select("hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(stored(sizes, "minhash-sizes"), "hub") \
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))) \
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.select("hub", "i", "j", "block", *[c for c in rows.columns if c != "hub"]) \
        .repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate groups of ``docs``."""
    ship_package(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    sig = stored(texts.mapInArrow(_signature_task(shingle), _SIG_TYPE), "minhash-signatures")
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(named.groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
                                             *[F.first(s).alias(s) for s in _SIG]), "minhash-classes")
    nodes = classes.drop("fp")

    keys = nodes.select("id", F.explode(_keys()).alias("key"))
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "minhash-buckets")
    members = stored(keys.join(sizes, "key"), "minhash-members")
    fame = stored(members.groupBy("id").agg(F.sum("size").alias("fame")), "minhash-fame")
    famed = members.join(fame, "id").groupBy("key").agg(
        F.min("id").alias("h0"), F.max(F.struct("fame", (-F.col("id")).alias("id"))).alias("h1"))
    hubs = stored(famed.select("key", "h0", (-F.col("h1.id")).alias("h1")), "minhash-hubs")
    groups = stored(members.select("key", "id").join(hubs, "key").groupBy("h1", "id", "h0").agg(F.lit(1).alias("one"))
                    .select("h0", "h1", "id"), "minhash-groups")

    pairs = groups.select("id", F.explode(F.array("h0", "h1")).alias("h")).filter("id <> h") \
        .select(*_ordered(F.col("id"), F.col("h"))).distinct()
    pairs = pairs.join(_sided(nodes, "a"), "a").join(_sided(nodes, "b"), "b").filter(_near("a", "b", percent))
    pairs = stored(pairs.select("a", "b"), "minhash-pairs")
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), shingle, id_col, text_col)
    comp = stored(components(_confirmed(pairs, sets, percent)), "minhash-components")

    named_groups = groups.select(F.col("h1").alias("hub"), "id").distinct().join(comp, "id", "left") \
        .select("hub", "id", F.coalesce("component", "id").alias("c"))
    named_groups = stored(named_groups, "minhash-named")
    near = _in_blocks(named_groups.join(nodes, "id")).mapInArrow(_near_task(percent), "id long")
    near = stored(near.distinct(), "minhash-near")
    more = _sets(docs, near, shingle, id_col, text_col).withColumn("n", F.size("shingles"))
    found = _in_blocks(named_groups.join(more, "id")).mapInArrow(_link_task(percent), "a long, b long")
    top = components(found).select(F.col("id").alias("component"), F.col("component").alias("top"))

    whole = classes.select("fp", "id").join(comp, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    whole = stored(whole.join(stored(top, "minhash-top"), "component", "left")
                   .select("fp", F.coalesce("top", "component").alias("component")), "minhash-found")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sig.join(whole, "fp", "left").select(
        "doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"))


def op1(spark, sf_dir: str) -> DataFrame:
    from paylens.llm.store import table
    return near_duplicates(table(spark, sf_dir, "documents"))
