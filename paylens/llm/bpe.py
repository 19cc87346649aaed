"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks of ``chunk`` characters, each with ``overlap`` more
from its successor.  Chunks are pre-tokenised in parallel.  Where two
neighbours share a pre-token boundary in their overlap, the text is stitched:
the left chunk ends and the right one begins there.  Only boundaries between a
character that is no white space and one that is are used, since no match of
the pattern crosses such a place: the two sides resynchronise there whatever
came before.  Neighbours without one (a run longer than the overlap) are
joined into one piece.  The pieces are then encoded, in parallel too, and a
text's ids are its pieces' ids in order.  Decoding concatenates the ids' raw
bytes.

Most texts are one chunk and are encoded where they are read; only the chunks
of longer ones are shuffled, so one very long text becomes many tasks.

Defined results: null reads as empty and gives no ids; invalid UTF-8 reads as
U+FFFD; rows that repeat are encoded each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from paylens.llm.store import stored, table
from paylens.llm.words import texts
from paylens.session import ship_package

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK, OVERLAP = 1 << 16, 1 << 10
_OUT_BYTES = 4 << 20


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def id_lists(lists: list[np.ndarray]) -> pa.ListArray:
    offs = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)])))


def _encode_task(path: str):
    """Batches (keys..., text) to (keys..., ids)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            keys, lo, size, out = batch.num_columns - 1, 0, 0, []
            for text in texts(batch.column(keys)):
                out.append(np.array(enc.encode_ordinary(text), np.int32))
                size += len(text)
                if size > _OUT_BYTES:
                    yield _ids(batch, keys, lo, out)
                    lo, size, out = lo + len(out), 0, []
            yield _ids(batch, keys, lo, out)
    return task


def _ids(batch: pa.RecordBatch, keys: int, lo: int, out: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(i).slice(lo, len(out)) for i in range(keys)] + [id_lists(out)],
                                      names=[*batch.schema.names[:keys], "ids"])


def _chunk_task(chunk: int, overlap: int):
    """Batches (row_id, doc_id, text) to one row per chunk with its overlap."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, doc, text in zip(rows, ids, texts(batch.column(2))):
                starts = list(range(0, len(text), chunk))
                for lo in range(0, len(starts), 32):
                    part = starts[lo:lo + 32]
                    yield pa.RecordBatch.from_pydict(
                        {"row_id": [row] * len(part), "doc_id": pa.array([doc] * len(part), pa.int64()),
                         "no": [s // chunk for s in part], "text": [text[s:s + chunk + overlap] for s in part]},
                        schema=pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int64()),
                                          ("text", pa.string())]))
    return task


def boundaries(text: str, pattern: regex.Pattern, lo: int, hi: int) -> list[int]:
    """Ends of pre-tokens in [lo, hi) that no match crosses in any text: white space follows something else."""
    return [m.end() for m in pattern.finditer(text)
            if lo <= m.end() < hi and not text[m.end() - 1].isspace() and text[m.end()].isspace()]


def _boundary_task(pattern: str, chunk: int, overlap: int):
    """Boundaries of each chunk in the overlap at its head and at its tail, counted from the overlap's start."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text in texts(batch.column(2)):
                ends = boundaries(text, compiled, 0, len(text))
                heads.append([e for e in ends if e < overlap])
                tails.append([e - chunk for e in ends if e >= chunk])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                names=["row_id", "no", "head", "tail"])
    return task


def stitched(chunks: DataFrame, chunk: int, overlap: int, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(row_id, doc_id, piece, text): the chunks cut where neighbours resynchronise, joined where they do not."""
    spread = chunks.select("row_id", "no", "text").repartition("row_id", "no")
    ends = stored(spread.mapInArrow(_boundary_task(pattern, chunk, overlap),
                                    "row_id long, no long, head array<int>, tail array<int>"), "bpe-boundaries")
    cuts = ends.select("row_id", (F.col("no") + 1).alias("no"), "tail").join(
        ends.select("row_id", "no", "head"), ["row_id", "no"]) \
        .select("row_id", "no", F.array_min(F.array_intersect("tail", "head")).alias("cut"))
    w = Window.partitionBy("row_id").orderBy("no")
    plan = ends.select("row_id", "no").join(cuts, ["row_id", "no"], "left").select(
        "row_id", "no", F.col("cut").alias("begin"), F.lead("cut").over(w).alias("end"),
        F.count("cut").over(w).alias("piece"))
    start = F.coalesce("begin", F.lit(0))
    part = F.substring(F.col("text"), start + 1, F.lit(chunk) + F.coalesce("end", F.lit(0)) - start)
    parts = chunks.join(plan, ["row_id", "no"]).select("row_id", "doc_id", "piece", "no", part.alias("part"))
    return parts.groupBy("row_id", "doc_id", "piece").agg(
        F.array_sort(F.collect_list(F.struct("no", "part"))).alias("parts")).select(
        "row_id", "doc_id", "piece", F.concat_ws("", F.col("parts.part")).alias("text"))


def encode(docs: DataFrame, path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = rows.filter(F.length("text") <= chunk).mapInArrow(_encode_task(path), "doc_id long, ids array<int>")
    long_rows = rows.filter(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    chunks = stored(long_rows.mapInArrow(_chunk_task(chunk, overlap), "row_id long, doc_id long, no long, text string"),
                    "bpe-chunks")
    pieces = stitched(chunks, chunk, overlap).repartition("row_id", "piece")
    coded = pieces.mapInArrow(_encode_task(path), "row_id long, doc_id long, piece long, ids array<int>")
    many = coded.groupBy("row_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p")) \
        .select("doc_id", F.flatten(F.col("p.ids")).alias("ids"))
    return one.union(many)


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, data) of (doc_id, ids): the ids' raw bytes, one after the other."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [joined(ids, path) for ids in _lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.large_binary()).cast(pa.binary())],
                                             names=["doc_id", "data"])
    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, data binary")


@functools.lru_cache(maxsize=4)
def _bytes_of(path: str) -> list[bytes]:
    table_ = ranks(path)
    out = [b""] * (max(table_.values()) + 1)
    for raw, i in table_.items():
        out[i] = raw
    return out


@functools.lru_cache(maxsize=1)
def _decimal(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def joined(ids: list[int], path: str = RANKS) -> bytes:
    return b"".join(map(_bytes_of(path).__getitem__, ids))


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    values, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(offs[:-1], offs[1:]):
        yield values[a:b].tolist()


def digests(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _decimal(len(_bytes_of(path)))
        for batch in batches:
            n, a, b = [], [], []
            for ids in _lists(batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
                b.append(hashlib.sha256(joined(ids, path)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return encoded.select("doc_id", "ids").mapInArrow(
        task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
