"""Packing into sequences by cutting-stock column generation.

A document is its token ids and a closing id 0, cut into whole sequences of
``CAPACITY`` ids and one remainder.  The remainders' length histogram is a
cutting-stock problem: which patterns (sets of lengths that fit a sequence) and
how often each, so that few sequences hold them all.  Its linear program is
solved by column generation: the simplex method over the patterns found so
far, whose prices a knapsack dynamic program turns into the best new pattern,
until no pattern improves the bound by more than ``GAP``.  The solution is
rounded down; the few lengths left over are packed best fit decreasing.

Pieces are ranked inside their length and take the patterns' slots in rank
order, so sequences get exact numbers and offsets from a join with the (bounded)
slot table.  A length that many documents share is ranked in salted parts.

Only the histogram (at most ``CAPACITY`` lengths) and the patterns are on the
driver.  Sequences are padded to ``CAPACITY`` unless their fill is a power of
two.

Ids are those of the ``tokenizers`` library for ``byte_bpe_50k.json``; texts in
Latin-1, whose pre-tokens do not depend on the library's Unicode version, are
encoded by the same vocabulary's tiktoken ranks, which is four times as fast
(tests compare the two).

Defined results: null reads as empty (one id); rows that repeat are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from paylens.llm.bpe import RANKS, ranks
from paylens.llm.store import stored, table
from paylens.llm.words import texts
from paylens.session import ship_package

CAPACITY, END = 1024, 0
GAP, MAX_COLUMNS = 1e-3, 400
PART_ROWS = 1 << 14
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str):
    library = Tokenizer.from_file(json_path)
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(ranks_path),
                             special_tokens=special)
    return library, fast, set(special)


def token_ids(text: str, json_path: str = TOKENIZER, ranks_path: str = RANKS) -> list[int]:
    """The library's ids of a text, without added special tokens."""
    library, fast, special = _encoders(json_path, ranks_path)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return library.encode(text, add_special_tokens=False).ids
    return fast.encode(text, allowed_special=special, disallowed_special=())


def _piece_task(json_path: str, ranks_path: str, capacity: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = np.array(token_ids(text, json_path, ranks_path) + [END], "<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    out.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return task


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_path: str = TOKENIZER, ranks_path: str = RANKS) -> DataFrame:
    """Every document's ids and closing id cut at multiples of ``capacity``."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_piece_task(json_path, ranks_path, capacity),
                           "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of lengths within the capacity, as counts."""
    value = np.zeros(capacity + 1)
    fits = lengths <= capacity
    value[lengths[fits]] = np.maximum(price[fits], 0)
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        options = value[1:c + 1] + best[c - 1::-1][:c]
        k = int(options.argmax())
        best[c], take[c] = options[k], k + 1
    counts, c, index = np.zeros(len(lengths), int), capacity, {int(n): i for i, n in enumerate(lengths)}
    while c > 0 and best[c] > 0:
        i = index.get(int(take[c]))
        if i is not None and price[i] > 0:
            counts[i] += 1
        c -= int(take[c])
    return float(best[capacity]), counts


def first_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis: the largest open length, filled up with open lengths (abundant ones first), until one runs out.

    Every pattern uses up a length that no later one holds, so the basis is triangular.
    """
    m, left = len(lengths), demand.astype(float).copy()
    basis, is_open = np.zeros((m, m)), np.ones(m, bool)
    for _ in range(m):
        top = int(np.flatnonzero(is_open)[-1])
        value = np.where(is_open, lengths * (1 + 1e-4 * left / left.max()), 0.0)
        _, pattern = best_pattern(lengths, value, capacity - int(lengths[top]))
        pattern[top] += 1
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        out = int(ratio.argmin())
        left = np.maximum(left - ratio[out] * pattern, 0)
        basis[:, out], is_open[out], left[out] = pattern, False, 0
        if not left.any():  # the rest ran out at the same time: patterns of their own, not used
            for i in np.flatnonzero(is_open):
                basis[i, i] = max(1, capacity // int(lengths[i]))
            break
    return basis


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY,
                  gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns, counts by length) of the linear program's last basis and their use."""
    basis = first_patterns(lengths, demand, capacity)
    inverse = np.linalg.inv(basis)
    use = np.maximum(inverse @ demand, 0)
    bound = float(demand @ lengths) / capacity  # prices in proportion to length are a feasible dual
    for k in range(MAX_COLUMNS):
        price = inverse.sum(0)
        worth, pattern = best_pattern(lengths, price, capacity)
        bound = max(bound, float(use.sum()) / worth)  # so are these prices divided by the best pattern's worth
        if worth <= 1 + 1e-9 or use.sum() <= bound * (1 + gap):
            break
        step = inverse @ pattern
        rising = step > 1e-9
        out = int(np.argmin(np.where(rising, use / np.where(rising, step, 1), np.inf)))
        basis[:, out] = pattern
        if k % 100 == 99:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
        use = np.maximum(inverse @ demand, 0)
    return np.rint(basis).astype(int), use


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in each) that hold every piece of the histogram exactly once."""
    out = [(histogram[capacity], [capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(n for n in histogram if n < capacity), int)
    if not len(lengths):
        return out
    left = np.array([histogram[int(n)] for n in lengths])
    basis, use = cutting_stock(lengths, left.astype(float), capacity, gap)
    for k in np.argsort(-use):
        times = int(use[k] + 1e-6)
        used = basis[:, k] > 0
        if times and used.any():
            times = min(times, int((left[used] // basis[used, k]).min()))
        if times:
            left = left - times * basis[:, k]
            out.append((times, [int(n) for n, c in zip(lengths, basis[:, k]) for _ in range(c)]))
    rooms: dict[int, list[list[int]]] = {}  # best fit decreasing: open sequences by room
    for n, c in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        for _ in range(c):
            room = min((r for r in rooms if r >= n), default=None)
            seq = rooms[room].pop() if room is not None else []
            if room is not None and not rooms[room]:
                del rooms[room]
            seq.append(n)
            rooms.setdefault((capacity if room is None else room) - n, []).append(seq)
    merged: dict[tuple[int, ...], int] = {}
    for seqs in rooms.values():
        for seq in seqs:
            merged[tuple(sorted(seq))] = merged.get(tuple(sorted(seq)), 0) + 1
    return out + [(t, list(seq)) for seq, t in sorted(merged.items())]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a sequence, first sequence, offset): where each rank of a length goes."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for times, seq in patterns:
        offset = 0
        for n in sorted(set(seq), reverse=True):
            copies, first = seq.count(n), taken.get(n, 0)
            out.append((n, first, first + times * copies, copies, sequence, offset))
            taken[n] = first + times * copies
            offset += n * copies
        sequence += times
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, capacity), "packing-pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = spark.createDataFrame(
        slots(plan(histogram, capacity)),
        "length long, first long, end long, copies long, sequence long, offset0 long")
    parts = spark.createDataFrame([(n, -(-c // PART_ROWS)) for n, c in histogram.items()], "length long, parts long")
    salted = cut.join(F.broadcast(parts), "length").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("r", F.row_number().over(
        Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))) \
        .join(counted, ["length", "part"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    at = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(where.withColumnRenamed("length", "n")),
                         (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + F.pmod(at, F.col("copies")) * F.col("length")).alias("offset"))


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
