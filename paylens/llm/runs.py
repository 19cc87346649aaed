"""Periodic runs of words, found by enumerating maximal pairs.

A run is a stretch of words with smallest period q and at least
``max(least, 2q)`` words that neither neighbour extends.  Its start i and i + q
are a maximal pair: the words from both agree for l = length - q words, and the
words before both differ.  Conversely a maximal pair at distance d <= l with
l + d >= least is a maximal stretch of period d; of the pairs that give one
stretch (multiples of its period) the smallest distance is the run's.

The suffixes of all texts of a block are ranked by prefix doubling (from words
over windows of ``least / 2`` words, the smallest l there can be; only suffixes
that still tie are ranked again), and longest common prefixes are read off the
levels' ranks.  The LCP-interval tree is then walked bottom-up: each interval
holds its positions in order, and where many lie close together also a list for
each left word.  When two children meet at depth l, every position of the
smaller looks in the larger for positions with another left word at a distance
of at most l.  Positions that no such pair can hold (their window recurs only
farther away than its repeated stretch is long) do not enter the tree.

Cost: positions move to larger lists O(log n) times each; a look-up reads the
positions in reach or the left-word lists, whichever are fewer; the pairs found
are as many as half the sum of the runs' exponents, at most linear in the words.

Defined results: null, empty and blank texts have no runs and an empty
collapsed text; rows that repeat are treated each; a null id stays null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paylens.llm.store import table
from paylens.llm.words import SPACE, Block, blocks, span_hashes
from paylens.session import ship_package

LEAST, FEW = 12, 16
Edit = Callable[[pa.Array, pa.Array], pa.Array]


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a, b), b from -1."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 2) + b + 1, return_inverse=True)[1]


class Suffixes:
    """Ranks of the prefixes of all suffixes of rows of words, at growing lengths.

    Two positions have one rank at a length if so many words agree from there
    on; ranks ascend in one order of the suffixes, row by row.
    """

    def __init__(self, words: np.ndarray, row: np.ndarray, end: np.ndarray, width: int):
        self.end = end[row] if len(row) else end  # of each position's row
        self.levels: list[tuple[int, np.ndarray]] = [(1, words)]
        size = 1
        while 2 * size <= width:
            rank = self.levels[-1][1]
            self.levels.append((2 * size, _dense(rank, self._ahead(rank, size))))
            size *= 2
        rank = self.levels[-1][1]
        rank = _dense(row, _dense(rank, self._ahead(rank, width - size)) if size < width else rank)
        count = np.bincount(rank)
        rank = (np.cumsum(count) - count)[rank]
        if size == width:
            self.levels.pop()
        self.levels.append((width, rank))
        order = np.argsort(rank, kind="stable")
        group = rank[order]
        self.repeated = order[self._tied(group)]  # by rank, then position
        self.width = width
        at, size = self.repeated, width
        while len(at):
            rank = self.levels[-1][1]
            first, second = rank[at], self._ahead(rank, size, at)
            order = np.lexsort((second, first))
            at, first, second = at[order], first[order], second[order]
            new_group = np.r_[True, first[1:] != first[:-1]]
            new = new_group | np.r_[True, second[1:] != second[:-1]]
            i = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(new_group, i, 0))
            finer = rank.copy()
            finer[at] = first + (np.maximum.accumulate(np.where(new, i, 0)) - begin)
            size *= 2
            self.levels.append((size, finer))
            at = at[self._tied(finer[at])]

    def _ahead(self, rank: np.ndarray, by: int, at: np.ndarray | None = None) -> np.ndarray:
        """The rank ``by`` words on, -1 beyond the row."""
        at = np.arange(len(rank)) if at is None else at
        to = at + by
        return np.where(to < self.end[at], rank[np.minimum(to, len(rank) - 1)], -1)

    @staticmethod
    def _tied(rank: np.ndarray) -> np.ndarray:
        """Places in ``rank`` (grouped) that share it with a neighbour."""
        same = rank[1:] == rank[:-1]
        return np.r_[False, same] | np.r_[same, False] if len(rank) else np.zeros(0, bool)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words on which the suffixes from ``a`` and ``b`` (different, in one row) agree."""
        n = np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            at, to = a + n, b + n
            inside = (at < self.end[a]) & (to < self.end[b])
            last = len(rank) - 1
            n += size * (inside & (rank[np.minimum(at, last)] == rank[np.minimum(to, last)]))
        return n

    def in_reach(self) -> np.ndarray:
        """Positions that may be in a maximal pair not farther apart than it is long, in suffix order.

        All windows of a pair's prefixes recur, so it is at most ``width - 1``
        words longer than the stretch of recurring windows that begins there.
        """
        at = np.sort(self.repeated)
        if not len(at):
            return at
        breaks = np.flatnonzero(np.r_[np.diff(at) != 1, True] | np.r_[self.end[at[1:]] != self.end[at[:-1]], True])
        reach = np.zeros(len(self.end), np.int64)
        reach[at] = breaks[np.searchsorted(breaks, np.arange(len(at)))] - np.arange(len(at)) + self.width
        by = self.repeated
        rank = dict(self.levels)[self.width]
        gap = np.where(rank[by[1:]] == rank[by[:-1]], by[1:] - by[:-1], len(rank))
        near = np.r_[gap, len(rank)] <= reach[by]
        near |= np.r_[len(rank), gap] <= reach[by]
        kept = by[near]
        return kept[np.argsort(self.levels[-1][1][kept], kind="stable")]


def maximal_pairs(order: list[int], common: list[int], left: list[int], shortest: int, least: int) -> list[tuple[int, int, int]]:
    """(position, distance, length) of the maximal pairs not farther apart than long, by the LCP-interval tree.

    ``order``: positions in suffix order; ``common[i]``: LCP of the i-th with
    the one before it; ``left``: the word before each position of the block.
    Intervals shallower than ``shortest`` hold no pair that counts.
    """
    found: list[tuple[int, int, int]] = []

    def meet(a, b, depth):
        """Pairs between two children of an interval, and the children's union: [positions, positions by left word]."""
        if len(a[0]) < len(b[0]):
            a, b = b, a
        held, by_left = a
        new = b[0]
        for p in new:
            lo = bisect_left(held, p - depth)
            hi = bisect_right(held, p + depth, lo)
            if lo == hi:
                continue
            own = left[p]
            if hi - lo <= FEW or by_left is not None and hi - lo <= len(by_left):
                others = [q for q in held[lo:hi] if left[q] != own]
            else:
                if by_left is None:
                    by_left = a[1] = {}
                    for q in held:
                        by_left.setdefault(left[q], []).append(q)
                others = [q for word, of in by_left.items() if word != own
                          for q in of[bisect_left(of, p - depth):bisect_right(of, p + depth)]]
            for q in others:
                far = abs(p - q)
                if depth + far >= least:
                    found.append((min(p, q), far, depth))
        if len(new) <= 8:
            for p in new:
                insort(held, p)
        else:
            held += new
            held.sort()
        if by_left is not None:
            for p in new:
                insort(by_left.setdefault(left[p], []), p)
        return a

    stack: list[tuple[int, list]] = []
    for i, p in enumerate(order):
        depth = common[i + 1] if i + 1 < len(order) else 0
        child = [[p], None]
        while stack and stack[-1][0] > depth:
            above, held = stack.pop()
            child = meet(held, child, above)
        if depth < shortest:
            stack.clear()
        elif stack and stack[-1][0] == depth:
            stack[-1] = depth, meet(stack[-1][1], child, depth)
        else:
            stack.append((depth, child))
    return found


def block_runs(b: Block, least: int = LEAST) -> np.ndarray:
    """Runs of a block's rows, as rows (row, first word in the block, length, period), in order."""
    none = np.zeros((0, 4), np.int64)
    if not len(b.starts):
        return none
    words = np.unique(span_hashes(b.buf, b.starts, b.ends, lower=False), return_inverse=True)[1]
    shortest = -(-least // 2)
    s = Suffixes(words, b.row, b.first[1:], shortest)
    at = s.in_reach()
    if not len(at):
        return none
    common = np.zeros(len(at), np.int64)
    same = np.flatnonzero(b.row[at[1:]] == b.row[at[:-1]]) + 1
    common[same] = s.common(at[same - 1], at[same])
    left = np.r_[-1, words[:-1]]
    left[b.first[:-1][b.n_words > 0]] = -1
    pairs = maximal_pairs(at.tolist(), common.tolist(), left.tolist(), shortest, least)
    if not pairs:
        return none
    start, period, length = np.array(pairs, np.int64).T
    length = length + period
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return np.stack([b.row[start], start, length, period], 1)[order]


def collapsed(b: Block, found: np.ndarray) -> Iterator[bytes]:
    """Each row's words joined by one space, without those that a run holds after its first period."""
    kept = np.ones(len(b.starts), bool)
    data, mask = b.buf.copy(), ~SPACE[b.buf]
    data[~mask] = 32
    if len(found):
        depth = np.zeros(len(b.starts) + 1, np.int64)
        np.add.at(depth, found[:, 1] + found[:, 3], 1)
        np.add.at(depth, found[:, 1] + found[:, 2], -1)
        kept = np.cumsum(depth)[:-1] == 0
        edge = np.zeros(len(mask) + 1, np.int64)
        edge[b.starts[~kept]] += 1
        np.add.at(edge, b.ends[~kept], -1)
        mask &= np.cumsum(edge)[:-1] == 0
    after = b.ends[kept & (b.ends < b.offs[1:][b.row])] if len(b.row) else b.ends
    mask[after] = True
    n = b.per_row(mask)
    out, end = data[mask].tobytes(), np.cumsum(n).tolist()
    for hi, size in zip(end, n.tolist()):
        yield out[hi - size:hi].rstrip(b" ")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs_task(least: int, edit: Edit | None):
    """Batches (doc_id, text) to (doc_id, runs, collapsed)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            if edit is not None:
                column = edit(batch.column(0), column)
            for b in blocks(column):
                found = block_runs(b, least)
                offs = np.searchsorted(found[:, 0], np.arange(b.hi - b.lo + 1)).astype(np.int32)
                start = found[:, 1] - b.first[found[:, 0]]
                parts = [pa.array(np.ascontiguousarray(x)) for x in (start, found[:, 2], found[:, 3])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, b.hi - b.lo),
                     pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays(parts, ["start", "length", "period"])),
                     pa.array(list(collapsed(b, found)), pa.binary()).cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"])
    return task


def runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of every whole text by start and period, and the text without their repetitions.

    ``edit`` maps ids and texts to the texts to look at, inside the task.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runs_task(least, edit),
                           "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def repeated_tails(ids: pa.Array, column: pa.Array) -> pa.Array:
    """The contract's texts: one document in ten has its words from word a on repeated with period p."""
    column = column.cast(pa.large_binary())
    mask, new = [], []
    for k, doc in enumerate(ids.to_pylist()):
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        words = _WORD.findall(column[k].as_py() or b"") if h % 10 == 0 else ()
        mask.append(bool(words))
        if words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            new.append(b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]))
    if not new:
        return column
    return pc.replace_with_mask(column, pa.array(mask), pa.array(new, pa.large_binary()))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of (doc_id, runs, collapsed)."""
    longest = F.element_at(F.array_sort("runs", lambda a, b: F.coalesce(
        *(F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)) for x, y in (
            (b["length"], a["length"]), (a["start"], b["start"]), (a["period"], b["period"]))), F.lit(0))), 1)
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(
        "", r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = found.withColumn("_best", F.when(F.size("runs") > 0, longest))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return digests(runs(table(spark, sf_dir, "documents"), edit=repeated_tails))
