"""M-3: second-order gradient boosting on histograms.

Features are cut into at most ``BINS`` bins at approximate quantiles; the binned
rows (one byte a feature, label, weight, margin) are kept as NumPy blocks.  A
level of a tree adds up gradients and hessians by node, feature and bin for one
child of each split (the other one's sums are the parent's less these), and
each node's split is picked by the regularised gain.

A level is one job of a single stage (``_Local``): a task maps its blocks from a
file on its executor's own disk, finds each row's node as the last level left it,
sums whichever child has fewer of its rows and takes the other one from its own
parent's sums; features with few bins share one table.  Each task sends one array
bounded by the parameters; more than ``PARTIALS`` of them are added by tasks
first.  Should a file be gone or half changed (a lost executor or failed task),
the files are made again from the checkpointed blocks and the trees so far;
after ``ATTEMPTS`` times the blocks are an RDD persisted in memory and on disk
instead (``_Jobs``), whose tasks route the drawn rows through the part of the
tree there is and whose margins are checkpointed every ``REFRESH`` rounds.

Gradients are added as integers (multiples of 2^-SCALE), so a model depends
neither on the partitioning nor on the order of the sums nor on the way; rows and
features are drawn by counters.  After each round the average precision of the
held-out rows is read from ``BUCKETS`` score buckets (0 where none of them is
positive), and fitting ends ``patience`` rounds after its best value; without
held-out rows all rounds are kept.
"""

from __future__ import annotations

import fcntl
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.session import cut_lineage, ship_package

BINS, SCALE, BUCKETS, REFRESH = 256, 20, 4096, 32
LEAST_GAIN = 1e-6
TREE_SCHEMA = "tree int, node int, feature int, threshold double, gain double, cover double, value double"


@dataclass(frozen=True)
class Settings:
    """Published settings of the model; ``rounds`` at most, ``reg`` the L2 term of the leaf weights."""
    rounds: int = 450
    depth: int = 5
    rate: float = 0.03
    least_child: float = 8.0
    rows: float = 0.9
    columns: float = 0.9
    reg: float = 1.0
    patience: int = 30
    seed: int = 42


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit counters over all bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(ids: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on."""
    u = _mixed(ids.astype(np.int64).view(np.uint64) ^ _mixed(np.array([tree * 1_000_003 + seed]))[0]) >> np.uint64(11)
    return u < np.uint64(int(share * (1 << 53)))


def drawn_features(n: int, tree: int, seed: int, share: float) -> list[int]:
    """Which features a tree may split on: the first ones of a shuffle by counters."""
    order = np.argsort(_mixed(np.arange(n) + (tree + 1) * 1_000_003 + seed * 7_919), kind="stable")
    return sorted(order[:max(1, int(share * n))].tolist())


def leaves(values: np.ndarray, feature: np.ndarray, left: np.ndarray, right: np.ndarray, goes_left) -> np.ndarray:
    """Leaves (``feature`` below 0) that rows with ``values`` [feature, row] reach; a leaf is its own child, so a
    step moves all rows alike."""
    n = values.shape[1]
    leaf, own = feature < 0, np.arange(len(feature))
    child = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], 1).reshape(-1)
    start = np.maximum(feature, 0) * n
    node, flat, rows = np.zeros(n, np.int64), values.reshape(-1), np.arange(n)
    while n and not leaf[node].all():
        node = child[2 * node + goes_left(flat[start[node] + rows], node)]
    return node


@dataclass
class Tree:
    """A complete binary tree (children of k: 2k + 1, 2k + 2); ``feature`` -1: a leaf."""
    feature: np.ndarray
    cut: np.ndarray        # bins up to it go left
    threshold: np.ndarray  # values below it go left
    gain: np.ndarray
    cover: np.ndarray      # sum of hessians
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), *(np.zeros(n) for _ in range(4)))

    def by_bins(self, bins: np.ndarray) -> np.ndarray:
        """Nodes of rows with ``bins`` [feature, row]."""
        child = 2 * np.arange(len(self.feature)) + 1
        return leaves(bins, self.feature, child, child + 1, lambda at, node: at <= self.cut[node])

    def by_values(self, x: np.ndarray) -> np.ndarray:
        """Nodes of rows ``x`` [row, feature]."""
        child = 2 * np.arange(len(self.feature)) + 1
        return leaves(np.ascontiguousarray(x.T), self.feature, child, child + 1, lambda at, node: at < self.threshold[node])


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss, in multiples of 2^-SCALE."""
    p = 1.0 / (1.0 + np.exp(-margin))
    g, h = weight * (p - label), np.maximum(weight * p * (1.0 - p), 1e-16)
    return np.rint(g * (1 << SCALE)).astype(np.int64), np.rint(h * (1 << SCALE)).astype(np.int64)


def best_split(g: np.ndarray, h: np.ndarray, features: list[int], s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, last bin of the left side) of a node's histograms [position in ``features``, bin] in units of 2^-SCALE; ties: first."""
    unit = float(1 << SCALE)
    total_g, total_h = float(g[0].sum()) / unit, float(h[0].sum()) / unit
    left_g, left_h = np.cumsum(g, 1)[:, :-1] / unit, np.cumsum(h, 1)[:, :-1] / unit
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = 0.5 * (left_g ** 2 / (left_h + s.reg) + right_g ** 2 / (right_h + s.reg) - total_g ** 2 / (total_h + s.reg))
    gain = np.where((left_h >= s.least_child) & (right_h >= s.least_child), gain, -np.inf)
    i, at = divmod(int(np.argmax(gain)), gain.shape[1])
    return (float(gain[i, at]), features[i], at) if gain[i, at] > LEAST_GAIN else None


@dataclass
class BoostedTrees:
    """A fitted model: columns, trees, and the held-out average precision after each round."""
    columns: list[str]
    trees: list[Tree]
    history: list[float] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, x = np.zeros(len(x)), np.asfortranarray(x)
        for t in self.trees:
            out += t.value[t.by_values(x)]
        return out

    def transform(self, df: DataFrame, out: str = "clf_score") -> DataFrame:
        """Adds the probability; absent values count as 0."""
        spark = df.sparkSession
        ship_package(spark)
        held = spark.sparkContext.broadcast(self)  # at most rounds x 2^(depth + 1) nodes

        @F.pandas_udf(T.DoubleType())
        def probability(*series: pd.Series) -> pd.Series:
            x = np.column_stack([v.fillna(0.0).to_numpy(dtype=float) for v in series])
            return pd.Series(1.0 / (1.0 + np.exp(-held.value.margin(x))))

        return df.withColumn(out, probability(*[F.col(c).cast("double") for c in self.columns]))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table."""
        rows = [(k, n, int(t.feature[n]), float(t.threshold[n]), float(t.gain[n]), float(t.cover[n]), float(t.value[n]))
                for k, t in enumerate(self.trees) for n in range(len(t.feature)) if t.feature[n] >= 0 or t.cover[n] > 0]
        return spark.createDataFrame(rows, TREE_SCHEMA)

    @staticmethod
    def from_nodes(nodes: DataFrame, columns: list[str]) -> BoostedTrees:
        trees = []
        for _, t in nodes.toPandas().sort_values(["tree", "node"]).groupby("tree"):
            tree = Tree.empty(max(1, int(t["node"].max() + 1).bit_length() - 1))
            at = t["node"].to_numpy()
            for name in ("feature", "threshold", "gain", "cover", "value"):
                getattr(tree, name)[at] = t[name].to_numpy()
            trees.append(tree)
        return BoostedTrees(list(columns), trees)


#: rows of a block, and partial sums that the driver adds itself (more of them are added by tasks first)
BLOCK_ROWS, PARTIALS = 1 << 16, 64
#: times that files are made, and cells of a table that several features share
ATTEMPTS, CELLS = 4, 1024


def _block_task(cuts: list[np.ndarray]):
    """Batches (features..., label, weight, id, held) to blocks of binned rows, one packed record each."""
    n = len(cuts)

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        block = tuple(np.concatenate(x, axis=-1) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            bins = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, values)]).astype(np.uint8)
            label, weight, ids, held = values[n:]
            parts.append((bins, label.astype(np.int8), weight.astype(float), ids.astype(np.int64), held.astype(bool), np.zeros(len(label))))
            size += len(label)
            if size >= BLOCK_ROWS:
                yield packed(parts)
                parts, size = [], 0
        if parts:
            yield packed(parts)
    return task


def _advanced(tree: Tree):
    """Blocks with the margins after one more tree."""
    def step(block: tuple) -> tuple:
        return *block[:5], block[5] + tree.value[tree.by_bins(block[0])]
    return step


def _drawn_rows(number: int, features: list[int], s: Settings):
    """Blocks to what a tree is grown on, the drawn rows' bins by feature with gradients and hessians, and the
    counts of held-out rows by label and score bucket."""
    def step(block: tuple) -> tuple:
        bins, label, weight, ids, held, margin = block
        bucket = np.minimum((BUCKETS / (1.0 + np.exp(-margin[held]))).astype(np.int64), BUCKETS - 1)
        counted = np.unique(label[held].astype(np.int64) * BUCKETS + bucket, return_counts=True)
        used = np.flatnonzero(~held & drawn(ids, number, s.seed, s.rows))
        g, h = gradients(margin[used], label[used], weight[used])
        return bins[:, used], g, h, counted
    return step


def _level_sums(tree: Tree, slots: dict[int, int], features: list[int], scored: bool):
    """A partition's histograms of gradients and hessians [slot, feature, bin], and the counts of held-out rows."""
    def task(blocks: Iterator[tuple]) -> Iterator[tuple]:
        sums = np.zeros((2, len(slots), len(features), BINS), np.int64)
        counts = np.zeros(2 * BUCKETS if scored else 0, np.int64)
        slot_of = np.full(len(tree.feature), -1)
        for node, k in slots.items():
            slot_of[node] = k
        for bins, g, h, (bucket, times) in blocks:
            if scored:
                counts[bucket] += times
            slot = slot_of[tree.by_bins(bins)]
            some = np.flatnonzero(slot >= 0)
            base, g, h = slot[some] * BINS, g[some].astype(float), h[some].astype(float)
            for i, f in enumerate(features):
                at = base + bins[f, some]
                for k, x in enumerate((g, h)):
                    sums[k, :, i] += np.rint(np.bincount(at, x, len(slots) * BINS)).astype(np.int64).reshape(-1, BINS)
        yield sums, counts
    return task


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def average_precision(positives: np.ndarray, negatives: np.ndarray) -> float | None:
    """Of counts by score bucket, ascending; None without positives."""
    tp, fp = np.cumsum(positives[::-1]), np.cumsum(negatives[::-1])
    if not len(tp) or tp[-1] == 0:
        return None
    return float((positives[::-1] * tp / np.maximum(tp + fp, 1)).sum() / tp[-1])


def in_few_parts(df: DataFrame) -> DataFrame:
    """``df`` in at most as many partitions as there are cores, without a shuffle: one task merges all partitions'
    quantile sketches, so its time must not grow with the number of partitions."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 2))


def quantile_cuts(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct approximate quantiles of each column, ascending (one aggregate)."""
    ranks = [i / bins for i in range(1, bins)]
    row = in_few_parts(df).agg(*[F.percentile_approx(c, ranks, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(row[f"c{i}"] if row[f"c{i}"] is not None else [], float)) for i in range(len(columns))]


def fit(rows: DataFrame, columns: list[str], s: Settings = Settings(), cuts: list[np.ndarray] | None = None) -> BoostedTrees:
    """Fit to ``rows``: the feature columns, ``label`` (0/1), ``weight``, ``id`` (long) and ``held`` (held-out rows)."""
    ship_package(rows.sparkSession)
    data = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
                       F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"),
                       F.col("id").cast("long").alias("id"), F.coalesce("held", F.lit(False)).alias("held"))
    if cuts is None:
        cuts = quantile_cuts(data.filter("not held"), columns)
    context = rows.sparkSession.sparkContext
    parts = max(context.defaultParallelism, 2)
    packed = cut_lineage(data.mapInArrow(_block_task(cuts), "block binary").repartition(parts))
    blocks = packed.rdd.map(lambda r: pickle.loads(r.block))
    levels = _Levels(blocks, [len(c) + 1 for c in cuts], s, 1 if parts <= PARTIALS else 2)
    try:
        return _rounds(levels.level, columns, s, cuts)
    finally:
        levels.way.release()


class _Levels:
    """The sums of a level by ``_Local``, made anew where files were gone, at last by ``_Jobs``."""

    def __init__(self, blocks: RDD, sizes: list[int], s: Settings, depth: int):
        self.blocks, self.sizes, self.s, self.depth, self.made = blocks, sizes, s, depth, 0
        self.way = self.make([])

    def make(self, trees: list[Tree]) -> _Local | _Jobs:
        self.made += 1
        if self.made <= ATTEMPTS:
            return _Local(self.blocks, self.sizes, self.s, self.depth, trees)
        return _Jobs(self.blocks, self.s, self.depth, trees)

    def level(self, trees: list[Tree], tree: Tree, slots: dict[int, int], features: list[int], level: int) -> tuple:
        while (found := self.way.level(trees, tree, slots, features, level)) is None:
            self.way.release()
            self.way = self.make(trees)
        return found


class _Jobs:
    """A level as a job over the persisted rows with their margins, and those that the tree is grown on."""

    def __init__(self, blocks: RDD, s: Settings, depth: int, trees: list[Tree]):
        before = list(trees)  # the list grows
        self.state = blocks.map(lambda block: _replayed(block, before)).persist(StorageLevel.MEMORY_AND_DISK)
        self.s, self.depth, self.held_back, self.grown = s, depth, [self.state], None

    def level(self, trees: list[Tree], tree: Tree, slots: dict[int, int], features: list[int], level: int) -> tuple:
        number = len(trees)
        if level == 0 or self.grown is None:
            if self.grown is not None:
                self.state = self.state.map(_advanced(trees[-1])).persist(StorageLevel.MEMORY_AND_DISK)
                if number % REFRESH == 0:
                    self.state.checkpoint()
                self.held_back.append(self.state)
            self.grown = self.state.map(_drawn_rows(number, features, self.s)).persist(StorageLevel.MEMORY_AND_DISK)
            self.held_back.append(self.grown)
        found = self.grown.mapPartitions(_level_sums(tree, slots, features, level == 0)).treeReduce(_added, self.depth)
        for x in self.held_back:  # the margins before this tree have been used
            if x is not self.state and x is not self.grown:
                x.unpersist()
        self.held_back[:] = [self.state, self.grown]
        return found

    def release(self) -> None:
        for x in self.held_back:
            x.unpersist()


def _tables(sizes: list[int]) -> list[list[int]]:
    """Features by the table that they are counted in: those with few bins together, up to ``CELLS`` cells."""
    tables, cells = [], 0
    for f in sorted(range(len(sizes)), key=lambda f: (sizes[f], f)):
        if tables and cells * sizes[f] <= CELLS:
            tables[-1].append(f)
            cells *= sizes[f]
        else:
            tables.append([f])
            cells = sizes[f]
    return tables


def _replayed(block: tuple, trees: list[Tree]) -> tuple:
    for tree in trees:
        block = _advanced(tree)(block)
    return block


class _Local:
    """A level as a job over files that the tasks' executors keep: an RDD of their paths, persisted so that a task
    is run where its file is."""

    def __init__(self, blocks: RDD, sizes: list[int], s: Settings, depth: int, trees: list[Tree]):
        self.home, self.s, self.sizes, self.depth = blocks.mapPartitions(_written(sizes, list(trees))).persist(StorageLevel.MEMORY_AND_DISK), s, sizes, depth

    def level(self, trees: list[Tree], tree: Tree, slots: dict[int, int], features: list[int], level: int) -> tuple | None:
        """None: a file is gone or was left half changed."""
        task = _local_sums(len(trees), trees[-1] if trees else None, tree, slots, features, level, self.sizes, self.s)
        *found, gone = self.home.mapPartitions(task).treeReduce(_added, self.depth)
        return None if gone else tuple(found)

    def release(self) -> None:
        self.home.foreach(_remove)
        self.home.unpersist()


def _remove(path: str) -> None:
    for name in (path, f"{path}.state"):
        if os.path.exists(name):
            os.remove(name)


def _written(sizes: list[int], trees: list[Tree]):
    """A part's blocks, with the margins after ``trees``, to a file of the executor (its folder goes with it)."""
    def task(blocks: Iterator[tuple]) -> Iterator[str]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        path = os.path.join(folder if os.path.isdir(folder) else tempfile.gettempdir(), f"boosting-{uuid.uuid4().hex}")
        places: list[list[tuple]] = []
        with open(path, "wb") as file:
            for block in blocks:
                places.append([])
                for x in _laid_out(_replayed(block, trees), _tables(sizes), sizes):
                    at = file.seek(-(-file.tell() // 64) * 64)
                    file.write(np.ascontiguousarray(x).data)
                    places[-1].append((x.shape, x.dtype, at))
        _keep(path, {"places": places, "number": len(trees) - 1, "done": 0, "bounds": [{}] * len(places), "own": {}, "counts": None})
        yield path
    return task


def _keep(path: str, state: dict) -> None:
    with open(f"{path}.new", "wb") as file:
        pickle.dump(state, file, 5)
    os.replace(f"{path}.new", f"{path}.state")


def _local_sums(number: int, last: Tree | None, tree: Tree, slots: dict[int, int], features: list[int], level: int,
                sizes: list[int], s: Settings):
    """A part's sums of a level, the counts of held-out rows, and whether its file was of no use."""
    def task(paths: Iterator[str]) -> Iterator[tuple]:
        for path in paths:
            sums, counts = np.zeros((2, len(slots), len(features), BINS), np.int64), np.zeros(2 * BUCKETS if level == 0 else 0, np.int64)
            try:
                file = open(path, "r+b")
            except FileNotFoundError:
                yield sums, counts, 1
                continue
            with file:
                fcntl.flock(file, fcntl.LOCK_EX)
                try:
                    with open(f"{path}.state", "rb") as kept:
                        state = pickle.load(kept)
                except FileNotFoundError:
                    yield sums, counts, 1
                    continue
                os.remove(f"{path}.state")  # until the level is done
                part = _Part(file, state, sizes, s)
                part.bring(number, last, tree, features, level)
                for node, k in slots.items():
                    sums[:, k] = part.own[node][:, features]
                if level == 0:
                    counts += part.counts
                _keep(path, part.state())
                del part
            yield sums, counts, 0
    return task


def _laid_out(block: tuple, tables: list[list[int]], sizes: list[int]) -> list[np.ndarray]:
    """The arrays of a ``_Block``: those of ``block``, room for gradients, hessians and row numbers, and the cells
    of the tables that features share."""
    bins, n = block[0], len(block[1])
    room = [np.zeros(n, kind) for kind in (float, float, np.int32, np.int32)]
    shared = []
    for table in tables:
        if len(table) > 1:
            code = np.zeros(n, np.uint16)
            for f in table:
                code = code * np.uint16(sizes[f]) + bins[f]
            shared.append(code)
    return [*block, *room, *shared]


class _Block:
    """Rows of a part: ``order`` has the drawn ones by node, a node's at ``bounds[node]``; ``rest`` the others."""

    def __init__(self, arrays: list[np.ndarray], tables: list[list[int]], bounds: dict[int, tuple[int, int]]):
        self.bins, self.label, self.weight, self.ids, self.held, self.margin, self.g, self.h, self.order, self.rest, *shared = arrays
        self.bounds = bounds
        codes = iter(shared)
        self.codes = [next(codes) if len(t) > 1 else self.bins[t[0]] for t in tables]

    def rows(self, node: int) -> int:
        a, b = self.bounds[node]
        return b - a

    def of(self, node: int) -> np.ndarray:
        a, b = self.bounds[node]
        return self.order[a:b].astype(np.int64)

    def start(self, number: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Draws the rows of a tree; held-out rows by label and score bucket, with their counts."""
        g, h = gradients(self.margin, self.label, self.weight)
        self.g[:], self.h[:] = g, h
        used = ~self.held & drawn(self.ids, number, s.seed, s.rows)
        n = int(used.sum())
        self.order[:n], self.rest[:len(used) - n] = np.flatnonzero(used), np.flatnonzero(~used)
        self.bounds = {0: (0, n)}
        bucket = np.minimum((BUCKETS / (1.0 + np.exp(-self.margin[self.held]))).astype(np.int64), BUCKETS - 1)
        return np.unique(self.label[self.held].astype(np.int64) * BUCKETS + bucket, return_counts=True)

    def divide(self, node: int, f: int, cut: int) -> int:
        """Sends a node's rows to its children; how many go left."""
        rows, (a, b) = self.of(node), self.bounds.pop(node)
        left = self.bins[f][rows] <= cut
        n = int(left.sum())
        self.order[a:a + n], self.order[a + n:b] = rows[left], rows[~left]
        self.bounds[2 * node + 1], self.bounds[2 * node + 2] = (a, a + n), (a + n, b)
        return n

    def advance(self, tree: Tree) -> None:
        """Margins after the tree that was grown."""
        for node in list(self.bounds):
            if tree.feature[node] >= 0:
                self.divide(node, tree.feature[node], tree.cut[node])
        for node in self.bounds:
            self.margin[self.of(node)] += tree.value[node]
        rest = self.rest[:len(self.rest) - sum(b - a for a, b in self.bounds.values())].astype(np.int64)
        self.margin[rest] += tree.value[tree.by_bins(self.bins[:, rest])]


class _Part:
    """A part's rows, mapped from ``file``, and its own sums of the level's nodes."""

    def __init__(self, file, state: dict, sizes: list[int], s: Settings):
        self.sizes, self.s, self.tables = sizes, s, _tables(sizes)
        self.places, self.number, self.done, self.own, self.counts = (state[k] for k in ("places", "number", "done", "own", "counts"))
        whole = np.asarray(np.memmap(file, np.uint8, "r+")) if self.places else None
        self.blocks = [_Block([np.ndarray(shape, kind, whole, at) for shape, kind, at in place], self.tables, dict(bounds))
                       for place, bounds in zip(self.places, state["bounds"])]

    def state(self) -> dict:
        return {"places": self.places, "number": self.number, "done": self.done, "bounds": [b.bounds for b in self.blocks],
                "own": self.own, "counts": self.counts}

    def sums(self, node: int, features: list[int]) -> np.ndarray:
        """Of a node's rows here: [gradients or hessians, feature, bin]."""
        drawn_here = [k for k, t in enumerate(self.tables) if any(f in features for f in t)]
        found = {k: np.zeros((2, int(np.prod([self.sizes[f] for f in self.tables[k]]))), np.int64) for k in drawn_here}
        for block in self.blocks:
            rows = block.of(node)
            if not len(rows):
                continue
            g, h = block.g[rows], block.h[rows]
            for k, cells in found.items():
                code = block.codes[k][rows].astype(np.int64)
                for i, x in enumerate((g, h)):
                    cells[i] += np.rint(np.bincount(code, x, cells.shape[1])).astype(np.int64)
        out = np.zeros((2, len(self.sizes), BINS), np.int64)
        for k, cells in found.items():
            cells = cells.reshape(2, *[self.sizes[f] for f in self.tables[k]])
            for at, f in enumerate(self.tables[k]):
                out[:, f, :self.sizes[f]] = cells.sum(tuple(j + 1 for j in range(len(self.tables[k])) if j != at))
        return out

    def bring(self, number: int, last: Tree | None, tree: Tree, features: list[int], level: int) -> None:
        """Up to a level of tree ``number``, from the level or tree before (``last``) or from new files."""
        if self.number != number:
            self.counts = np.zeros(2 * BUCKETS, np.int64)
            for block in self.blocks:
                if block.bounds:
                    block.advance(last)
                bucket, times = block.start(number, self.s)
                self.counts[bucket] += times
            self.own, self.number, self.done = {0: self.sums(0, features)}, number, 0
        while self.done < level:
            above, self.own = self.own, {}
            for parent in above:
                if tree.feature[parent] < 0:
                    continue
                rows, left = np.sum([(block.rows(parent), block.divide(parent, tree.feature[parent], tree.cut[parent]))
                                     for block in self.blocks] or [(0, 0)], 0)
                few = 2 * parent + 1 + int(2 * left > rows)
                beside = few + 1 if few % 2 else few - 1
                self.own[few] = self.sums(few, features)
                self.own[beside] = above[parent] - self.own[few]
            self.done += 1


def _rounds(level_sums: Callable, columns: list[str], s: Settings, cuts: list[np.ndarray]) -> BoostedTrees:
    """``level_sums``: of the trees so far, the one that grows, its slots, the features and the level, the sums
    [gradients or hessians, slot, feature, bin] and, on the first level, the counts of held-out rows."""
    trees: list[Tree] = []
    history: list[float] = []
    best = (-1.0, 0)  # average precision, minus its number of trees
    for number in range(s.rounds + 1):
        tree, features = Tree.empty(s.depth), drawn_features(len(columns), number, s.seed, s.columns)
        slots = {0: 0}
        sums: dict[int, np.ndarray] = {}  # of the level's nodes: [gradients or hessians, feature, bin]
        for level in range(s.depth):
            found, counts = level_sums(trees, tree, slots, features, level)
            if level == 0:
                counts = counts.reshape(2, BUCKETS).astype(float)
                if number:
                    precision = average_precision(counts[1], counts[0])
                    if precision is None and counts.sum():
                        precision = 0.0
                    if precision is not None:
                        history.append(precision)
                        best = max(best, (precision, -number))  # the first of the best
                        if number + best[1] >= s.patience:
                            return BoostedTrees(list(columns), trees[:-best[1]], history)
                if number == s.rounds:
                    return BoostedTrees(list(columns), trees[:-best[1]] if best[0] >= 0 else trees, history)
            above, sums = sums, {node: found[:, k] for node, k in slots.items()}
            for node in slots:
                if level:  # a node and the one beside it share their parent's sums
                    beside = node + 1 if node % 2 else node - 1
                    sums[beside] = above[(node - 1) // 2] - sums[node]
            slots = {}
            for node in sorted(sums):
                g, h = sums[node]
                if level == 0:
                    _set_leaf(tree, node, g[0].sum(), h[0].sum(), s)
                split = best_split(g, h, features, s)
                if split is None:
                    continue
                gain, f, at = split
                i = features.index(f)
                tree.feature[node], tree.cut[node], tree.threshold[node], tree.gain[node] = f, at, cuts[f][at], gain
                for child, side in ((2 * node + 1, slice(None, at + 1)), (2 * node + 2, slice(at + 1, None))):
                    _set_leaf(tree, child, g[i, side].sum(), h[i, side].sum(), s)
                slots[2 * node + 1 + int(tree.cover[2 * node + 1] > tree.cover[2 * node + 2])] = len(slots)
            if not slots:
                break
        trees.append(tree)
    return BoostedTrees(list(columns), trees, history)


def _set_leaf(tree: Tree, node: int, g, h, s: Settings) -> None:
    unit = float(1 << SCALE)
    tree.cover[node] = float(h) / unit
    tree.value[node] = -s.rate * (float(g) / unit) / (float(h) / unit + s.reg)
