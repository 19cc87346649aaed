"""Chunking and nearest-neighbour retrieval (K-1 … K-4, SRC-10).

kNN is exact and pruned.  Vectors are kept in blocks: contiguous ranges by
nearest pivot and distance to it, so that a block is a shell around its pivot.
A query's nearest block gives its k-th distance so far; by the triangle
inequality every block whose shell lies farther away is skipped.  Within a block
one matrix product finds the candidates of all its queries, and only these are
measured exactly.  ``row_number() <= k`` per query (a WindowGroupLimit, trimmed
before the shuffle) merges the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.session import cut_lineage, ship_package

#: vectors and queries in one block of the kNN search, and pivots at most
VECTOR_BLOCK, QUERY_BLOCK, PIVOTS = 1 << 14, 1 << 12, 256
#: rough distances, and components of candidates, that a task holds at once; rows of a batch compared with the pivots at once
_ROUGH, _MEASURED, _PLACED = 1 << 19, 1 << 21, 1 << 10
#: hits' ids that are broadcast at most (8 bytes each)
HIT_IDS = 1 << 20
#: where a text is cut by preference: paragraphs, lines, words
BREAKS = ("\n\n", "\n", " ")


def chunk_text(df: DataFrame, text: str = "text", size: int = C.CHUNK_SIZE,
               overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """K-1: fixed windows of ``size`` characters every ``size - overlap`` characters.

    Chunks start at 0, step, 2*step … until a window reaches the end of the text
    (a text no longer than ``size`` is one chunk).  Whole texts are processed.
    """
    step = size - overlap
    n = F.length(F.col(text))
    count = F.greatest(F.ceil((n - F.lit(size)) / F.lit(float(step))), F.lit(0)) + 1
    return (df.select("*", F.posexplode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("chunk_id", "_k"))
            .withColumn("chunk_start", F.col("_k") * step)
            .withColumn("chunk", F.substring(F.col(text), F.col("chunk_start") + 1, size))
            .drop("_k", "chunk_id")
            .withColumn("chunk_id", (F.col("chunk_start") / step).cast("int")))


def split_at_breaks(text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                    breaks: tuple[str, ...] = BREAKS) -> list[tuple[int, str]]:
    """(start, chunk) of a text cut at the strongest break that gives small enough pieces.

    The text is cut before every occurrence of the first of ``breaks`` that it
    holds; consecutive pieces shorter than ``size`` are packed into chunks of at
    most ``size`` characters, a chunk starting with as many of the last pieces
    before it as fit ``overlap``; a piece of ``size`` or more is cut by the next
    break in the same way (by characters after the last one).  Chunks lose white
    space at both ends; empty ones are left out.
    """
    out: list[tuple[int, str]] = []

    def emit(lo: int, hi: int) -> None:
        chunk = text[lo:hi]
        body = chunk.strip()
        if body:
            out.append((lo + len(chunk) - len(chunk.lstrip()), body))

    def pack(edges: list[int]) -> None:
        """Pieces edges[i]:edges[i + 1], packed greedily."""
        first = 0
        for i in range(len(edges) - 1):
            length = edges[i + 1] - edges[i]
            if edges[i] - edges[first] + length > size and i > first:
                emit(edges[first], edges[i])
                while edges[i] - edges[first] > overlap or (first < i and edges[i] - edges[first] + length > size):
                    first += 1
        if first < len(edges) - 1:
            emit(edges[first], edges[-1])

    def cut(lo: int, hi: int, level: int) -> None:
        while level < len(breaks) and text.find(breaks[level], lo, hi) < 0:
            level += 1
        if level == len(breaks):
            pack(list(range(lo, hi)) + [hi])
            return
        mark, edges, at = breaks[level], [lo], lo
        while (at := text.find(mark, at, hi)) >= 0:
            if at > edges[-1]:
                edges.append(at)
            at += len(mark)
        edges.append(hi)
        run = [lo]
        for a, b in zip(edges, edges[1:]):
            if b - a < size:
                run.append(b)
                continue
            if len(run) > 1:
                pack(run)
            cut(a, b, level + 1)
            run = [b]
        if len(run) > 1:
            pack(run)

    if text:
        cut(0, len(text), 0)
    return out


def chunk_at_breaks(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = C.CHUNK_SIZE,
                    overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """K-1, break-preferring: (id, chunk_id, chunk_start, chunk), see ``split_at_breaks``; null and blank texts have no chunks.

    A map without a shuffle; a text's chunks leave as they are cut.
    """
    ship_package(df.sparkSession)

    def task(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(ids):
                found = split_at_breaks(rows[i].as_py() or "", size, overlap)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int32()),
                         pa.array([a for a, _ in found], pa.int32()), pa.array([c for _, c in found], pa.string())],
                        names=[id_col, "chunk_id", "chunk_start", "chunk"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text).mapInArrow(task, f"{id_col} {kind}, chunk_id int, chunk_start int, chunk string")


def _squared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of ``x`` to all rows of ``y`` by a matrix product, and a bound of their error by row of ``x``."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    error = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (xx + yy.max(initial=0.0))
    return np.maximum(xx[:, None] + yy[None, :] - 2 * (x @ y.T), 0.0), error


def _matrix(vectors) -> np.ndarray:
    return np.stack(list(vectors)).astype(float) if len(vectors) else np.zeros((0, 0))


def _nearest(k: int):
    """Cogrouped (query_id, query_vec) and a block's (id, vec) to each query's k nearest vectors of the block."""
    def task(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "distance": []}
        if len(queries) and len(vectors):
            ids, x, names = vectors["id"].to_numpy(), _matrix(vectors["vec"]), queries["query_id"].to_numpy()
            step = max(1, _ROUGH // len(x))
            for lo in range(0, len(names), step):
                q = _matrix(queries["query_vec"].iloc[lo:lo + step])
                rough, error = _squared(q, x)
                limit = (np.partition(rough, k - 1, 1)[:, k - 1] if len(x) > k else rough.max(1)) + 2 * error
                close = rough <= limit[:, None]
                ends, a = np.cumsum(close.sum(1)), 0
                while a < len(q):  # vectors that come many times are all candidates: some queries at a time
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _MEASURED // x.shape[1], "right")))
                    row, col = np.nonzero(close[a:b])
                    row += a
                    d = x[col] - q[row]
                    d = np.cumsum(np.multiply(d, d, out=d), 1, out=d)[:, -1]  # summed in element order
                    order = np.lexsort((ids[col], d, row))
                    row, col, d = row[order], col[order], d[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
                    out["query_id"] += names[lo:lo + step][row[kept]].tolist()
                    out["id"] += ids[col[kept]].tolist()
                    out["distance"] += d[kept].tolist()
                    a = b
        return pd.DataFrame(out)
    return task


def _to_pivots(pivots: np.ndarray, keep: str):
    """Batches (…, vector) to themselves with the distances to all pivots, or the nearest one's number and distance."""
    def task(batches):
        for batch in (b.slice(lo, _PLACED) for b in batches for lo in range(0, max(b.num_rows, 1), _PLACED)):
            rows = batch.column(batch.num_columns - 1)
            x = _matrix(rows.to_pylist())
            d = np.sqrt(_squared(x, pivots)[0]) if len(x) else np.zeros((0, len(pivots)))
            near = d.argmin(1) if len(x) else np.zeros(0, int)
            cols, names = list(batch.columns), list(batch.schema.names)
            if keep == "all":
                added = [("far", pa.array(list(d), pa.list_(pa.float64())))]
            else:
                added = [("pivot", pa.array(near, pa.int32())), ("r", pa.array(d[np.arange(len(x)), near], pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols + [c for _, c in added], names=names + [n for n, _ in added])
    return task


class BallIndex:
    """Vectors in blocks around pivots, written once to the shared checkpoint folder.

    ``blocks`` has (block, pivot, low, high, rows): the nearest and farthest
    distance to the pivot.  Pivots are the ``PIVOTS`` (at most) vectors with the
    smallest hash, the only vectors that reach the driver.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding"):
        ship_package(vectors.sparkSession)
        rows = vectors.filter(F.col(vec_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        self.vector_type = dict(vectors.dtypes)[vec_col]
        n = rows.count()
        count = max(1, min(PIVOTS, -(-n // max(1, VECTOR_BLOCK // 4))))
        chosen = [r.vec for r in rows.orderBy(F.xxhash64("id"), "id").limit(count).collect()]
        self.pivots = _matrix(chosen)
        placed = rows.mapInArrow(_to_pivots(self.pivots, "nearest"), "id long, vec array<double>, pivot int, r double") if chosen else \
            rows.withColumns({"pivot": F.lit(0), "r": F.lit(0.0)})
        placed = placed.repartitionByRange(max(1, -(-n // VECTOR_BLOCK)), "pivot", "r", "id")
        self.vectors = cut_lineage(placed.withColumn("block", F.spark_partition_id()))
        shells = [F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("rows")]
        self.blocks = cut_lineage(self.vectors.groupBy("block", "pivot").agg(*shells))

    def distances(self, queries: DataFrame) -> DataFrame:
        """(query_id, query_vec, far): each query with its distances to the pivots."""
        kind = dict(queries.dtypes)["query_id"]
        return cut_lineage(queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec")).mapInArrow(
            _to_pivots(self.pivots, "all"), f"query_id {kind}, query_vec array<double>, far array<double>"))

    @staticmethod
    def least() -> Column:
        """Lower bound of the distance from a query at ``d`` from a pivot to the shell ``low`` to ``high`` (rounding is allowed for)."""
        gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"))
        return F.greatest(gap - F.lit(1e-9) * (F.col("d") + F.col("high") + 1), F.lit(0.0))

    def search(self, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """k nearest vectors (query_id, id, distance) within each block of ``pairs`` (query_id, block).

        A block's queries come in parts of about ``QUERY_BLOCK``, so neither side of a group grows with the tables.
        """
        kind = dict(queries.dtypes)["query_id"]
        parts = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
        asked = pairs.select("query_id", "block").join(parts, "block").join(queries.select("query_id", "query_vec"), "query_id") \
            .select("block", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "query_vec")
        held = self.vectors.join(parts, "block").select(
            "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "vec")
        return asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(
            _nearest(k), f"query_id {kind}, id long, distance double")

    def nearest(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Each query's k nearest of every block that it met, and those (query_id, block) pairs."""
        if not len(self.pivots):
            kind = dict(queries.dtypes)["query_id"]
            spark = queries.sparkSession
            return spark.createDataFrame([], f"query_id {kind}, id long, distance double"), \
                spark.createDataFrame([], f"query_id {kind}, block int")
        asked = self.distances(queries)
        nearest = asked.select("query_id", (F.array_position("far", F.array_min("far")) - 1).cast("int").alias("pivot"),
                               F.array_min("far").alias("d"))
        home = nearest.join(self.blocks, "pivot").groupBy("query_id").agg(
            F.min(F.struct((F.col("rows") < k).alias("short"), self.least().alias("least"), "block")).alias("home"))
        home = cut_lineage(home.select("query_id", "home.block"))
        first = cut_lineage(self.search(asked, home, k))
        limit = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("limit"))
        within = F.col("limit").isNull() | (self.least() * self.least() <= F.col("limit"))
        cells = self.blocks.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        open_cells = asked.select("query_id", F.posexplode("far").alias("pivot", "d")).join(limit, "query_id", "left") \
            .join(F.broadcast(cells), "pivot").filter(within).drop("low", "high")  # at most PIVOTS cells
        more = open_cells.join(self.blocks, "pivot").filter(within).select("query_id", "block").distinct()
        more = cut_lineage(more.join(home, ["query_id", "block"], "left_anti"))
        return first.union(self.search(asked, more, k)), home.union(more)


def knn(vectors: DataFrame, queries: DataFrame, k: int = C.KNN_K, id_col: str = "vec_id",
        vec_col: str = "embedding") -> DataFrame:
    """K-3: k nearest vectors per query by squared L2 (ties -> lower id), exact, for any number of queries.

    ``queries`` has (query_id, query_vec), each id once.
    """
    found, _ = BallIndex(vectors, id_col, vec_col).nearest(queries, k)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumnRenamed("id", id_col))


def label_exemplars(vectors: DataFrame, label: str = "label", id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """One query per label: the vector with the lowest id (a hash aggregate)."""
    return vectors.groupBy(label).agg(F.min_by(vec_col, id_col).alias("query_vec")) \
                  .select(F.col(label).alias("query_id"), "query_vec")


def passages_of(neighbours: DataFrame, passages: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The rows of ``passages`` that some neighbour names, before any text is shuffled.

    Ids of hits are at most k per query; up to ``HIT_IDS`` of them are broadcast as
    a filter of the scan, more are joined.
    """
    wanted = cut_lineage(neighbours.select(id_col).distinct())
    return passages.join(F.broadcast(wanted) if wanted.count() <= HIT_IDS else wanted, id_col, "leftsemi")


def retrieval_answer(neighbours: DataFrame, sources: DataFrame | None = None, passages: DataFrame | None = None,
                     source_col: str = "source", id_col: str = "vec_id", text_col: str = "passage") -> DataFrame:
    """K-4: top-3 sources, confidence = clamp(1 - best distance), context of hits with score < .8.

    ``sources`` gives each vector's source tag (and its passage, unless
    ``passages`` has them in a table of their own); the context holds the
    passages under their tags, joined by blank lines.  ``neighbours`` is a K-3
    result (query_id, id, distance, rank), at most k rows per query, so the
    per-query ``collect_list`` is bounded by k; only the hits' rows of both
    tables go on to the joins.
    """
    nb = neighbours
    if sources is not None:
        nb = cut_lineage(nb)
        texts = [] if passages is not None else [text_col]
        found = nb.join(passages_of(nb, sources.select(id_col, source_col, *texts), id_col), id_col, "left")
        if passages is not None:
            found = found.join(passages_of(nb, passages.select(id_col, text_col), id_col), id_col, "left")
        nb = found.withColumn(source_col, F.coalesce(source_col, F.lit("unknown")))
    else:
        nb = nb.withColumn(source_col, F.concat(F.lit("vec-"), F.col(id_col).cast("string"))).withColumn(text_col, F.lit(""))
    g = nb.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", source_col, "distance", text_col))).alias("_hits"))
    top = F.slice("_hits", 1, C.ANSWER_TOP_SOURCES)
    ctx = F.filter("_hits", lambda h: h["distance"] < C.KNN_CONTEXT_MAX_DISTANCE)
    return g.select(
        "query_id",
        F.transform(top, lambda h: h[source_col]).alias("sources"),
        F.least(F.greatest(1.0 - F.least(F.element_at("_hits", 1)["distance"], F.lit(1.0)), F.lit(0.0)),
                F.lit(1.0)).alias("confidence"),
        F.array_join(F.transform(ctx, lambda h: F.concat(F.lit("[Source: "), h[source_col], F.lit("]\n"),
                                                    F.coalesce(h[text_col], F.lit("")))),
                     "\n\n").alias("context"),
        F.size(ctx).alias("context_hits"))


def write_vectors(vectors: DataFrame, path: str, id_col: str = "vec_id", source_col: str | None = None,
                  vec_col: str = "embedding") -> None:
    """K-2: persist (id, source, embedding) as Parquet for later kNN scans."""
    src = F.col(source_col) if source_col else F.concat(F.lit("vec-"), F.col(id_col).cast("string"))
    vectors.select(id_col, src.alias("source"), vec_col).write.mode("overwrite").parquet(path)
