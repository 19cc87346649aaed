"""Anomaly model: isolation forest + boosted trees ensemble (M-1 … M-10).

Isolation forest (Liu, Ting & Zhou, 2008) has no MLlib class, so:
  * sampling — a row is kept by the hash of its id (about ``trees * 2 * psi`` rows
    whatever the table size) and joins trees by counters of (row, tree); every
    tree takes its ``psi`` rows with the lowest counters (a bounded window group);
  * building — ``groupBy(tree).applyInPandas`` grows each tree on <= psi rows; a
    node's feature and cut are counters of (tree, node), the cut between the
    node's min and max, depth limit ceil(log2 psi).  Nothing depends on the
    partitioning, so plain SQL regrows the same trees.  The node table has at
    most trees * (2 psi - 1) rows, a bound set by the parameters, not the data,
    and is shipped to tasks as a broadcast;
  * scoring — a vectorised pandas UDF walks all trees level by level per Arrow
    batch: s(x) = 2 ** (-E[h(x)] / c(psi)).
Boosted trees are second-order histogram boosting (``boosting``) with class
weights and a validation slice for early stopping.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens import constants as C
from paylens.operators import boosting
from paylens.operators.boosting import BoostedTrees
from paylens.session import ship_package

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, left int, right int, "
               "size long, leaf boolean")


def c_factor(n: float) -> float:
    """Average unsuccessful-search path length in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def assemble(df: DataFrame, columns: list[str] = C.FEATURE_COLUMNS, out: str = "features") -> DataFrame:
    """M-8: feature vector by column list; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Training dataset missing features: {missing}")
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(
        df.fillna(0.0, subset=columns))


PRIME = (1 << 31) - 1


def mixed(x):
    """One step of a counter hash modulo ``PRIME``; of a Python integer or a bigint column."""
    x = x % PRIME
    return (x * x + 48271 * x + 12345) % PRIME


def draw(tree: int, node: int, k: int, seed: int) -> int:
    """The k-th counter of a node, 0 to PRIME - 1."""
    return mixed(mixed(mixed(tree * 1_000_003 + node * 10_007 + k * 101 + seed)))


def _hex(text, start: int, digits: int):
    return F.conv(F.substring(text, start, digits), 16, 10).cast("long")


def iforest_sample(df: DataFrame, id_col: str, trees: int, psi: int, seed: int) -> DataFrame:
    """Rows per tree: a bounded subsample (<= psi rows per tree), chosen by counters of the id's md5 (null ids: none)."""
    n = df.select(F.count(F.lit(1))).scalar()
    keep = F.least(F.lit(1.0), F.lit(float(trees * 2 * psi)) / n.cast("double"))
    name = F.md5(F.col(id_col).cast("string").cast("binary"))
    # P(row in a given tree | kept), as a column: subqueries may not sit inside lambdas
    kept = df.withColumn("_m1", _hex(name, 1, 8)).withColumn("_m2", _hex(name, 9, 7)).filter(F.col("_m1") / float(1 << 32) < keep) \
        .withColumn("_share", F.lit(2.0 * psi) / (keep * n.cast("double")))

    def key(tree):
        return mixed(mixed(F.col("_m2") + tree * 1_000_003 + seed))

    tids = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")), lambda t: key(t) / float(PRIME) < F.col("_share"))
    assigned = kept.select("*", F.explode(tids).alias("tree_id"))
    w = Window.partitionBy("tree_id").orderBy(key(F.col("tree_id")), id_col)
    return assigned.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).drop("_r", "_m1", "_m2", "_share") \
        .withColumn("tree_id", F.col("tree_id").cast("int"))


def _grow(pdf: pd.DataFrame, columns: list[str], psi: int, seed: int) -> pd.DataFrame:
    """One tree; children of node k are 2k + 1 and 2k + 2."""
    tree_id = int(pdf["tree_id"].iloc[0])
    x = pdf[columns].to_numpy(dtype=float)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    nodes = []
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        node_id, idx, depth = stack.pop()
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        free = np.flatnonzero(hi > lo)
        if depth >= limit or len(idx) <= 1 or not len(free):
            nodes.append((tree_id, node_id, -1, 0.0, -1, -1, len(idx), True))
            continue
        f = int(free[draw(tree_id, node_id, 0, seed) % len(free)])
        thr = float(lo[f] + draw(tree_id, node_id, 1, seed) / float(PRIME) * (hi[f] - lo[f]))
        go_left = sub[:, f] < thr
        left, right = 2 * node_id + 1, 2 * node_id + 2
        kept = [(child, part) for child, part in ((left, idx[go_left]), (right, idx[~go_left]))]
        nodes.append((tree_id, node_id, f, thr, left, right, len(idx), False))
        stack += [(child, part, depth + 1) for child, part in kept if len(part)]
        nodes += [(tree_id, child, -1, 0.0, -1, -1, 0, True) for child, part in kept if not len(part)]
    return pd.DataFrame(nodes, columns=["tree_id", "node_id", "feature", "threshold", "left", "right",
                                        "size", "leaf"])


def fit_isolation_forest(df: DataFrame, columns: list[str] = C.FEATURE_COLUMNS, id_col: str = "transaction_id",
                         trees: int = 200, psi: int = 256, seed: int = 42) -> DataFrame:
    """M-2 fit: node table (tree_id, node_id, feature, threshold, left, right, size, leaf)."""
    ship_package(df.sparkSession)
    sample = iforest_sample(df.select(id_col, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                                for c in columns]), id_col, trees, psi, seed)
    return sample.groupBy("tree_id").applyInPandas(lambda pdf: _grow(pdf, columns, psi, seed), NODE_SCHEMA)


class IsolationForestModel:
    """Node arrays per tree, scored level by level over Arrow batches."""

    def __init__(self, nodes: pd.DataFrame, columns: list[str], psi: int):
        self.columns, self.psi = list(columns), psi
        self.trees = []
        for _, t in nodes.sort_values(["tree_id", "node_id"]).groupby("tree_id"):
            size = int(t["node_id"].max()) + 1
            arr = {k: np.zeros(size, dtype=d) for k, d in
                   (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64),
                    ("size", float), ("leaf", bool))}
            ids = t["node_id"].to_numpy()
            for k in arr:
                arr[k][ids] = t[k].to_numpy()
            # depth of each node and the adjustment c(size) at leaves
            depth = np.zeros(size)
            for nid in ids:
                if not arr["leaf"][nid]:
                    depth[arr["left"][nid]] = depth[nid] + 1
                    depth[arr["right"][nid]] = depth[nid] + 1
            arr["path"] = depth + np.array([c_factor(s) if lf else 0.0 for s, lf in zip(arr["size"], arr["leaf"])])
            self.trees.append(arr)
        self.norm = c_factor(min(psi, max(2, psi)))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        values = np.ascontiguousarray(x.T)
        for t in self.trees:
            feature = np.where(t["leaf"], -1, t["feature"])
            total += t["path"][boosting.leaves(values, feature, t["left"], t["right"], lambda at, node: at < t["threshold"][node])]
        mean_path = total / max(len(self.trees), 1)
        return np.power(2.0, -mean_path / self.norm) if self.norm > 0 else np.full(len(x), 0.5)

    def transform(self, df: DataFrame, out: str = "iso_score") -> DataFrame:
        spark = df.sparkSession
        ship_package(spark)
        bc = spark.sparkContext.broadcast(self)
        cols = self.columns

        @F.pandas_udf(T.DoubleType())
        def iso(*series: pd.Series) -> pd.Series:
            x = np.column_stack([s.fillna(0.0).to_numpy(dtype=float) for s in series])
            return pd.Series(bc.value.score(x))

        return df.withColumn(out, iso(*[F.col(c).cast("double") for c in cols]))


def load_isolation_forest(nodes: DataFrame, columns: list[str] = C.FEATURE_COLUMNS,
                          psi: int = 256) -> IsolationForestModel:
    """Collect the node table into a scorer; fitting bounds it by trees * (2 psi - 1) rows."""
    return IsolationForestModel(nodes.toPandas(), columns, psi)


def train_classifier(train: DataFrame, label: str = "is_fraud", max_iter: int = 450, seed: int = 42,
                     validation_fraction: float = 0.1) -> BoostedTrees:
    """M-3: boosted trees under the published settings (``boosting.Settings``), positives weighted by neg / pos.

    Early stopping looks at a slice of the *training* rows (the newest
    ``validation_fraction`` by time), not at the test split.
    """
    from paylens.functions.timecols import epoch_micros
    stats = boosting.in_few_parts(train).agg(
        (F.count(F.when(~F.col(label), 1)).cast("double") / F.greatest(F.count(F.when(F.col(label), 1)), F.lit(1)).cast("double")).alias("w"),
        F.percentile_approx(epoch_micros("timestamp"), 1.0 - validation_fraction, 10_000).alias("cut")).first()
    rows = train.select(
        *C.FEATURE_COLUMNS, F.coalesce(F.col(label), F.lit(False)).cast("int").alias("label"),
        F.when(F.col(label), F.lit(stats.w)).otherwise(F.lit(1.0)).alias("weight"),
        F.xxhash64("transaction_id").alias("id"), (epoch_micros("timestamp") > F.lit(stats.cut)).alias("held"))
    return boosting.fit(rows, C.FEATURE_COLUMNS, boosting.Settings(rounds=max_iter, seed=seed))


def classifier_scores(model: BoostedTrees, df: DataFrame, out: str = "clf_score") -> DataFrame:
    return model.transform(df, out)


def predict(df: DataFrame, iso: IsolationForestModel, clf: BoostedTrees,
            iso_range: tuple[float, float] | None = None) -> DataFrame:
    """M-7: .3 * iso + .7 * clf, clamped; missing features -> 0.

    Like the served model the isolation score is used raw unless ``iso_range``
    (training min, max) is given, which applies the training-time min-max.
    """
    for c in C.FEATURE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    scored = classifier_scores(clf, iso.transform(df))
    iso_col = F.col("iso_score")
    if iso_range is not None:
        lo, hi = iso_range
        iso_col = (iso_col - lo) / (hi - lo + 1e-9)
    s = C.ENSEMBLE_ISO_WEIGHT * iso_col + C.ENSEMBLE_CLF_WEIGHT * F.col("clf_score")
    return scored.withColumn("anomaly_score", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


class EnsembleModel:
    """M-7 as an object for R-9: ``transform`` adds anomaly_score; absent features count as 0."""

    def __init__(self, iso: IsolationForestModel, clf: BoostedTrees, iso_range: tuple[float, float] | None = None):
        self.iso, self.clf, self.iso_range = iso, clf, iso_range

    def transform(self, df: DataFrame) -> DataFrame:
        return predict(df, self.iso, self.clf, self.iso_range).drop("iso_score", "clf_score")


def train_ensemble(features: DataFrame, trees: int = 200, psi: int = 256, max_iter: int = 450,
                   seed: int = 42):
    """M-1 … M-6: chronological split, fit both models on train, min-max ensemble on test, metrics.

    ``features`` is read many times, each time by few columns: give a stored table.
    """
    from paylens.operators.evaluation import chronological_split, ensemble, evaluate
    from paylens.session import cut_lineage, stored
    split = chronological_split(features)
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    nodes = cut_lineage(fit_isolation_forest(train, trees=trees, psi=psi, seed=seed))   # grown once, read twice
    iso = load_isolation_forest(nodes, psi=psi)
    clf = train_classifier(train, max_iter=max_iter, seed=seed)
    both = stored(classifier_scores(clf, iso.transform(test)), "scored")   # the rows are scored once, read by every step below
    scored = ensemble(both, "iso_score", "clf_score")
    metrics = evaluate(scored, "anomaly_score", "is_fraud")
    return iso, nodes, clf, scored, metrics


def save_models(path: str, nodes: DataFrame, clf: BoostedTrees, metrics: DataFrame) -> None:
    """M-9: the two models' node tables and the metrics table under one root."""
    nodes.write.mode("overwrite").parquet(f"{path}/isolation_forest")
    clf.nodes(nodes.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{path}/classifier")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_models(spark, path: str, psi: int = 256):
    nodes = spark.read.parquet(f"{path}/isolation_forest")
    return (load_isolation_forest(nodes, psi=psi),
            BoostedTrees.from_nodes(spark.read.parquet(f"{path}/classifier"), C.FEATURE_COLUMNS),
            spark.read.parquet(f"{path}/metrics"))
