"""Histogram boosting against the same algorithm in plain Python, row by row."""

import math
import random

import numpy as np
import pytest

from paylens.operators import boosting as B


def _plain(x, y, w, ids, held, cuts, s):
    """[(split or leaf by node) per tree], average precision after each round; loops over rows, exact fractions of 2^-SCALE."""
    unit, n = 1 << B.SCALE, len(cuts)
    margin, trees, history = [0.0] * len(x), [], []
    for number in range(s.rounds):
        features = B.drawn_features(n, number, s.seed, s.columns)
        used = [i for i in range(len(x)) if not held[i] and bool(B.drawn(np.array([ids[i]]), number, s.seed, s.rows)[0])]
        grad = {}
        for i in used:
            p = 1 / (1 + math.exp(-margin[i]))
            grad[i] = (round(w[i] * (p - y[i]) * unit), round(max(w[i] * p * (1 - p), 1e-16) * unit))
        tree = {}

        def grow(node, rows, depth):
            g, h = (sum(grad[i][k] for i in rows) / unit for k in (0, 1))
            best = None
            if depth < s.depth:
                for f in features:
                    for c in cuts[f]:
                        left = [i for i in rows if x[i][f] < c]
                        lg, lh = (sum(grad[i][k] for i in left) / unit for k in (0, 1))
                        rg, rh = g - lg, h - lh
                        if lh < s.least_child or rh < s.least_child:
                            continue
                        gain = 0.5 * (lg ** 2 / (lh + s.reg) + rg ** 2 / (rh + s.reg) - g ** 2 / (h + s.reg))
                        if gain > B.LEAST_GAIN and (best is None or gain > best[0]):
                            best = (gain, f, c)
            tree[node] = (best, h, -s.rate * g / (h + s.reg))
            if best:
                grow(2 * node + 1, [i for i in rows if x[i][best[1]] < best[2]], depth + 1)
                grow(2 * node + 2, [i for i in rows if x[i][best[1]] >= best[2]], depth + 1)

        grow(0, used, 0)
        for i in range(len(x)):
            node = 0
            while tree[node][0]:
                node = 2 * node + (1 if x[i][tree[node][0][1]] < tree[node][0][2] else 2)
            margin[i] += tree[node][2]
        trees.append(tree)
        pos, neg = np.zeros(B.BUCKETS), np.zeros(B.BUCKETS)
        for i in range(len(x)):
            if held[i]:
                (pos if y[i] else neg)[min(int(B.BUCKETS / (1 + math.exp(-margin[i]))), B.BUCKETS - 1)] += 1
        history.append(B.average_precision(pos, neg))
    return trees, history


def _table(spark, x, y, w, ids, held, parts):
    names = [f"f{k}" for k in range(len(x[0]))]
    rows = [(*map(float, a), int(b), float(c), int(d), bool(e)) for a, b, c, d, e in zip(x, y, w, ids, held)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", label int, weight double, id long, held boolean") \
        .repartition(parts), names


def _data(seed, n=160):
    rnd = random.Random(seed)
    x = [[rnd.randrange(8), rnd.random(), rnd.gauss(0, 1), rnd.choice([0.0, 1.0])] for _ in range(n)]
    y = [int(a[0] + 3 * a[1] + rnd.gauss(0, 1) > 6) for a in x]
    return x, y, [2.5 if v else 1.0 for v in y], [rnd.randrange(1 << 40) - (1 << 39) for _ in x], [rnd.random() < 0.25 for _ in x]


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_equal_the_plain_version(spark, seed):
    x, y, w, ids, held = _data(seed)
    cuts = [np.arange(1, 8.0), np.linspace(0.1, 0.9, 9), np.linspace(-2, 2, 11), np.array([1.0])]
    s = B.Settings(rounds=5, depth=3, rate=0.3, least_child=2.0, columns=0.75, seed=seed)
    df, names = _table(spark, x, y, w, ids, held, 3)
    model = B.fit(df, names, s, cuts)
    trees, history = _plain(x, y, w, ids, held, cuts, s)
    assert np.allclose(model.history, history, rtol=1e-12, atol=0)
    best = int(np.argmax(history)) + 1
    assert len(model.trees) == best
    for got, want in zip(model.trees, trees):
        inner = {k: v for k, v in want.items() if v[0]}
        assert set(np.flatnonzero(got.feature >= 0).tolist()) == set(inner)
        for k, (split, cover, value) in want.items():
            assert math.isclose(got.cover[k], cover, rel_tol=1e-12) and math.isclose(got.value[k], value, rel_tol=1e-9, abs_tol=1e-15)
            if split:
                assert (got.feature[k], got.threshold[k]) == split[1:] and math.isclose(got.gain[k], split[0], rel_tol=1e-9)


def test_the_model_does_not_depend_on_partitions_or_refreshes(spark, monkeypatch):
    x, y, w, ids, held = _data(3, 300)
    s = B.Settings(rounds=6, depth=3, rate=0.2, least_child=1.0)
    models = []
    for parts, refresh in ((1, 32), (5, 2)):
        monkeypatch.setattr(B, "REFRESH", refresh)
        df, names = _table(spark, x, y, w, ids, held, parts)
        models.append(B.fit(df, names, s))
    a, b = ([(t.feature.tolist(), t.threshold.tolist(), t.value.tolist()) for t in m.trees] for m in models)
    assert a == b and models[0].history == models[1].history


def test_early_stop_and_round_trip(spark, tmp_path):
    x, y, w, ids, held = _data(4, 400)
    y = [v if not h else random.Random(i).randrange(2) for i, (v, h) in enumerate(zip(y, held))]  # nothing to learn for these
    df, names = _table(spark, x, y, w, ids, held, 2)
    s = B.Settings(rounds=60, depth=2, rate=0.5, least_child=1.0, patience=4)
    model = B.fit(df, names, s)
    best = int(np.argmax(model.history))
    assert len(model.history) == best + 1 + 4 < 60 and len(model.trees) == best + 1
    model.nodes(spark).write.parquet(f"{tmp_path}/m")
    again = B.BoostedTrees.from_nodes(spark.read.parquet(f"{tmp_path}/m"), names)
    a = [r.p for r in model.transform(df, "p").orderBy("id").collect()]
    assert a == [r.p for r in again.transform(df, "p").orderBy("id").collect()] and len(set(a)) > 2


def test_held_out_rows_without_positives_end_the_rounds(spark):
    x, y, w, ids, held = _data(6, 200)
    df, names = _table(spark, x, [0 if h else v for v, h in zip(y, held)], w, ids, held, 2)
    model = B.fit(df, names, B.Settings(rounds=50, depth=2, patience=3, least_child=1.0))
    assert model.history == [0.0] * 4 and len(model.trees) == 1


def test_nothing_to_split_and_no_held_out_rows(spark):
    df, names = _table(spark, [[1.0, 2.0]] * 30, [0, 1] * 15, [1.0] * 30, range(30), [False] * 30, 2)
    model = B.fit(df, names, B.Settings(rounds=3))
    assert len(model.trees) == 3 and all((t.feature < 0).all() for t in model.trees) and model.history == []
    x, y, w, ids, _ = _data(5, 120)
    df, names = _table(spark, x, y, w, ids, [False] * 120, 2)
    full = B.fit(df, names, B.Settings(rounds=4, least_child=1.0))
    assert len(full.trees) == 4
    loss = []
    margin = np.zeros(120)
    for t in full.trees:
        margin += t.value[t.by_values(np.array(x, float))]
        p = 1 / (1 + np.exp(-margin))
        loss.append(-np.mean(np.where(np.array(y) == 1, 2.5 * np.log(p), np.log(1 - p))))
    assert loss == sorted(loss, reverse=True)


def test_a_level_takes_one_stage_and_a_round_few_jobs(spark):
    x, y, w, ids, held = _data(7, 300)
    df, names = _table(spark, x, y, w, ids, held, 2)
    cuts = [np.arange(1, 8.0), np.linspace(0.1, 0.9, 9), np.linspace(-2, 2, 11), np.array([1.0])]
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("boosting-levels", "boosting")
    try:
        B.fit(df, names, B.Settings(rounds=4, depth=3, least_child=1.0, patience=9), cuts)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("boosting-levels")]
    assert len(stages) <= 4 * 3 + 1 + 5 and sum(n > 1 for n in stages) <= 2  # the rest: rows cut into blocks once


def test_quantile_sketches_are_no_more_than_cores(spark):
    """One task merges the sketches of all partitions, so they must not be as many as a large table has partitions."""
    context = spark.sparkContext
    rows = spark.range(0, 4000, 1, 40).selectExpr("CAST(id % 700 AS DOUBLE) AS a")
    context.setJobGroup("quantile-sketches", "quantile cuts")
    try:
        cuts = B.quantile_cuts(rows, ["a"], bins=4)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("quantile-sketches") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= max(context.defaultParallelism, 2)
    values = sorted(i % 700 for i in range(4000))
    assert cuts[0].tolist() == [values[math.ceil(4000 * q) - 1] for q in (0.25, 0.5, 0.75)]


def test_leaves_against_a_walk_row_by_row():
    """Leaves at uneven depths, children anywhere in the table, NaN (goes right), no rows."""
    rng = np.random.default_rng(3)
    feature = np.array([1, -1, 0, -1, 2, -1, -1])
    left, right = np.array([2, -1, 1, -1, 5, -1, -1]), np.array([4, -1, 3, -1, 6, -1, -1])
    threshold, x = rng.normal(size=7), rng.normal(size=(200, 3))
    x[7, 1] = x[8, 0] = np.nan

    def walk(row):
        node = 0
        while feature[node] >= 0:
            node = left[node] if row[feature[node]] < threshold[node] else right[node]
        return node

    for some in (x, x[:0]):
        got = B.leaves(np.ascontiguousarray(some.T), feature, left, right, lambda at, node: at < threshold[node])
        assert got.tolist() == [walk(r) for r in some]


def _both_ways(spark, monkeypatch, df, names, s, cuts=None):
    """The models of files that executors keep, of files made anew in the middle of trees, and of persisted rows."""
    found = []
    for attempts in (1, 99, 2, 0):
        lost, given = iter(range(3, 1000, 7)), B._Local.level
        at, times = next(lost), 0

        def level(self, *args):
            nonlocal at, times
            times += 1
            if attempts > 1 and times == at:
                at = next(lost)
                self.home.foreach(B._remove)
            return given(self, *args)

        with monkeypatch.context() as patch:
            patch.setattr(B, "ATTEMPTS", attempts)
            patch.setattr(B._Local, "level", level)
            found.append(B.fit(df, names, s, cuts))
    return found


def _same(a, b):
    return a.history == b.history and len(a.trees) == len(b.trees) and all(
        (getattr(x, k) == getattr(y, k)).all() for x, y in zip(a.trees, b.trees) for k in ("feature", "cut", "threshold", "gain", "cover", "value"))


def test_files_of_executors_give_the_trees_of_persisted_rows(spark, monkeypatch):
    """Features of few and many bins, drawn rows and features, small blocks; files lost now and then."""
    x, y, w, ids, held = _data(8, 400)
    x = [[*a, float(i % 3), float(i % 2)] for i, a in enumerate(x)]
    df, names = _table(spark, x, y, w, ids, held, 3)
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    s = B.Settings(rounds=5, depth=4, rate=0.3, least_child=1.0, rows=0.8, columns=0.7, patience=12)
    first, *others = _both_ways(spark, monkeypatch, df, names, s)
    assert len(first.history) == 5 and any((t.feature[7:15] >= 0).any() for t in first.trees)
    assert all(_same(first, x) for x in others)


def test_a_level_reads_only_the_rows_of_the_lesser_child(tmp_path):
    """A task's sums of the other child follow from its own parent's, and a level that is asked for again is not done twice."""
    rng = np.random.default_rng(5)
    n, sizes, s = 1000, [256, 2, 3], B.Settings(rows=1.0, least_child=1.0)
    bins = np.stack([rng.integers(0, k, n) for k in sizes]).astype(np.uint8)
    block = (bins, rng.integers(0, 2, n).astype(np.int8), np.ones(n), np.arange(n), np.zeros(n, bool), np.zeros(n))
    [path] = B._written(sizes, [])(iter([block]))
    tree, read = B.Tree.empty(2), []
    given = B._Block.of
    try:
        B._Block.of = lambda self, node: (read.append((node, self.rows(node))), given(self, node))[1]
        [(root, counts, gone)] = B._local_sums(0, None, tree, {0: 0}, [0, 1, 2], 0, sizes, s)(iter([path]))
        tree.feature[0], tree.cut[0] = 0, 200
        read.clear()
        for _ in range(2):
            [(sums, _, _)] = B._local_sums(0, None, tree, {1: 0, 2: 1}, [0, 1, 2], 1, sizes, s)(iter([path]))
    finally:
        B._Block.of = given
        B._remove(path)
    right = int((bins[0] > 200).sum())
    assert gone == 0 and read == [(0, n), (2, right)] and right < n / 2
    g, h = B.gradients(block[5], block[1], block[2])
    for k, rows in enumerate((bins[0] <= 200, bins[0] > 200)):
        for f in range(3):
            for i, x in enumerate((g, h)):
                assert sums[i, k, f].tolist() == np.bincount(bins[f][rows], x[rows], 256).astype(np.int64).tolist()
    assert (sums.sum(1) == root[:, 0]).all()


def test_tables_that_features_share_stay_small():
    sizes = [256, 2, 3, 200, 24, 2, 256, 5]
    tables = B._tables(sizes)
    assert sorted(f for t in tables for f in t) == list(range(len(sizes))) and len(tables) < len(sizes)
    assert all(len(t) == 1 or math.prod(sizes[f] for f in t) <= B.CELLS for t in tables)


def _small_training(spark, tmp_path, monkeypatch):
    """The training queries over 400 events of their own, with 5 isolation trees and 3 rounds; how often features were made, and the scored frames."""
    from paylens.plans import ml_q as Q
    rnd, made, scored = random.Random(11), [], []
    rows = [(i, 1_704_067_200 + 3600 * i, rnd.randrange(9), rnd.choice(["purchase", "error", "view", "click", "signup"]), rnd.random() * 300, '{"k": %d}' % rnd.randrange(50))
            for i in range(400)]
    spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string") \
        .selectExpr("event_id", "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    train, features = Q.ML.train_ensemble, Q.rounded_training_features

    def small(f, **_):
        out = train(f, trees=5, psi=16, max_iter=3)
        scored.append(out[3])
        return out

    monkeypatch.setattr(Q.ML, "train_ensemble", small)
    monkeypatch.setattr(Q, "rounded_training_features", lambda *a, **k: made.append(1) or features(*a, **k))
    return Q, made, scored


def test_features_are_made_once_for_training_and_properties(spark, tmp_path, monkeypatch):
    Q, made, _ = _small_training(spark, tmp_path, monkeypatch)
    row = Q.q_train_properties(spark, str(tmp_path)).collect()[0]
    assert (row.train_rows, row.test_rows, row.scores_in_range, row.metrics_in_range) == (320, 80, 80, True) and len(made) == 1


def test_test_rows_are_scored_once(spark, tmp_path, monkeypatch):
    """The minimum, the maximum, the metrics and the result read stored scores; none of them walks the trees again."""
    Q, _, scored = _small_training(spark, tmp_path, monkeypatch)
    out = Q.q_ensemble_scores(spark, str(tmp_path))
    assert out.count() == 80 and out.columns == ["transaction_id", "merchant_id", "is_fraud", "iso_score", "clf_score", "anomaly_score"]
    assert "EvalPython" not in scored[0]._jdf.queryExecution().toString()
