"""G-1 cumulative, chronological split and curve metrics against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paylens.operators import evaluation as EV
from paylens.operators.ranking import global_cumulative


def test_global_cumulative_with_hot_key(spark):
    rng = np.random.default_rng(7)
    keys = np.concatenate([rng.integers(0, 500, 3000), np.full(2000, 250)])      # one key holds 40 %
    df = spark.createDataFrame(pd.DataFrame({"k": keys.astype(float), "n": 1}))
    got = global_cumulative(df, "k", ["n"], buckets=16).toPandas().sort_values("k")
    exp = pd.Series(keys).value_counts().sort_index().cumsum()
    assert got["cum_n"].tolist() == exp.tolist()
    desc = global_cumulative(df, "k", ["n"], buckets=16, descending=True).toPandas().sort_values("k")
    exp_d = pd.Series(keys).value_counts().sort_index(ascending=False).cumsum().sort_index()
    assert desc["cum_n"].tolist() == exp_d.tolist()


def test_no_single_partition_over_rows(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("k"), F.lit(1).alias("n"))
    plan = global_cumulative(df, "k", ["n"])._jdf.queryExecution().executedPlan().toString()
    # the only unpartitioned window is over the per-bucket totals (<= buckets rows)
    assert plan.count("SinglePartition") <= 3


def brute_metrics(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    order = np.argsort(-s, kind="stable")
    ap = 0.0
    for t in np.unique(s)[::-1]:
        pred = s >= t
        tp = (pred & (y == 1)).sum()
        prec = tp / pred.sum()
        ap += ((s == t) & (y == 1)).sum() / (y == 1).sum() * prec
    return auc, ap


def test_metrics_match_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 0.5 + y * 0.3, 2)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "label": y}))
    m = EV.evaluate(df, "score", "label").first()
    auc, ap = brute_metrics(y, s)
    assert abs(m.roc_auc - auc) < 1e-12 and abs(m.avg_precision - ap) < 1e-12
    assert m.total_samples == 300 and m.fraud_samples == int(y.sum())
    assert 0.05 <= m.threshold <= 0.95


def test_chronological_split(spark):
    from datetime import datetime, timedelta
    rows = [(f"T{i:02d}", datetime(2024, 1, 1) + timedelta(hours=i // 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp_ntz")
    got = {r.transaction_id: r.split for r in EV.chronological_split(df, 0.8).collect()}
    assert [got[f"T{i:02d}"] for i in range(10)] == ["train"] * 8 + ["test"] * 2


def test_ordered_positions_strings(spark):
    from paylens.operators.ranking import ordered_positions
    ids = [f"K{(i * 7919) % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in ids], "k string")
    got = {r.k: r._pos for r in ordered_positions(df, ["k"], partitions=8).collect()}
    assert [got[k] for k in sorted(ids)] == list(range(1, 1001))


def test_chronological_split_large_tie_group(spark):
    from datetime import datetime
    rows = [(f"T{i:03d}", datetime(2024, 1, 1)) for i in range(50)]          # all share one timestamp
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp_ntz")
    a = {r.transaction_id: r.split for r in EV.chronological_split(df, 0.8).collect()}
    b = {r.transaction_id: r.split for r in EV.chronological_split(df, 0.8).collect()}
    assert a == b and sum(v == "train" for v in b.values()) == 40
    assert all(b[f"T{i:03d}"] == ("train" if i < 40 else "test") for i in range(50))


def test_running_totals_with_more_buckets_than_keys(spark):
    rng = np.random.default_rng(1)
    keys = np.round(rng.standard_normal(4000), 2)
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "n": np.arange(4000)}))
    want = pd.Series(np.arange(4000)).groupby(keys).sum().sort_index().cumsum()
    for buckets in (1, 3, 2000):
        got = global_cumulative(df, "k", ["n"], buckets=buckets).toPandas().sort_values("k")
        assert got["k"].tolist() == want.index.tolist() and got["cum_n"].tolist() == want.tolist()


def test_bucket_count_is_not_capped(spark):
    from paylens.operators import ranking as RK

    class Frame:
        sparkSession = spark  # noqa: N815

        class _jdf:  # noqa: N801
            @staticmethod
            def queryExecution():  # noqa: N802
                class Plan:
                    optimizedPlan = stats = lambda self: self
                    sizeInBytes = lambda self: 100 << 40  # noqa: E731, N815
                return Plan()

    assert RK.bucket_count(Frame) == (100 << 40) // RK.BUCKET_BYTES > 1_000_000


def test_split_reads_three_times_and_shuffles_only_the_cut_hour(spark):
    from datetime import datetime, timedelta
    rows = [(f"T{i:03d}", datetime(2024, 1, 1) + timedelta(minutes=(i * 37) % 600)) for i in range(400)] + [("late", None)]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp_ntz")
    out = EV.chronological_split(df, 0.7)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    ordered = sorted((t, i) for i, t in rows if t is not None)
    want = {i: "train" if n < 280 else "test" for n, (_, i) in enumerate(ordered)}
    assert {r.transaction_id: r.split for r in out.collect()} == want
    for share, side in ((0.0, "test"), (1.0, "train")):
        assert {r.split for r in EV.chronological_split(df, share).collect()} == {side}
    assert EV.chronological_split(df.limit(0)).count() == 0


def test_metrics_where_the_best_score_lies_outside_the_bounds(spark):
    def metrics(rows, **kw):
        return EV.evaluate(spark.createDataFrame(rows, "score double, label int"), **kw).first()

    low = metrics([(0.01, 1), (0.02, 1), (0.001, 0)])
    assert (low.threshold, low.precision_at_threshold, low.recall_at_threshold) == (0.05, 0.0, 0.0)
    high = metrics([(0.99, 1), (0.98, 1), (0.97, 1), (0.1, 0)])
    assert (high.threshold, high.precision_at_threshold, high.recall_at_threshold) == (0.95, 1.0, 1.0)
    given = metrics([(0.9, 1), (0.8, 0), (0.3, 1)], threshold=0.8)
    assert (given.threshold, given.precision_at_threshold, given.recall_at_threshold) == (0.8, 0.5, 0.5)
    none = metrics([])
    assert none.threshold == 0.85 and none.roc_auc is None
