"""Streaming consumer edge cases and the isolation forest."""

import base64
import json
import uuid

import numpy as np
import pandas as pd

from paylens.operators import ml as ML
from paylens.session import checkpoint_dir
from paylens.streaming import consumer as CS


def _b64(d) -> str:
    return base64.b64encode((d if isinstance(d, str) else json.dumps(d)).encode()).decode()


def _run(spark, root, recs, **kw):
    spark.createDataFrame(recs, "key string, data string").write.mode("append").json(f"{root}/landing")
    for q in CS.start_consumer(spark, CS.record_stream(spark, f"{root}/landing"), f"{root}/out", f"{root}/ck", **kw):
        q.awaitTermination()


def _zone(spark, root, name):
    return spark.read.parquet(f"{root}/out/{name}").collect()


def test_consumer_rejects_dedupes_and_alerts(spark):
    root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    base = {"transaction_id": "T1", "merchant_id": "M1", "amount_aud": 5000.0, "timestamp": "2026-01-01T10:00:00",
            "merchant_abn": "1", "currency": "AUD", "is_outside_business_hours": True, "channel": "web"}
    recs = [("M1", _b64(base)), ("M1", _b64(base)),                                  # duplicate id
            ("M1", _b64({**base, "transaction_id": "T2", "amount_aud": 10.0})),
            ("M1", _b64({**base, "transaction_id": "T3", "amount_aud": None})),      # a null value passes
            ("M1", _b64({**base, "transaction_id": "T4", "timestamp": "soon"})),
            ("M1", _b64({**base, "transaction_id": "T5", "amount_aud": "much"})),
            ("M1", _b64({"merchant_id": "M1"})), ("M1", "@@@"), ("M1", _b64("[1, 2]"))]
    _run(spark, root, recs)
    raw = _zone(spark, root, "raw")
    want = [json.dumps({**base, "transaction_id": t, **x}) for t, x in
            (("T1", {}), ("T1", {}), ("T2", {"amount_aud": 10.0}), ("T3", {"amount_aud": None}))]
    assert sorted(r.value for r in raw) == sorted(want)                              # verbatim, before the dedupe
    assert sorted(r.transaction_id for r in _zone(spark, root, "scored")) == ["T1", "T2", "T3"]
    scored = next(r for r in _zone(spark, root, "scored") if r.transaction_id == "T1")
    assert (scored.merchant_abn, scored.currency, scored.is_outside_business_hours) == ("1", "AUD", True)
    alerts = _zone(spark, root, "alerts")
    assert [(a.transaction_id, a.anomaly_score) for a in alerts] == [("T1", 1.0)]
    rejects = _zone(spark, root, "rejects")
    assert sorted(r.reason for r in rejects) == [
        "bad_amount", "bad_timestamp", "missing:amount_aud,timestamp,transaction_id", "not_json_object", "undecodable"]
    assert len(raw) + len(rejects) + len(_zone(spark, root, "late")) == len(recs)
    snap = spark.read.parquet(f"{root}/out/snapshots/version={0:012d}").collect()
    assert [s.merchant_id for s in snap] == ["M1"]


def test_late_records_are_kept(spark):
    root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    rec = lambda t, h: ("M1", _b64({"transaction_id": t, "merchant_id": "M1", "amount_aud": 1.0,
                                    "timestamp": f"2026-01-01T{h:02d}:30:00"}))
    _run(spark, root, [rec("A", 12)])
    _run(spark, root, [rec("LATE3H", 9), rec("B", 12)])
    _run(spark, root, [rec("LATE2H", 10), rec("C", 11)])
    ids = lambda name: sorted(json.loads(r.value)["transaction_id"] for r in _zone(spark, root, name))
    assert ids("raw") == ["A", "B", "C"] and ids("late") == ["LATE2H", "LATE3H"]
    assert sorted(r.transaction_id for r in CS.read_raw(spark, f"{root}/out").collect()) == ["A", "B", "C"]


def _velocity_changes(spark, root, batches, **kw):
    """The changes after landing ``batches`` of (merchant, id, time) one after the other."""
    from paylens.streaming import velocity as V
    for rows in batches:
        pdf = pd.DataFrame(rows, columns=["merchant_id", "transaction_id", "event_ts"])
        spark.createDataFrame(pdf.astype({"event_ts": "datetime64[us]"})).coalesce(1).write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema("merchant_id string, transaction_id string, event_ts timestamp").json(f"{root}/in")
        with CS.state_in_rocksdb(spark):
            q = (V.exact_velocity(stream, **kw).writeStream.format("parquet").option("path", f"{root}/out")
                 .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def test_velocity_of_late_events(spark):
    """20:00 on day 1, 00:00 on day 3, then 10:00 on day 2: the last sees the first, and the second is revised."""
    from paylens.streaming import velocity as V
    root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    times = [pd.Timestamp(t) for t in ("2026-01-01 20:00", "2026-01-03 00:00", "2026-01-02 10:00", "2026-01-01 00:00")]
    changes = _velocity_changes(spark, root, [[("M1", f"T{k}", t)] for k, t in enumerate(times)], lateness_hours=30, block_hours=6)
    got = sorted((r.transaction_id, r.txn_velocity_24h, r.change) for r in changes.collect())
    assert got == [("T0", 1, 1), ("T1", 1, -1), ("T1", 1, 1), ("T1", 2, 1), ("T2", 2, 1)]  # T3 is older than the watermark
    assert sorted((r.transaction_id, r.txn_velocity_24h) for r in V.current_counts(changes).collect()) == [("T0", 1), ("T1", 2), ("T2", 2)]


def test_velocity_equals_the_batch_counts_whatever_arrives_when(spark):
    """Random late events, ties at a block's edge, equal ids and a hot merchant, in blocks of 1, 6 and 24 hours."""
    import random
    from paylens.streaming import velocity as V
    for block in (1, 6, 24):
        rnd = random.Random(block)
        root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
        start = pd.Timestamp("2026-01-01")
        edge = [0, 3600, 3600 * 6, 86400, 86400 + 3600]
        rows = [(rnd.choice(["hot", "hot", "M2"]), f"T{k % 70}",
                 start + pd.Timedelta(rnd.choice([rnd.choice(edge), rnd.randrange(2 * 86400)]), "s")) for k in range(80)]
        changes = _velocity_changes(spark, root, [rows[:30], rows[30:60], rows[60:]], lateness_hours=24 * 30, block_hours=block)

        def inside(m, t, hours):
            return sum(1 for x, _, u in rows if x == m and t - pd.Timedelta(hours, "h") < u <= t)

        want = sorted((m, i, str(t), inside(m, t, 1), inside(m, t, 24)) for m, i, t in rows)
        assert sorted((r.merchant_id, r.transaction_id, str(r.event_ts), r.txn_velocity_1h, r.txn_velocity_24h)
                      for r in V.current_counts(changes).collect()) == want
        assert {r.change for r in changes.collect()} == {-1, 1}


def test_isolation_forest_flags_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    x[:10] += 8.0
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["transaction_id"] = [f"T{i}" for i in range(len(pdf))]
    df = spark.createDataFrame(pdf)
    nodes = ML.fit_isolation_forest(df, ["a", "b", "c"], trees=50, psi=128, seed=1)
    assert nodes.select("tree_id").distinct().count() == 50
    model = ML.load_isolation_forest(nodes, ["a", "b", "c"], psi=128)
    s = model.transform(df).toPandas().set_index("transaction_id")["iso_score"]
    assert s.iloc[:10].mean() > s.iloc[10:].quantile(0.99)
    assert s.between(0, 1).all()


def test_c_factor():
    assert ML.c_factor(1) == 0.0 and ML.c_factor(2) == 1.0
    assert abs(ML.c_factor(256) - 10.244770920116851) < 1e-6


def test_consumer_restart_without_duplicates(spark):
    """A second run on the same checkpoint processes only new files; replays add nothing."""
    root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    mk = lambda i: ("M1", _b64({"transaction_id": f"T{i}", "merchant_id": "M1", "amount_aud": 1.0 * i,
                                "timestamp": f"2026-01-01T10:{i:02d}:00"}))
    _run(spark, root, [mk(i) for i in range(5)])
    for q in CS.start_consumer(spark, CS.record_stream(spark, f"{root}/landing"), f"{root}/out", f"{root}/ck"):
        q.awaitTermination()                             # a restart with nothing new
    _run(spark, root, [mk(i) for i in range(5, 8)])
    assert sorted(r.transaction_id for r in _zone(spark, root, "scored")) == sorted(f"T{i}" for i in range(8))
    assert len(_zone(spark, root, "raw")) == 8


def test_sparse_merchants_share_state_entries(spark):
    """300 merchants on one day: a state entry per bucket and block, not one per merchant."""
    from paylens.streaming import velocity as V
    root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    rows = [(f"M{k}", f"T{k}", pd.Timestamp("2026-01-01 10:00") + pd.Timedelta(k, "s")) for k in range(300)]
    pdf = pd.DataFrame([*rows, (None, None, rows[0][2])], columns=["merchant_id", "transaction_id", "event_ts"])
    spark.createDataFrame(pdf.astype({"event_ts": "datetime64[us]"}), "merchant_id string, transaction_id string, event_ts timestamp") \
        .write.json(f"{root}/in")
    stream = spark.readStream.schema("merchant_id string, transaction_id string, event_ts timestamp").json(f"{root}/in")
    with CS.state_in_rocksdb(spark):
        q = (V.exact_velocity(stream, block_hours=24, buckets=4).writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    held = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
    assert 0 < held <= 4 * 2 * 4  # buckets x blocks x (rows, timer and its index)
    got = V.current_counts(spark.read.parquet(f"{root}/out")).collect()
    assert len(got) == 301 and {(r.txn_velocity_1h, r.txn_velocity_24h) for r in got} == {(1, 1)}


def test_records_are_parsed_once_for_each_field(spark):
    """Every JSON function of the classification stands once in the plan, and the processor gets no decoded text."""
    records = spark.createDataFrame([("k", "e30="), ("k", "@"), ("k", None)], "key string, data string")
    d = CS.classify(records)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 2 and plan.lower().count("jsonobjectkeys") == 1
    assert sorted((r.reason or "").split(":")[0] for r in d.collect()) == ["missing", "undecodable", "undecodable"]


def test_windowed_velocity(spark):
    from pyspark.sql import functions as F
    from paylens.streaming.velocity import windowed_velocity
    root = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    rows = [("M1", f"2026-01-01 10:{m:02d}:00") for m in (0, 10, 50)] + [("M1", "2026-01-01 13:00:00")]
    spark.createDataFrame(rows, "merchant_id string, t string").write.parquet(f"{root}/in")
    src = (spark.readStream.schema("merchant_id string, t string").parquet(f"{root}/in")
           .withColumn("event_ts", F.col("t").cast("timestamp")))
    q = (windowed_velocity(src, "1 hour", watermark="1 minute").writeStream.format("parquet")
         .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.window.start.hour, r.txn_count) for r in spark.read.parquet(f"{root}/out").collect()}
    assert (10, 3) in got                                # the 10:00 window closed once 13:00 advanced the watermark
