"""Sources and sinks round trips (SRC-1, SRC-2, SRC-10, SRC-11, SNK-1 … SNK-9, K-2, J-7, M-7, M-9)."""

import json
import os
import uuid

from pyspark.sql import functions as F

from paylens import schemas
from paylens.session import checkpoint_dir
from paylens.sinks import writers as W
from paylens.sources import files as FS
from paylens.sources.tables import transactions

SF = "/root/testdata/sf0.001"


def _dir(spark):
    return f"{checkpoint_dir(spark)}/sinks-{uuid.uuid4().hex}"


def test_partitioned_write_prunes(spark):
    root = _dir(spark)
    tx = transactions(spark, SF)
    W.write_partitioned(tx, f"{root}/cleaned", ["merchant_category", "state"])
    back = spark.read.parquet(f"{root}/cleaned").filter((F.col("state") == "NSW") & (F.col("merchant_category") == "hospitality"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "NSW" in plan
    assert back.count() == tx.filter("state = 'NSW' AND merchant_category = 'hospitality'").count()


def test_csv_and_parquet_fallback(spark):
    root = _dir(spark)
    tx = transactions(spark, SF).limit(50)
    W.write_dataset(tx, f"{root}/t.csv", fmt="csv")
    got = FS.read_dataset(spark, f"{root}/t.parquet", schemas.TRANSACTIONS)    # missing parquet -> csv
    assert got.count() == 50 and got.schema == schemas.TRANSACTIONS
    W.write_dataset(tx, f"{root}/p.parquet")
    assert FS.table_or_path(spark, f"{root}/p.parquet").count() == 50


def test_register_and_append(spark):
    tx = transactions(spark, SF)
    name = f"tx_{uuid.uuid4().hex[:8]}"
    assert W.register_table(spark, name, tx)
    assert not W.register_table(spark, name, tx)                           # exists: skipped
    assert spark.table(name).count() == tx.count()


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "faq.md").write_text("# FAQ\nline two\n")
    (tmp_path / "kb" / "sub").mkdir()
    (tmp_path / "kb" / "sub" / "guide.md").write_text("guide text")
    (tmp_path / "kb" / "skip.txt").write_text("not markdown")
    rows = FS.read_markdown_corpus(spark, str(tmp_path / "kb")).collect()
    assert sorted(os.path.basename(r.source) for r in rows) == ["faq.md", "guide.md"]
    assert any(r.text == "# FAQ\nline two\n" for r in rows)


def test_audit_snapshot_report(spark):
    from paylens.operators.questions import answer_questions, questions_from_conversations
    from paylens.sources.tables import read_table
    from paylens.streaming.snapshots import latest_version, upsert_snapshot
    root = _dir(spark)
    q = questions_from_conversations(read_table(spark, SF, "conversations"), read_table(spark, SF, "events"))
    audit = W.audit_rows(answer_questions(q, transactions(spark, SF)))
    W.write_audit(audit, f"{root}/audit")
    assert spark.read.json(f"{root}/audit").count() == q.count()
    tx = transactions(spark, SF).withColumn("event_ts", F.col("timestamp")).withColumn("anomaly_score", F.lit(0.1))
    upsert_snapshot(tx.filter("timestamp < '2024-01-10'"), f"{root}/snap", 0)
    upsert_snapshot(tx, f"{root}/snap", 1)
    upsert_snapshot(tx, f"{root}/snap", 1)                                   # replay: same version
    snap = latest_version(spark, f"{root}/snap")
    assert snap.count() == tx.select("merchant_id").distinct().count()
    recs = W.feature_records(snap.select("merchant_id", "amount_aud", "state"))
    assert recs.count() == 2 * snap.count()
    W.write_report(spark.range(1).select(F.lit(7).alias("success_count")), f"{root}/report")
    assert json.loads(spark.read.text(f"{root}/report").first()[0]) == {"success_count": 7}


def test_vectors_and_stream_static_join(spark):
    from paylens.operators.retrieval import write_vectors
    from paylens.sources.tables import read_table
    from paylens.streaming.consumer import enrich
    root = _dir(spark)
    write_vectors(read_table(spark, SF, "embeddings"), f"{root}/vec")
    v = spark.read.parquet(f"{root}/vec")
    assert v.columns == ["vec_id", "source", "embedding"]
    stream = spark.readStream.schema(v.schema).parquet(f"{root}/vec")
    joined = enrich(stream.withColumnRenamed("vec_id", "merchant_id"),
                    v.select(F.col("vec_id").alias("merchant_id"), F.lit(1).alias("f")))
    assert joined.isStreaming and "f" in joined.columns


def test_predict_save_load(spark):
    from paylens.operators import ml as ML
    from paylens.operators.features import training_features
    root = _dir(spark)
    f = training_features(transactions(spark, SF)).cache()
    nodes = ML.fit_isolation_forest(f, trees=10, psi=64)
    iso = ML.load_isolation_forest(nodes, psi=64)
    clf = ML.train_classifier(f, max_iter=5)
    from paylens.operators.evaluation import evaluate
    metrics = evaluate(ML.classifier_scores(clf, f), "clf_score", "is_fraud")
    ML.save_models(root, nodes, clf, metrics)
    iso2, clf2, m2 = ML.load_models(spark, root, psi=64)
    a = ML.predict(f.drop("amount_zscore"), iso, clf).select("transaction_id", "anomaly_score").toPandas()
    b = ML.predict(f.drop("amount_zscore"), iso2, clf2).select("transaction_id", "anomaly_score").toPandas()
    assert a.sort_values("transaction_id").anomaly_score.round(12).tolist() == \
        b.sort_values("transaction_id").anomaly_score.round(12).tolist()
    assert a.anomaly_score.between(0, 1).all()
    assert m2.count() == 1


def _bytes(path):
    import os
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_snapshot_store_writes_follow_the_batch_and_replays_change_nothing(spark, tmp_path):
    from paylens.streaming import snapshots as SN
    root = f"{tmp_path}/store"

    def batch(n, merchants, hour):
        return spark.range(n).selectExpr(
            f"concat('M', id % {merchants}) merchant_id", f"timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,{hour},0,id) event_ts",
            f"concat('T{hour:03}-', id) transaction_id", "cast(id as double) amount_aud", "'NSW' state")

    SN.upsert_snapshot(batch(4000, 2000, 0), root, 0, least_rows=1000)              # becomes the base
    assert SN._listed(spark, root, "base") == [0]
    sizes = []
    for k in range(1, 6):
        SN.upsert_snapshot(batch(40, 20, k), root, k, least_rows=1000)
        sizes.append(_bytes(SN._at(root, "version", k)))
    assert SN._listed(spark, root, "base") == [0] and max(sizes) < _bytes(SN._at(root, "base", 0))

    def state(at=1 << 62):
        return sorted(tuple(r) for r in SN.version(spark, root, at).select("merchant_id", "transaction_id").collect())

    before, third = state(), state(3)
    assert len(before) == 2000 and ("M7", "T005-27") in before and ("M7", "T003-27") in third and ("M77", "T000-2077") in before
    SN.upsert_snapshot(batch(40, 20, 3), root, 3, least_rows=1000)                  # replay
    assert state() == before and state(3) == third
    SN.compact(spark, root, 5, kept=2)
    assert state() == before and SN._listed(spark, root, "base") == [0, 5] and state(3) == third   # still readable
    SN.upsert_snapshot(batch(40, 20, 2), root, 2, least_rows=1000)                  # older than the base: nothing
    assert state() == before
    SN.upsert_snapshot(batch(40, 20, 6), root, 6, least_rows=1000)
    SN.compact(spark, root, 8, kept=2)
    assert SN._listed(spark, root, "base") == [5, 8] and SN._listed(spark, root, "version") == [6]
    assert ("M7", "T006-27") in state() and len(state()) == 2000
    one = SN.version(spark, root, 1 << 62, merchants=["M7"])
    assert [tuple(r) for r in one.select("merchant_id", "transaction_id").collect()] == [("M7", "T006-27")]
    assert SN.latest_version(spark, f"{tmp_path}/none") is None


def test_snapshot_store_compacts_when_deltas_outgrow_the_base(spark, tmp_path):
    from paylens.streaming import snapshots as SN
    root, written = f"{tmp_path}/store", 0
    for k in range(12):
        rows = spark.range(50).selectExpr(f"concat('M', id + {50 * k}) merchant_id", "timestamp'2026-01-01' event_ts",
                                          "'t' transaction_id", "1D amount_aud")
        SN.upsert_snapshot(rows, root, k, least_rows=100, kept=1)
        written += 50
        assert SN.latest_version(spark, root).count() == written
    bases = SN._listed(spark, root, "base")
    assert bases[-1] >= 6 and len(SN._listed(spark, root, "version")) <= 12 - bases[-2] if len(bases) > 1 else bases


def test_retried_append_changes_nothing(spark, tmp_path):
    from paylens.sinks import writers as W
    name = "retried_append_t"
    try:
        for batch in ("a", "b'\\", "a", "b'\\"):
            W.append_table(spark.range(3).select("id", F.lit(batch).alias("v")), name, f"{tmp_path}/{name}", batch_id=batch)
        assert sorted((r.id, r.v, r.batch_id) for r in spark.table(name).collect()) == [
            (i, b, b) for i in range(3) for b in ("a", "b'\\")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
