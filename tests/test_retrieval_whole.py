"""Retrieval over whole texts."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_context_holds_whole_texts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    long = 0
    for r in E.queries()["retrieval_answer"](spark, SF_SMALL).collect():
        for source in r.sources.split(",")[:r.context_hits]:
            text = docs.get(int(source.removeprefix("vec-"))) or ""
            assert f"[Source: {source}]\n{text}" in r.context
            long += len(text) > 1000
    assert long


def test_contexts_of_no_one_and_several_hits(spark):
    rows = E.queries()["retrieval_answer"](spark, SF_SMALL).collect()
    assert {min(r.context_hits, 2) for r in rows} == {0, 1, 2}
    assert {r.confidence for r in rows if r.context_hits == 1} == {1.0}
    assert all(r.confidence == 0 and r.context == "" for r in rows if r.context_hits == 0)
    assert all(0.2 < r.confidence < 1 and r.context.count("[Source: vec-") >= 2 for r in rows if r.context_hits > 1)


def test_texts_of_hits_only_leave_the_scan(spark):
    """The documents are filtered by the hits' ids right above their scan, before any exchange."""
    plan = E.queries()["retrieval_answer"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip(" :+-") for x in plan.splitlines()]
    scan = next(k for k, x in enumerate(lines) if "FileScan parquet" in x and "text" in x)
    above = [x for x in lines[:scan] if "Exchange" in x or "Join" in x]
    assert "BroadcastHashJoin" in above[-1] and "LeftSemi" in above[-1]


def test_exact_search_skips_far_blocks(spark, monkeypatch):
    import numpy as np
    from paylens.operators import retrieval as K
    monkeypatch.setattr(K, "VECTOR_BLOCK", 50)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 8)) * 20
    x = np.concatenate([centre[i % 40] + rng.standard_normal((1, 8)) for i in range(3000)] + [np.full((700, 8), 99.0)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9999, None)], "vec_id long, embedding array<double>")
    asked = list(range(0, 3000, 100)) + [3001]
    q = spark.createDataFrame([(i, x[i].tolist()) for i in asked], "query_id long, query_vec array<double>")
    index = K.BallIndex(v)
    found, met = index.nearest(q, 5)
    blocks = index.blocks.select("block").distinct().count()
    assert blocks > 50 and index.blocks.agg({"rows": "max"}).first()[0] < 200  # equal vectors are cut too
    assert met.count() == met.distinct().count() < 0.2 * blocks * len(asked)
    got = {}
    for r in K.knn(v, q, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.distance))
    for i in asked:
        d = ((x - x[i]) ** 2).cumsum(1)[:, -1]
        best = np.lexsort((np.arange(len(x)), d))[:5]
        assert sorted(got[i]) == [(n + 1, int(j), d[j]) for n, j in enumerate(best)]


def test_search_without_vectors_or_with_few(spark):
    from paylens.operators import retrieval as K
    schema, asked = "vec_id long, embedding array<float>", "query_id long, query_vec array<float>"
    q = spark.createDataFrame([(1, [0.0, 0.0])], asked)
    assert K.knn(spark.createDataFrame([(1, None)], schema), q, 3).collect() == []
    few = K.knn(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, -1.0])], schema), q, 3).collect()
    assert [(r.vec_id, r.distance, r.rank) for r in few] == [(1, 1.0, 1), (2, 1.0, 2)]
    assert K.knn(spark.createDataFrame([(1, [0.0, 1.0])], schema), q.filter("query_id > 5"), 3).collect() == []


def test_landed_documents_come_back_whole(spark, tmp_path):
    from paylens.sinks.writers import land_markdown
    from paylens.sources.files import read_landed_documents
    rows = [(1, "aa"), (2, None), (3, "bb"), (4, ""), (5, "\n"), (6, "a\x1eb\x1e\\r\\s\\\\\x1e"), (7, "\x1e8\nx"), (8, "\r\n\r\n"),
            (None, "no id"), (None, None), (9, "tail\\"), (10, " \u0085﻿\x00 x\n\n"), (1, "aa")]
    land_markdown(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"{tmp_path}/corpus", 4)
    got = [tuple(r) for r in read_landed_documents(spark, f"{tmp_path}/corpus").collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_many_copies_of_a_vector_are_measured_in_bounded_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd
    from paylens.operators import retrieval as K
    rnd = np.random.default_rng(1)
    x = np.r_[np.repeat(rnd.normal(size=(1, 64)), 4000, 0), rnd.normal(size=(96, 64))]
    vectors = pd.DataFrame({"id": np.arange(len(x))[::-1], "vec": list(x)})
    queries = pd.DataFrame({"query_id": np.arange(196), "query_vec": list(x[3900:])})
    tracemalloc.start()
    try:
        got = K._nearest(5)(queries, vectors)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120e6  # 196 queries x 4000 copies x 64 components of 8 bytes are 410 MB
    assert got[got.query_id == 0][["id", "distance"]].values.tolist() == [[96.0 + k, 0.0] for k in range(5)]
    assert len(got) == 5 * len(queries) and (got[got.query_id >= 100].groupby("query_id").distance.min() == 0).all()
