import random

import numpy as np
import pyarrow as pa
import pytest

from paylens.llm import components, minhash, vectors
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, frame, near_groups


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def test_awkward_documents(spark):
    rows = minhash.near_duplicates(frame(spark, awkward())).collect()
    assert len(rows) == len(awkward())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == \
        near_groups([(d, t) for d, t, _, _ in awkward()])
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_given_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = near_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert result(minhash.op1(spark, SF_SMALL)) == want


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.random()) if rng.random() < share else w for w in words]


def test_groups_of_edited_copies_match_brute_force(spark, monkeypatch):
    """Copies of copies around the similarity, groups with a shared passage, and tiny blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, rows = random.Random(3), []
    for g in range(4):
        base = [f"w{g}_{rng.randrange(1000)}" for _ in range(150)]
        for share in (0.01, 0.02, 0.03, 0.04, 0.06):
            rows += [" ".join(edited(rng, base, share)) for _ in range(12)]
    passage = [f"p{i}" for i in range(60)]
    rows += [" ".join(passage + [f"u{k}_{i}" for i in range(30)]) for k in range(60)]
    rng.shuffle(rows)
    docs = list(enumerate(rows))
    got = result(minhash.near_duplicates(frame(spark, [(d, t, "en", "s") for d, t in docs])))
    assert got == near_groups(docs)


def test_signature_distance_is_covered_by_keys():
    """Any 19 changed symbols leave a chunk with at most one change."""
    rng = random.Random(1)
    for _ in range(500):
        hit = rng.sample(range(minhash.SYMBOLS), minhash.MAX_DISTANCE)
        errors = [sum(1 for h in hit if h // minhash.PER_CHUNK == c) for c in range(minhash.CHUNKS)]
        assert min(errors) <= 1


def test_signature_similarity_estimates_jaccard():
    rng = np.random.Generator(np.random.PCG64(1))
    same, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3000, 500, 500))
    sig = minhash.signatures(np.concatenate([same, a, same, b]), np.array([0, 3500])).view(np.uint16)
    assert abs((sig[0] != sig[1]).mean() - 0.25) < 0.25


def test_pairs_that_share_a_bucket_are_linked_at_any_distance(spark):
    """Texts and their longer copies (Jaccard 56 / 74) whose signatures differ in 20 or more symbols."""
    rng, rows = random.Random(11), []
    for k in range(8000):
        words = [f"{rng.randrange(1 << 30):x}" for _ in range(78)]
        rows += [" ".join(words[:60]), " ".join(words)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])
    sig = np.concatenate([np.stack([c.to_numpy() for c in b.columns[3:]], 1) for b in minhash._signature_task(5)(iter([batch]))])
    differ = (sig.view(np.uint16)[::2] != sig.view(np.uint16)[1::2]).reshape(-1, minhash.CHUNKS, minhash.PER_CHUNK).sum(2)
    far = np.flatnonzero((differ.sum(1) > minhash.MAX_DISTANCE) & (differ.min(1) <= 1))
    assert len(far)
    docs = [(int(2 * k + side), rows[2 * k + side]) for k in far for side in (0, 1)]
    got = result(minhash.near_duplicates(frame(spark, [(d, t, "en", "s") for d, t in docs])))
    assert got == near_groups(docs) and all(c == d // 2 * 2 for d, (_, c) in got.items())


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
                                   [(5, 9), (9, 5), (3, 3), (2, 9), (7, 8), (7, 8)], []])
def test_components(spark, links):
    parent = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in parent:
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == parent


def brute_vectors(rows, cosine=0.95):
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows)
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {k: 0 for k in range(len(rows))}, {i: i for i, _ in rows}
    for k, i, v in good:
        for k2, i2, v2 in good:
            if k != k2 and len(v) == len(v2) and v @ v2 / np.sqrt((v @ v) * (v2 @ v2)) >= cosine:
                links[k] += 1
                a, b = parent[i], parent[i2]
                for x in parent:
                    if parent[x] in (a, b) and x is not None:
                        parent[x] = min(a, b)
    return [(i, links[k], parent[i]) for k, (i, _) in enumerate(rows)]


def vector_rows(rng, dim, groups):
    rows = []
    for g in range(groups):
        c = rng.standard_normal(dim)
        rows += [(len(rows) + j, [float(x) for x in c + rng.standard_normal(dim) * 0.22]) for j in range(15)]
    return rows


def test_vectors_with_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rng = np.random.Generator(np.random.PCG64(2))
    rows = vector_rows(rng, 48, 6)
    n = len(rows)
    v = rows[0][1]
    rows += [(n, v), (n + 1, [2 * x for x in v]), (n + 2, v), (n + 3, None), (n + 4, []), (n + 5, [0.0] * 48),
             (n + 6, [float("nan")] * 48), (n + 7, [None] + v[1:]), (n + 8, [float("inf")] + v[1:]), (n + 9, v[:32]),
             (n + 10, v[:32]), (n + 11, [x * 1e200 for x in v])]
    df = spark.createDataFrame([(i, x, 1, 2, "k") for i, x in rows], "vec_id long, embedding array<double>, label int, id int, key string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect())
    assert got == sorted(brute_vectors([(i, x if i != n + 11 else v) for i, x in rows]))


def test_vectors_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_vectors(df).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("None", 0, "None", True)]
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_vector_recall_at_the_threshold():
    rng = np.random.Generator(np.random.PCG64(5))
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.standard_normal(a.shape)
    g -= (g * a).sum(1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * g
    x, y = vectors.codes(a), vectors.codes(b)
    found = np.array([len(set(p) & set(q)) > 0 for p, q in zip(x.tolist(), y.tolist())])
    assert found.mean() >= 0.99
    assert vectors.hadamard(np.eye(8)).round(12).tolist() == (vectors.hadamard(np.eye(8)).T).round(12).tolist()
