"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece

from paylens.llm import pieces
from paylens.llm.queries import QUERIES
from tests.llm.helpers import SCHEMA, awkward, frame

MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
PARTS = ["a", "b", "e", "x", " ", "  ", "\n", "\t", "the", "ing", "er", "▁", "1", "0", "日", "本", "é", "́", "😀", "\x00", "①",
         "=", "-", "_", "aaaa", "<s>", "<0x41>", "    ", " ", "Ａ"]


def _random_texts(seed, n):
    rnd = random.Random(seed)
    return (["".join(rnd.choices(PARTS, k=rnd.randrange(0, 60))) for _ in range(n)]
            + ["".join(rnd.choices("ab", k=rnd.randrange(0, 80))) for _ in range(n // 4)]
            + ["".join(rnd.choices("aeinrst=-", k=200)) for _ in range(n // 4)])


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.MODEL)


def test_ids_equal_the_library_on_random_and_long_texts(vocab):
    some = _random_texts(1, 3000) + ["", " ", "     ", "x" * 20000, "ab" * 10000, " " * 3000, "=" * 5000, "a b" * 4000]
    got = pieces.encode_texts(pieces.Known(vocab), some)
    assert [g.tolist() for g in got] == MODEL.encode(some)


def test_words_met_before_and_forgotten_words_give_the_same_ids(vocab, monkeypatch):
    some = _random_texts(2, 400)
    monkeypatch.setattr(pieces, "_KNOWN_CHARS", 500)
    monkeypatch.setattr(pieces, "_PART_CHARS", 7)
    known, got = pieces.Known(vocab), []
    for lo in range(0, len(some), 9):
        got += pieces.encode_texts(known, some[lo:lo + 9])
    assert [g.tolist() for g in got] == MODEL.encode(some)


def test_a_merge_that_makes_a_better_pair_goes_first():
    """(a,b) is the word's minimum twice; its first merge makes (ab,a), which is better and takes the second one's a."""
    import dataclasses

    import numpy as np

    v = dataclasses.replace(
        pieces.vocabulary(pieces.MODEL), size=4, symbols=4, pair=np.array([0 * 4 + 1, 2 * 4 + 0], np.int64),
        rank=np.array([5, 1], np.int32), merged=np.array([2, 3], np.int32))  # a=0 b=1 ab=2 aba=3
    word = np.zeros(5, np.int64)
    assert pieces.merge_rounds(v, np.array([0, 1, 0, 1, 0], np.int32), word)[0].tolist() == [3, 1, 0]
    two = np.array([0, 1, 0, 1, 0, 1, 0, 1], np.int32)
    assert pieces.merge_rounds(v, two, np.array([0, 0, 0, 0, 1, 1, 1, 1]))[0].tolist() == [3, 1, 3, 1]


def test_decoding_equals_the_library_for_any_ids(vocab):
    rnd = random.Random(3)
    for _ in range(20000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(300), rnd.randrange(3, 259), 0, 1, 2]) for _ in range(rnd.randrange(12))]
        assert pieces.decoded(vocab, ids) == MODEL.decode(ids).encode(), ids


def test_a_block_that_ends_with_its_batch(vocab, monkeypatch):
    assert pieces.encode_texts(pieces.Known(vocab), []) == []
    monkeypatch.setattr(pieces, "_BLOCK_CHARS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", "long enough"])], names=["doc_id", "text"])
    got = [r for b in pieces._encode_task(pieces.MODEL)(iter([batch])) for r in b.to_pylist()]
    assert got == [{"doc_id": 1, "ids": MODEL.encode("a")}, {"doc_id": 2, "ids": MODEL.encode("long enough")}]


def test_whole_table_and_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    ids = pieces.encode(docs)
    got = sorted(((r.doc_id, r.ids) for r in ids.collect()), key=str)
    assert got == sorted(((d, MODEL.encode(t or "")) for d, t, _, _ in rows), key=str)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(ids).collect()), key=str)
    assert back == sorted(((d, t or "") for d, t, _, _ in rows), key=str)
    assert pieces.digests(pieces.encode(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_equals_the_library(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_sentencepiece"](spark, sf_dir).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = MODEL.encode(d.text or "")
        want[d.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(MODEL.decode(ids).encode()))
    assert got == want
