"""Periodic runs against a comparison of all words at all distances."""

import hashlib
import random
import zlib

import pyarrow as pa

from paylens.llm import runs
from paylens.llm.queries import QUERIES
from paylens.llm.words import blocks
from tests.llm.helpers import SCHEMA, WORD, awkward, frame


def brute_runs(words, least=12):
    """(start, length, period) of every run: maximal agreement with the words q on, for each q; smallest q of a stretch."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _found(texts, least=12, size=1 << 20):
    out = []
    for b in blocks(pa.array(texts, pa.string()), size):
        rows = runs.block_runs(b, least)
        kept = list(runs.collapsed(b, rows))
        for r in range(b.hi - b.lo):
            out.append(([(s - int(b.first[r]), n, q) for x, s, n, q in rows.tolist() if x == r], kept[r].decode()))
    return out


def _periodic(rnd):
    words = [rnd.choice("abcdefgh"[:rnd.choice([1, 2, 3, 8])]) for _ in range(rnd.randrange(60))]
    if words and rnd.random() < 0.6:
        p = rnd.randrange(1, len(words) + 1)
        words += words[-p:] * rnd.randrange(5)
        words += [rnd.choice("abc")] * rnd.randrange(3)
    return words


def test_random_texts_by_both_ways_of_looking_up(monkeypatch):
    rnd = random.Random(7)
    for trial in range(600):
        monkeypatch.setattr(runs, "FEW", 0 if trial % 2 else 16)
        least = rnd.choice([12, 12, 2, 3, 5, 17])
        rows = [_periodic(rnd) for _ in range(rnd.randrange(1, 5))]
        want = [(brute_runs(w, least), brute_collapsed(w, brute_runs(w, least))) for w in rows]
        assert _found([" ".join(w) for w in rows], least) == want


def test_long_periodic_texts():
    some = [["a"] * 3000, ["a", "b"] * 1500, [*"abcdefg"] * 300, [f"w{i % 700}" for i in range(2500)]]
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    some.append([*b])  # Fibonacci word: as many runs as a text can hold, nearly
    want = [(brute_runs(w), brute_collapsed(w, brute_runs(w))) for w in some]
    assert _found([" ".join(w) for w in some]) == want


def test_runs_stay_inside_their_row_and_white_space_is_one_space():
    got = _found(["x x x x x x", "x x x x x x", " x\t\tx\n" * 7, "a b c " * 3 + "a b"], 12)
    assert got == [([], "x x x x x x"), ([], "x x x x x x"), ([(0, 14, 1)], "x"), ([], "a b c a b c a b c a b")]
    assert _found([f"line number {i} of the same long text" for i in range(50)], 12) == \
        [([], f"line number {i} of the same long text") for i in range(50)]


def test_awkward_rows(spark):
    rows = awkward()
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.runs(frame(spark, rows)).collect()), key=str)
    want = []
    for d, t, _, _ in rows:
        words = WORD.findall(t or "")
        found = [(0, 240000, 12)] if d == 11 else brute_runs(words)
        want.append((d, found, brute_collapsed(words, found)))
    assert got == sorted(want, key=str)
    assert runs.digests(runs.runs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_digests_choose_the_longest_then_first(spark):
    text = "a " * 12 + "b " * 12 + "c d " * 6
    row = runs.digests(runs.runs(spark.createDataFrame([(1, text), (2, "x y")], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert row[0][1:6] == (3, 0, 12, 1, 12000)
    assert row[0].runs_sha256 == hashlib.sha256(b"0,12,1\n12,12,1\n24,12,2\n").hexdigest()
    assert row[0].collapsed_sha256 == hashlib.sha256(b"a b c d").hexdigest()
    assert row[1][1:7] == (0, None, None, None, None, hashlib.sha256(b"").hexdigest())


def test_query_against_the_contract_in_plain_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    tails = 0
    for d in docs:
        words, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        if len(words) > 3000:
            continue
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words, tails = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)], tails + 1
        found = brute_runs(words)
        s, n, q = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert got[d.doc_id] == (len(found), s, n, q, n and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(
            found, key=lambda x: (x[0], x[2])))), sha(brute_collapsed(words, found)))
    assert tails > 5
