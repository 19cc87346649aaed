"""The break-preferring splitter against a version that works on lists of strings, and its properties."""

import random
import re

import __spark_entry__ as E
from paylens.operators import retrieval as K
from tests.conftest import SF_SMALL


def _plain(text, size, overlap, breaks):
    """Strings only: cut before the first break that occurs, pack short pieces, recurse into long ones."""
    for k, mark in enumerate(breaks):
        if mark in text:
            parts = [p for p in re.split(f"(?={re.escape(mark)})", text)] if len(mark) == 1 else None
            if parts is None:  # occurrences that do not overlap, from the left
                parts, rest = [], text
                while (at := rest.find(mark, len(mark) if rest.startswith(mark) else 0)) >= 0:
                    parts.append(rest[:at])
                    rest = rest[at:]
                parts.append(rest)
            rest_breaks = breaks[k + 1:]
            break
    else:
        parts, rest_breaks = list(text), None
    out, short = [], []

    def packed(pieces):
        done, held = [], []
        for p in pieces:
            if sum(map(len, held)) + len(p) > size and held:
                done.append("".join(held).strip())
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held = held[1:]
            held = held + [p]
        return [*done, "".join(held).strip()] if held else done

    for p in (p for p in parts if p):
        if len(p) < size or rest_breaks is None:
            short.append(p)
        else:
            out += packed(short)
            short = []
            out += _plain(p, size, overlap, rest_breaks)
    return [c for c in out + packed(short) if c]


def test_equals_the_plain_version_on_random_texts():
    rnd = random.Random(1)
    for _ in range(3000):
        alphabet = rnd.choice(["ab \n", "abcdefgh  \n", "ab\n\n", "x", "word \n\n\n"])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(120)))
        size = rnd.randrange(1, 25)
        overlap = rnd.randrange(0, size)
        got = K.split_at_breaks(text, size, overlap)
        assert [c for _, c in got] == _plain(text, size, overlap, K.BREAKS), (text, size, overlap)
        assert all(text[a:a + len(c)] == c and len(c) <= size for a, c in got)


def test_known_cuts():
    text = "First paragraph here.\n\nSecond one, a little longer.\nWith a line.\n\nThird."
    assert [c for _, c in K.split_at_breaks(text, 32, 8)] == [
        "First paragraph here.", "Second one, a little longer.", "With a line.", "Third."]
    assert [c for _, c in K.split_at_breaks("one two three four five", 13, 6)] == ["one two three", "three four", "four five"]
    assert [c for _, c in K.split_at_breaks("abcdefghij", 4, 1)] == ["abcd", "defg", "ghij"]
    assert K.split_at_breaks("", 5, 1) == [] and K.split_at_breaks(" \n\n \n", 5, 1) == []


def test_awkward_rows_and_whole_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (None, "x" * 2500)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.chunk_id, r.chunk_start, len(r.chunk)) for r in K.chunk_at_breaks(df).collect()), key=str)
    assert got == [(3, 0, 0, 3), (None, 0, 0, 1000), (None, 1, 800, 1000), (None, 2, 1600, 900)]
    assert K.chunk_at_breaks(df.limit(0)).count() == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    found = {}
    for r in E.queries()["chunk_documents_breaks"](spark, SF_SMALL).orderBy("doc_id", "chunk_id").collect():
        found.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        chunks = found.get(doc, [])
        assert [r.chunk_id for r in chunks] == list(range(len(chunks)))
        covered, last = 0, 0
        for r in chunks:
            assert text[r.chunk_start:r.chunk_start + len(r.chunk)] == r.chunk and text[last:r.chunk_start].strip() == "" or r.chunk_start <= last
            covered, last = covered + 1, r.chunk_start + len(r.chunk)
        assert text[last:].strip() == ""
