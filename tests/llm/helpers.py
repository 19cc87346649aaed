"""Fixture documents with the awkward cases, and plain-Python versions of what the operators compute."""

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id long, key string, fp string, ids string, row long, block string, shard int, n long, score double, a int, hub int")


def frame(spark, rows):
    """documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame(
        [(d, t, lang, src, len(t) if t is not None else None, 7, "k", "f", "i", 1, "b", 2, 3, 0.5, 1, 4)
         for d, t, lang, src in rows], SCHEMA)


def awkward():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    return [
        (1, base, "en", "s"), (2, base, "en", "s"), (2, base, "en", "s"), (3, base.upper(), "en", None),
        (4, base + " more", None, "s"), (5, None, "en", "s"), (6, "", "en", "s"), (7, " \t\n \x0b", None, None),
        (None, base, "en", "s"), (None, None, None, None), (8, "word", "de", "t"), (9, "word", "de", "t"),
        (10, "wörd Ärger\nx\nx\n\nx \n", "de", "t"), (11, "a b c d e f g h i j k l " * 20000, "en", "s"),
        (12, "$$$ ### *** & | < > 1 2 3", "xx", "t"), (13, "日本語 テキスト \U0001f600 ok", None, "t"),
        (14, "x" * 300000, "en", "s"), (15, "it's we'll  \n\n  <|endoftext|> 'll", "en", "s"),
    ]


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(zip(*[w[i:] for i in range(n)]))


def near_groups(docs, percent=75):
    """{doc_id: (set size, smallest linked id)} by comparing every pair that shares a shingle."""
    sets = {d: shingles(t) for d, t in docs if d is not None}
    holders, parent = defaultdict(list), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        for e, i in Counter(e for x in s for e in holders[x] if e > d).items():
            if 100 * i >= percent * (len(s) + len(sets[e]) - i):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
