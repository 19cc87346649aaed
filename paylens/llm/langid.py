"""Language identification by compression with zstandard raw-content dictionaries.

Every language gets a dictionary: normalised text of a bounded sample of its
labelled documents (``SAMPLE_DOCS`` on average, at most ``DOC_CHARS`` characters
of one, ``DICT_BYTES`` in all, of which every passage gets an even part).  A text is normalised whole (letters, lower
case, single spaces), cut into blocks of ``BLOCK`` bytes so that long texts
cannot feed on themselves, and every block is compressed with every
dictionary; the language with the smallest total wins.  The prediction is
rejected when the runner-up's total is within ``MIN_MARGIN`` of the winner's.

Only the dictionaries reach the driver; their size is bounded by the number of
languages.  Scoring is one pass over the texts without a shuffle.

Defined results: null or letterless texts are ``und`` with score 0 and are
rejected; ties go to the first language by name and are rejected; without any
labelled row everything is ``und``; rows repeat as given; a null id counts as
held out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F

from paylens.llm.store import held_out, table, with_text
from paylens.llm.words import texts

SAMPLE_DOCS, DOC_CHARS, DICT_BYTES, LANGUAGES = 160, 4000, 192 << 10, 256
BLOCK, LEVEL = 4096, 7
MIN_MARGIN = 0.004
#: relative size difference that makes a language e times less likely in the score
SCALE = 0.02

_LETTERS = regex.compile(r"\p{L}+")


def normalised(text: str | None) -> bytes:
    """Lower-case runs of letters joined by single spaces."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "replace") if text else b""


def fit_dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_chars: int = DOC_CHARS,
                     dict_bytes: int = DICT_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Raw dictionary content by language, from rows that are not held out and have a language.

    Labels may be dirty: the ``languages`` with the most rows (ties: by name) are
    learned; rows of others are still judged, by the learned ones.
    Rows are sampled by a hash of their id and text at each language's own
    rate; a sampled text gives a passage at a hashed offset.
    """
    train = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")) \
        .filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return {}
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n))]),
                        F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    offset = F.pmod(F.xxhash64("doc_id", F.lit("offset")), F.greatest(F.length("text") - doc_chars, F.lit(0)) + 1)
    rows = train.filter(F.col("lang").isin(list(sizes)) & (draw < rate)).select(
        "lang", "doc_id", F.substring(F.col("text"), offset.cast("int") + 1, F.lit(doc_chars)).alias("text")).collect()
    out: dict[str, list[bytes]] = {lang: [] for lang in sizes}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        out[r.lang].append(normalised(r.text))
    return {lang: _even(parts, dict_bytes) for lang, parts in sorted(out.items())}


def _even(parts: list[bytes], size: int) -> bytes:
    """The passages joined in ``size`` bytes; the longest are cut to one length, so that each has its part."""
    left, most = size - max(0, len(parts) - 1), 0
    for k, n in enumerate(sorted(map(len, parts))):
        most = max(0, left // (len(parts) - k))
        if n > most:
            break
        left, most = left - n, n
    return b" ".join(p[:most] for p in parts)[:size]


def _compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(
            level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def judge(text: str | None, compressors) -> tuple[str, float, float]:
    """Language, score and margin of one text."""
    data = normalised(text)
    if not data or not compressors:
        return "und", 0.0, 0.0
    parts = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = [(sum(len(c.compress(p)) for p in parts), lang) for lang, c in compressors]
    best, lang = min(sizes)
    score = 1.0 / sum(math.exp(-min(700.0, (s - best) / (SCALE * best))) for s, _ in sizes)
    second = min((s for s, other in sizes if other != lang), default=2 * best)
    return lang, score, (second - best) / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], columns: tuple[str, ...] = ("doc_id",),
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``columns`` of every row with lang_pred, score, margin and rejected for its whole text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries)
        for batch in batches:
            found = [judge(t, compressors) for t in texts(batch.column(at))]
            langs, scores, margins = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(columns))] + [pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                names=[*columns, "lang_pred", "score", "margin"])

    rows, at, schema = with_text(docs, columns)
    found = rows.mapInArrow(task, schema + ", lang_pred string, score double, margin double")
    return found.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < min_margin))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_dictionaries(docs)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")
