"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets counts over its whole text.  Ratios of these counts go into
logarithmic-bucket sketches (buckets of a fixed relative width, so a sketch is
a table of counts and merging is addition) per language and source, per
language, and over all documents.  A group's threshold for a ratio is its upper
quartile plus ``FENCE`` times its spread; mean word length also has the lower
fence.  The spread is the group's interquartile range or, where its quartiles
are equal, the distance from its median to its ninth decile.  Groups of fewer
than ``LEAST_GROUP`` documents use their language's merged sketch, languages as
small the sketch of all documents.  Where a ratio is the same in nine of ten
documents of a group, the merged sketches tell how large it is where it occurs
at all: the fence is ``RARE`` of the lower quartile of its positive values in
the language, or else in all documents; without any there is no fence.

These thresholds replace fixed cutoffs.  A document fails the verdict if a ratio
lies outside its group's fences beyond what the count itself leaves open: its
``SURE``-fold standard error (square root) is taken off the count first, so one
repeated line in a short text is no evidence.

Everything after the counts is DataFrame code: sketches are partial sums, so a
hot source sends one row per bucket and task, and the thresholds meet the
documents in a join that adaptive execution can split.

Defined results: a null or wordless text has zero counts and fails the base
rule; null languages and sources are groups of their own; repeated rows stay
rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paylens.functions.numeric import round_half
from paylens.llm.store import stored, table
from paylens.llm.words import blocks, span_hashes, windows
from paylens.session import ship_package

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: relative width of a sketch's buckets, and the ratio that counts as zero
WIDTH, ZERO = 0.02, 1e-6
FENCE, LEAST_GROUP, RARE, SURE = 3.0, 100, 0.25, 2.0
#: ratio -> its count and what the count is set against
RATIOS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
          "echo_ratio": ("n_echoes", "n_words"), "upper_ratio": ("n_upper", "word_chars"),
          "mark_ratio": ("n_marks", "word_chars"), "word_length": ("word_chars", "n_words")}
LOWER = {"word_length"}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echoes", "n_upper", "n_marks"]
_SYMBOL, _UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?")] = True


def _repeat_words(block, hashes: np.ndarray) -> np.ndarray:
    """Words of each row inside a 5-word window that the row holds twice or more."""
    win, at = windows(hashes, block.row, WINDOW)
    n = len(block.offs) - 1
    if not len(win):
        return np.zeros(n, np.int64)
    tagged = win ^ (block.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(tagged)
    ranked = tagged[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(win), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + WINDOW + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:len(hashes)] > 0)])
    return covered[block.first[1:]] - covered[block.first[:-1]]


def _echoes(block, hashes: np.ndarray) -> np.ndarray:
    """Words of each row equal to the word before them."""
    same = (hashes[1:] == hashes[:-1]) & (block.row[1:] == block.row[:-1])
    return np.bincount(block.row[1:][same], minlength=len(block.offs) - 1)


def _lines(block) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, by row."""
    n = len(block.offs) - 1
    breaks = np.flatnonzero(block.buf == 10)
    starts = np.union1d(block.offs[:-1], breaks + 1)
    starts = starts[starts < len(block.buf)]
    ends = np.append(starts[1:], len(block.buf))
    ends = ends - ((ends > starts) & (block.buf[ends - 1] == 10))
    row = np.searchsorted(block.offs, starts, "right") - 1
    word = np.searchsorted(block.starts, ends, "left") > np.searchsorted(block.starts, starts, "left")
    starts, ends, row = starts[word], ends[word], row[word]
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    hashes = span_hashes(block.buf, starts, ends, lower=False)
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    again = np.append(False, (r[1:] == r[:-1]) & (h[1:] == h[:-1]))
    return np.bincount(row, minlength=n), np.bincount(r[again], minlength=n)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(batch.num_columns - 1)):
            hashes = span_hashes(block.buf, block.starts, block.ends, lower=False)
            in_word = np.zeros(len(block.buf) + 1, np.int8)
            in_word[block.starts] += 1
            in_word[block.ends] -= 1
            chars = (np.cumsum(in_word[:-1], dtype=np.int8) > 0) & ((block.buf & 0xC0) != 0x80)
            lines, dup = _lines(block)
            counts = [block.n_words, block.per_row(chars), block.per_row(_SYMBOL[block.buf]), dup,
                      _repeat_words(block, hashes), lines, _echoes(block, hashes), block.per_row(_UPPER[block.buf]),
                      block.per_row(_MARK[block.buf])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(block.lo, block.hi - block.lo) for i in range(batch.num_columns - 1)]
                + [pa.array(c.astype(np.int64)) for c in counts],
                names=[*batch.schema.names[:-1], *COUNTS])


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_task, "doc_id long, lang string, source string, "
                           + ", ".join(f"{c} long" for c in COUNTS))


def ratios(errors: float = 0.0) -> dict[str, Column]:
    """The ratios, with so many standard errors added to their counts."""
    return {r: (F.col(count) + F.lit(errors) * F.sqrt(count)) / F.greatest(of, F.lit(1)) for r, (count, of) in RATIOS.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def sketch(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Counts by ``by`` and bucket of the column ``value`` (not negative)."""
    bucket = F.when(F.col(value) < ZERO, F.lit(None)).otherwise(
        F.ceil(F.log(F.col(value) / ZERO) / math.log1p(WIDTH))).cast("int")
    return values.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up to coarser groups."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """One row per group: its size ``total`` and for each name the value at that rank, within ``WIDTH``."""
    w = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first())
    whole = Window.partitionBy(*by)
    ranked = sketches.select(*by, "bucket", F.sum("n").over(w).alias("upto"), F.sum("n").over(whole).alias("total"))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(
        F.lit(ZERO) * F.pow(F.lit(1 + WIDTH), F.col("bucket") - 0.5))
    return ranked.groupBy(*by).agg(F.first("total").alias("total"), *[
        F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value)).alias(name) for name, q in at.items()])


def group_key(name: str) -> Column:
    """Never null; null and empty values apart."""
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(name)))


def thresholds(counts: DataFrame) -> DataFrame:
    """Keys lang_key and source_key (see ``group_key``) and the fences of each ratio."""
    long = counts.filter(~base_failed()).select(
        group_key("lang").alias("lang_key"), group_key("source").alias("source_key"),
        F.explode(F.create_map(*[x for k, v in ratios().items() for x in (F.lit(k), v)])).alias("ratio", "value"))
    groups = stored(sketch(long, ["lang_key", "source_key", "ratio"]), "quality-sketch")
    at = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}
    langs = merged(groups, ["lang_key", "ratio"])
    every = merged(langs, ["ratio"])

    def figures(sketches: DataFrame, by: list[str], mark: str) -> DataFrame:
        """Size and quantiles of merged sketches, and the lower quartile of the positive values."""
        whole = quantiles(sketches, by, at).select(*by, F.col("total").alias(f"{mark}_total"), F.struct(*at).alias(mark))
        some = quantiles(sketches.filter("bucket is not null"), by, {f"{mark}_some": 0.25}).drop("total")
        return whole.join(some, by, "left")

    fenced = quantiles(groups, ["lang_key", "source_key", "ratio"], at) \
        .select("lang_key", "source_key", "ratio", F.col("total").alias("own_total"), F.struct(*at).alias("own")) \
        .join(figures(langs, ["lang_key", "ratio"], "lang"), ["lang_key", "ratio"]).join(figures(every, ["ratio"], "every"), "ratio") \
        .withColumn("q", F.when(F.col("own_total") >= LEAST_GROUP, F.col("own"))
                    .when(F.col("lang_total") >= LEAST_GROUP, F.col("lang")).otherwise(F.col("every"))) \
        .select("lang_key", "source_key", "ratio", "q.*", F.coalesce("lang_some", "every_some").alias("some"))
    reach = F.when(F.col("q3") > F.col("q1"), F.lit(FENCE) * (F.col("q3") - F.col("q1"))) \
        .when(F.col("q9") > F.col("q2"), F.lit(FENCE) * (F.col("q9") - F.col("q2"))).otherwise(F.lit(RARE) * F.col("some"))
    fenced = fenced.withColumn("reach", reach)
    return fenced.groupBy("lang_key", "source_key").agg(
        *[F.max(F.when(F.col("ratio") == r, F.col("q3") + F.col("reach"))).alias(f"{r}_max") for r in RATIOS],
        *[F.max(F.when(F.col("ratio") == r, F.col("q1") - F.col("reach"))).alias(f"{r}_min") for r in sorted(LOWER)])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, thresholds and verdict of every document."""
    counts = stored(text_counts(docs), "quality-counts")
    limits = stored(thresholds(counts), "quality-thresholds")
    least, most = ratios(-SURE), ratios(SURE)
    out = F.lit(False)
    for r in RATIOS:
        out = out | F.coalesce(least[r] > F.col(f"{r}_max"), F.lit(False))
    for r in sorted(LOWER):
        out = out | F.coalesce(most[r] < F.col(f"{r}_min"), F.lit(False))
    keyed = counts.withColumn("lang_key", group_key("lang")).withColumn("source_key", group_key("source"))
    return keyed.join(limits, ["lang_key", "source_key"], "left") \
        .withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & ~out).drop("lang_key", "source_key")


def op4(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[round_half(f"{r}_max", 6).alias(f"{r}_max") for r in RATIOS],
        *[round_half(f"{r}_min", 6).alias(f"{r}_min") for r in sorted(LOWER)])
