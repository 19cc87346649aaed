"""Licence scans: TF-IDF cosine of lines, runs and whole files to templates, then directory inheritance.

Every line of every whole text is a sparse vector of its terms (runs of ASCII
letters and digits, and of other alphabets' bytes, in lower case), weighted by
term count and by inverse document frequency over all files.  A line states a
licence if its cosine to one of that licence's templates reaches ``COSINE``; a
file's own licence is its best statement's.

Licence texts, standard headers and notices (all templates) are also compared
with every run of as many terms as they have, at any term and over any line
ends, and with the whole file: a notice wrapped over lines or inside a longer
one, a comment block and a full text are found.  Only files whose terms could
reach ``COSINE`` for a template are searched; that bound loses none.  Document frequencies are needed for the
templates' terms only: all other terms weigh like one never seen, which can
only lower a cosine.

Licence files (the caller says which files are) give their licence to their
directory, the best statement winning.  A file without a statement inherits
from the nearest ancestor directory that has one: its ancestor paths are joined
with the directories' licences and the deepest wins.

The texts are read twice, each time by a map without a shuffle; the join
shuffles paths only, and only the term statistics (bounded by the templates)
reach the driver.

Defined results: null and empty texts state nothing; a null path has no
directory; of a file's statements the largest cosine (to nine digits) counts,
then the earlier line, then the licence's name; of equal runs the longer
template goes first, and a run ranks before a line only if it is larger or as
large and longer; inside a line that states a licence the notices are not
searched again; a run's line is the one it begins in; rows that repeat stay rows; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paylens.llm.store import stored, table
from paylens.llm.words import blocks, span_hashes
from paylens.session import ship_package

COSINE, NOTICE_LINES = 0.8, 4

# Short licence notices by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: standard headers, compared as runs of terms
HEADERS: dict[str, list[str]] = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."],
}
for _name, _title, _version in (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"),
                                ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")):
    _start = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU " \
        f"{_title} Public License as published by the Free Software Foundation, "
    HEADERS[_name] = [_start + f"either version {_version} of the License, or (at your option) any later version.",
                      _start + f"version {_version} of the License."]
    for _id in ("", "-only", "-or-later"):
        HEADERS[_name].append(f"SPDX-License-Identifier: {_name}{_id}")
for _name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0",
              "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "ISC", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib"):
    HEADERS.setdefault(_name, []).append(f"SPDX-License-Identifier: {_name}")


def full_texts() -> dict[str, list[str]]:
    """The licence texts in ``licence_texts`` (read on the driver only)."""
    return {f.stem: [f.read_text("utf-8")] for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


#: separators of terms: all ASCII but letters and digits
NOT_TERM = np.zeros(256, bool)
NOT_TERM[:128] = True
NOT_TERM[48:58] = NOT_TERM[65:91] = NOT_TERM[97:123] = False


def _terms(text: str) -> np.ndarray:
    block = next(blocks(pa.array([text]), between=NOT_TERM))
    return span_hashes(block.buf, block.starts, block.ends)


class Templates:
    """Counts of the templates' terms: ``counts[template, term]``, terms by sorted hash."""

    def __init__(self, *templates: dict[str, list[str]]):
        pairs = [(name, _terms(text)) for some in templates for name, texts in sorted(some.items()) for text in texts]
        self.names = [name for name, _ in pairs]
        self.terms = np.unique(np.concatenate([t for _, t in pairs]))
        self.counts = np.stack([np.bincount(np.searchsorted(self.terms, t), minlength=len(self.terms)) for _, t in pairs])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known terms and their numbers."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == hashes)
        return known, at[known]


def _frequency_task(templates: Templates):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, files = np.zeros(len(templates.terms), np.int64), 0
        for batch in batches:
            files += batch.num_rows
            for block in blocks(batch.column(0), between=NOT_TERM):
                known, term = templates.find(span_hashes(block.buf, block.starts, block.ends))
                pair = np.unique(block.row[known] * len(total) + term)
                total += np.bincount(pair % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(files, total))],
                                         names=["term", "files"])
    return task


def inverse_frequencies(files: DataFrame, templates: Templates, text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights of the templates' terms over all files, and of a term never seen."""
    rows = files.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _frequency_task(templates), "term long, files long").groupBy("term").agg(F.sum("files").alias("files")).collect()
    seen = {r.term: r.files for r in rows}
    n = seen.get(-1, 0)
    df = np.array([seen.get(i, 0) for i in range(len(templates.terms))])
    return np.log((1 + n) / (1 + df)) + 1, math.log(1 + n) + 1


class Runs:
    """Statements over several lines or inside one: runs of terms and whole files against templates."""

    def __init__(self, templates: Templates, notices: int, weight: np.ndarray, unseen: float, cosine: float):
        """The first ``notices`` templates are also compared line by line."""
        scaled = templates.counts * weight
        scaled = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        self.templates, self.notices, self.weight, self.unseen, self.cosine = templates, notices, weight, unseen, cosine
        self.scaled, self.size = scaled * weight, templates.counts.sum(1)
        self.share = (scaled ** 2).T.astype(np.float32)

    def hopeful(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """[row, template]: the row has terms for ``cosine``, by Cauchy and Schwarz a square of it of the template's."""
        present = np.zeros((n, len(self.share)), np.float32)
        present[rows, terms] = 1
        return present @ self.share >= self.cosine ** 2 - 1e-4

    def best(self, hashes: np.ndarray, line: np.ndarray, stated: np.ndarray, picks: np.ndarray):
        """The best (-cosine, -size, first term, licence) of a file, if any, and whether it matches as a whole."""
        words, code, times = np.unique(hashes, return_inverse=True, return_counts=True)
        at, term = self.templates.find(words)
        own = np.full(len(words), self.unseen)
        own[at] = self.weight[term]
        n, square = len(hashes), (own ** 2)[code]
        keys = np.sort(code * (n + 1) + np.arange(n))
        whole_norm = np.sqrt(((times * own) ** 2).sum())

        def times_in(c, lo, hi):
            return np.searchsorted(keys, c * (n + 1) + hi) - np.searchsorted(keys, c * (n + 1) + lo)

        found, whole = [], False
        for t in picks:
            worth = np.zeros(len(words))
            worth[at] = self.scaled[t, term]
            dot = np.concatenate([[0.0], np.cumsum(worth[code])])
            score = round(float(dot[-1] / whole_norm), 9)
            whole |= score >= self.cosine
            compared = t < self.notices
            name, m = self.templates.names[t], int(self.size[t])
            if score >= self.cosine and not (compared and line[0] == line[-1] and stated[0]):
                found.append((-score, -m, 0, name))
            if n <= m:
                continue
            s = np.arange(n - m)
            first = ((np.bincount(code[:m], minlength=len(words)) * own) ** 2).sum()
            out, into = times_in(code[s], s, s + m), times_in(code[s + m], s + 1, s + m)
            norm = first + np.concatenate([[0.0], np.cumsum(square[s] * (1 - 2 * out) + square[s + m] * (2 * into + 1))])
            scores = np.round((dot[m:] - dot[:-m]) / np.sqrt(np.maximum(norm, 1e-9)), 9)
            if compared:
                scores[(line[:n - m + 1] == line[m - 1:]) & stated[:n - m + 1]] = 0
            k = int(scores.argmax())
            if scores[k] >= self.cosine:
                found.append((-float(scores[k]), -m, k, name))
        return min(found, default=None), whole


def _scan_task(templates: Templates, weight: np.ndarray, unseen: float, cosine: float, runs: Runs):
    """Batches (keys..., text) to (keys..., own licence, its cosine, its line)."""
    scaled = templates.counts * weight
    scaled = scaled / np.linalg.norm(scaled, axis=1, keepdims=True) * weight

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.num_columns - 1
            for block in blocks(batch.column(keys), between=NOT_TERM):
                n = block.hi - block.lo
                best, size = {}, {}
                hashes = span_hashes(block.buf, block.starts, block.ends)
                known, term = templates.find(hashes)
                breaks = np.union1d(block.offs, np.flatnonzero(block.buf == 10) + 1)
                line = np.searchsorted(breaks, block.starts, "right") - 1
                lines, stating = np.unique(line[known]), np.zeros(len(breaks) + 1, bool)
                own = np.searchsorted(lines, line[known])
                dot, square = np.zeros((len(lines), len(scaled))), np.zeros(len(lines))
                np.add.at(dot, own, scaled[:, term].T)
                np.add.at(square, own, weight[term] ** 2)
                # repeated terms only lengthen a line's vector, so this is an upper bound
                hopeful = np.flatnonzero(dot.max(1, initial=0) >= cosine * np.sqrt(square) - 1e-9)
                first = np.searchsorted(line, lines, "left")
                last = np.searchsorted(line, lines, "right")
                for k in hopeful:
                    words, counts = np.unique(hashes[first[k]:last[k]], return_counts=True)
                    at, term_ = templates.find(words)
                    w = np.full(len(words), unseen)
                    w[at] = weight[term_]
                    scores = np.round(dot[k] / np.sqrt(((counts * w) ** 2).sum()), 9)
                    t = int(scores.argmax())
                    row = int(block.row[first[k]])
                    no = int(lines[k] - np.searchsorted(breaks, block.offs[row], "right") + 2)
                    if scores[t] >= cosine:
                        stating[lines[k]] = True
                        if row not in best or scores[t] > best[row][1]:
                            best[row] = templates.names[t], min(1.0, float(scores[t])), no
                            size[row] = int(templates.counts[t].sum())
                whole = np.zeros(n, bool)
                known, term = runs.templates.find(hashes)
                picks = runs.hopeful(block.row[known], term, n)
                for row in np.flatnonzero(picks.any(1)):
                    a, b = block.first[row], block.first[row + 1]
                    run, whole[row] = runs.best(hashes[a:b], line[a:b], stating[line[a:b]], np.flatnonzero(picks[row]))
                    if run and (row not in best or (run[0], run[1]) < (-best[row][1], -size[row])):
                        no = int(line[a + run[2]] - np.searchsorted(breaks, block.offs[row], "right") + 2)
                        best[row] = run[3], min(1.0, -run[0]), no
                found = [best.get(r, (None, None, None)) for r in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(block.lo, n) for i in range(keys)]
                    + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                       pa.array([f[2] for f in found], pa.int64()),
                       pa.array(block.per_row(block.buf == 10) + 1), pa.array(whole)],
                    names=[*batch.schema.names[:keys], "own_license", "own_score", "line", "lines", "whole"])
    return task


def scan(files: DataFrame, keys: list[str], text_col: str = "text", templates: dict[str, list[str]] | None = None,
         cosine: float = COSINE) -> DataFrame:
    """The columns ``keys`` of every file with own_license, own_score, line (null where none is stated), lines and
    whole (the file matches a template as a whole)."""
    ship_package(files.sparkSession)
    known = Templates(templates or TEMPLATES)
    every = Templates(templates or TEMPLATES, HEADERS, full_texts())
    all_weights, unseen = inverse_frequencies(files, every, text_col)
    weight = all_weights[np.searchsorted(every.terms, known.terms)]
    rows = files.select(*keys, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.drop("text").dtypes)
    runs = Runs(every, len(known.names), all_weights, unseen, cosine)
    return rows.mapInArrow(_scan_task(known, weight, unseen, cosine, runs),
                           f"{schema}, own_license string, own_score double, line long, lines long, whole boolean")


def inherit(statements: DataFrame, is_licence_file: Column, path: str = "path") -> DataFrame:
    """``statements`` with license (own or inherited) and inherited_from (the directory, null for own ones)."""
    directory = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    rows = statements.withColumn("_dir", directory)
    given = rows.filter(is_licence_file & F.col("own_license").isNotNull() & F.col(path).isNotNull()) \
        .groupBy(F.col("_dir").alias("_above")).agg(F.max(F.struct("own_score", "own_license")).alias("best")) \
        .select("_above", F.col("best.own_license").alias("given"))
    given = stored(given, "licence-directories")
    # all directories above one: "a/b/c" has "a/b/c", "a/b", "a" and the root ""
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asking = rows.filter(F.col("own_license").isNull() & F.col(path).isNotNull()).select("_dir").distinct()
    nearest = asking.select("_dir", F.explode(F.array_distinct(above)).alias("_above")).join(given, "_above") \
        .groupBy("_dir").agg(F.max(F.struct(F.length("_above").alias("depth"), "_above", "given")).alias("best")) \
        .select("_dir", F.col("best.given").alias("_given"), F.col("best._above").alias("_from"))
    joined = rows.join(stored(nearest, "licence-nearest"), "_dir", "left")
    own = F.col("own_license").isNotNull()
    return joined.select(*statements.columns, F.coalesce("own_license", "_given").alias("license"),
                         F.when(~own, F.col("_from")).alias("inherited_from"))


def document_path() -> Column:
    """documents as files: source/language/thousand/number (a missing part reads ``_``)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("_")),
                       part("doc_id"))


def op2(spark, sf_dir: str) -> DataFrame:
    """A document of a few lines that begins or ends with its statement, or one that matches as a whole,
    serves as its directory's licence file."""
    docs = table(spark, sf_dir, "documents").withColumn("path", document_path())
    found = stored(scan(docs, ["doc_id", "path"]), "licence-scan")
    few = (F.col("lines") <= NOTICE_LINES) & ((F.col("line") == 1) | (F.col("line") == F.col("lines")))
    return inherit(found, F.col("whole") | few).drop("whole")
