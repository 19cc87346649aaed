"""Toxicity by a linear-chain conditional random field over a document's tokens.

Tokens are runs of letters.  Their features are the hashed token and its first
four, six and eight bytes (inflected forms share them).  Training uses a
bounded sample of labelled documents that are not held out (``SAMPLE`` of each
class on average).  Document labels become token labels by association: a
token of a toxic document is labelled when one of its features is
significantly more frequent, by documents, among toxic than clean ones.  The
field is fitted to windows of ``WINDOW`` tokens around and away from labelled
tokens by gradient ascent on the regularised log-likelihood, with exact
forward-backward expectations.

Scoring runs forward-backward over every whole text.  Tokens are laid out in
segments: products of the 2x2 step matrices inside segments, messages along a
document's segments, then messages inside segments, each step for all segments
of a block at once.  The marginals give the offending spans (character offsets
of tokens with a marginal of at least 0.5) and, through a logistic of the joint
evidence and the document's length, its score.

Only the bounded training sample and the weights (``1 << BITS`` numbers) pass
the driver; scoring is one map over the texts without a shuffle.

Defined results: null and letterless texts have no spans and the score of no
evidence; without both classes in the training rows every score is 0; labels
of repeated ids count once per row; rows without a label are only scored; a
null id counts as held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paylens.llm.store import held_out, table, with_text
from paylens.llm.words import blocks, span_hashes

SAMPLE, DOC_BYTES = 1200, 1 << 15
BITS, PREFIXES = 18, (4, 6, 8)
MIN_GAIN, MIN_LOG_ODDS = 24.0, 2.0
WINDOW, MAX_WINDOWS, STEPS, L2 = 32, 12000, 60, 1e-4
SEGMENT = 64
FLAGGED, SUSPECT = 0.5, 0.2

#: separators: everything but letters; bytes of non-ASCII characters count as letters
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def token_features(block) -> np.ndarray:
    """Feature ids of all tokens of a block: [1 + len(PREFIXES), tokens]."""
    hashes = span_hashes(block.buf, block.starts, block.ends, upto=PREFIXES)
    out = np.empty(hashes.shape, np.int64)
    for k, h in enumerate(hashes):
        out[k] = ((h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
                  >> np.uint64(64 - BITS)).astype(np.int64)
    return out


@dataclass
class Field:
    """Weights of label 1 against 0 by feature, the bias, the transition factors, and the score's logistic."""
    weights: np.ndarray
    bias: float
    trans: np.ndarray  # exp of the transition weights, [from, to]
    coef: np.ndarray | None = None  # of evidence, length, 1

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each row from its tokens' marginals."""
        return 1 / (1 + np.exp(-np.clip(evidence(p, first) @ self.coef, -30, 30)))

    def odds(self, features: np.ndarray) -> np.ndarray:
        """Emission factor of label 1 against 0 for each token."""
        return np.exp(np.clip(self.bias + self.weights[features].sum(0), -30, 30))


def messages(odds: np.ndarray, live: np.ndarray, trans: np.ndarray, start: np.ndarray, reverse: bool) -> np.ndarray:
    """Ratios of forward (or backward) messages inside rows of ``odds``; ``start`` enters each row.

    Forward: the message after a token, emission included.  Backward: the
    message into a token from its right, emission of the token excluded.
    """
    (t00, t01), (t10, t11) = trans
    out, x = np.empty_like(odds), start.astype(float)
    cols = range(odds.shape[1] - 1, -1, -1) if reverse else range(odds.shape[1])
    for c in cols:
        e = odds[:, c]
        if reverse:
            out[:, c] = x
            y = e * x
            x = np.where(live[:, c], (t10 + t11 * y) / (t00 + t01 * y), x)
        else:
            x = np.where(live[:, c], e * (t01 + t11 * x) / (t00 + t10 * x), x)
            out[:, c] = x
    return out


def _products(odds: np.ndarray, live: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each row's product of step matrices T diag(1, odds), scaled."""
    (t00, t01), (t10, t11) = trans
    n = len(odds)
    a, b, c, d = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for k in range(odds.shape[1]):
        e, on = odds[:, k], live[:, k]
        a, b = np.where(on, a * t00 + b * t10, a), np.where(on, (a * t01 + b * t11) * e, b)
        c, d = np.where(on, c * t00 + d * t10, c), np.where(on, (c * t01 + d * t11) * e, d)
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    return a, b, c, d


def marginals(odds: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every token; row r holds tokens first[r]:first[r + 1]."""
    n = np.diff(first)
    total = int(first[-1] - first[0])
    if not total:
        return np.zeros(0)
    per = -(-n // SEGMENT)
    seg0 = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(total) - np.repeat(first[:-1] - first[0], n)
    seg, col = seg0[row] + pos // SEGMENT, pos % SEGMENT
    grid, live = np.ones((seg0[-1], SEGMENT)), np.zeros((seg0[-1], SEGMENT), bool)
    grid[seg, col], live[seg, col] = odds, True
    a, b, c, d = _products(grid, live, trans)
    ahead, behind = np.zeros(seg0[-1]), np.ones(seg0[-1])
    order = np.argsort(-per, kind="stable")
    begin, last = seg0[:-1][order], seg0[1:][order] - 1
    for k in range(1, int(per.max(initial=0))):
        at = begin[:int(np.searchsorted(-per[order], -k, "left"))] + k - 1
        ahead[at + 1] = (b[at] + d[at] * ahead[at]) / (a[at] + c[at] * ahead[at])
        at = last[:len(at)] - k + 1
        behind[at - 1] = (c[at] + d[at] * behind[at]) / (a[at] + b[at] * behind[at])
    fwd = messages(grid, live, trans, ahead, False)
    bwd = messages(grid, live, trans, behind, True)
    ratio = (fwd * bwd)[seg, col]
    return ratio / (1 + ratio)


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[log of the joint evidence, log length, 1] of each row.

    The evidence is -log of the chance that no suspicious token (marginal of at
    least ``SUSPECT``) is toxic.
    """
    total = np.concatenate([[0.0], np.cumsum(np.where(p >= SUSPECT, -np.log1p(-np.minimum(p, 1 - 1e-6)), 0.0))])
    o = first - first[0]
    return np.stack([np.log(np.maximum(total[o[1:]] - total[o[:-1]], 0) + 0.05), np.log1p(np.diff(o)),
                     np.ones(len(o) - 1)], 1)


def _seeds(features: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic rows with a feature that toxic documents hold significantly more often."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    seed = np.zeros(features.shape[1], bool)
    for f in features:
        pair = np.unique(row.astype(np.int64) << BITS | f)
        by = [np.bincount(pair[on] & ((1 << BITS) - 1), minlength=1 << BITS)
              for on in (toxic[pair >> BITS], ~toxic[pair >> BITS])]
        k1, k0 = by[0].astype(float), by[1].astype(float)
        pooled = np.maximum((k1 + k0) / (n1 + n0), 1e-12)
        gain = 2 * (k1 * np.log(np.maximum(k1 / n1, 1e-12) / pooled) + k0 * np.log(np.maximum(k0 / n0, 1e-12) / pooled))
        odds = np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1))
        seed |= ((gain >= MIN_GAIN) & (odds >= MIN_LOG_ODDS))[f]
    return seed & toxic[row]


def _windows(first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Token indexes [windows, WINDOW] (-1 past a row's end): labelled ones first, then others, evenly spaced."""
    starts = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(first[:-1], first[1:])] or [np.zeros(0, int)])
    ends = np.concatenate([np.minimum(np.arange(a, b, WINDOW) + WINDOW, b) for a, b in zip(first[:-1], first[1:])]
                          or [np.zeros(0, int)])
    c = np.concatenate([[0], np.cumsum(label)])
    has = c[ends] > c[starts]
    yes, no = np.flatnonzero(has), np.flatnonzero(~has)
    yes = yes[:: max(1, -(-len(yes) * 2 // MAX_WINDOWS))]
    no = no[:: max(1, -(-len(no) * 2 // MAX_WINDOWS))]
    pick = np.concatenate([yes, no])
    at = starts[pick, None] + np.arange(WINDOW)
    return np.where(at < ends[pick, None], at, -1)


def fit_field(features: np.ndarray, first: np.ndarray, toxic: np.ndarray, share: float) -> Field:
    """Fit the field and its score on rows with document labels ``toxic``, ``share`` of them among all rows."""
    row = np.repeat(np.arange(len(toxic)), np.diff(first))
    label = _seeds(features, row, toxic)
    at = _windows(first, label)
    live, y = at >= 0, np.where(at >= 0, label[at], False)
    feats = np.where(live, features[:, at], 0)
    field = Field(np.zeros(1 << BITS), -4.0, np.ones((2, 2)))
    log_t, grads = np.zeros((2, 2)), [np.full(1 << BITS, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    n, prev = live.sum(), np.concatenate([np.zeros((len(at), 1), bool), y[:, :-1]], 1)
    seen = np.array([[(live & (prev == i) & (y == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    for _ in range(STEPS):
        field.trans = np.exp(log_t)
        odds = np.where(live, field.odds(feats.reshape(len(feats), -1)).reshape(at.shape), 1.0)
        fwd = messages(odds, live, field.trans, np.zeros(len(at)), False)
        bwd = messages(odds, live, field.trans, np.ones(len(at)), True)
        p = np.where(live, fwd * bwd / (1 + fwd * bwd), 0.0)
        before = np.concatenate([np.zeros((len(at), 1)), fwd[:, :-1]], 1)
        joint = np.stack([field.trans[0, 0] * np.ones_like(odds), field.trans[0, 1] * odds * bwd,
                          before * field.trans[1, 0], before * field.trans[1, 1] * odds * bwd])
        joint = joint / joint.sum(0) * live
        diff = np.where(live, y - p, 0.0)
        g = [np.zeros(1 << BITS), diff.sum() / n, (seen - joint.sum((1, 2)).reshape(2, 2)) / n]
        for f in feats:
            g[0] += np.bincount(f.ravel(), diff.ravel(), 1 << BITS)
        g[0] = g[0] / n - L2 * field.weights / 100
        for k in range(3):
            grads[k] = grads[k] + g[k] * g[k]
        field.weights = field.weights + 0.5 * g[0] / np.sqrt(grads[0])
        field.bias += 0.5 * g[1] / np.sqrt(grads[1])
        log_t = log_t + 0.2 * g[2] / np.sqrt(grads[2])
    field.trans = np.exp(log_t)
    x = evidence(marginals(field.odds(features), first, field.trans), first)
    field.coef = _logistic(x, toxic, share)
    return field


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Ridge logistic regression of y on x by Newton steps; class 1 weighs ``share`` of all."""
    w = np.where(y, share / max(1, y.sum()), (1 - share) / max(1, (~y).sum()))
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
        b = b + np.clip(np.linalg.solve(h, x.T @ (w * (y - p)) - ridge @ b), -2, 2)
    return b


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
                  doc_bytes: int = DOC_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of about ``sample`` labelled, not held-out documents of each class.

    A sampled text longer than ``doc_bytes`` characters gives a passage at a hashed offset.
    With them the numbers of such rows by class.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")) \
        .filter(~held_out("doc_id") & F.col("toxic").isin(0, 1))
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))) \
        .otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    offset = F.pmod(F.xxhash64("doc_id", F.lit("offset")), F.greatest(F.length("text") - doc_bytes, F.lit(0)) + 1)
    sampled = marks.filter(draw < rate)  # about 2 * sample rows, whatever the table's size
    rows = texts.join(F.broadcast(sampled), "doc_id").select(
        "doc_id", "toxic", F.substring(F.col("text"), offset.cast("int") + 1, F.lit(doc_bytes)).alias("text"))
    return rows, sizes


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field learned from a bounded sample; None without rows of both classes."""
    frame, sizes = training_rows(docs, labels, sample)
    rows = sorted(frame.collect(), key=lambda r: (r.doc_id, r.text, r.toxic))
    toxic = np.array([r.toxic == 1 for r in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    feats, counts = [], []
    for block in blocks(pa.array([r.text for r in rows], pa.string()), between=NOT_LETTER):
        feats.append(token_features(block))
        counts.append(block.n_words)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return fit_field(np.concatenate(feats, 1), first, toxic, sizes[1] / (sizes[0] + sizes[1]))


def score(docs: DataFrame, field: Field | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row with score, n_toxic_tokens and the spans (character offsets) of its whole text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at), between=NOT_LETTER):
                n = block.hi - block.lo
                if field is None:
                    scores, flagged = np.zeros(n), np.zeros(0, int)
                else:
                    p = marginals(field.odds(token_features(block)), block.first, field.trans)
                    scores, flagged = field.score(p, block.first), np.flatnonzero(p >= FLAGGED)
                chars = np.cumsum((block.buf & 0xC0) != 0x80)
                chars = np.concatenate([[0], chars])
                row = block.row[flagged]
                base = chars[block.offs[row]]
                spans = pa.StructArray.from_arrays(
                    [pa.array((chars[block.starts[flagged]] - base).astype(np.int32)),
                     pa.array((chars[block.ends[flagged]] - base).astype(np.int32))], names=["start", "end"])
                counts = np.bincount(row, minlength=n)
                offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(block.lo, n) for i in range(len(columns))]
                    + [pa.array(scores), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offs), spans)],
                    names=[*columns, "score", "n_toxic_tokens", "spans"])

    rows, at, schema = with_text(docs, columns)
    return rows.mapInArrow(
        task, schema + ", score double, n_toxic_tokens long, spans array<struct<start:int,end:int>>")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_toxic_tokens", "spans")
