import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from paylens.llm import bpe, langid, lengths, licenses, packing, quality, sharding, toxicity, words
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.helpers import WORD, awkward, frame, is_held_out

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\n\t\x0b\x85é日$", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_the_regex_words(rows):
    seen = [[] for _ in rows]
    for size in (1, 1 << 20):
        got = [[] for _ in rows]
        for block in words.blocks(pa.array(rows, pa.string()), size):
            for s, e, r in zip(block.starts, block.ends, block.row):
                got[block.lo + r].append(bytes(block.buf[s:e]).decode())
        seen = got
        assert got == [WORD.findall(t or "") for t in rows]
    assert len(seen) == len(rows)


def test_word_hashes_depend_on_the_word_only(monkeypatch):
    monkeypatch.setattr(words, "_CAP", 16)
    block = next(words.blocks(pa.array(["Alpha beta " + "c" * 50 + " alpha " + "C" * 50 + " bet beta" + " x" * 30])))
    h = words.span_hashes(block.buf, block.starts, block.ends, upto=(3,))
    w = [bytes(block.buf[s:e]).decode().lower() for s, e in zip(block.starts, block.ends)]
    for i in range(len(w)):
        for j in range(len(w)):
            assert (h[0][i] == h[0][j]) == (w[i] == w[j])
            assert (h[1][i] == h[1][j]) == (w[i][:3] == w[j][:3])


# quality -------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts_and_base_rule(spark):
    rows = awkward() + [(20 + i, "a b c d e a b c d e f\nx y\nx y\n" * i, "en", "s") for i in range(4)]
    got = quality.quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((d, *brute_counts(t)) for d, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(frame(spark, [])).collect() == []


def test_quality_counts_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r.doc_id: brute_counts(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            for r in quality.op4(spark, SF_SMALL).collect()} == want


def test_sketch_quantiles_and_merging(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    rows = [(g, float(v)) for g, scale in (("x", 1.0), ("y", 50.0)) for v in np.append(rng.exponential(scale, 4000), [0.0] * 40)]
    parts = quality.sketch(spark.createDataFrame(rows, "g string, value double"), ["g"])
    at = {"q1": 0.25, "q2": 0.5, "q3": 0.99, "q0": 0.001}
    for sketches, by, groups in ((parts, ["g"], {g: [v for h, v in rows if h == g] for g in "xy"}),
                                 (quality.merged(parts.withColumn("all", parts.g.isNotNull()), ["all"]), ["all"],
                                  {True: [v for _, v in rows]})):
        for r in quality.quantiles(sketches, by, at).collect():
            values = np.sort(groups[r[by[0]]])
            for name, q in at.items():
                exact = values[int(np.ceil(q * len(values))) - 1]
                assert abs(r[name] - exact) <= quality.WIDTH * exact + 1e-6


def test_adaptive_thresholds_keep_clean_and_reject_junk(spark):
    rows = [(r.doc_id, r.quality, r.kept, r.base_failed) for r in quality.op4(spark, SF_MID).join(
        spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").collect()]
    clean = [k for _, q, k, b in rows if q == 1 and not b]
    junk = [k for _, q, k, _ in rows if q == 0]
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.05


def test_thresholds_follow_their_group(spark):
    """A symbol ratio that is usual in one source is an outlier in another."""
    plain = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    heavy = plain.replace("a ", "$ ")
    rows = [(i, f"{plain} p{i}", "en", "plain") for i in range(200)] + [(1000 + i, f"{heavy} p{i}", "en", "code") for i in range(200)]
    rows.append((5000, heavy + " odd", "en", "plain"))
    got = {r.doc_id: r.kept for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert not got[5000] and sum(got.values()) == 400


def test_thresholds_follow_the_spread_of_their_group(spark):
    def row(i, source, upper):
        words = ["ABCDE"] * upper + ["abcde"] * (40 - upper)
        return (i, " ".join(f"{w}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k, w in enumerate(words)), "en", source)

    even = [row(i, "even", 10 + i % 2) for i in range(200)]
    wide = [row(1000 + i, "wide", 10 + 4 * (i % 3 - 1)) for i in range(201)]
    got = quality.quality_rules(frame(spark, [*even, *wide, row(5000, "even", 30), row(6000, "wide", 30)])).collect()
    limit = {r.source: r.upper_ratio_max for r in got}
    kept = {r.doc_id: r.kept for r in got}
    # 7 letters a word: upper-case shares 10 and 11 of 40 against 6, 10 and 14 of 40, times 5 / 7
    assert abs(limit["even"] - (11 + 3 * 1) / 56) < 0.01 and abs(limit["wide"] - (14 + 3 * 8) / 56) < 0.03
    assert not kept[5000] and kept[6000] and sum(kept.values()) == 402


def test_rare_ratios_are_fenced_by_the_merged_sketches(spark):
    """No group varies in the ratio; the positive values of the language, or else of all, give the fence."""
    plain = " ".join(f"abc{k:03}" for k in range(60))
    rows = [(100 * g + i, f"{plain} p{i:05} q{g:05}", lang, f"s{g}") for g, lang in enumerate(["en", "en", "de"]) for i in range(100)]
    rows.append((901, plain + " $$$$xy" * 5 + " $$$$$$" * 3, "en", "s0"))     # the language's only positive value
    rows.append((902, plain + " $abcde", "de", "s2"))                        # one sign is no evidence
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    share = 38 / got[901].word_chars
    for of in (1, 101):
        assert abs(got[of].symbol_ratio_max - share / 4) < 0.01 * share
        assert got[of].mark_ratio_max is None
    assert got[201].symbol_ratio_max < share / 30            # the German value is the small one
    assert {d for d, r in got.items() if not r.kept and not r.base_failed} == {901}


def test_null_and_empty_groups_stay_apart(spark):
    low, high = "ab cd ef gh ij kl mn op qr st uv", "abcdefgh bcdefghi cdefghij defghijk efghijkl fghijklm ghijklmn hijklmno ijklmnop jklmnopq klmnopqr"
    rows = [(i, f"{low} {chr(97 + i % 26)}x", None, None) for i in range(120)] + [(500 + i, f"{high} {chr(97 + i % 26)}xxxxxxx", "", "") for i in range(120)]
    got = quality.quality_rules(frame(spark, rows)).collect()
    assert len(got) == 240 and all(r.kept for r in got)
    limits = {(r.lang, r.source): r.word_length_max for r in got}
    assert set(limits) == {(None, None), ("", "")} and limits[None, None] < 4 < 8 <= limits["", ""]


# language ------------------------------------------------------------------

def test_language_of_given_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    rows = langid.op6(spark, SF_MID).collect()
    assert len(rows) == len(docs) and all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang is not None]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97
    assert np.mean([r.rejected for r in rows]) < 0.03


def test_language_awkward_and_empty(spark):
    docs = frame(spark, awkward())
    found = langid.identify(docs, langid.fit_dictionaries(docs)).collect()
    assert len(found) == len(awkward())
    for r in found:
        text = {d: t for d, t, _, _ in awkward()}.get(r.doc_id)
        if r.doc_id is not None and not regex.search(r"\p{L}", text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in {"en", "de", "xx"}
    empty = frame(spark, [])
    assert langid.fit_dictionaries(empty) == {} and langid.identify(empty, {}).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_every_sampled_passage_is_in_the_dictionary(spark):
    """More passages than the dictionary holds: each gives an even part, late ids too."""
    name = lambda i: "q" + "".join(chr(97 + int(c)) for c in str(i)) + "q"
    rows = [(i, f"{name(i)} " * 900, "en", "s") for i in range(120)] + [(500, "short text", "en", "s")]
    found = langid.fit_dictionaries(frame(spark, rows))["en"]
    assert langid.DICT_BYTES * 0.98 <= len(found) <= langid.DICT_BYTES
    assert all(name(i).encode() in found for i in range(120) if not is_held_out(i))
    assert langid._even([], 9) == b"" and langid._even([b"ab", b"cdefgh", b"ijklmn"], 10) == b"ab cde ijk"


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(i, f"some words number {i}", ["en", "en", "en", "de", "de", None, f"rare{i}"][i % 7], "s") for i in range(210)]
    found = langid.fit_dictionaries(frame(spark, rows), languages=2)
    assert set(found) == {"en", "de"}
    assert len(langid.identify(frame(spark, rows), found).collect()) == 210


def test_language_query_against_a_plain_version(spark):
    """Sampling by SQL expressions; dictionaries, compression, scores and margins in plain Python, for every document."""
    import zstandard
    draws = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr(
        "doc_id", "text", "lang", "pmod(xxhash64(doc_id, 'langid'), 1073741824) / 1073741824D as draw",
        f"pmod(xxhash64(doc_id, 'offset'), greatest(length(text) - {langid.DOC_CHARS}, 0) + 1) as at").collect()
    letters = regex.compile(r"\p{L}+")
    plain = lambda t: " ".join(letters.findall(t.lower())).encode()
    train = [r for r in draws if not is_held_out(r.doc_id) and r.lang is not None and r.text is not None]
    content = {}
    for lang in sorted({r.lang for r in train}):
        own = sorted((r for r in train if r.lang == lang), key=lambda r: r.doc_id)
        rate = min(1.0, langid.SAMPLE_DOCS / len(own))
        parts = [plain(r.text[r.at:r.at + langid.DOC_CHARS]) for r in own if r.draw < rate]
        most = max(k for k in range(max(map(len, parts)) + 1) if sum(min(k, len(p)) for p in parts) + len(parts) - 1 <= langid.DICT_BYTES)
        joined = b" ".join(p[:most] for p in parts)
        content[lang] = joined
    packers = {k: zstandard.ZstdCompressor(level=langid.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False,
                                           dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
               for k, c in content.items()}
    got = {r.doc_id: r for r in langid.op6(spark, SF_SMALL).collect()}
    for r in draws:
        data = plain(r.text or "")
        if not data:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        size = {k: sum(len(p.compress(data[i:i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)) for k, p in packers.items()}
        best = min(size, key=lambda k: (size[k], k))
        score = 1 / sum(np.exp(-min(700, (n - size[best]) / (langid.SCALE * size[best]))) for n in size.values())
        second = min(n for k, n in size.items() if k != best)
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - score) < 1e-12
        assert got[r.doc_id].rejected == ((second - size[best]) / second < langid.MIN_MARGIN)


def test_language_ties_are_rejected():
    compressors = langid._compressors({"a": b"same words here", "b": b"same words here"})
    lang, _, margin = langid.judge("same words", compressors)
    assert lang == "a" and margin < langid.MIN_MARGIN


# toxicity ------------------------------------------------------------------

def chain(odds, trans):
    """Marginals of one chain by enumerating all labelings."""
    n, total, ones = len(odds), 0.0, np.zeros(len(odds))
    for code in range(1 << n):
        y = [(code >> k) & 1 for k in range(n)]
        w = 1.0
        for k in range(n):
            w *= trans[y[k - 1] if k else 0][y[k]] * (odds[k] if y[k] else 1.0)
        total += w
        ones += w * np.array(y)
    return ones / total


def test_marginals_match_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "SEGMENT", 3)
    rng = np.random.Generator(np.random.PCG64(4))
    trans = rng.uniform(0.2, 2, (2, 2))
    sizes = [7, 0, 1, 10, 3, 4, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    odds = np.exp(rng.normal(0, 2, first[-1]))
    got = toxicity.marginals(odds, first, trans)
    for a, b in zip(first[:-1], first[1:]):
        np.testing.assert_allclose(got[a:b], chain(odds[a:b], trans), rtol=1e-9)


def test_toxicity_of_given_documents(spark):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    rows = toxicity.op5(spark, SF_MID).collect()
    assert len(rows) == len(text) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == is_held_out(r.doc_id) for r in rows)
    held = [(marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([p == m for m, p in held]) >= 0.93
    assert np.mean([p for m, p in held if m == 0]) <= 0.03
    found = Counter(text[r.doc_id][s.start:s.end].lower() for r in rows for s in r.spans)
    assert {"idiot", "trash", "stupid"} & set(dict(found.most_common(12)))


def test_toxicity_awkward_and_empty(spark):
    docs = frame(spark, awkward())
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 16)], "doc_id long, quality int, toxic int")
    field = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, field).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    wordless = {(r.score, tuple(r.spans)) for r in rows if r.doc_id in (5, 6, 7)}  # null, empty, blank
    assert len(wordless) == 1 and not wordless.pop()[1]                           # what a text without evidence has
    real = toxicity.fit(spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet"))
    clean = [r for r in toxicity.score(docs, real).collect() if r.doc_id in (5, 6, 7, 12, 13, 14)]  # and without words of any list
    assert len(clean) == 6 and all(r.score < 0.1 and not r.spans for r in clean)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), field).collect() == []


# BPE, packing, lengths -----------------------------------------------------

def test_bpe_matches_the_library_and_round_trips(spark):
    enc = bpe.encoding(bpe.RANKS)
    rows = awkward()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(frame(spark, rows))).collect())
    want = Counter()
    for d, t, _, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode(frame(spark, [])).collect() == []


@pytest.mark.parametrize("chunk, overlap", [(16, 4), (40, 40), (64, 12)])
def test_bpe_chunks_are_stitched(spark, chunk, overlap):
    """Runs longer than the overlap, contractions and white space at every cut."""
    enc = bpe.encoding(bpe.RANKS)
    rows = [r for r in awkward() if len(r[1] or "") < 5000] + [
        (30, "it's we'll they've 'll" * 9, "en", "s"), (31, "a  \n\n \t b" * 20, "en", "s"), (32, " " * 200, "en", "s"),
        (33, "1234567890" * 30 + " end", "en", "s"), (34, "ünï çødé 日本 語" * 12, "en", "s")]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(docs, chunk=chunk, overlap=overlap).collect())
    assert got == Counter((d, tuple(enc.encode_ordinary(t or ""))) for d, t, _, _ in rows)
    back = Counter((r.doc_id, bytes(r.data).decode()) for r in bpe.decode(bpe.encode(docs, chunk=chunk, overlap=overlap)).collect())
    assert back == Counter((d, t or "") for d, t, _, _ in rows)


LIBRARY = Tokenizer.from_file(packing.TOKENIZER)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab 's'll\n\t<|endoftext|>é")), max_size=60))
def test_packing_ids_are_the_library_s(text):
    assert packing.token_ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, capacity):
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    padding = 0
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    for doc, text in docs:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]
        starts = Counter()
        for r in pieces[doc]:
            part = np.array(ids[r.start:r.start + r.length], "<u4")
            assert (len(part), zlib.crc32(part.tobytes()), len(ids)) == (r.length, r.ids_crc32, r.doc_tokens)
            starts[r.start] += r.length
        copies = sum(1 for d, _ in docs if d == doc)
        assert sum(starts.values()) == copies * len(ids)
    return padding / max(1, sum(r.length for r in rows))


def test_packing_awkward_documents(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = packing.pack(frame(spark, rows)).collect()
    check_packing(got, [(d, t) for d, t, _, _ in rows], 1024)
    assert packing.pack(frame(spark, [])).collect() == []
    assert len(packing.pack(frame(spark, [(None, None, None, None)])).collect()) == 1


def test_packing_given_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 16)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    assert check_packing(packing.op7(spark, SF_MID).collect(), docs, 1024) < 0.01


def test_plan_holds_every_piece_once():
    rng = np.random.Generator(np.random.PCG64(6))
    for n in (1, 3, 40, 500):
        histogram = Counter(int(x) for x in rng.integers(1, 65, n))
        used = Counter()
        for times, seq in packing.plan(dict(histogram), 64):
            assert sum(seq) <= 64 and times > 0
            for x in seq:
                used[x] += times
        assert used == histogram


def test_linear_program_reaches_its_bound():
    lengths_ = np.array([20, 30, 45])
    basis, use = packing.cutting_stock(lengths_, np.array([60.0, 60.0, 60.0]), 100)
    np.testing.assert_allclose(basis @ use, 60)
    assert use.sum() <= 60 * (1 + 1e-2)  # 45 + 30 + 20 fits one sequence


def test_token_counts_match_brute_force(spark):
    enc = bpe.encoding(bpe.RANKS)
    docs = frame(spark, awkward())
    n = np.array([len(enc.encode_ordinary(t or "")) for _, t, _, _ in awkward()])
    histogram = lengths.length_histogram(docs)
    limits = lengths.context_limits(histogram)
    rows = {r.context_limit: r for r in limits.collect()}
    assert set(rows) == set(n.tolist())
    for limit, r in rows.items():
        cut = np.minimum(n, limit)
        assert (r.docs_at_limit, r.docs_over, r.docs_within, r.total_docs) == \
            ((n == limit).sum(), (n > limit).sum(), (n <= limit).sum(), len(n))
        assert (r.total_tokens, r.truncated_total, r.tokens_cut) == (n.sum(), cut.sum(), (n - cut).sum())
    assert lengths.truncated_total(histogram, 7).first().tokens == np.minimum(n, 7).sum()
    assert lengths.quantile(limits, 0.5).first().length == np.sort(n)[int(np.ceil(0.5 * len(n))) - 1]
    assert lengths.context_limits(lengths.length_histogram(frame(spark, []))).collect() == []


# sharding ------------------------------------------------------------------

def check_shards(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_shards_are_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 3)
    docs = [(d, t) for d, t, _, _ in awkward()]
    check_shards(sharding.shard_rows(frame(spark, awkward()), 5).collect(), docs, 5)
    check_shards(sharding.shard_rows(frame(spark, awkward()), 40).collect(), docs, 40)
    assert sharding.shard_rows(frame(spark, [])).collect() == []


def test_shards_of_given_documents(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    rows = sharding.op9(spark, SF_MID).collect()
    check_shards(rows, docs, 16)
    assert abs(np.corrcoef([r.doc_id for r in rows], [r.slot for r in rows])[0, 1]) < 0.15
    monkeypatch.setattr(sharding, "LINES", 7)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 60)                       # many lines, written seven at a time
    check_shards(sharding.op9(spark, SF_MID).collect(), docs, 16)
    plan = sharding.op9(spark, SF_MID)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_hypergeometric_law():
    import random
    rng = random.Random(1)
    x = np.array([sharding.hypergeometric(rng, 50, 450, 60) for _ in range(20000)])
    assert abs(x.mean() - 6) < 0.06 and abs(x.var() - 4.76) < 0.2
    for sizes in ([5, 0, 7, 1], [1000, 1], [0], [3]):
        matrix = sharding.communication_matrix(sizes, 4, 1)
        assert [sum(m) for m in matrix] == sizes
        columns = [sum(c) for c in zip(*matrix)]
        assert max(columns) - min(columns) <= 1


# licences ------------------------------------------------------------------

def test_licence_statements_and_inheritance(spark):
    rows = [("src/LICENSE", "Released under the MIT License."), ("src/a.py", "code\n# licensed under the Apache license, version 2.0\n"),
            ("src/b.py", "plain code"), ("src/lib/c.py", "plain"), ("src/lib/vendor/COPYING", "x\nLicensed under CC BY-NC 4.0."),
            ("src/lib/vendor/deep/er/d.py", "plain"), ("src/lib/vendor/COPYING", "Licensed under CC BY-NC 4.0."),
            ("other/e.py", None), ("top.py", ""), (None, "Released under the MIT License."), (None, None),
            ("src/lib/vendored.py", "released"), ("src/b.py", "plain code"),
            ("src/long.py", "word " * 20000 + "\nThis work is licensed under the GNU General Public License, version 3.")]
    files = spark.createDataFrame([(p, t, "x", 1) for p, t in rows], "path string, text string, _dir string, line int")
    found = licenses.scan(files, ["path"])
    is_file = found.path.rlike("(LICENSE|COPYING)$")
    got = Counter((r.path, r.own_license, r.license, r.inherited_from) for r in licenses.inherit(found, is_file).collect())
    nc, mit = "CC-BY-NC-4.0", "MIT"
    assert got == Counter([
        ("src/LICENSE", mit, mit, None), ("src/a.py", "Apache-2.0", "Apache-2.0", None), ("src/b.py", None, mit, "src"),
        ("src/b.py", None, mit, "src"), ("src/lib/c.py", None, mit, "src"), ("src/lib/vendor/COPYING", nc, nc, None),
        ("src/lib/vendor/COPYING", nc, nc, None), ("src/lib/vendor/deep/er/d.py", None, nc, "src/lib/vendor"),
        ("other/e.py", None, None, None), ("top.py", None, None, None), (None, mit, mit, None), (None, None, None, None),
        ("src/lib/vendored.py", None, mit, "src"), ("src/long.py", "GPL-3.0", "GPL-3.0", None)])
    empty = licenses.scan(files.limit(0), ["path"])
    assert licenses.inherit(empty, empty.path.rlike("LICENSE")).collect() == []


def test_licence_cosine_matches_brute_force(spark):
    """Scores of all lines of the given documents, computed with dictionaries."""
    import math
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    term = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
    terms = lambda t: Counter(term.findall(t.lower() if t.isascii() else "".join(c.lower() if c < "\x80" else c for c in t)))
    df = Counter(w for _, t in docs for w in terms(t or ""))
    vocabulary = {w for ts in licenses.TEMPLATES.values() for t in ts for w in terms(t)}
    idf = lambda w: math.log((1 + len(docs)) / (1 + (df[w] if w in vocabulary else 0))) + 1
    norm = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))
    want = {}
    for d, text in docs:
        best = (0.0, None)
        for line in (text or "").split("\n"):
            c = terms(line)
            for name, ts in licenses.TEMPLATES.items():
                for t in ts:
                    k = terms(t)
                    dot = sum(n * k[w] * idf(w) ** 2 for w, n in c.items() if w in k)
                    if dot and dot / (norm(c) * norm(k)) > best[0] + 1e-9:
                        best = dot / (norm(c) * norm(k)), name
        want[d] = best[1] if best[0] >= licenses.COSINE else None
    assert {r.doc_id: r.own_license for r in licenses.op2(spark, SF_SMALL).collect()} == want


def test_runs_of_terms_match_a_comparison_of_every_window():
    """Random files against random templates: cosines of all windows and whole files by dictionaries."""
    import math
    import random
    rnd = random.Random(3)
    for trial in range(400):
        known, other = list(range(1, 7)), list(range(20, 30))
        sized = [[rnd.choice(known) for _ in range(rnd.randrange(1, 6))] for _ in range(rnd.randrange(1, 4))]
        terms = np.array(sorted({t for x in sized for t in x}), np.uint64)

        class Templates:
            names = [f"L{i}" for i in range(len(sized))]
            counts = np.array([[x.count(int(t)) for t in terms] for x in sized], float)

            def find(self, hashes):
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == hashes)
                return hit, at[hit]

        Templates.terms = terms
        weight, unseen, cosine = np.array([rnd.uniform(0.5, 2) for _ in terms]), 2.0, 0.8
        runs = licenses.Runs(Templates(), 0, weight, unseen, cosine)
        file = [rnd.choice(known + other[:rnd.randrange(1, 8)]) for _ in range(rnd.randrange(1, 25))]
        idf = {int(t): w for t, w in zip(terms, weight)}
        norm = lambda c: math.sqrt(sum((n * idf.get(t, unseen)) ** 2 for t, n in c.items()))

        def cos(part, of):
            a, b = Counter(part), Counter(of)
            return sum(n * b[t] * idf[t] ** 2 for t, n in a.items() if t in b) / (norm(a) * norm(b))

        want, whole = [], False
        for name, x in zip(Templates.names, sized):
            whole |= round(cos(file, x), 9) >= cosine
            tried = [(-round(cos(file, x), 9), -len(x), 0, name)]
            if len(file) > len(x):
                scores = [round(cos(file[k:k + len(x)], x), 9) for k in range(len(file) - len(x) + 1)]
                k = int(np.argmax(scores))
                tried.append((-scores[k], -len(x), k, name))
            want += [t for t in tried if -t[0] >= cosine]
        n = len(file)
        got, full = runs.best(np.array(file, np.uint64), np.arange(n), np.zeros(n, bool), np.arange(len(sized)))
        assert full == whole
        best = min(want, default=None)
        assert (got is None) == (best is None)
        if best:
            assert abs(got[0] - best[0]) < 1e-8 and (got[1], got[3]) == (best[1], best[3]) or any(
                abs(got[0] - t[0]) < 1e-8 and got[1] == t[1] for t in want), (got, want)


def test_licence_texts_headers_and_wrapped_notices(spark, tmp_path):
    """Statements over several lines, inside a line, and whole licence files of more than four lines."""
    texts = licenses.full_texts()
    gnu = ("# This program is free software: you can redistribute it and/or modify\n"
           "# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, "
           "either version {} of the License, or\n# (at your option) any later version.\nimport os\nprint(os.name)\n")
    code = "\n".join(f"line {i} of some other text {i * i}" for i in range(300))
    cases = [(t[0], name, True) for name, t in texts.items()] + [
        ("MIT License\n\nCopyright (c) 2019 Some One <some@one.org>\n" + texts["MIT"][0].split("\n", 3)[3], "MIT", True),
        ("// SPDX-License-Identifier: MIT\nint main() { return 0; }", "MIT", False),
        (code + "\n/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0", False),
        ("SPDX-License-Identifier: GPL-2.0-only\n" + code, "GPL-2.0", False),
        (gnu.format("", 3) + code, "GPL-3.0", False), (gnu.format("Lesser ", 3) + code, "LGPL-3.0", False),
        (gnu.format("", 2) + code, "GPL-2.0", False),
        (code + "\n * Released under\n * the MIT License.\n" + code, "MIT", False),
        ("The words of this book are by many. Licensed under CC BY-NC 4.0. Please ask for more of them at the desk.", "CC-BY-NC-4.0", False),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0", True),
        ("the software is free of charge and the license is in another file", None, False), (code, None, False)]
    files = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "id int, text string")
    got = {r.id: (r.own_license, r.whole) for r in licenses.scan(files, ["id"]).collect()}
    assert got == {i: (name, whole) for i, (_, name, whole) in enumerate(cases)}
    docs = [(1, texts["BSD-3-Clause"][0], "en", "s"), (2, code, "en", "s")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.op2(spark, str(tmp_path)).collect()}
    assert got == {1: ("BSD-3-Clause", None), 2: ("BSD-3-Clause", "s/en/0")}
