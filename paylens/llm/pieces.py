"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are split where no piece of the vocabulary can reach across: before a
space that follows something else, and between two characters that stand side
by side in no piece.  Such a stretch is a word of its own for the merges.  All
words that a task meets for the first time are laid into flat NumPy arrays
(symbol, word) and encoded together, in rounds: the pair rank of every
neighbouring pair, the segmented minimum per word, all leftmost occurrences of
that minimum merged at once, the arrays compacted, until no pair remains.

A round is what a priority queue (best score first, leftmost on ties) would do
one merge after the other.  The one case in which it is not, a merge that makes
a neighbouring pair as good as or better than the word's minimum, is found in
the round, and the word's occurrences after it wait for the next round.

Characters outside the vocabulary become their UTF-8 bytes' pieces.  Decoding
joins the pieces' bytes.

Defined results: null reads as empty and gives no ids; invalid UTF-8 reads as
U+FFFD; rows that repeat are encoded each; an empty table gives an empty
result; other columns are ignored.  Models other than BPE with byte fallback,
identity normalisation and a leading space are refused.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from paylens.llm.bpe import _lists, id_lists
from paylens.llm.store import table
from paylens.llm.words import texts
from paylens.session import ship_package

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE, NONE = "▁", np.iinfo(np.int32).max
_BLOCK_CHARS, _PART_CHARS, _KNOWN_CHARS = 1 << 20, 1 << 20, 1 << 23


@dataclass(frozen=True)
class Vocabulary:
    """``symbol``: of each code point (-1: in no piece); pairs as sorted keys with rank and merged symbol."""
    size: int
    symbol: np.ndarray
    pair: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    beside: np.ndarray   # sorted keys of symbols of characters that stand side by side in a piece
    symbols: int
    byte: np.ndarray     # id of each byte's piece
    spaced: bool         # no piece has a space after something else
    raw: tuple[bytes, ...]
    control: frozenset[int]
    unknown: int
    bytes_of: dict[int, int]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " ①Ａ  ▁ "
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or model.encode("\U0010fffd")[-1:] == [model.unk_id()]:
        raise ValueError(f"{path}: only byte fallback, identity normalisation and a leading space are handled")
    size = model.get_piece_size()
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    if any(model.is_unused(i) for i in range(size)):
        raise ValueError(f"{path}: unused pieces are not handled")
    pieces = {model.id_to_piece(i): i for i in range(size) if i not in special}
    chars = {c for p in pieces for c in p}
    ids = pieces | {c: size + k for k, c in enumerate(sorted(chars - pieces.keys()))}
    symbol = np.full(0x110000, -1, np.int32)
    for c in chars:
        symbol[ord(c)] = ids[c]
    symbols = size + len(chars)
    score = {i: model.get_score(i) for i in pieces.values()}
    ranks = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
    pairs, beside = {}, set()
    for p, i in pieces.items():
        for k in range(1, len(p)):
            left, right = ids.get(p[:k]), ids.get(p[k:])
            if left is not None and right is not None:
                pairs[left * symbols + right] = (ranks[score[i]], i)
            beside.add(ids[p[k - 1]] * symbols + ids[p[k]])
    keys = np.array(sorted(pairs), np.int64)
    held = np.array([pairs[k] for k in keys.tolist()], np.int32).reshape(-1, 2)
    byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    raw = [model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
    for b, i in enumerate(byte.tolist()):
        raw[i] = bytes([b])
    control = frozenset(i for i in special if model.is_control(i))
    for i in control:
        raw[i] = b""
    raw[model.unk_id()] = " ⁇ ".encode()
    return Vocabulary(size, symbol, keys, held[:, 0].copy(), held[:, 1].copy(), np.array(sorted(beside), np.int64), symbols, byte,
                      not any(b == SPACE and a != SPACE for p in pieces for a, b in zip(p, p[1:])), tuple(raw), control,
                      model.unk_id(), {int(i): b for b, i in enumerate(byte)})


def _pairs(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank (NONE if they form no piece) and merged symbol of pairs."""
    key = left.astype(np.int64) * v.symbols + right
    at = np.minimum(np.searchsorted(v.pair, key), len(v.pair) - 1)
    hit = (v.pair[at] == key) & (left >= 0) & (right >= 0)
    return np.where(hit, v.rank[at], NONE), np.where(hit, v.merged[at], -1)


def merge_rounds(v: Vocabulary, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges and their words; ``word`` ascends."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank, made = np.full(len(symbol), NONE, np.int32), np.full(len(symbol), -1, np.int32)
    inner = np.flatnonzero(word[:-1] == word[1:])
    rank[inner], made[inner] = _pairs(v, symbol[inner], symbol[inner + 1])
    while len(symbol):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbol)]))
        live = least < NONE
        if not live.all():
            done.append((symbol[~live], word[~live]))
            symbol, word, rank, made, least = symbol[live], word[live], rank[live], made[live], least[live]
            if not len(symbol):
                break
        at = np.flatnonzero(rank == least)
        heads = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        at = at[(np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))) % 2 == 0]  # leftmost, none overlaps

        merged, own = made[at], word[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
        joined = np.r_[False, (np.diff(at) == 2) & (own[1:] == own[:-1])]  # its left neighbour is the merge before it
        left = np.where(joined, np.r_[0, merged[:-1]], symbol[before])
        left_rank = np.where((at > 0) & (word[before] == own), _pairs(v, left, merged)[0], NONE)
        right_rank = np.where((at + 2 < len(symbol)) & (word[after] == own), _pairs(v, merged, symbol[after])[0], NONE)
        early = np.minimum(left_rank, right_rank) <= least[at]
        if early.any():  # what stands after such a merge waits a round
            _, group = np.unique(own, return_inverse=True)
            stop = np.full(group.max() + 1, len(symbol))
            np.minimum.at(stop, group[early], at[early])
            ok = at <= stop[group]
            at, merged = at[ok], merged[ok]

        symbol[at] = merged
        kept = np.ones(len(symbol), bool)
        kept[at + 1] = False
        place = np.cumsum(kept) - 1
        symbol, word, rank, made = symbol[kept], word[kept], rank[kept], made[kept]
        changed = place[at]
        changed = np.unique(np.r_[changed, changed[changed > 0] - 1])
        rank[changed], made[changed] = NONE, -1
        changed = changed[changed + 1 < len(symbol)]
        changed = changed[word[changed] == word[changed + 1]]
        rank[changed], made[changed] = _pairs(v, symbol[changed], symbol[changed + 1])
    if not done:
        return symbol, word
    symbol, word = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return symbol[order], word[order]


def _bytes_pieces(v: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of UTF-8 bytes of code points, and their pieces, one code point after the other."""
    n = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    grid = np.zeros((len(points), 4), np.int64)
    for k in (1, 2, 3, 4):
        of = n == k
        p = points[of].astype(np.int64)
        for i in range(k):
            shift = 6 * (k - 1 - i)
            grid[of, i] = (p >> shift) & 0x3F | 0x80 if i else p >> shift | (0, 0, 0xC0, 0xE0, 0xF0)[k]
    return n, v.byte[grid[np.arange(4) < n[:, None]]]


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of words, each after a space of its own, and the number of ids of each."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    flat = SPACE + SPACE.join(w.replace(" ", SPACE) for w in words)
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    symbol = v.symbol[points]
    key = symbol[:-1].astype(np.int64) * v.symbols + symbol[1:]
    at = np.minimum(np.searchsorted(v.beside, key), len(v.beside) - 1)
    apart = (v.beside[at] != key) | (symbol[:-1] < 0) | (symbol[1:] < 0) | (owner[1:] != owner[:-1])
    stretch = np.r_[0, np.cumsum(apart)]
    first = np.flatnonzero(np.r_[True, apart])  # a stretch's first character
    ids, of = merge_rounds(v, symbol.copy(), stretch)
    owner = owner[first[of]]
    odd = (ids < 0) | (ids >= v.size)
    if odd.any():
        # a symbol that is no piece is a character that never merged; find it again by counting characters
        length = np.ones(len(ids), np.int64)
        length[~odd] = _char_counts(v)[ids[~odd]]
        begin = np.cumsum(length) - length
        n, of_bytes = _bytes_pieces(v, points[begin[odd]])
        count = np.ones(len(ids), np.int64)
        count[odd] = n
        out = np.repeat(np.where(odd, 0, ids), count).astype(np.int32)
        out[np.repeat(odd, count)] = of_bytes
        ids, owner = out, np.repeat(owner, count)
    return ids.astype(np.int32), np.bincount(owner, minlength=len(words))


@functools.lru_cache(maxsize=4)
def _counts(raw: tuple[bytes, ...]) -> np.ndarray:
    return np.array([len(r.decode("utf-8", "replace")) for r in raw], np.int64)


def _char_counts(v: Vocabulary) -> np.ndarray:
    return _counts(v.raw)


def words_of(text: str) -> list[str]:
    """A text's words without their own first space; further spaces before a word belong to it."""
    words = text.split(" ")
    if "" not in words:
        return words
    out, pad = [], ""
    for w in words:
        if w:
            out.append(pad + w)
            pad = ""
        else:
            pad += " "
    return out + [pad[1:]] if pad else out


def _parts(text: str) -> Iterator[str]:
    """``text`` cut at single spaces after at least so many characters (each part has a space before it)."""
    lo = 0
    while len(text) - lo > _PART_CHARS:
        at = text.find(" ", lo + _PART_CHARS)
        while at > 0 and text[at - 1] == " ":
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[lo:at]
        lo = at + 1
    yield text[lo:]


class Known(dict):
    """Words met so far, numbered in order; ``ids`` and ``offs`` hold the encoded ones."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.ids, self.offs, self.chars = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        self.chars += len(word) + 1
        return number

    def encode(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of numbered words, and the number of ids of each."""
        if self.fresh:
            ids, n = encode_words(self.v, self.fresh)
            self.ids = np.concatenate([self.ids, ids])
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(n)])
            self.fresh = []
        n = np.diff(self.offs)[numbers]
        end = np.cumsum(n)
        return self.ids[np.arange(end[-1] if len(end) else 0) + np.repeat(self.offs[numbers] - (end - n), n)], n


def encode_texts(known: Known, some: list[str]) -> list[np.ndarray]:
    """Ids of each text; the new words of all are merged together."""
    numbers, sizes = [], []
    for text in some:
        before = len(numbers)
        if text:
            text = text.replace(SPACE, " ")
            for part in _parts(text):
                numbers += map(known.__getitem__, words_of(part) if known.v.spaced else [part])
        sizes.append(len(numbers) - before)
    ids, n = known.encode(np.array(numbers, np.int64))
    ends = np.r_[0, np.cumsum(n)][np.cumsum(np.array(sizes, np.int64))]
    if known.chars > _KNOWN_CHARS:
        known.forget()
    return np.split(ids, ends[:-1]) if some else []


def _encode_task(path: str):
    """Batches (doc_id, text) to (doc_id, ids)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(vocabulary(path))
        for batch in batches:
            lo, size, some = 0, 0, []
            for text in texts(batch.column(1)):
                some.append(text)
                size += len(text)
                if size > _BLOCK_CHARS:
                    yield _rows(batch, lo, encode_texts(known, some))
                    lo, size, some = lo + len(some), 0, []
            yield _rows(batch, lo, encode_texts(known, some))
    return task


def _rows(batch: pa.RecordBatch, lo: int, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(ids)), id_lists(ids)], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode_task(path), "doc_id long, ids array<int>")


def decoded(v: Vocabulary, ids: list[int]) -> bytes:
    """UTF-8 of the ids' text: pieces joined, the first one's leading space dropped, bytes that form no character as U+FFFD each."""
    data = b"".join(map(v.raw.__getitem__, ids))
    try:
        if not v.control.isdisjoint(ids):  # a control piece between bytes parts them
            raise ValueError
        data.decode()
    except ValueError:
        data, run = b"", bytearray()
        for i in [*ids, None]:
            if i in v.bytes_of:
                run.append(v.bytes_of[i])
            else:
                data += _mended(bytes(run)) + (b"" if i is None else v.raw[i])
                run.clear()
    head = next((i for i in ids if i not in v.control), None)
    if head is not None and head != v.unknown and head not in v.bytes_of and data[:1] == b" ":
        return data[1:]
    return data


def _mended(run: bytes) -> bytes:
    out, i = [], 0
    while i < len(run):
        for k in (1, 2, 3, 4):
            try:
                run[i:i + k].decode()
            except UnicodeDecodeError:
                continue
            if i + k <= len(run):
                out.append(run[i:i + k])
                i += k
                break
        else:
            out.append(b"\xef\xbf\xbd")
            i += 1
    return b"".join(out)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            data = [decoded(v, ids) for ids in _lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()).cast(pa.string())], names=["doc_id", "text"])
    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")) \
        .mapInArrow(task, "doc_id long, text string")


@functools.lru_cache(maxsize=1)
def _decimal(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def digests(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        names = _decimal(v.size)
        for batch in batches:
            n, a, b = [], [], []
            for ids in _lists(batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(b",".join(map(names.__getitem__, ids))).hexdigest())
                b.append(hashlib.sha256(decoded(v, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return encoded.select("doc_id", "ids").mapInArrow(
        task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
