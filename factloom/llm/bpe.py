"""Byte-level BPE encoding and decoding by rank files, without regex (operator 4).

Pre-tokenisation: every code point becomes a symbol (letter, number, white space, ...; what the pattern looks ahead for
is part of the symbol), every symbol a transition function over the few states a token can be in. Composition is
associative, so the states before all code points of a batch come from a blocked scan over function numbers: totals
of blocks, a scan of the totals, then the states inside all blocks side by side. State and symbol tell the token starts.

The slices between starts are encoded once while the cache holds them. Merging works on all new slices of one length at
once: in each round every row merges its leftmost pair of least rank.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, table
from .words import ranges, slices

#: White space of the pattern (Unicode White_Space).
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

# symbols; FIRST is added for the first code point of a text
LETTER, NUMBER, OTHER, APOS2, APOS3, SPACE_MID, SPACE_LAST, BLANK_LAST = range(8)
FIRST = 8
# states before a code point
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8

BLOCK = 256
#: Pieces whose ids a process keeps; bytes of text that are worked on at once.
CACHE_PIECES, SLICE = 150_000, 1 << 20
#: Pieces over so many bytes are merged one by one; of those only ones up to so many bytes are kept.
LONG_PIECE, LONGEST_CACHED = 256, 512


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if symbol >= FIRST:
        return _step(symbol - FIRST, FRESH)[0], True
    if symbol == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (FRESH if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol in (OTHER, APOS2, APOS3):
        if symbol == OTHER or state in (IN_OTHER, AFTER_BLANK):
            return IN_OTHER, state not in (IN_OTHER, AFTER_BLANK)
        return (ONE_LEFT if symbol == APOS2 else TWO_LEFT), True
    if symbol == SPACE_MID:
        return IN_SPACE, state != IN_SPACE
    return (FRESH if symbol == SPACE_LAST else AFTER_BLANK), True


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function number of each symbol, composition of function numbers, state after each (function, state), state after each (symbol, state), starts."""
    symbols = range(2 * FIRST)
    functions = [tuple(range(STATES))]
    number = {functions[0]: 0}
    generators = [tuple(_step(x, s)[0] for s in range(STATES)) for x in symbols]
    for f in functions:  # grows while it is walked
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    assert len(functions) <= 256
    return (np.array([number[g] for g in generators], np.uint8), compose, np.array(functions, np.uint8), np.array(generators, np.uint8), np.array([[_step(x, s)[1] for s in range(STATES)] for x in symbols]))


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_MID of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k is not None:
            out[c] = k
    out[WHITE] = SPACE_MID
    return out


def scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Exclusive prefix composition of function numbers."""
    n = len(functions)
    if n <= BLOCK:
        out, now = np.zeros(n, np.uint8), 0
        for i in range(n):
            out[i] = now
            now = compose[now, functions[i]]
        return out
    rows = -(-n // BLOCK)
    cut = np.zeros(rows * BLOCK, np.uint8)  # 0 is the identity
    cut[:n] = functions
    cut = np.ascontiguousarray(cut.reshape(rows, BLOCK).T)
    total = np.zeros(rows, np.uint8)
    for column in cut:
        total = compose[total, column]
    now = scan(total, compose)
    out = np.empty_like(cut)
    for i, column in enumerate(cut):
        out[i] = now
        now = compose[now, column]
    return out.T.reshape(-1)[:n]


def symbols_of(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbols of the code points of texts laid end to end; firsts: where each (not empty) text starts."""
    n = len(points)
    out = classes()[points]
    last = np.zeros(n, bool)
    last[np.append(firsts[1:], n) - 1] = True
    white = out == SPACE_MID
    before_word = white & ~np.append(white[1:], True) & ~last
    out[before_word] = np.where(points[before_word] == 0x20, BLANK_LAST, SPACE_LAST)
    for i in np.flatnonzero(points == 0x27):
        if last[i]:
            continue
        one = chr(points[i + 1])
        if one in SHORT:
            out[i] = APOS2
        elif not last[i + 1] and one + chr(points[i + 2]) in LONG:
            out[i] = APOS3
    out[firsts] += FIRST
    return out


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start."""
    number, compose, functions, _, starts = machine()
    symbols = symbols_of(points, firsts)
    state = functions[scan(number[symbols], compose), FRESH]
    return np.flatnonzero(starts[symbols, state])


class Bpe:
    """Ranks of a vocabulary file, with caches."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        words = sorted(self.ranks.items(), key=lambda x: x[1])
        assert [r for _, r in words] == list(range(len(words)))
        self.size = np.array([len(w) for w, _ in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(w for w, _ in words), np.uint8)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((self.ranks[w[:i]] << 32 | self.ranks[w[i:]], r) for w, r in words for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks)
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        self.cache: dict[bytes, np.ndarray] = {}

    @cached_property
    def pair_of(self) -> dict[int, int]:
        return dict(zip(self.pair.tolist(), self.pair_rank.tolist(), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces of one length."""
        none = np.iinfo(np.int64).max
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)]
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if not ids.shape[1] > 1:
                best = np.full(len(rows), none)
            else:
                at = ranks.argmin(axis=1)  # the leftmost of the least
                best = ranks[np.arange(len(rows)), at]
            done = best == none
            for r, x in zip(rows[done], ids[done].astype(np.uint32), strict=True):
                out[r] = x
            if done.all():
                break
            go = ~done
            rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            n, k = ids.shape
            own = np.arange(n)
            ids[own, at] = best
            column = np.arange(k - 1)
            ids = np.take_along_axis(ids, column[None, :] + (column[None, :] > at[:, None]), axis=1)
            if k == 2:
                ranks = np.zeros((n, 0), np.int64)
                continue
            column = np.arange(k - 2)
            ranks = np.take_along_axis(ranks, column[None, :] + (column[None, :] >= at[:, None]), axis=1)
            left, right = at > 0, at < k - 2
            ranks[own[left], at[left] - 1] = self.rank(ids[own[left], at[left] - 1], best[left])
            ranks[own[right], at[right]] = self.rank(best[right], ids[own[right], at[right] + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece: a heap of pairs over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pair_of
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := pairs.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        cache = self.cache
        found = [cache.get(p) for p in pieces]
        todo = [i for i, x in enumerate(found) if x is None]
        if todo and len(cache) + len(todo) > CACHE_PIECES:
            cache.clear()
        by_size: dict[int, list[int]] = {}
        for i in todo:
            p = pieces[i]
            r = self.ranks.get(p)
            if r is not None:
                found[i] = cache[p] = np.array([r], np.uint32)
            elif len(p) > LONG_PIECE:
                found[i] = self.merge_long(p)
                if len(p) <= LONGEST_CACHED:
                    cache[p] = found[i]
            else:
                by_size.setdefault(len(p), []).append(i)
        for own in by_size.values():
            for i, x in zip(own, self.merge_many([pieces[i] for i in own]), strict=True):
                found[i] = cache[pieces[i]] = x
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's start (one more: the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        raw = pa.concat_arrays([texts.cast(pa.large_binary())])
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        n = int(begin[-1])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = b"".join(raw.to_pylist())
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        starts = token_starts(points, begin[:-1][sizes > 0])
        bytes_at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
        offsets = np.append(bytes_at[starts], bytes_at[-1])
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self.pieces(cut.dictionary.to_pylist())
        count = np.array([len(x) for x in found], np.int64)
        at = np.concatenate([[0], np.cumsum(count)])
        codes = cut.indices.to_numpy(zero_copy_only=False)
        lengths = count[codes]
        ids = np.concatenate(found)[ranges(at[codes], lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, begin)]

    def ends(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where each id's bytes end, counted from its text's start."""
        to = np.concatenate([[0], np.cumsum(self.size[ids])])
        return to[1:] - np.repeat(to[starts[:-1]], np.diff(starts))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.at[ids], self.size[ids])]


@lru_cache(1)
def shared(path: str) -> Bpe:
    """One for all tasks of a process."""
    return Bpe(path)


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id, text as doc_id, ids, ends (both little-endian unsigned 32 bit)."""
    bpe = shared(path)
    for b in slices(batches, size=SLICE):
        ids, starts = bpe.batch(b["text"])
        yield pa.RecordBatch.from_arrays([b["doc_id"], _binary(ids.astype("<u4"), starts), _binary(bpe.ends(ids, starts).astype("<u4"), starts)], ["doc_id", "ids", "ends"])


def decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id, ids, ends with the decoded bytes in `decoded`; ends that the ids do not lead to raise an error."""
    bpe = shared(path)
    for b in batches:
        ids, ends = (np.frombuffer(b"".join(b[c].to_pylist()), "<u4") for c in ("ids", "ends"))
        starts = np.concatenate([[0], np.cumsum(pc.binary_length(b["ids"]).to_numpy() // 4)]).astype(np.int64)
        if (bpe.ends(ids, starts) != ends).any():
            raise ValueError("ids and offsets disagree")
        to = np.concatenate([[0], np.cumsum(bpe.size[ids])])
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["ids"], b["ends"], _binary(bpe.decode(ids), to[starts])], ["doc_id", "ids", "ends", "decoded"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, ids, ends. A null text is an empty text and has no ids; nothing is shuffled."""
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: encoded(it, path), "doc_id long, ids binary, ends binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """encode()'s rows with the bytes that the ids stand for."""
    return coded.select("doc_id", "ids", "ends").mapInArrow(lambda it: decoded(it, path), "doc_id long, ids binary, ends binary, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also the ids."""
    own = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches):
        from hashlib import sha256

        for b in decoded(encoded(batches, path), path):
            ids, text = ([sha256(x.as_buffer()).hexdigest() for x in b[c]] for c in ("ids", "decoded"))
            made = [b["doc_id"], pa.array(pc.binary_length(b["ids"]).to_numpy().astype(np.int64) // 4), pa.array(ids, pa.string()), pa.array(text, pa.string()), b["ids"]]
            yield pa.RecordBatch.from_arrays(made[: len(own)], own)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
