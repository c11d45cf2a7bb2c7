"""Language-model scores by deleted interpolation (operator 6).

The model mixes the maximum-likelihood estimates of a word after its two predecessors, after its predecessor alone, of the
word alone and of any word at all. The weights depend on buckets of the contexts' frequencies (powers of two) and are learned by
expectation-maximisation on held-out counts: each training token in turn is held out, so its estimates are taken from counts
from which its own occurrence is deleted. The three lower estimates are mixed first; the trigram's estimate is then mixed with that.

Counts are exact and cover all training documents. No token is shuffled: a block of documents (a slice of what a task
reads) asks for the counts of its distinct n-grams and adds what it has itself seen of them. Requests travel in two steps,
so that their number stays far under blocks x buckets: a block writes one request for each range of hashes (as many
ranges as the root of the number of buckets); a group of blocks merges the requests of a range, with their counts
summed, and asks the range's buckets; the sums go back the same way. Buckets, ranges and groups follow the size of the
corpus, so what a task holds does not grow with it. Words and pairs, then trigrams, travel in two trips each, to have less on
disk at once. N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_and_text, materialise, table
from .words import codes_of, lowered, slices, words_of

#: Characters of text in a block, about; and of all texts for each bucket of hashes.
BLOCK_BYTES, BUCKET_CHARS = 8 << 20, 16_000_000
#: The bucket of a context's frequency c is the number of its binary digits, up to this one.
TOP_BUCKET = 24
#: The held-out counts are gathered by context bucket and by the estimates' ratios in steps of 1/STEPS octave, up to OCTAVES.
STEPS, OCTAVES = 4, 40
RATIOS = STEPS * OCTAVES + 1
ROUNDS = 200


def _hash(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text)


#: No word has a space in it.
END, START = " ", "  "


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    out = before * np.uint64(0x9E3779B97F4A7C15) + word
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed: the bytes of each place of the numbers side by side."""
    codec = pa.Codec("zstd")
    out = [struct.pack("<i", len(arrays))]
    for x in arrays:
        raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""
        body = codec.compress(raw, asbytes=True) if raw else b""
        out += [struct.pack("<4sqq", x.dtype.str[1:].encode(), len(x), len(body)), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    n, at, out = struct.unpack_from("<i", data)[0], 4, []
    for _ in range(n):
        kind, size, length = struct.unpack_from("<4sqq", data, at)
        at += 20
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        if size:
            raw = codec.decompress(data[at : at + length], size * dtype.itemsize, asbytes=True)
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, size).T).view(dtype).ravel())
        else:
            out.append(np.zeros(0, dtype))
        at += length
    return out


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct tokens of some texts, the tokens as places in them, and where each text's start (one more: the end).

    Each text closes with the end token.
    """
    from xxhash import xxh64_intdigest

    words, starts = words_of(lowered(texts))
    code, distinct = codes_of(words)
    h = np.array([xxh64_intdigest(w) for w in distinct.to_pylist()] + [_hash(END.encode())], np.uint64)
    known, place = np.unique(h, return_inverse=True)
    n = len(starts) - 1
    out = np.full(len(code) + n, place[-1], np.int64)
    at = starts + np.arange(n + 1)
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner] = place[code]
    return known, out, at


def pairs_of(known: np.ndarray, token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each token after the one before it."""
    h = known[token]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = _hash(START.encode())
    return pair_hash(before, h)


def _blocks(batches: Iterator[pa.RecordBatch], size: int):
    """Batches of doc_id, text, held as blocks (block, data): distinct words and the documents' tokens."""
    for b in slices(batches, size=size):
        known, token, at = tokens_of(b["text"])
        held = b["held"].to_numpy(zero_copy_only=False).astype(np.uint8)
        null = np.asarray(b["doc_id"].is_null()).astype(np.uint8)
        doc = pc.fill_null(b["doc_id"], 0).to_numpy(zero_copy_only=False)
        data = pack(doc, null, held, at, token.astype(np.uint32), np.diff(known, prepend=np.uint64(0)))
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([data], pa.binary())], ["block", "data"])


class Routes:
    """How n-grams and blocks are dealt: hashes to buckets, buckets to ranges, blocks to groups; a part is a group's share of a range."""

    def __init__(self, size: int):
        buckets = max(12, -(-size // BUCKET_CHARS))
        self.ranges = math.isqrt(buckets - 1) + 1
        self.each = -(-buckets // self.ranges)
        self.groups, self.buckets = self.each, self.ranges * self.each
        self.parts = self.ranges * self.groups

    def cuts(self, keys: np.ndarray, first: int, last: int, of_ranges: bool) -> np.ndarray:
        """Where the buckets (or ranges) first, ..., last - 1 begin in sorted keys, and where the last one ends."""
        n = self.ranges if of_ranges else self.buckets
        return np.searchsorted((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(first, last + 1))

    def part(self, block: str, range_: int) -> int:
        return range_ * self.groups + int(block[:8], 16) % self.groups


def _rows(schema: str, *columns: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows sorted by key, group by group; a group is streamed, so it must be used up before the next one."""
    return groupby((r for b in batches for r in b.to_pylist()), itemgetter(key))


#: Trips of the exchange: which orders of n-grams (0: words, 1: pairs, 2: trigrams), and which share of their hashes. What is on disk at once is a trip's.
TRIPS = [((0, 1), 0), ((0, 1), 1), ((2,), 0), ((2,), 1)]
SHARES = 2


class _Block:
    """A block's documents, tokens and n-grams."""

    def __init__(self, data: bytes):
        self.doc, self.null, self.held, self.at, token, known = unpack(data)
        self.token, known = token.astype(np.int64), np.cumsum(known, dtype=np.uint64)
        self.words = known & ~np.uint64(1)  # an even key is a word's, an odd one a pair's
        self.train = np.repeat(self.held == 0, np.diff(self.at))
        self.pair = pairs_of(known, self.token, self.at)
        self.hash = known[self.token]
        self.known: dict[int, tuple] = {}

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | slice]:
        """The distinct n-grams' sorted keys, and the number among them of each token of a choice. The first trigram of a document is its first pair, so it has none."""
        if order not in self.known:
            if order == 0:
                self.known[0] = self.words, self.token, slice(None)
            elif order == 1:
                self.known[1] = *np.unique(self.pair | np.uint64(1), return_inverse=True), slice(None)
            else:
                inner = np.ones(len(self.pair), bool)
                inner[self.at[:-1]] = False
                at = np.flatnonzero(inner)
                self.known[2] = *np.unique(pair_hash(self.pair[at - 1], self.hash[at]), return_inverse=True), at
        return self.known[order]

    def keys(self, orders: tuple[int, ...], share: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """A trip's sorted keys; for each order the n-grams of the share, and their places in these."""
        own = [np.flatnonzero((self.grams(o)[0] >> np.uint64(1)) % np.uint64(SHARES) == share) for o in orders]
        keys = np.concatenate([self.grams(o)[0][x] for o, x in zip(orders, own, strict=True)])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return keys[order], list(zip(orders, own, np.split(place, np.cumsum([len(x) for x in own])[:-1]), strict=True))

    def asked(self, orders: tuple[int, ...], share: int) -> tuple[np.ndarray, np.ndarray]:
        """A trip's sorted keys, and the training tokens' counts of them."""
        keys, parts = self.keys(orders, share)
        seen = np.zeros(len(keys), np.int64)
        for o, own, place in parts:
            known, number, at = self.grams(o)
            seen[place] = np.bincount(number[self.train[at]], minlength=len(known))[own]
        return keys, seen

    def counted(self, totals: dict[int, np.ndarray]) -> bytes:
        """The documents and, for each token, the training counts of itself, its pair and its trigram. totals: of each trip's keys."""
        counts = [np.zeros(len(self.grams(o)[0]), np.int64) for o in range(3)]
        for k, (orders, share) in enumerate(TRIPS):
            for o, own, place in self.keys(orders, share)[1]:
                counts[o][own] = totals[k][place] if len(place) else 0
        word, pair = (counts[o][self.grams(o)[1]] for o in (0, 1))
        triple = pair.copy()
        triple[self.grams(2)[2]] = counts[2][self.grams(2)[1]]
        return pack(self.doc, self.null, self.held, self.at, *map(_small, (word, pair, triple)))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x


def _asks(routes: Routes, trip: tuple[tuple[int, ...], int]):
    """Blocks to their requests (part, block, data): for each range the sorted keys and the training tokens' counts of them."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for block, data in zip(b["block"].to_pylist(), b["data"], strict=True):
                keys, seen = _Block(data.as_py()).asked(*trip)
                at = routes.cuts(keys, 0, routes.ranges, True)
                rows = [(routes.part(block, r), pack(np.diff(keys[i:j], prepend=np.uint64(0)), _small(seen[i:j]))) for r, (i, j) in enumerate(pairwise(at)) if j > i]
                yield _rows("part int, block string, data binary", [x for x, _ in rows], [block] * len(rows), [x for _, x in rows])

    return run


def _merged(routes: Routes):
    """Requests sorted by part: a row for each bucket of a part (keys and sums), and one for each block (its keys' places in the part)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part, own in _grouped(batches, "part"):
            blocks, keys, seen = zip(*((r["block"], np.cumsum((x := unpack(r["data"]))[0], dtype=np.uint64), x[1]) for r in own), strict=True)
            known, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate(seen)).astype(np.int64)
            first = part // routes.groups * routes.each
            at = routes.cuts(known, first, first + routes.each, False)
            rows = [(first + k, None, pack(np.diff(known[i:j], prepend=np.uint64(0)), _small(total[i:j]))) for k, (i, j) in enumerate(pairwise(at)) if j > i]
            for block, x in zip(blocks, np.split(place, np.cumsum([len(x) for x in keys])[:-1]), strict=True):
                rows.append((None, block, pack(np.diff(x, prepend=0).astype(np.uint32))))
            buckets, names, data = map(list, zip(*rows, strict=True))
            yield _rows(_MERGED, [part] * len(rows), buckets, names, data)

    return run


_MERGED = "part int, bucket int, block string, data binary"


def _sums(batches: Iterator[pa.RecordBatch]):
    """Rows of buckets, sorted by bucket: for each part what all parts have, and a row without a part: v distinct words and n training tokens."""
    for bucket, own in _grouped(batches, "bucket"):
        parts, keys, seen = zip(*((r["part"], np.cumsum((x := unpack(r["data"]))[0], dtype=np.uint64), x[1]) for r in own), strict=True)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(seen)).astype(np.int64)
        words = total[known & np.uint64(1) == 0]
        data = [pack(_small(total[x])) for x in np.split(place, np.cumsum([len(x) for x in keys])[:-1])]
        k = len(parts)
        yield _rows(f"{_MERGED}, v long, n long", [*parts, None], [bucket] * (k + 1), [None] * (k + 1), [*data, None], [None] * k + [int((words > 0).sum())], [None] * k + [int(words.sum())])


def _returned(trip: int):
    """Sums of a part by bucket, then its blocks' places: (block, trip, part, data), the counts of the block's keys in the part's range."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part, own in _grouped(batches, "part"):
            sums, whole = [], None
            for r in own:
                if r["block"] is None:
                    sums.append(unpack(r["data"])[0].astype(np.int64))
                    continue
                whole = np.concatenate(sums) if whole is None else whole
                yield _rows(_BACK, [r["block"]], [trip], [part], [pack(_small(whole[np.cumsum(unpack(r["data"])[0], dtype=np.int64)]))])

    return run


_BACK = "block string, trip int, part int, data binary"


def _counted(batches: Iterator[pa.RecordBatch]):
    """A block (trip -1) and the counts that came back to it, sorted by block, trip and part: the block's counts."""
    for _, own in _grouped(batches, "block"):
        one = _Block(next(own)["data"])
        totals = {k: [np.zeros(0, np.int64)] for k in range(len(TRIPS))}
        for r in own:
            totals[r["trip"]].append(unpack(r["data"])[0].astype(np.int64))
        yield _rows("data binary", [one.counted({k: np.concatenate(x) for k, x in totals.items()})])


def exchanged(blocks: DataFrame, routes: Routes) -> tuple[DataFrame, int, int]:
    """The blocks' counts, and the distinct and all training tokens."""
    v = n = 0
    back = []
    for k, trip in enumerate(TRIPS):
        asked = blocks.mapInArrow(_asks(routes, trip), "part int, block string, data binary")
        asked = asked.repartitionById(routes.parts, F.col("part")).sortWithinPartitions("part", "block")
        merged = materialise(asked.mapInArrow(_merged(routes), _MERGED), "lm-merged")
        sums = merged.where("bucket is not null").repartitionById(routes.buckets, F.col("bucket")).sortWithinPartitions("bucket", "part").mapInArrow(_sums, f"{_MERGED}, v long, n long")
        sums = materialise(sums, "lm-sums")
        if 0 in trip[0]:
            more = sums.where("part is null").agg(F.sum("v"), F.sum("n")).first()
            v, n = v + (more[0] or 0), n + (more[1] or 0)
        both = merged.where("block is not null").unionByName(sums.where("part is not null").select(*merged.columns))
        both = both.repartitionById(routes.parts, F.col("part")).sortWithinPartitions("part", F.col("block").asc_nulls_first(), "bucket")
        back.append(materialise(both.mapInArrow(_returned(k), _BACK), "lm-back"))
        discard(merged, sums)
    own = blocks.select("block", F.lit(-1).alias("trip"), F.lit(-1).alias("part"), "data")
    every, packs = reduce(DataFrame.unionByName, back, own), []
    for half in range(2):  # what is shuffled at once is half of the blocks
        mine = every.where(F.crc32(F.col("block").cast("binary")) % 2 == half)
        packs.append(materialise(mine.repartition(routes.buckets, "block").sortWithinPartitions("block", "trip", "part").mapInArrow(_counted, "data binary"), "lm-counts"))
    discard(blocks, *back)
    return reduce(DataFrame.unionByName, packs), v, n


def _counts(batches: Iterator[pa.RecordBatch], docs_in_training: int):
    """Each block's documents and, for each token, the training counts of its two words' context, its one word's, itself, its pair and its trigram."""
    for b in batches:
        for x in b["data"]:
            doc, null, held, at, *counts = unpack(x.as_py())
            word, pair, triple = (c.astype(np.int64) for c in counts)
            contexts = []
            for c in (pair, word):
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[at[:-1]] = docs_in_training
                contexts.append(before)
            yield doc, null, held, at, *contexts, word, pair, triple


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(c, 0) + 1)).astype(np.int64), TOP_BUCKET)


def _ratio_step(p: np.ndarray, base: float | np.ndarray) -> np.ndarray:
    """0 for no chance, else 1 + the step of p / base, from -OCTAVES / 2 octaves on."""
    with np.errstate(divide="ignore"):
        step = np.round(STEPS * (np.log2(p / base) + OCTAVES / 2))
    return np.where(p > 0, 1 + np.clip(step, 0, RATIOS - 1), 0).astype(np.int64)


def _lower(weights: np.ndarray, c_context: np.ndarray, c_pair: np.ndarray, c_word: np.ndarray, n: int, v: int) -> np.ndarray:
    """The mix of the pair's, the word's and any word's estimate."""
    w = weights[context_bucket(c_context)]
    return w[:, 0] * np.where(c_context > 0, c_pair / np.maximum(c_context, 1), 0) + w[:, 1] * c_word / max(n, 1) + w[:, 2] / (v + 1)


def held_out_counts(packs: DataFrame, n: int, v: int, docs_in_training: int, weights: np.ndarray | None = None) -> DataFrame:
    """(cell, n): how many training tokens, each deleted from the counts, fall into each cell.

    Without weights a cell is (context bucket, step of the pair's estimate, step of the word's); with the lower estimates' weights it is
    (bucket of the two words' context, step of the trigram's estimate over the lower mix).
    """

    def run(batches):
        for _, _, held, at, c_two, c_context, c_word, c_pair, c_triple in _counts(batches, docs_in_training):
            train = np.repeat(held == 0, np.diff(at))
            two, h, w, hw, triple = (c[train] - 1 for c in (c_two, c_context, c_word, c_pair, c_triple))
            base = 1 / (v + 1)
            if weights is None:
                pair = _ratio_step(np.where(h > 0, hw / np.maximum(h, 1), 0), base)
                word = _ratio_step(w / max(n - 1, 1), base)
                cell = (context_bucket(h) * (RATIOS + 1) + pair) * (RATIOS + 1) + word
            else:
                lower = _lower(weights, h, hw, w, n - 1, v)
                cell = context_bucket(two) * (RATIOS + 1) + _ratio_step(np.where(two > 0, triple / np.maximum(two, 1), 0), lower)
            cell, count = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], ["cell", "n"])

    return packs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _maximised(chance: np.ndarray, counts: np.ndarray, bucket: np.ndarray, empty: tuple) -> np.ndarray:
    """Expectation-maximisation of the weights of the estimates (rows of chance) in each context bucket; buckets without counts take the next lower one's."""
    out = np.zeros((TOP_BUCKET + 1, len(chance)))
    for k in range(TOP_BUCKET + 1):
        own = bucket == k
        if not own.any():
            out[k] = out[k - 1] if k else empty
            continue
        p, c = chance[:, own], counts[own]
        w = np.full(len(chance), 1 / len(chance))
        for _ in range(ROUNDS):
            part = w[:, None] * p
            new = (part / part.sum(axis=0) * c).sum(axis=1) / c.sum()
            done = np.abs(new - w).max() < 1e-7
            w = new
            if done:
                break
        out[k] = w
    return out


def _chance(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** ((step - 1) / STEPS - OCTAVES / 2), 0)


def learn_weights(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weights (pair, word, any word) of each bucket of the context."""
    chance = np.stack([_chance(cells // (RATIOS + 1) % (RATIOS + 1)), _chance(cells % (RATIOS + 1)), np.ones(len(cells))])
    return _maximised(chance, counts, cells // (RATIOS + 1) ** 2, (0, 0.5, 0.5))


def learn_top(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weights (trigram, lower mix) of each bucket of the two words' context."""
    return _maximised(np.stack([_chance(cells % (RATIOS + 1)), np.ones(len(cells))]), counts, cells // (RATIOS + 1), (0, 1))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod folds is not 0, score all: one row for each row of docs.

    doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score, score (log10). A null text is an
    empty text, whose only token is the end. Rows with a null doc_id are training rows. Without training rows every
    token is as likely as any other and scores 0.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False)).alias("held")
    data = id_and_text(docs, id_col, text_col, held)
    size = data.agg(F.sum(F.length("text")), F.count_if(~F.col("held"))).first()
    routes, in_training, block_bytes = Routes(size[0] or 0), size[1], BLOCK_BYTES
    blocks = materialise(data.mapInArrow(lambda it: _blocks(it, block_bytes), "block string, data binary"), "lm-blocks")
    packs, v, n = exchanged(blocks, routes)
    cells = held_out_counts(packs, n, v, in_training).toArrow()
    weights = learn_weights(cells["cell"].to_numpy(), cells["n"].to_numpy())
    cells = held_out_counts(packs, n, v, in_training, weights).toArrow()
    top = learn_top(cells["cell"].to_numpy(), cells["n"].to_numpy())

    def score(batches):
        for doc, null, held, at, c_two, c_context, c_word, c_pair, c_triple in _counts(batches, in_training):
            mix = np.where((c_two > 0)[:, None], top[context_bucket(c_two)], [[0.0, 1.0]])
            p = mix[:, 0] * c_triple / np.maximum(c_two, 1) + mix[:, 1] * _lower(weights, c_context, c_pair, c_word, n, v)
            if not n:
                p = np.ones(len(c_word))
            base = np.log10((c_word + 0.1) / (n + 0.1 * (v + 1)))
            first = at[:-1]
            sums = [np.add.reduceat(x, first) for x in (np.log10(p), base, (c_word > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(np.diff(at)), pa.array(sums[2]), pa.array(np.full(len(doc), n, np.int64)), pa.array(sums[1]), pa.array(sums[0])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return packs.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return lm_scores(table(spark, sf_dir, "documents"))
