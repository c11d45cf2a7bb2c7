"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores them (operator 9).

Words are compared in lower case and without ASCII punctuation around them. The items are a stated query set: they are taken
in blocks of bounded size, each block's seeds and words go to all tasks, and every document is searched whole where it
is read, so no text is shuffled. A first pass counts, for every seed, the documents that hold it; each item then
searches with its rarest seeds (a share of its own seeds, not a fixed frequency, so an item that leaked into a third of all documents
is still found). A hit proposes a window of the document, and local alignment scores the window against the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, materialise, table
from .words import plain_words, ranges, seeds_of, slices

SEED_WORDS = 3
#: An item searches with this share of its seeds, the rarest ones, and with at least so many.
SEED_SHARE, LEAST_SEEDS = 0.75, 12
MATCH, MISMATCH, GAP = 2, 1, 1
#: A passage is a copy of an item from this share of the item's score with itself.
MIN_SCORE = 0.5
#: Words of the items of one block.
BLOCK_WORDS = 1_000_000
#: Cells of the alignments that are worked on side by side.
CELLS = 1 << 21


class SeedSet:
    """Sorted seeds behind a bit map."""

    BITS = 22

    def __init__(self, seeds: np.ndarray):
        self.seeds = np.unique(seeds)
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[self.seeds >> np.uint64(64 - self.BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of hashes are seeds, and the seeds' numbers."""
        at = np.flatnonzero(self.map[hashes >> np.uint64(64 - self.BITS)])
        if not len(at) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.seeds, hashes[at]), len(self.seeds) - 1)
        hit = self.seeds[number] == hashes[at]
        return at[hit], number[hit]


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of rows of a (passages) with rows of b (items), padded with 0 and 1: the best scores, and where in the passages they end.

    A row's leftward gaps are a running maximum, so each item word is one vector step over all pairs.
    """
    n, w = a.shape
    above = np.zeros((n, w + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = GAP * np.arange(w, dtype=np.int32)
    for i in range(b.shape[1]):
        now = above[:, :-1] + np.where(a == b[:, i : i + 1], MATCH, -MISMATCH).astype(np.int32)
        np.maximum(now, above[:, 1:] - GAP, out=now)
        np.maximum(now, 0, out=now)
        now += slope
        np.maximum.accumulate(now, axis=1, out=now)
        now -= slope
        above[:, 1:] = now
        at = now.argmax(axis=1)
        top = now[np.arange(n), at]
        more = top > best
        best[more], end[more] = top[more], at[more]
    return best, end


def _padded(words: np.ndarray, begin: np.ndarray, end: np.ndarray, fill: int, back: bool = False) -> np.ndarray:
    size = end - begin
    out = np.full((len(begin), int(size.max())), fill, np.uint64)
    for i, (x, y) in enumerate(zip(begin, end, strict=True)):
        out[i, : y - x] = words[x:y][::-1] if back else words[x:y]
    return out


def score_windows(words: np.ndarray, begin: np.ndarray, end: np.ndarray, item_words: np.ndarray, item_at: np.ndarray, item: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: the share of the item's own score, and where the aligned passage begins and ends (only for shares of `least` or more)."""
    n = len(begin)
    share, first, last = np.zeros(n), begin.copy(), begin.copy()
    size = item_at[item + 1] - item_at[item]
    order = np.lexsort((-size, begin - end))  # the longest window first, so it bounds what is padded to its length
    at = 0
    while at < n:
        cells = int((end - begin)[order[at]]) + 1
        step = max(1, CELLS // (4 * cells))
        own = order[at : at + step]
        at += step
        a, b = begin[own], end[own]
        x, y = item_at[item[own]], item_at[item[own] + 1]
        best, stop = align(_padded(words, a, b, 0), _padded(item_words, x, y, 1))
        share[own] = best / (MATCH * size[own])
        last[own] = a + stop + 1
        good = np.flatnonzero(share[own] >= least)
        if len(good):
            _, back = align(_padded(words, a[good], last[own][good], 0, True), _padded(item_words, x[good], y[good], 1, True))
            first[own[good]] = last[own[good]] - back - 1
    return share, first, last


def pieces_of(doc: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows sorted by doc, item and lo: overlapping ones of a document and item as one, and long ones cut into pieces.

    An alignment of a score over 0 spans three item lengths at most (a match is worth two gaps), so pieces of six lengths that overlap by
    three hold it whole. size: of each window's item.
    """
    new = np.ones(len(lo), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    far = (np.cumsum(new) - 1) * (int(hi.max(initial=0)) + 1)  # a running maximum that starts anew with each document and item
    reach = np.maximum.accumulate(hi + far) - far
    new[1:] |= lo[1:] > reach[:-1]
    head = np.flatnonzero(new)
    doc, item, lo, hi, size = doc[head], item[head], lo[head], np.maximum.reduceat(hi, head), size[head]
    step = 3 * size
    n = np.maximum(1, -(-(hi - lo) // step) - 1)
    own = np.repeat(np.arange(len(n)), n)
    begin = lo[own] + step[own] * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    return doc[own], item[own], begin, np.minimum(begin + 2 * step[own], hi[own])


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """item_ids, words and starts of the items, some BLOCK_WORDS words at a time; only a block is on the driver."""
    rows, n = [], 0
    data = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").distinct()

    def block():
        words, starts = plain_words(pa.array([r[1] for r in rows], pa.string()))
        return np.array([r[0] for r in rows], np.int64), words, starts

    for r in data.toLocalIterator():
        rows.append((r["id"], r["text"]))
        n += 1 + r["text"].count(" ")
        if n >= BLOCK_WORDS:
            yield block()
            rows, n = [], 0
    if rows:
        yield block()


def _searches(data: DataFrame, items: DataFrame, min_score: float, item_col: str, item_text_col: str, seed_share: float):
    """For each block of items (item ids, search); search(texts): document, item, share, first and end word (places in the texts laid end to end), and where texts start."""
    for k, (item_ids, item_words, item_at) in enumerate(_item_blocks(items, item_col, item_text_col)):
        hashes, where = seeds_of(item_words, item_at, SEED_WORDS)
        if not len(hashes):
            continue
        every = SeedSet(hashes)

        def count(batches, every=every):
            df = np.zeros(len(every.seeds), np.int64)
            for b in slices(batches):
                words, starts = plain_words(b["text"])
                h, place = seeds_of(words, starts, SEED_WORDS)
                at, number = every.find(h)
                doc = np.searchsorted(starts, place[at], side="right")
                df += np.bincount(np.unique(number * (len(b) + 1) + doc) // (len(b) + 1), minlength=len(df))
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["seed", "n"])

        rows = materialise(data.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")), f"seeds-{k}").toArrow()
        df = np.zeros(len(every.seeds), np.int64)
        df[rows["seed"].to_numpy()] = rows["n"].to_numpy()
        item = np.searchsorted(item_at, where, side="right") - 1
        frequency = df[np.searchsorted(every.seeds, hashes)]
        order = np.lexsort((where, frequency, item))
        rank = np.arange(len(order)) - np.repeat(*np.unique(item[order], return_index=True, return_counts=True)[1:])
        total = np.bincount(item, minlength=len(item_ids))[item[order]]
        rare = order[rank < np.maximum(LEAST_SEEDS, np.ceil(seed_share * total))]
        rare = rare[np.argsort(hashes[rare], kind="stable")]
        own = SeedSet(hashes[rare])
        seed_from = np.searchsorted(hashes[rare], own.seeds)  # a seed's items lie side by side
        seed_to = np.append(seed_from[1:], len(rare))
        seed_item, seed_place = item[rare], where[rare] - item_at[item[rare]]

        def search(texts, own=own, seed_from=seed_from, seed_to=seed_to, seed_item=seed_item, seed_place=seed_place, item_words=item_words, item_at=item_at):
            words, starts = plain_words(texts)
            h, place = seeds_of(words, starts, SEED_WORDS)
            at, number = own.find(h)
            if not len(at):
                none = np.zeros(0, np.int64)
                return none, none, np.zeros(0), none, none, starts
            n = seed_to[number] - seed_from[number]
            pick = ranges(seed_from[number], n)
            item, begin = seed_item[pick], np.repeat(place[at], n) - seed_place[pick]
            doc = np.searchsorted(starts, np.repeat(place[at], n), side="right") - 1
            size = item_at[item + 1] - item_at[item]
            slack = size // 3 + 2
            lo, hi = np.maximum(begin - slack, starts[doc]), np.minimum(begin + size + slack, starts[doc + 1])
            order = np.lexsort((lo, item, doc))
            doc, item, lo, hi = pieces_of(doc[order], item[order], lo[order], hi[order], size[order])
            share, first, last = score_windows(words, lo, hi, item_words, item_at, item, min_score)
            good = np.flatnonzero(share >= min_score)
            good = good[np.lexsort((first[good], -share[good], item[good], doc[good]))]
            keep = np.ones(len(good), bool)  # the best of a document and item
            keep[1:] = (doc[good][1:] != doc[good][:-1]) | (item[good][1:] != item[good][:-1])
            good = good[keep]
            return doc[good], item[good], share[good], first[good], last[good], starts

        yield item_ids, search


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_share: float = SEED_SHARE) -> DataFrame:
    """A row for each document and item of which it holds a copy: doc_id, item_id, score, first_word, end_word.

    score: the best local alignment's share of the item's score with itself (1: the item word for word); the aligned
    passage lies between the document's words (without punctuation) first_word and end_word, end exclusive. Null and
    empty texts hold nothing. Items without a text or an id, and items of fewer than SEED_WORDS words, which cannot be
    told from chance, are never found. Repeated documents have their own rows. seed_share: with which share of its seeds, the rarest, an item
    searches; with 1 no copy that has any seed is missed.
    """
    data = id_and_text(docs, id_col, text_col)
    out = None
    for item_ids, search in _searches(data, items, min_score, item_col, item_text_col, seed_share):

        def run(batches, item_ids=item_ids, search=search):
            for b in slices(batches):
                doc, item, share, first, last, starts = search(b["text"])
                if len(doc):
                    yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(doc)), pa.array(item_ids[item]), pa.array(share), pa.array(first - starts[doc]), pa.array(last - starts[doc])], ["doc_id", "item_id", "score", "first_word", "end_word"])

        found = data.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")


def drop_contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a copy of an item. All columns stay as they are.

    Each row is judged by its own text where it is read, so nothing is joined, and rows with a null or repeated doc_id are as any others.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = docs
    for _, search in _searches(texts, items, min_score, "item_id", "text", SEED_SHARE):

        def run(batches, search=search):
            for b in slices(batches, text_col):
                keep = np.ones(len(b), bool)
                keep[search(b[text_col])[0]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, first_word and end_word of every document and the items that it holds copies of."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
