"""Resampling towards a target distribution by hashed n-gram importance weights (operator 12), in two Arrow passes.

First pass: every task counts the buckets of its features (np.bincount) into one vector of BUCKETS longs; a tree of reduces merges the vectors, so
the driver meets a few of them, however many tasks there are. From the two vectors (all documents, the target) follows a gain for each bucket: a
table of fixed size, which is broadcast. Second pass: every task gathers its features' gains and sums them by document.

The draw is by a Gumbel key on top of the weight, so the highest scores are a weighted sample without replacement. Ranks over all rows come from range
partitions: a row's place in its part plus the rows of the parts before it; no window goes over the table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, materialise, table
from .words import lowered, ranges, slices

BUCKETS = 10_000
#: Levels of the tree that merges the vectors: with p tasks about p^(1 / DEPTH) vectors come to the driver.
DEPTH = 3
#: 0-9, a-z and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def alnum_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the texts with A-Z lower-cased, as bytes, and where each text's words start (one more: the end)."""
    low = lowered(texts)
    offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(low) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    first[heads] = inside[heads]  # a text's first byte begins a word, whatever the text before it ends in
    starts = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(inside)]).astype(np.int64)
    cuts = np.concatenate([before[starts], before[-1:]])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    return words, np.searchsorted(starts, offsets)


def features(texts: pa.Array, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of every run of 1 to max_words words (space-joined, repeats counted), and each text's number of words."""
    words, starts = alnum_words(texts)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found, whose, runs = [], [], words
    for n in range(1, max_words + 1):
        if n > 1:
            at = ranges(starts[:-1], np.maximum(sizes - n + 1, 0))
            last = np.full(len(words), -1)
            last[own_at] = np.arange(len(own_at))
            runs = pc.binary_join_element_wise(runs.take(pa.array(last[at])), words.take(pa.array(at + n - 1)), pa.scalar(b" ", pa.large_binary())) if len(at) else words.slice(0, 0)
            own_at = at
        else:
            own_at = np.arange(len(words))
        coded = runs.dictionary_encode()
        value = np.fromiter((zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        found.append(value[coded.indices.to_numpy(zero_copy_only=False)] if len(value) else np.zeros(0, np.int64))
        whose.append(owner[own_at])
    return np.concatenate(found), np.concatenate(whose), sizes


def bucket_counts(texts: DataFrame, max_words: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all rows fall into each bucket. Null texts have none; no rows give zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches):
            total += np.bincount(features(b["text"], max_words, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    rows = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vectors = rows.mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    merged = vectors.mapPartitions(lambda it: [reduce(np.add, it, np.zeros(buckets, np.int64))])
    return merged.treeReduce(np.add, DEPTH) if merged.getNumPartitions() else np.zeros(buckets, np.int64)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the target's and the corpus's smoothed shares) of each bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in pairs], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, max_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains, long) of every row; a text without a word weighs 0."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains.astype(np.float64)), len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bucket, owner, sizes = features(b["text"], max_words, buckets)
            # sums of whole numbers stay exact in doubles
            weight = np.bincount(owner, weights=shared.value[bucket], minlength=len(b)).astype(np.int64)
            columns = [b["doc_id"], pa.array(sizes.astype(np.int64)), pa.array(np.bincount(owner, minlength=len(b)).astype(np.int64)), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(docs, id_col, text_col).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order, name: str = "ranked") -> DataFrame:
    """rows with their place (`place`, from 1) in the given order, which must be total enough for range partitions to split ties.

    The rows are written in order; monotonically_increasing_id tells a row's part and its place there. The rows of each part, a row of two longs a
    part, are summed up and joined back.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    out = materialise(sorted_rows, name)
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in out.groupBy(part.alias("part")).count().withColumnRenamed("count", "n").collect())
    before = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    base = out.sparkSession.createDataFrame(list(before.items()), "__part long, __before long")
    placed = out.join(F.broadcast(base), part == F.col("__part"))
    return placed.select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, max_words: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank.

    Of the N rows with at least least_words words, floor(percent * N / 100) are drawn: those of the highest scores, ties to the smaller doc_id (null
    last; of equal rows any). rank counts them from 1; it is null for all others. Null texts have no words; a null doc_id is the
    empty string in its key. Without rows there is no rank; an empty target has no features. Other columns of docs are left behind.
    """
    gains = bucket_gains(bucket_counts(docs, max_words, buckets, text_col), bucket_counts(target, max_words, buckets, text_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = importance_weights(docs, gains, max_words, id_col, text_col)
    # `row` splits ties of equal rows over parts; it is fixed once written
    scored = materialise(weighed.select("*", (F.col("weight") + noise).cast("long").alias("score"), F.monotonically_increasing_id().alias("row")), "weights")
    may, out = F.col("n_words") >= least_words, ("doc_id", "n_features", "weight", "score")
    drawn = percent * scored.where(may).count() // 100
    places = ranked(scored.where(may).select(*out, "row"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    return places.select(*out, rank.alias("rank")).unionByName(scored.where(~may).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: a tenth of those with 20 words, drawn towards the texts of `benchmark`."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
