"""Retrieval: hashed bag-of-words embeddings, cosine top-k, reciprocal rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EMBEDDING_DIMENSION, cosine, words

RRF_K = 60
MIN_SCORE = 0.15
#: Query vectors that go to all tasks at once, and rows that a task compares with them at once.
QUERY_BLOCK, ROWS = 1024, 2048


def hashed_vectors(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, bucket, weight): the non-zero dimensions of each text's embedding, of length 1. Texts without words have no rows.

    Words are cut in the row by native functions; a task gets them an Arrow batch at a time, looks up the bucket of each distinct word and counts the buckets of
    its rows. Nothing is shuffled.
    """
    rows = texts.select(F.col(key), words(F.col(text)).alias("__words"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.slice(at, ROWS)
                lists = b["__words"]
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                if not len(coded):
                    continue
                own = np.fromiter((int(hashlib.md5(w.encode()).hexdigest()[-3:], 16) % EMBEDDING_DIMENSION for w in coded.dictionary.to_pylist()), np.int64)
                cell, count = np.unique(np.repeat(np.arange(len(b)), sizes) * EMBEDDING_DIMENSION + own[coded.indices.to_numpy()], return_counts=True)
                row = cell // EMBEDDING_DIMENSION
                norm = np.sqrt(np.bincount(row, weights=count.astype(np.float64) ** 2, minlength=len(b)))
                yield pa.RecordBatch.from_arrays([b[key].take(pa.array(row)), pa.array((cell % EMBEDDING_DIMENSION).astype(np.int32)), pa.array(count / norm[row])], [key, "bucket", "weight"])

    return rows.mapInArrow(embed, rows.select(key, F.lit(0).alias("bucket"), F.lit(0.0).alias("weight")).schema)


def nearest(vectors: DataFrame, query: Column, k: int, key: str, vector: str, min_score: float | None = None) -> DataFrame:
    """The k rows of the greatest positive cosine with one query vector; what is under min_score goes after the cut, not before."""
    scored = vectors.select(key, cosine(F.col(vector).cast("array<double>"), query).alias("score")).where("score > 0")
    top = scored.orderBy(F.col("score").desc(), key).limit(k)
    return top if min_score is None else top.where(F.col("score") >= min_score)


def _query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of QUERY_BLOCK queries at a time; only a block is on the driver."""
    ids, own = [], []
    for r in queries.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).toLocalIterator():
        ids.append(r[0])
        own.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(own, np.float64)
            ids, own = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(own, np.float64)


def keep_best(best: list | None, queries: tuple[np.ndarray, np.ndarray] | None, own: np.ndarray, ids: np.ndarray, k: int) -> list:
    """best: (query number, id, score) of the k best so far (None: none). queries: numbers and vectors. The k best after rows own, ids; ties in the order of ids."""
    if best is None:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    number, q = queries
    for at in range(0, len(own) if len(q) else 0, ROWS):
        rows, names = own[at : at + ROWS], ids[at : at + ROWS]
        scale = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=1))[None, :]
        about = np.divide(q @ rows.T, scale, out=np.zeros_like(scale), where=scale > 0)
        least = np.partition(about, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(q), -1.0)
        i, j = np.nonzero((about >= least[:, None] - 1e-9) & (about > -1e-9))
        # equal vectors must have equal scores, so these are summed row by row
        score = np.concatenate([np.zeros(0), *((q[i[s : s + ROWS]] * rows[j[s : s + ROWS]]).sum(axis=1) for s in range(0, len(i), ROWS))])
        score = np.divide(score, scale[i, j], out=np.zeros(len(i)), where=scale[i, j] > 0)
        more = score > 0
        best = [np.concatenate(x) for x in zip(best, (number[i[more]], names[j[more]], score[more]), strict=True)]
        order = np.lexsort((best[1], -best[2], best[0]))
        best = [x[order] for x in best]
        head = np.searchsorted(best[0], best[0])
        best = [x[np.arange(len(head)) - head < k] for x in best]
    return best


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, min_score: float | None = None) -> DataFrame:
    """(query_id, place, key, score): for each row of queries (key, vector) what nearest() says, ties in the order of the key.

    Queries are taken in blocks; a task keeps the k best of each query, and a window over the query merges the tasks' ones.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    out = None
    for q_ids, q in _query_blocks(queries, key, vector):

        def search(batches, q_ids=q_ids, q=q):
            best, number = keep_best(None, None, None, None, k), np.arange(len(q))
            for b in batches:
                if len(b):
                    best = keep_best(best, (number, q), b["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1), b["id"].to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "id", "score"])

        found = rows.mapInArrow(search, "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    top = out.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", F.col("id").alias(key), "score")
    return top if min_score is None else top.where(F.col("score") >= min_score)


def fuse(lists: DataFrame, k: int | None = 5, by: list[str] | None = None, constant: int = RRF_K) -> DataFrame:
    """lists: list, rank, key and the columns of by, which tell apart searches that are fused at once.

    (by, key, score, first_list, first_rank), the k best of each search; ties in the order of first sight. k None: all.
    """
    by = by or []
    scored = lists.groupBy(*by, "key").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("f"))
    flat = scored.select(*by, "key", "score", F.col("f.list").alias("first_list"), F.col("f.rank").alias("first_rank"))
    best = [F.col("score").desc(), F.col("first_list"), F.col("first_rank")]
    if k is None:
        return flat
    if not by:
        return flat.orderBy(*best).limit(k)
    return flat.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("place") <= k)


def upsert_vectors(stored: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Vectors of stored and batch, the batch's where both have an id; a batch's repeated ids keep one row, the last by `ord`."""
    names = [c for c in stored.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*names), "ord").alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in names))
    return stored.join(last.select(key), key, "left_anti").unionByName(last.select(*stored.columns))


def terms(texts: DataFrame, key: str, values: str) -> DataFrame:
    """values: an array of strings. (key, pos, term): each term once, case aside, in the order and spelling of its first place; blank ones go."""
    each = texts.select(key, F.posexplode(values).alias("pos", "term")).where("trim(term) != ''")
    first = each.groupBy(key, F.lower("term").alias("low")).agg(F.min(F.struct("pos", "term")).alias("f"))
    return first.select(key, "f.pos", "f.term")
