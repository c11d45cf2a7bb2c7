"""An inverted file over vectors: cells around centroids, of which a search looks into a few; scores are exact.

Centroids are fitted by k-means on a bounded sample (SAMPLE rows, the least hashes of their ids); every row is indexed, in the cell of its nearest one. Rows lie in folders by cell.
A search takes its queries in blocks: only the folders of cells that a block probes are read, and a row is compared with the queries that probe its cell. A cell is no task: rows
are dealt by file blocks, so a cell with a third of all rows is many tasks'. How many cells to probe is measured, not guessed: on CHECKED rows, whose true
neighbours are found by comparing with everything. Probing all cells gives the exact result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import _query_blocks, keep_best, nearest_of_each
from .tables import shared_dir

#: Rows that centroids are fitted on, most cells, rounds of k-means, rows that the number of probes is measured with.
SAMPLE, CELLS, ROUNDS, CHECKED = 50_000, 4096, 12, 200


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def fit_centroids(sample: np.ndarray, cells: int, seed: int = 11) -> np.ndarray:
    """Directions of `cells` centroids of the sample's directions; a cell that loses its rows takes the row that is worst off."""
    rng, rows = np.random.default_rng(seed), _unit(sample)
    centroids = rows[rng.choice(len(rows), cells, replace=False)]
    for _ in range(ROUNDS):
        like = rows @ centroids.T
        own = like.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(like.max(axis=1))[: len(empty)]]
        centroids = _unit(sums)
    return centroids


class VectorIndex:
    """centroids; rows: id, v, cell, written by cell; key: the id's name; probes: how many cells a search looks into by default."""

    def __init__(self, vectors: DataFrame, key: str, vector: str, cells: int | None = None, recall: float = 0.95, k: int = 5):
        """vectors: key (long) and vector; null vectors are left out. recall: the share of the k true neighbours that `probes` is chosen for."""
        spark = vectors.sparkSession
        self.key, self.root = key, f"{shared_dir(spark)}/facts-vectors-{uuid.uuid4().hex}"
        rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        n = len(picked)
        self.cells = max(1, min(CELLS, n, cells or math.isqrt(rows.count())))
        sample = picked["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
        self.centroids = fit_centroids(sample, self.cells) if n else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast(self.centroids)  # CELLS vectors at most

        def place(batches):
            for b in batches:
                if len(b):
                    own = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                    yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array((own @ shared.value.T).argmax(axis=1).astype(np.int32))], ["id", "v", "cell"])

        placed = rows.mapInArrow(place, "id long, v array<double>, cell int")
        placed.sortWithinPartitions("cell").write.partitionBy("cell").parquet(self.root)
        self.rows = spark.read.schema("id long, v array<double>, cell int").parquet(self.root)
        self.probes = self.probes_for(recall, k) if n else 0

    def probes_for(self, recall: float, k: int) -> int:
        """The least number of probed cells with which CHECKED rows find that share of their k true neighbours."""
        asked = self.rows.select("id", "v").orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(CHECKED)
        true = nearest_of_each(self.rows.select("id", "v"), asked, k, "id", "v").select("query_id", "id")
        where = true.join(self.rows.select("id", "cell"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").select("q", "cell").toArrow()
        if not len(where):
            return self.cells
        q = where["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(where), -1)
        like = q @ self.centroids.T
        cell = where["cell"].to_numpy()
        rank = (like > like[np.arange(len(cell)), cell][:, None]).sum(axis=1) + 1
        return int(np.sort(rank)[min(len(rank), math.ceil(recall * len(rank))) - 1])

    def nearest(self, queries: DataFrame, vector: str, k: int, probes: int | None = None, min_score: float | None = None) -> DataFrame:
        """(query_id, place, key, score): up to k rows of the greatest positive cosine for each row of queries (the index's key, vector), from the probed cells; ties in the order of the key.

        probes=self.cells: from all rows, as nearest_of_each.
        """
        probes = min(self.cells, probes or self.probes)
        out = self.rows.sparkSession.createDataFrame([], "query_id long, id long, score double")
        for q_ids, q in _query_blocks(queries, self.key, vector):
            if not self.cells or not probes:
                break
            asked = np.zeros((len(q), self.cells), bool)
            np.put_along_axis(asked, np.argpartition(-(q @ self.centroids.T), probes - 1, axis=1)[:, :probes], True, axis=1)
            wanted = np.flatnonzero(asked.any(axis=0)).tolist()

            def search(batches, q_ids=q_ids, q=q, asked=asked):
                best = keep_best(None, None, None, None, k)
                for b in batches:
                    if not len(b):
                        continue
                    own, ids, cell = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1), b["id"].to_numpy(), b["cell"].to_numpy()
                    for c in np.unique(cell):
                        here, who = cell == c, np.flatnonzero(asked[:, c])
                        best = keep_best(best, (who, q[who]), own[here], ids[here], k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "id", "score"])

            out = out.unionByName(self.rows.where(F.col("cell").isin(wanted)).mapInArrow(search, "query_id long, id long, score double"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
        top = out.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", F.col("id").alias(self.key), "score")
        return top if min_score is None else top.where(F.col("score") >= min_score)
