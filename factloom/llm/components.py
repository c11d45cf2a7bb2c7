"""Connected components of a graph given as edges, by alternating large and small stars; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise

MAX_ROUNDS = 60


def _stars(pairs: DataFrame, name: str) -> DataFrame:
    """pairs (u, v) with, in m, the least of u and its partners; written, for it is read more than once."""
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-least")
    return attach(pairs, least, "u", "n").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v), longs: a row (node, root) for each node of an edge between two different nodes, root the least of its component."""
    pairs = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = None
    for _ in range(MAX_ROUNDS):
        now = pairs.agg(mark).first()[0]
        if now == before:
            break
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialise(large, "large")
        star = _stars(large, "small")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        pairs = materialise(small.where("u != v").distinct(), "small")
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
