"""Bounded graph traversal over edge tables (src, dst): frontiers, shortest predecessors, capped path enumeration.

Every level joins the frontier with edges that are stored by the node and drops what was seen by an anti join, so work follows the edges that are
reached, not paths, and no edge is shuffled after it was stored. A level is written before the next one starts. Depths are small constants, so the loops are short;
the driver only learns whether a level is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .adjacency import Adjacency
from .tables import is_written, written


def reach(edges: DataFrame | Adjacency, starts: DataFrame, max_depth: int, forward: bool = False) -> DataFrame:
    """(node, depth): the nodes that edges lead to from the starts (backward: that lead to them), with their least depth.

    edges: src, dst, nulls lead nowhere; or edges that are stored already, by the end that is walked from. starts: node; all of them have depth 0, known to the edges
    or not. Cycles, repeated edges and self loops do no harm.
    """
    stored = edges if isinstance(edges, Adjacency) or max_depth < 1 else Adjacency.store(edges, *(("src", "dst") if forward else ("dst", "src")))
    level = written(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "level-0")
    seen = level
    for depth in range(1, max_depth + 1):
        found = stored.from_(level).select(F.col("next").alias("node")).distinct()
        found = found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        level = written(found, f"level-{depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    if stored is not edges and max_depth > 0:
        stored.drop()
    return seen


def walked_edges(edges: DataFrame, depths: DataFrame, max_depth: int, forward: bool = False) -> DataFrame:
    """(depth, src, dst): all edges out of each frontier, those back to visited nodes included; depth counts from 1."""
    near = "src" if forward else "dst"
    from_ = depths.where(F.col("depth") < max_depth).select(F.col("node").alias(near), (F.col("depth") + 1).alias("depth"))
    return edges.select("src", "dst").join(from_, near).select("depth", "src", "dst").distinct()


def shortest_predecessors(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """(node, predecessor, depth): the next nodes on shortest chains from a caller `node` back to the start."""
    a = depths.select(F.col("node").alias("src"), F.col("depth").alias("depth"))
    b = depths.select(F.col("node").alias("dst"), (F.col("depth") + 1).alias("depth"))
    # edges that no chain has are dropped before repeated ones are
    both = edges.select("src", "dst").join(a, "src").join(b, ["dst", "depth"])
    return both.select(F.col("src").alias("node"), F.col("dst").alias("predecessor"), "depth").distinct()


def callers_beyond(edges: DataFrame, depths: DataFrame, max_depth: int) -> DataFrame:
    """One row (n): how many distinct callers of the deepest level were left out."""
    last = depths.where(F.col("depth") == max_depth).select(F.col("node").alias("dst"))
    more = edges.select("src", "dst").join(last, "dst", "left_semi").select(F.col("src").alias("node"))
    return more.join(depths.select("node"), "node", "left_anti").agg(F.count_distinct("node").alias("n"))


def shortest_chains(predecessors: DataFrame, starts: DataFrame, max_depth: int, limit: int = 10) -> DataFrame:
    """(node, depth, chain, capped): for each node up to `limit` of its shortest chains, from the start to the node.

    Chains are kept in the order of their nodes; capped tells that a node has more. A node's prefixes are capped too,
    to limit + 1, which loses no chain that the order would have kept: a chain's first nodes decide first.
    """
    level = written(starts.select("node", F.lit(0).alias("depth"), F.array("node").alias("chain")), "chains-0")
    whole = level
    predecessors = predecessors if is_written(predecessors) else written(predecessors, "predecessors")
    first = Window.partitionBy("node").orderBy("chain")
    for depth in range(1, max_depth + 1):
        steps = predecessors.where(F.col("depth") == depth).select(F.col("predecessor").alias("was"), F.col("node").alias("next"))
        grown = level.join(steps, level["node"] == steps["was"]).select(F.col("next").alias("node"), F.lit(depth).alias("depth"), F.array_append("chain", F.col("next")).alias("chain"))
        level = written(grown.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit + 1).drop("rank"), f"chains-{depth}")
        if level.isEmpty():
            break
        whole = whole.unionByName(level)
    ranked = whole.withColumn("rank", F.row_number().over(first)).withColumn("n", F.count("*").over(Window.partitionBy("node")))
    return ranked.where(F.col("rank") <= limit).select("node", "depth", "chain", (F.col("n") > limit).alias("capped"))


def containers(edges: DataFrame, max_hops: int = 4, owners: DataFrame | None = None) -> DataFrame:
    """(owner, node, hops): who contains whom within max_hops steps of src CONTAINS dst, by the least number of steps. owners (owner): only what these contain."""
    hop = edges.select(F.col("src").alias("owner"), F.col("dst").alias("node")).distinct()
    level = hop if owners is None else hop.join(owners.select("owner"), "owner", "left_semi")
    whole = level.withColumn("hops", F.lit(1))
    for hops in range(2, max_hops + 1):
        step = hop.select(F.col("owner").alias("node"), F.col("node").alias("next"))
        level = level.join(step, "node").select("owner", F.col("next").alias("node")).distinct()
        whole = whole.unionByName(level.withColumn("hops", F.lit(hops)))
    return whole.groupBy("owner", "node").agg(F.min("hops").alias("hops"))


def downstream(edges: DataFrame, owners: DataFrame, max_depth: int = 3) -> DataFrame:
    """(node, depth, directness): services that the owning ones lead to; owners themselves never count."""
    found = reach(edges, owners, max_depth, forward=True).where("depth > 0")
    return found.select("node", "depth", F.when(F.col("depth") == 1, "DIRECT").otherwise("INDIRECT").alias("directness"))


def capped_paths(paths: DataFrame, limit: int = 10) -> DataFrame:
    """paths: category, terminal, steps. Each path once, up to `limit` of a terminal, with `capped` where it has more."""
    own = Window.partitionBy("category", "terminal")
    ranked = paths.select("category", "terminal", "steps").distinct().withColumn("rank", F.row_number().over(own.orderBy("steps"))).withColumn("n", F.count("*").over(own))
    return ranked.where(F.col("rank") <= limit).select("category", "terminal", "steps", (F.col("n") > limit).alias("capped"))


def rendered(steps: Column) -> Column:
    """steps: array of (name, relationship, direction). The path as one line; reverse steps have their arrow turned."""
    arrow = lambda s: F.when(s["direction"] == "REVERSE", F.concat(F.lit(" <-["), s["relationship"], F.lit("]- "))).otherwise(F.concat(F.lit(" -["), s["relationship"], F.lit("]-> ")))
    return F.array_join(F.transform(steps, lambda s: F.concat(F.when(s["relationship"].isNull(), F.lit("")).otherwise(arrow(s)), s["name"])), "")


def name_calls(chunks: DataFrame) -> DataFrame:
    """chunks: id, name, text. Edges (src, dst): src's text calls a name that is dst's; found once a chunk, joined on the name."""
    called = chunks.select(F.col("id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\w+)\s*\("), F.lit(1)))).alias("called"))
    named = chunks.select(F.col("id").alias("dst"), F.substring_index("name", ".", -1).alias("called"))
    return called.join(named, "called").where("src != dst").select("src", "dst").distinct()
