"""Idempotent graph upserts: the last record of an id wins, per property; edges need both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_rows(stored: DataFrame, batch: DataFrame, keys: list[str], properties: list[str]) -> DataFrame:
    """stored and batch: keys, properties (batch also `ord`, its order). One row for each key, with the properties of the batch's last record of it or else as stored."""
    old = stored.select(*keys, F.lit(-1).cast("long").alias("ord"), *properties)
    new = batch.select(*keys, F.col("ord").cast("long").alias("ord"), *properties)
    last = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(F.lit(0), *properties), "ord").alias("p"))
    return last.select(*keys, *(F.col(f"p.{c}").alias(c) for c in properties))


def merge_nodes(stored: DataFrame, batch: DataFrame, properties: list[str], label: str = "label", key: str = "id") -> DataFrame:
    """stored and batch: label, id, properties (batch also `ord`, its order). One row for each label and id.

    The batch's last record of an id sets its properties, and a null there removes a stored value, as a later write of the
    whole record does. Ids that the batch doesn't have keep what is stored.
    """
    return merge_rows(stored, batch, [label, key], properties)


def merge_edges(stored: DataFrame, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start_label, start_id, rel_type, end_label, end_id), each once; edges of the batch without both of their nodes are left out."""
    names = ["start_label", "start_id", "rel_type", "end_label", "end_id"]
    ids = nodes.select("label", "id").distinct()
    ends = batch.select(*names).distinct()
    ends = ends.join(ids.select(F.col("label").alias("start_label"), F.col("id").alias("start_id")), ["start_label", "start_id"], "left_semi")
    ends = ends.join(ids.select(F.col("label").alias("end_label"), F.col("id").alias("end_id")), ["end_label", "end_id"], "left_semi")
    return stored.select(*names).unionByName(ends.select(*names)).distinct()


def ingestion_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): how many records of each label and relationship were sent, repeats included."""
    a = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    b = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return a.unionByName(b)


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """(label, id, n) of the ids that break the rule of one node for each."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")
