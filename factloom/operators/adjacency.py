"""Edges stored for traversals: bucketed and sorted by the node that they leave, so a level moves its frontier and no edge.

A plain written table forgets how it was dealt, and each level would shuffle all edges again. Here the table's layout is in the catalog: a frontier is
dealt to the edges' buckets (or broadcast, if it is small) and meets them where they lie. Nodes of very many edges, hubs, are cut into parts by a hash of the other
end, so that no bucket holds a hub whole; they are a short list that the frontier is joined with first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import MAX_BROADCAST_ROWS, shared_dir

#: A node of more edges than this is a hub, cut into parts of about so many.
HUB = 100_000


class Adjacency:
    """The edges node -> next under `root`, each once. Made by store(), opened again by open(); drop() forgets the catalog's entry, the files stay."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, types: str):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.name = f"adjacency_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({types}, part INT) USING parquet CLUSTERED BY (node, part) SORTED BY (node, part) INTO {buckets} BUCKETS LOCATION '{root}/edges'")
        self.hubs = spark.read.parquet(f"{root}/hubs")
        self.has_hubs = not self.hubs.isEmpty()

    @classmethod
    def store(cls, edges: DataFrame, near: str = "src", far: str = "dst", root: str | None = None) -> Adjacency:
        """edges: near, far. Null ends lead nowhere and are left out; of repeated edges one stays."""
        spark = edges.sparkSession
        root = root or f"{shared_dir(spark)}/facts-adjacency-{uuid.uuid4().hex}"
        own = edges.select(F.col(near).alias("node"), F.col(far).alias("next")).where("node is not null and next is not null")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        degree = own.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
        degree.select("node", F.ceil(F.col("n") / HUB).cast("int").alias("parts")).write.parquet(f"{root}/hubs")
        hubs = spark.read.parquet(f"{root}/hubs")
        cut = own.withColumn("part", F.lit(0)) if hubs.isEmpty() else own.join(cls._small(hubs), "node", "left").select("node", "next", F.coalesce(F.pmod(F.xxhash64("next"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
        name = f"adjacency_{uuid.uuid4().hex}"
        dealt = cut.repartition(buckets, "node", "part").dropDuplicates(["node", "part", "next"])
        dealt.write.format("parquet").bucketBy(buckets, "node", "part").sortBy("node", "part").option("path", f"{root}/edges").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
        spark.createDataFrame([(buckets, types)], "buckets int, types string").coalesce(1).write.json(f"{root}/layout")
        return cls(spark, root, buckets, types)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Adjacency:
        layout = spark.read.json(f"{root}/layout").first()
        return cls(spark, root, layout["buckets"], layout["types"])

    @staticmethod
    def _small(hubs: DataFrame) -> DataFrame:
        return F.broadcast(hubs) if hubs.count() <= MAX_BROADCAST_ROWS else hubs

    def edges(self) -> DataFrame:
        """node, next, part."""
        return self.spark.table(self.name)

    def from_(self, frontier: DataFrame) -> DataFrame:
        """frontier: node. (node, next) of the edges out of it."""
        asked = frontier.select("node").distinct()
        if self.has_hubs:
            parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
            asked = asked.join(self._small(self.hubs), "node", "left").select("node", parts)
        else:
            asked = asked.withColumn("part", F.lit(0))
        return self.edges().join(asked, ["node", "part"], "left_semi").select("node", "next")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
