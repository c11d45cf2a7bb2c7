"""Tables that are upserted by key: copy-on-write buckets under a manifest of versions.

A row lies in the bucket of its key's hash. An upsert reads and writes the buckets that its batch touches; the files of all others, and of buckets that come
out as they were, keep their names. A version is a manifest that tells each bucket's folder, made by one atomic create: a writer that
comes second starts over from the version that won. Readers see one version, whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import written
from ..operators.upsert import merge_rows
from .files import create_once, names_in, read_json, remove

#: How often an upsert starts over because another writer was first.
TRIES = 20


class KeyedTable:
    """schema: DDL of keys and properties; keys: names of the key columns. buckets is fixed when the table is made."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.columns = spark.createDataFrame([], schema).columns
        self.properties = [c for c in self.columns if c not in keys]
        create_once(spark, self._manifest(0), {"version": 0, "n_buckets": buckets, "buckets": {}})
        self.buckets = self.manifest(0)["n_buckets"]

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest; by default the last one that is complete."""
        names = [self._manifest(version).rpartition("/")[2]] if version is not None else reversed([n for n in names_in(self.spark, f"{self.root}/manifest") if n.endswith(".json")])
        for name in names:
            found = read_json(self.spark, f"{self.root}/manifest/{name}")
            if found:
                return found
        raise KeyError(f"{self.root} has no version {version}")

    def _read(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/{x['data']}/bucket={k}" for k, x in manifest["buckets"].items() if buckets is None or k in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def _digests(self, rows: DataFrame) -> dict[str, str]:
        """A digest of the rows of each bucket, which their order does not change."""
        add = lambda seed: F.sum(F.xxhash64(F.lit(seed), *self.columns).cast("decimal(38,0)")).cast("string")
        return {str(r["bucket"]): r["d"] for r in rows.groupBy("bucket").agg(F.concat_ws(":", F.count("*"), add(1), add(2)).alias("d")).collect()}

    def upsert(self, batch: DataFrame) -> int:
        """batch: keys, properties and `ord`. Merge it as merge_rows does and return the version that has it.

        A batch that changes nothing, such as a repeated one, makes no version.
        """
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        mine = written(batch.select(*self.columns, "ord", bucket.alias("bucket")), "upsert")
        touched = [str(r["bucket"]) for r in mine.select("bucket").distinct().collect()]
        for _ in range(TRIES):
            last = self.manifest()
            data = uuid.uuid4().hex
            merged = merge_rows(self._read(last, touched), mine, self.keys, self.properties)
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{data}")
            after = self._digests(self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.root}/data/{data}")) if touched else {}
            changed = {k: {"data": data, "digest": d} for k, d in after.items() if last["buckets"].get(k, {}).get("digest") != d}
            for k in after.keys() - changed.keys() if changed else ():
                remove(self.spark, f"{self.root}/data/{data}/bucket={k}")
            new = {**last, "version": last["version"] + 1, "buckets": {**last["buckets"], **changed}}
            if changed and create_once(self.spark, self._manifest(new["version"]), new):
                return new["version"]
            remove(self.spark, f"{self.root}/data/{data}")
            if not changed:
                return last["version"]
        raise RuntimeError(f"{TRIES} upserts of {self.root} in turn were overtaken")

    def vacuum(self, keep: int = 2) -> None:
        """Remove the versions before the last `keep`, and the folders that only they use. No upsert may run meanwhile."""
        versions = [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        used = {x["data"] for v in versions[-keep:] for x in self.manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            if v:  # version 0 tells the number of buckets
                remove(self.spark, self._manifest(v))
        for data in names_in(self.spark, f"{self.root}/data"):
            if data not in used:
                remove(self.spark, f"{self.root}/data/{data}")
