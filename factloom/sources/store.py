"""Immutable snapshots as Parquet; a revision is written once, by one atomic create of its header.

Rows lie under a folder name that no other writer has, in PARTS parts by a hash of their key, before a header names that folder. So what can be loaded is
always of one writer, whole, and the loser of two writers of one revision finds the other's header. A header holds a digest of each part: a difference of
two revisions reads only the parts whose digests differ.
"""

from __future__ import annotations

import datetime
import hashlib
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.snapshot import entity_changes, entries, relationship_changes
from .files import create_once, names_in, read_json, remove

PARTS = 256
KEYS = {"entities": ["key"], "relationships": ["rel_type", "source", "target"]}
HASHED = {"entities": ["key", "entity_type", "name", "properties", "meta"], "relationships": ["rel_type", "source", "target", "properties"]}
#: How often, and how many seconds apart, a header is read again that another writer is just writing.
TRIES, PAUSE = 50, 0.1


class SnapshotConflict(ValueError):
    """The revision is stored with other contents."""


def _part(name: str) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(PARTS)).cast("int")


def part_digests(name: str, rows: DataFrame) -> dict[str, str]:
    """A digest of each part of entities or relationships that has rows, which no order of the rows changes: PARTS short strings at most.

    Rows are hashed where they are; a part adds up four parts of its rows' hashes, so no list of rows is gathered.
    """
    whole = [entries(F.col(c)) if c in ("properties", "meta") else F.col(c) for c in HASHED[name]]
    hashed = rows.select(_part(name).alias("part"), F.sha2(F.to_json(F.struct(*whole)), 256).alias("h"))
    add = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = hashed.groupBy("part").agg(F.concat_ws(":", F.count("*"), *(add(i) for i in range(4))).alias("d")).collect()
    return {str(r["part"]): hashlib.sha256(r["d"].encode()).hexdigest() for r in sums}


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, repository: str) -> str:
        return f"{self.root}/header/{hashlib.sha256(repository.encode()).hexdigest()}"

    def _path(self, repository: str, revision: str) -> str:
        return f"{self._folder(repository)}/{hashlib.sha256(revision.encode()).hexdigest()}.json"

    def header(self, repository: str, revision: str) -> dict | None:
        return read_json(self.spark, self._path(repository, revision))

    def save(self, repository: str, revision: str, committed_at: datetime.datetime | None, entities: DataFrame, relationships: DataFrame) -> bool:
        """True if it was written, False if the same contents are there; other contents under the same name are an error.

        Of several writers at once one creates the header; the others compare theirs with it and remove what they wrote.
        """
        rows = {"entities": entities, "relationships": relationships}
        digests = {n: part_digests(n, d) for n, d in rows.items()}
        own = hashlib.sha256(repr([sorted(digests[n].items()) for n in rows]).encode()).hexdigest()
        if self._same(repository, revision, own, self.header(repository, revision)):
            return False
        data = uuid.uuid4().hex
        for name, d in rows.items():
            d.withColumn("part", _part(name)).repartition("part").write.partitionBy("part").parquet(f"{self.root}/data/{data}/{name}")
        at = committed_at and committed_at.astimezone(datetime.UTC).isoformat()
        header = {"repository": repository, "revision": revision, "committed_at": at, "hash": own, "data": data, "digests": digests, "schemas": {n: d.schema.jsonValue() for n, d in rows.items()}}
        if create_once(self.spark, self._path(repository, revision), header):
            return True
        remove(self.spark, f"{self.root}/data/{data}")
        for _ in range(TRIES):
            winner = self.header(repository, revision)
            if winner:
                break
            time.sleep(PAUSE)
        else:
            raise TimeoutError(f"the header of {repository}@{revision} is not complete")
        self._same(repository, revision, own, winner)
        return False

    def _same(self, repository: str, revision: str, own: str, stored: dict | None) -> bool:
        if stored and stored["hash"] != own:
            raise SnapshotConflict(f"{repository}@{revision} is stored with other contents")
        return bool(stored)

    def _rows(self, header: dict, name: str, parts: list[str] | None = None) -> DataFrame:
        schema, base = StructType.fromJson(header["schemas"][name]), f"{self.root}/data/{header['data']}/{name}"
        there = [p for p in header["digests"][name] if parts is None or p in parts]
        if not there:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{base}/part={p}" for p in there))

    def load(self, repository: str, revision: str) -> tuple[DataFrame, DataFrame]:
        header = self.header(repository, revision)
        if not header:
            raise KeyError(f"{repository}@{revision} is not stored")
        return self._rows(header, "entities"), self._rows(header, "relationships")

    def different_parts(self, repository: str, previous: str, current: str) -> dict[str, list[str]]:
        """The parts of entities and relationships whose digests differ between two revisions; none are read for that."""
        a, b = (self.header(repository, r)["digests"] for r in (previous, current))
        return {n: [str(p) for p in range(PARTS) if a[n].get(str(p)) != b[n].get(str(p))] for n in KEYS}

    def changes(self, repository: str, previous: str, current: str) -> DataFrame:
        """entity_changes and relationship_changes of two revisions: equal parts of either are not read, but for names of changed relationships' ends."""
        a, b = self.header(repository, previous), self.header(repository, current)
        parts = self.different_parts(repository, previous, current)
        of = lambda h, n: self._rows(h, n, parts[n])
        entities = entity_changes(of(a, "entities"), of(b, "entities"))
        if not parts["relationships"]:
            return entities
        return entities.unionByName(relationship_changes(of(a, "relationships"), of(b, "relationships"), self._rows(a, "entities"), self._rows(b, "entities")))

    def revisions(self, repository: str) -> DataFrame:
        """(revision, committed_at), the oldest first."""
        folder, schema = self._folder(repository), "revision string, committed_at string"
        found = self.spark.read.schema(schema).json(folder) if names_in(self.spark, folder) else self.spark.createDataFrame([], schema)
        return found.where("revision is not null").select("revision", F.col("committed_at").cast("timestamp").alias("committed_at")).orderBy("committed_at", "revision")
