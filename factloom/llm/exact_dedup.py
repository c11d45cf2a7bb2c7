"""Exact dedup by a log-structured merge index of text digests (operator 10), in DataFrame operations only.

Flush: every task writes the digests of the rows that it reads as a run of its own, sorted by digest; nothing is shuffled. Runs are taken up in
memtables of MEMTABLE_BYTES of digests, two at least. Each memtable in turn becomes a level of the index: its digests, each once with its smallest identifier and its
number of rows, cut into ranges of keys and sorted, and a filter of them. Before it does, its digests are asked of the filters of the levels so far. What a filter does not deny
is looked up in the ranges of the level that it falls into, and no other range is read; what is there, or several times in the memtable itself, is a hit. Levels of like
size are merged by compaction, which keeps the smallest identifier, so there are as many as the logarithm of the number of memtables.

The texts of hits are read again and compared byte by byte (grouped by the whole text), and only what is proven equal forms a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, attach, discard, id_and_text, materialise, scratch, table

#: Bytes of digests that are one memtable, how many bytes a digest counts, and the most memtables that runs are dealt to.
MEMTABLE_BYTES, DIGEST_BYTES, MEMTABLES = 8 << 30, 48, 256
#: Bytes of digests of a range of a level, and the most ranges, as bits of the key.
RANGE_BYTES, RANGE_BITS = 32 << 20, 12
#: A filter has so many bits for each digest, about; of these so many are set and asked. A block of a filter is a binary value of BLOCK_BITS bits.
BITS_A_KEY, PROBES, BLOCK_BITS = 12, 2, 32_768
#: A level is merged into the one before it if that has at most so many times its digests.
RATIO = 2


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


class Level:
    """keys: key, keep_id, n, each key once, by `range` of the key and sorted; filter: block, bits; blocks: how many blocks the filter has."""

    def __init__(self, keys: DataFrame, size: int):
        spark = keys.sparkSession
        self.size, self.path = size, scratch(spark, "digest-level")
        self.bits = max(0, min(RANGE_BITS, (size * DIGEST_BYTES // RANGE_BYTES).bit_length()))
        dealt = keys.select("key", "keep_id", "n", self._range().alias("range")).repartition("range").sortWithinPartitions("range", "key")
        dealt.write.partitionBy("range").parquet(self.path)
        self.keys = spark.read.schema("key binary, keep_id long, n long, range int").parquet(self.path)
        self.keys._scratch_path = self.path
        self.blocks = max(1, -(-size * BITS_A_KEY // BLOCK_BITS))
        placed = self.keys.select(F.explode(_probes(F.col("key"), self.blocks)).alias("p")).select("p.block", F.bitmap_bit_position(F.col("p.bit")).alias("at"))
        self.filter = materialise(placed.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), "digest-filter")

    def _range(self) -> Column:
        """The key's first bits, as a number."""
        return F.shiftright(F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int"), 16 - self.bits)

    def find(self, keys: DataFrame) -> DataFrame:
        """The level's rows of the keys (key): those that the filter does not deny, looked up in their ranges alone."""
        asked = materialise(self.may_have(keys).select("key", self._range().alias("range")).distinct(), "digest-asked")
        ranges = [r["range"] for r in asked.select("range").distinct().collect()]  # 2^RANGE_BITS at most
        return self.keys.where(F.col("range").isin(ranges)).join(asked, ["range", "key"], "left_semi").select("key", "keep_id", "n")

    def may_have(self, keys: DataFrame) -> DataFrame:
        """keys (key) without those that the filter denies: each key's block is joined by its number, and its bits are looked at."""
        asked = keys.select("key", _probes(F.col("key"), self.blocks).alias("probes")).withColumn("block", F.col("probes")[0]["block"])
        small = self.blocks <= MAX_FILTER_BLOCKS
        met = asked.join(F.broadcast(self.filter) if small else self.filter, "block")
        # bit i of a block is bit i % 8 of its byte i / 8
        at = lambda i: F.bitmap_bit_position(F.col("probes")[i]["bit"])
        byte = lambda i: F.conv(F.hex(F.substring("bits", (at(i) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = lambda i: byte(i).bitwiseAND(F.pow(F.lit(2), at(i) % 8).cast("int")) > 0
        return met.where(reduce(Column.__and__, (is_set(i) for i in range(PROBES)))).select("key")


#: Filters of up to so many blocks (of 4 KB) are broadcast.
MAX_FILTER_BLOCKS = 1024


def _probes(key: Column, blocks: int) -> Column:
    """The (block, bit) pairs of a key: all of its bits lie in one block."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    own = F.xxhash64(key, F.lit(1))
    return F.array(*(F.struct(block.alias("block"), (F.pmod(F.shiftright(own, 20 * i), F.lit(BLOCK_BITS)) + 1).alias("bit")) for i in range(PROBES)))


class DigestIndex:
    """Levels of digests, smallest last, and the hits so far."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or scratch(spark, "digests")
        self.levels: list[Level] = []
        self.hits: list[DataFrame] = []

    def flush(self, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Write (key, sha, doc_id) rows as runs, one a task. The rows as written, and the memtables (key, doc_id) that the runs make up."""
        path = f"{self.root}/runs"
        dealt = rows.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(MEMTABLES)))
        dealt.sortWithinPartitions("slot", "key").write.partitionBy("slot").mode("append").parquet(path)
        run = self.spark.read.schema("key binary, sha binary, doc_id long, slot int").parquet(path)
        n = min(MEMTABLES, max(2, -(-run.count() * DIGEST_BYTES // MEMTABLE_BYTES)))
        return run.select("key", "sha", "doc_id"), [run.where(F.pmod(F.col("slot"), F.lit(n)) == k).select("key", "doc_id") for k in range(n)]

    def add(self, memtable: DataFrame) -> None:
        """memtable: key, doc_id. Make it the last level, note which of its keys are hits, and merge levels of like size."""
        fresh = materialise(memtable.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")), "digest-memtable")
        size = fresh.count()
        if not size:
            return
        found = [fresh.where("n > 1").select("key"), *(level.find(fresh.select("key")).select("key") for level in self.levels)]
        self.hits.append(materialise(reduce(DataFrame.unionByName, found).distinct(), "digest-hits"))
        self.levels.append(Level(fresh, size))
        discard(fresh)
        while len(self.levels) > 1 and self.levels[-2].size <= RATIO * self.levels[-1].size:
            self.compact(2)

    def compact(self, last: int) -> None:
        """Merge the last levels into one: each key's smallest identifier and number of rows."""
        old, self.levels = self.levels[-last:], self.levels[:-last]
        keys = reduce(DataFrame.unionByName, (x.keys for x in old)).groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        keys = materialise(keys, "digest-merged")
        self.levels.append(Level(keys, keys.count()))
        discard(keys, *(t for x in old for t in (x.keys, x.filter)))

    def repeated(self) -> DataFrame:
        """(key, n) of the keys that several rows have."""
        if not self.hits:
            return self.spark.createDataFrame([], "key binary, n long")
        hits = reduce(DataFrame.unionByName, self.hits).distinct()
        found = reduce(DataFrame.unionByName, (x.keys.select("key", "n") for x in self.levels)).join(hits, "key", "left_semi")
        return found.groupBy("key").agg(F.sum("n").alias("n"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, keep_id, n) of the keys (key) that the index has; of a level only the ranges are read that have a key which its filter does not deny."""
        found = [x.find(keys) for x in self.levels]
        return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts are empty texts. Of equal texts the row with the smallest doc_id stays; a null doc_id counts as the
    largest, and of rows equal in both one stays. digest_bytes: how much of the SHA-256 is the index key; rows that
    share a key but not their bytes are told apart by the byte verification.
    """
    spark = docs.sparkSession
    sha = F.unhex(F.sha2(F.col("norm"), 256))
    rows = id_and_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    keyed = rows.select(sha.alias("sha"), "doc_id").select(F.substring("sha", 1, digest_bytes).alias("key"), "sha", "doc_id")
    index = DigestIndex(spark)
    run, memtables = index.flush(keyed)
    for memtable in memtables:
        index.add(memtable)
    hits = materialise(index.repeated(), "digest-repeated")
    hit_rows = materialise(attach(run.select("key", "doc_id"), hits, "key", "n").where("n > 1").select("doc_id"), "hits")
    ids = hit_rows.where("doc_id is not null")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_ROWS else ids.distinct()
    texts = rows.where("doc_id is not null").join(ids, "doc_id", "left_semi")
    if not hit_rows.where("doc_id is null").isEmpty():
        texts = texts.unionByName(rows.where("doc_id is null"))
    # byte verification: rows are equal if their whole texts fall into one group; copies are summed up before the shuffle
    proven = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").select(sha.alias("sha"), "keep_id", "n")
    proven = materialise(proven, "proven")
    if not proven.groupBy("sha").count().where("count > 1").isEmpty():
        raise ValueError("different texts with one SHA-256")
    out = attach(run.select("sha", "doc_id"), proven, "sha", "n")
    out = out.withColumn("keep_id", F.coalesce("keep_id", "doc_id")).withColumn("n", F.coalesce("n", F.lit(1)).cast("long"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # a row that stays may be there several times: of such rows, which are few, the first one stays
    numbered = materialise(out.select("*", stays.alias("stays"), F.monotonically_increasing_id().alias("row")), "numbered")
    twice = numbered.where("stays and n > 1").groupBy("sha").agg(F.min("row").alias("first"), F.count("*").alias("m")).where("m > 1")
    twice = materialise(twice.withColumnRenamed("m", "n"), "twice")
    told = attach(numbered.select("row", "sha", "doc_id", "keep_id", F.col("n").alias("group_size"), "stays"), twice, "sha", "n")
    return told.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("first").isNull() | (F.col("first") == F.col("row")))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """documents without the rows that exact_dedup drops; all columns stay as they are."""
    said = materialise(exact_dedup(docs), "dedup")
    gone = said.where("not kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).count()
    twice = gone.join(said.where("kept"), (F.col("__id").eqNullSafe(F.col("doc_id"))) & (F.col("__sha") == F.col("text_sha256")), "left_semi")
    repeated = not twice.isEmpty()
    gone = gone.drop("count")
    if repeated:  # a row that stays has a twin of the same identifier: they go by dropDuplicates below, not by their identifier
        stay = twice.select(F.col("__id").alias("__stay"), F.col("__sha").alias("__text"))
        gone = materialise(gone.join(stay, F.col("__id").eqNullSafe(F.col("__stay")) & (F.col("__sha") == F.col("__text")), "left_anti"), "gone")
    small = gone.count() <= MAX_BROADCAST_ROWS
    marked = docs.withColumn("__own", F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))), 256))
    kept = marked.join(F.broadcast(gone) if small else gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["doc_id", "__own"])
    return kept.select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents) AS d
"""
