"""What the training-data operators share: scratch tables in the cluster's shared folder and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: At most this many rows of (key, few longs) are broadcast; larger sides are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Spark's setting for the bytes of an Arrow batch.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster, whose executors share no such folder, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-factloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """SQL settings of the session (dots as double underscores) for the length of a block."""
    own = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """From here on the session hands rows to Python in Arrow batches of about `size` bytes (a larger row: one of its own), unless it has a setting of its own.

    Otherwise 10,000 texts of any length make a batch, which lies in the JVM beside its heap and again in the Python worker.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(size))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a written table of the shared folder: cuts the lineage and outlives lost executors.

    Its shuffle files go when it is written, for what follows reads the table. Values may be megabytes long, so a writer looks at its
    size after each few rows.
    """
    path = scratch(df.sparkSession, name)
    small = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 1000}
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.options(**small).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only doc_id (long) and text (null: empty); whatever else docs has, clashing names included, is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left-joined to facts, which has each key once and in `weight` how many rows hold that key.

    Keys of HOT_SHARE of all rows or more (at most 1 / HOT_SHARE of them, so their broadcast has a proven bound) are
    joined where the rows are; only the others are shuffled, so that no task gets a hot key's rows. facts must be
    a written table (it is read twice). Null keys match nothing.
    """
    names = [c for c in facts.columns if c != key]
    total = facts.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return rows.join(facts, key, "left")
    limit = max(2, int(total * HOT_SHARE))
    if facts.count() <= MAX_BROADCAST_ROWS // 10:
        return rows.join(F.broadcast(facts), key, "left")
    hot = facts.where(F.col(weight) >= limit)
    if hot.isEmpty():
        return rows.join(facts, key, "left")
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*names).alias("__hot"))), key, "left")
    # a hot row's key for the shuffle is a null with its own partition number, so it is dealt evenly and matches nothing
    cold = facts.where(F.col(weight) < limit).select(F.col(key).alias("__key"), F.struct(*names).alias("__cold"), F.lit(0).alias("__deal"))
    dealt = marked.withColumn("__deal2", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.spark_partition_id()))
    out = dealt.join(cold, (dealt[key] == cold["__key"]) & (dealt["__deal2"] == cold["__deal"]), "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in names))
