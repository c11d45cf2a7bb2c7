"""Lineage cuts by written tables of the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that sorts or gathers rows of keys, about.
ROWS_A_TASK = 250_000
#: At most this many rows of a narrow table are broadcast; larger sides are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a session on one machine gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-facts-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/facts-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = True
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into partitions of about ROWS_A_TASK rows, as many as shuffles have at least: what a task sorts or gathers does not grow with the table.

    Groups, windows and joins by these keys, or by these and more, need no further shuffle.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_TASK))
    return df.repartition(parts, *keys)


def is_written(df: DataFrame) -> bool:
    """Whether df is as written() returned it, so that reading it twice costs no second run."""
    return getattr(df, "_written", False)
