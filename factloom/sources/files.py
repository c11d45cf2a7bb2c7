"""Small files of any Hadoop store, created once: what a commit is made of."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_once(spark: SparkSession, path: str, value: dict) -> bool:
    """Create the file with value as JSON; False if it exists, whoever made it. The store decides between writers that come at once."""
    fs, p = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    return True


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The file's value; None if there is no such file or its writer is not done with it."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    except json.JSONDecodeError:
        return None
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, p = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
