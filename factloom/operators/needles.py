"""Which of many strings stand in a text: an automaton over a table of needles, run where the texts are.

Needles are a written table, however they were made; none of them becomes a literal of a plan. They are searched in blocks of bounded size: of each block an
Aho-Corasick automaton is built once in a process, and a pass over the texts looks for all its needles at once, in time that follows the texts and what is
found, not the number of needles. What is found is a table of (row, needle), so everything after that is an equi join on the needle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Needles of a block and their bytes, at most about that: what a broadcast and an automaton hold.
NEEDLES, NEEDLE_BYTES = 100_000, 8 << 20
#: Found needles of one batch that leaves a task.
FOUND = 50_000

_built: dict = {}


def _automaton(name: str, needles) -> ahocorasick.Automaton:
    """The automaton of a block (broadcast); a process keeps the last one."""
    if name not in _built:
        _built.clear()
        own = ahocorasick.Automaton()
        for needle in needles.value:
            own.add_word(needle, needle)
        own.make_automaton()
        _built[name] = own
    return _built[name]


def substring_hits(rows: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """The columns of rows but `text`, and `needle`: each needle that stands in the row's text, once for each row.

    Letters count as they are. Null and empty needles stand nowhere, and nothing stands in a null text.
    """
    spark = rows.sparkSession
    own = written(needles.select(F.col(needle).cast("string").alias("needle")).where("needle != ''").distinct(), "needles")
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["n"] // NEEDLES), -(-size["bytes"] // NEEDLE_BYTES), 1)
    kept = [c for c in rows.columns if c != text]
    texts = rows.where(F.col(text).isNotNull()).select(*kept, F.col(text).cast("string").alias("__text"))
    schema = rows.select(*kept).withColumn(needle, F.lit("")).schema

    def search(name: str, block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, block)
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b["__text"].to_pylist()):
                    here = {n for _, n in automaton.iter(t)}
                    at += [i] * len(here)
                    found += here
                    if len(found) > FOUND or (found and i == len(b) - 1):
                        yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(at, pa.int64())) for c in kept), pa.array(found, pa.string())], [*kept, needle])
                        at, found = [], []

        return run

    parts = []
    for k in range(blocks if size["n"] else 0):
        block = [r["needle"] for r in own.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == k).toLocalIterator()]
        if block:
            parts.append(texts.mapInArrow(search(uuid.uuid4().hex, spark.sparkContext.broadcast(block)), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
