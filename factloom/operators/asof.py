"""As-of joins that prefer rows over a threshold: a sorted merge that carries a dominance stack, split inside keys.

Both sides are put into one order (key, time, right before left, ties) and dealt to tasks by ranges of that order, so a key with a third of all rows is several tasks'.
A task walks its range once. Of the right rows of the key at hand it keeps a stack: a row leaves it when a later one has at least its value, so values fall from the oldest to
the latest. The latest row above a threshold is found by bisection; each row is pushed and popped once.

What a task cannot know is the part of its first key that lies in earlier ranges. It leaves behind, for its last key, the greatest value, the last row and the
stack. The first two, one row a task, are looked at by all; a left row without an answer then knows which earlier range has it, and only that range's stack is
asked, by a window in the order of values.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Left rows that ask one copy of a stack.
ASKED = 200_000


def _like(batch: pa.RecordBatch, **types: pa.DataType | None) -> pa.Schema:
    """Fields of the given types, or of the batch's own."""
    return pa.schema([(name, t or batch.schema.field(name).type) for name, t in types.items()])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, k, side, v, p, row) in order. Out: kind 0: left rows; kind 1: the stack that a range leaves; kind 2: its greatest value and last row."""
    key, values, rows, last, first, part = None, [], [], None, True, None
    for b in batches:
        schema, out = _like(b, kind=pa.int32(), part=pa.int32(), k=None, v=None, p=None, row=None, open=pa.bool_()), []
        for part, k, side, v, p, row in zip(*(b[c].to_pylist() for c in ("part", "k", "side", "v", "p", "row")), strict=True):
            if k != key:
                first = key is None
                key, values, rows, last = k, [], [], None
            if side == 0:
                last = p
                if v is not None:
                    # values are kept negated, so that they rise
                    del rows[(at := bisect_left(values, -v)) :], values[at:]
                    values.append(-v)
                    rows.append(p)
            else:
                at = bisect_left(values, -v) if v is not None else 0
                found = rows[at - 1] if at else None
                out.append((0, part, k, v, found or last, row, first and not found))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
    if last is not None:
        left = [(1, part, key, -v, p, None, None) for v, p in zip(values, rows, strict=True)]
        left.append((2, part, key, -values[0] if values else None, last, None, None))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in left], schema=schema)


def _earlier(batches: Iterator[pa.RecordBatch], carried: dict) -> Iterator[pa.RecordBatch]:
    """Left rows that are still asking: the latest earlier range of their key with a greater value (target), else the key's last row before their range."""
    stairs: dict = {}
    for b in batches:
        schema, out = _like(b, row=None, v=None, p=None, target=pa.int32()), []
        for part, k, v, p, row in zip(*(b[c].to_pylist() for c in ("part", "k", "v", "p", "row")), strict=True):
            if (k, part) not in stairs:
                values, targets, last = [], [], None
                for earlier, most, own in carried.get(k, ()):
                    if earlier >= part:
                        break
                    last = own
                    if most is not None:
                        del targets[(at := bisect_left(values, -most)) :], values[at:]
                        values.append(-most)
                        targets.append(earlier)
                stairs[k, part] = values, targets, last
            values, targets, last = stairs[k, part]
            at = bisect_left(values, -v) if v is not None else 0
            out.append((row, v, p or last, targets[at - 1] if at else None))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)


def as_of_above(left: DataFrame, right: DataFrame, by: str, at: str, value: str, order: list[Column]) -> DataFrame:
    """left: row, by, at, value; right: by, at, value and more. For each left row the last right row not after it whose value is greater, or else the last one at all.

    Of right rows of one time the first by `order` counts as the last. The result is row and the right columns but `by`, as r_*. Null keys and times meet nothing; a null or NaN
    value is above nothing, and nothing is above it. Rows of left are told apart by `row`.
    """
    spark = left.sparkSession
    names = [c for c in right.columns if c != by]
    usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    payload = F.struct(*names)
    a = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("k"), F.col(at).alias("t"), F.lit(0).alias("side"), F.struct(*order).alias("o"), usable(value).alias("v"), payload.alias("p"), F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    asking = F.col(by).isNotNull() & F.col(at).isNotNull()
    b = left.where(asking).select(F.col(by).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(a.schema["o"].dataType).alias("o"), usable(value).alias("v"), F.lit(None).cast(a.schema["p"].dataType).alias("p"), "row")
    turn = ["k", "t", "side", F.col("o").desc(), "row"]
    both = a.unionByName(b).repartitionByRange(*turn).sortWithinPartitions(*turn).select(F.spark_partition_id().alias("part"), "k", "side", "v", "p", "row")
    shape = both.select(F.lit(0).alias("kind"), "part", "k", "v", "p", "row", F.lit(True).alias("open")).schema
    for f in shape.fields:
        f.nullable = True
    walked = written(both.mapInArrow(_merge, shape), "asof-ranges")
    carried: dict = {}
    for r in walked.where("kind = 2").select("k", "part", "v", "p").orderBy("part").collect():  # one row a range at most
        carried.setdefault(r["k"], []).append((r["part"], r["v"], r["p"].asDict(True)))
    shared = spark.sparkContext.broadcast(carried)
    told = walked.where("kind = 0 and not open").select("row", "p")
    out_shape = walked.select("row", "v", "p", F.col("part").alias("target")).schema
    asked = written(walked.where("kind = 0 and open").select("part", "k", "v", "p", "row").mapInArrow(lambda it: _earlier(it, shared.value), out_shape), "asof-asked")
    # each copy of a stack is asked by some rows: in the order of falling values a row comes before the stack's equal values, and the last one before it is its answer
    copies = written(asked.where("target is not null").groupBy(F.col("target").alias("part")).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("copies")), "asof-copies")
    stack = walked.where("kind = 1").join(F.broadcast(copies), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "v", F.lit(1).alias("side"), "p", F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    routed = asked.where("target is not null").select(F.col("target").alias("part"), "v", "row").join(F.broadcast(copies), "part")
    routed = routed.select("part", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int").alias("copy"), "v", F.lit(0).alias("side"), F.lit(None).cast(a.schema["p"].dataType).alias("p"), "row")
    w = Window.partitionBy("part", "copy").orderBy(F.col("v").desc(), "side").rowsBetween(Window.unboundedPreceding, 0)
    found = stack.unionByName(routed).withColumn("p", F.last("p", ignorenulls=True).over(w)).where("side = 0").select("row", "p")
    none = left.where(~asking).select("row", F.lit(None).cast(a.schema["p"].dataType).alias("p"))
    whole = told.unionByName(asked.where("target is null").select("row", "p")).unionByName(found).unionByName(none)
    return whole.select("row", *(F.col(f"p.{c}").alias(f"r_{c}") for c in names))

