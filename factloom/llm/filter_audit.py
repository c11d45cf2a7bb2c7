"""Filter interaction audit by mask histograms (operator 11), in DataFrame functions only.

A document's failures are a bit mask: one bit a filter, from native expressions over its text; the last bit is "identical to the text of a
smaller doc_id". That one needs a grouping by text: rows go by the SHA-256 of their text, so no text is shuffled. Of each text
its smallest doc_id passes; all its other rows fail, so they are counted as all rows less those, and no row has to meet the others of its text. What is
left of the corpus is a histogram: 2^5 cells a part. Every order of the filters is worked out from the cells alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, materialise, table

WHITE = " \t\n\x0b\x0c\r"


def production_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the query, by letter: few words, repetitive words, capitals, symbols."""
    bare = F.btrim(text, F.lit(WHITE))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    count = lambda of: F.when(bare == "", F.lit(0)).otherwise(F.size(of)).cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": count(words) < 200,
        "B": 100 * count(F.array_distinct(words)) < 50 * count(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, filters=production_filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (bit i: the i-th filter fails; the bit after the last: a copy of a smaller doc_id), n, good, toxic: rows with each mask.

    filters: from the text column to failure conditions by letter. Null texts are empty; a null part is the empty string. A null doc_id is larger than all
    others and has no label; rows that share text and doc_id are no copies of each other. A doc_id that labels has several times is good or
    toxic if one of its rows says so. Other columns of docs are left behind.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = list(filters(F.col("text")).values())
    mask = reduce(Column.__add__, (F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)))
    seen = rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), "doc_id", "part", mask.alias("mask"))
    seen = seen.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("good + toxic > 0")
    said = materialise(said.withColumn("__none", F.lit(False)), "audit-labels")
    # rows without a doc_id match nothing and are dealt by their text; a hot doc_id is left to the runtime's split of skewed joins
    own = seen.select("*", F.coalesce("doc_id", F.xxhash64("digest")).alias("__key"), F.col("doc_id").isNull().alias("__null"))
    side = F.broadcast(said) if said.count() <= MAX_BROADCAST_ROWS else said
    told = own.join(side, (F.col("__key") == F.col("__id")) & (F.col("__null") == F.col("__none")), "left")
    good, toxic = (F.col("n") * F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic"))
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", good.alias("good"), toxic.alias("toxic"))
    texts = told.groupBy("digest", "mask", "part").agg(F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"), F.min(least).alias("least"))
    texts = materialise(texts, "audit-texts")
    first = texts.groupBy(F.col("digest").alias("__digest")).agg(F.min(F.struct("least.none", "least.doc_id")).alias("first"))
    passing = texts.join(first, (F.col("digest") == F.col("__digest")) & F.col("least.doc_id").eqNullSafe(F.col("first.doc_id")))
    copy = 1 << len(fails)
    sums = ("n", "good", "toxic")
    parts = [
        texts.select("part", (F.col("mask") + copy).alias("mask"), *sums),
        passing.select("part", (F.col("mask") + copy).alias("mask"), *((-F.col(f"least.{c}")).alias(c) for c in sums)),
        passing.select("part", "mask", *(F.col(f"least.{c}").alias(c) for c in sums)),
    ]
    cells = reduce(DataFrame.unionByName, parts).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in sums))
    return cells.where("n > 0")


def order_effects(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, filter_order (all orders of letters) and step: what the filters do one after the other, from the cells of mask_cells alone.

    A filter's shapley value is a sum over its cells: in a cell of m failures it is the first of these in 1 / m of all orders.
    """
    orders = factorial(len(letters))
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    each = held.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))))
    each = each.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    before_of = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    bits = lambda of: reduce(Column.__add__, (F.when(F.instr(of, c) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters)))
    each = each.select("part", "cells", "filter_order", "step", bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))).alias("own"), bits(before_of).alias("before"))

    def total(value, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(where(c["mask"]), value(c)).otherwise(F.lit(0).cast("long")))

    own, before = F.col("own"), F.col("before")
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    now = lambda m: fails(m) & ~gone(m)
    rows = lambda c: c["n"]
    share = lambda c: (c["n"] * F.lit(orders) / F.bit_count(c["mask"])).cast("long")
    return each.select(
        "part", "filter_order", "step",
        total(rows, lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(rows, now).alias("removed"),
        total(rows, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(rows, lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], now).alias("good_lost"),
        total(lambda c: c["toxic"], now).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters=production_filters, copies: str = "E", **columns: str) -> DataFrame:
    """order_effects of the filters, and of the filter `copies` (its letter), on docs. An empty table has no part and no row."""
    letters = "".join(filters(F.lit(""))) + copies
    return order_effects(materialise(mask_cells(docs, labels, filters, **columns), "audit-cells"), letters)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of the five filters on all documents."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
marks AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  doc_id <> min(doc_id) OVER (PARTITION BY t) AS e, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM d),
cells AS (SELECT part, [a, b, c, d, e] AS f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marks GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM l p, l q, l r, l s, l u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, l.i AS step, o[l.i] AS own, o[:l.i - 1] AS before FROM orders, l),
met AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len(list_filter(before, lambda x: f[x])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS many FROM cells, steps),
effects AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM effects
"""
