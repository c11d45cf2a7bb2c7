"""Joins that resolve: first rule wins, exactly one candidate or none, suffix, as-of, interval and band joins.

None of them guesses: no candidate or several leave a row unresolved, with a reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import location_file, location_name, path_suffixes
from .tables import written


def edge_pattern(edges: DataFrame, nodes: DataFrame, start_label: str, rel_type: str, end_label: str) -> DataFrame:
    """(start_id, start_name, end_id, end_name) of (:start_label)-[:rel_type]->(:end_label)."""
    of = lambda label, side: nodes.where(F.col("label") == label).select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    own = edges.where(F.col("rel_type") == rel_type).select("start_id", "end_id")
    return own.join(of(start_label, "start"), "start_id").join(of(end_label, "end"), "end_id").select("start_id", "start_name", "end_id", "end_name")


def unique_match(left: DataFrame, candidates: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """left with `value` where `candidates` (key, value) has just one for its key, and status and reason otherwise."""
    one = candidates.select(key, value).distinct().groupBy(key).agg(F.count("*").alias("__n"), F.min(value).alias(value))
    n = F.coalesce("__n", F.lit(0))
    out = left.join(one, key, "left")
    return out.select(
        *left.columns,
        F.when(n == 1, F.col(value)).alias(value),
        F.when(n == 1, "RESOLVED").otherwise("UNRESOLVED").alias("status"),
        F.when(n == 0, F.concat(F.lit(f"no {what} matches"))).when(n > 1, F.format_string(f"%d {what}s match", n)).alias("reason"),
    )


def first_rule(left: DataFrame, row: str, rules: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """rules: (name, (row, value)), the first one that has the row decides. left with value and `rule`, null where none has it.

    All rules' candidates are one union, ranked and joined once, so a rule never multiplies rows.
    """
    found = [d.select(F.col(row).alias("__row"), F.col(value).alias(value), F.lit(i).alias("__rank"), F.lit(name).alias("rule")) for i, (name, d) in enumerate(rules)]
    best = reduce(DataFrame.unionByName, found).groupBy("__row").agg(F.min(F.struct("__rank", value, "rule")).alias("__best"))
    return left.join(best, left[row] == best["__row"], "left").select(*left.columns, F.col(f"__best.{value}").alias(value), F.col("__best.rule").alias("rule"))


def suffix_matches(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frames: frame_path; files: path. (frame_path, path): equal paths, else files that a frame's path ends with.

    Suffixes are exploded, so this is an equi join on the path whatever the number of files.
    """
    own = frames.select("frame_path").distinct()
    parts = own.select("frame_path", F.explode(path_suffixes(F.col("frame_path"))).alias("path"))
    hits = parts.join(files.select("path").distinct(), "path").withColumn("exact", F.col("path") == F.col("frame_path"))
    best = Window.partitionBy("frame_path")
    return hits.withColumn("any_exact", F.max("exact").over(best)).where("exact or not any_exact").select("frame_path", "path")


def resolve_locations(locations: DataFrame, index: DataFrame) -> DataFrame:
    """locations: location; index: id. (location, resolved): the indexed id of the same name whose file is the location's or a
    suffix of it, or the other way round, if there is just one; otherwise the location as it is.
    """
    own = locations.select("location").distinct()
    ids = index.select("id").distinct()
    exact = own.join(ids, own["location"] == ids["id"], "left_semi").withColumn("exact", F.lit(True))
    parts = lambda df, c: df.select(c, location_name(F.col(c)).alias("name"), location_file(F.col(c)).alias("file")).where("name is not null")
    a, b = parts(own, "location"), parts(ids, "id")
    longer = a.select("location", "name", F.explode(path_suffixes(F.col("file"))).alias("file")).join(b, ["name", "file"])
    shorter = b.select("id", "name", F.explode(path_suffixes(F.col("file"))).alias("file")).join(a, ["name", "file"])
    hits = longer.select("location", "id").unionByName(shorter.select("location", "id")).distinct()
    one = hits.groupBy("location").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    out = own.join(exact, "location", "left").join(one, "location", "left")
    return out.select("location", F.when(F.col("exact").isNull() & (F.col("n") == 1), F.col("id")).otherwise(F.col("location")).alias("resolved"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, order: list[Column], prefer: Column | None = None) -> DataFrame:
    """left: row, by, at; right: by, at and more. For each left row the right row of the greatest `at` that is not after its own.

    prefer: a condition over l.* and r.*; rows that meet it win over later ones that don't. order: ties.
    Without prefer it is one window over the union of both sides, each row carrying the last right row before it, so a
    key's rows are sorted once and no pairs are made. With prefer candidates are joined and the best one is kept by an aggregate.
    """
    names = [c for c in right.columns if c != by]
    if prefer is None:
        right_rows = right.select(F.col(by), F.col(at).alias("__at"), F.lit(0).alias("__side"), F.struct(*names).alias("__right"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.struct(*order).alias("__order"))
        left_rows = left.select(F.col(by), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right_rows.schema["__right"].dataType).alias("__right"), "row", F.lit(None).cast(right_rows.schema["__order"].dataType).alias("__order"))
        w = Window.partitionBy(by).orderBy("__at", "__side", F.col("__order").desc()).rowsBetween(Window.unboundedPreceding, 0)
        last = right_rows.unionByName(left_rows).withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
        return last.select("row", *(F.col(f"__last.{c}").alias(f"r_{c}") for c in names))
    pairs = left.alias("l").join(right.alias("r"), (F.col(f"l.{by}") == F.col(f"r.{by}")) & (F.col(f"r.{at}") <= F.col(f"l.{at}")))
    best = F.struct((~prefer).alias("a"), (-F.col(f"r.{at}")).alias("b"), *[c.alias(f"o{i}") for i, c in enumerate(order)], *(F.col(f"r.{c}").alias(f"r_{c}") for c in names))
    won = pairs.groupBy(F.col("l.row").alias("row")).agg(F.min(best).alias("won"))
    return left.select("row").join(won, "row", "left").select("row", *(F.col(f"won.r_{c}").alias(f"r_{c}") for c in names))


def as_of_same(left: DataFrame, right: DataFrame, by: str, same: str, at: str, order: list[Column]) -> DataFrame:
    """as_of() that prefers rows with an equal `same` to later ones: one window over (by, same) and one over by, so no pairs are made.

    left: row, by, same, at. Null names are equal to none.
    """
    key = F.when(F.col(same).isNotNull() & F.col(by).isNotNull(), F.struct(by, same))
    near = as_of(left.select("row", key.alias("__key"), at).where("__key is not null"), right.withColumn("__key", key).where("__key is not null"), "__key", at, order)
    any_ = as_of(left.select("row", by, at), right, by, at, order)
    names = [c for c in any_.columns if c != "row"]
    pick = lambda d, name: d.select("row", F.struct(*names).alias(name))
    both = pick(any_, "__any").join(pick(near, "__near"), "row", "left")
    found = F.coalesce(F.col(f"__near.r_{at}").isNotNull(), F.lit(False))
    return both.select("row", *(F.when(found, F.col(f"__near.{c}")).otherwise(F.col(f"__any.{c}")).alias(c) for c in names))


def dyadic_blocks(first: Column, last: Column) -> Column:
    """The blocks (level, block) that [first, last] is made of: block b of level k holds the 2^k numbers from b 2^k on; two of a level at most.

    Of each level at most the block at the left end and the one at the right end are left over by the coarser ones, so a span of n numbers has at
    most 2 log2 n blocks. Numbers may be negative; empty spans have no blocks.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("int")
    first, end = first.cast("long"), last.cast("long") + 1
    shifted = lambda x, k: F.call_function("shiftright", x, k)

    def of_level(k: Column) -> Column:
        left, right = -shifted(-first, k), shifted(end, k)  # rounded up, rounded down
        odd = lambda x: x.bitwiseAND(one) == 1
        return F.array(F.when((left < right) & odd(left), F.struct(k.alias("level"), left.alias("block"))), F.when((left < right) & odd(right), F.struct(k.alias("level"), (right - 1).alias("block"))))

    levels = F.sequence(zero, F.floor(F.log2(F.greatest(end - first, one).cast("double"))).cast("int") + 1)
    return F.filter(F.flatten(F.transform(levels, of_level)), lambda x: x.isNotNull())


def innermost(points: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """points: row, by, line; spans: by, first, last, name. Each point's innermost span around it (the latest start, then the earlier end, then name).

    A span is laid out as its dyadic blocks, and each block keeps one span; a point looks into the blocks around it, one of each level that some span
    has (64 at most). So a span costs the logarithm of its length, a point that of the longest span, and no pairs are made. Rows of points are told apart by `row`.
    """
    laid = spans.where("first <= last").select(by, F.struct("first", (-F.col("last")).alias("end"), "name").alias("s"), F.explode(dyadic_blocks(F.col("first"), F.col("last"))).alias("x"))
    best = written(laid.groupBy(by, "x.level", "x.block").agg(F.max("s").alias("s")), "interval-blocks")
    levels = sorted(r["level"] for r in best.select("level").distinct().collect())
    around = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col("line").cast("long"), k).alias("block")) for k in levels)) if levels else F.array().cast("array<struct<level:int,block:long>>")
    asked = points.where(F.col(by).isNotNull() & F.col("line").isNotNull()).select("row", by, F.explode(around).alias("x")).select("row", by, "x.level", "x.block")
    hit = asked.join(best, [by, "level", "block"]).groupBy("row").agg(F.max("s").alias("s"))
    return points.select("row").join(hit, "row", "left").select("row", F.col("s.name").alias("name"), F.col("s.first").alias("first"), (-F.col("s.end")).alias("last"))


def band(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """left: row, ts; right: other, ts. (row, other, delta): pairs at most `seconds` apart.

    Time is cut into buckets of that length; the right side stands in its own and the two next ones, so the join is on
    the bucket and only near rows meet.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000
    bucket = lambda t: F.floor(t / max(width, 1))
    a = left.where("ts is not null").select("row", at("ts").alias("a"), bucket(at("ts")).alias("bucket"))
    b = right.where("ts is not null").select("other", at("ts").alias("b"), F.explode(F.array(*(bucket(at("ts")) + i for i in (-1, 0, 1)))).alias("bucket"))
    hits = a.join(b, "bucket").where(F.abs(F.col("a") - F.col("b")) <= width)
    return hits.select("row", "other", ((F.col("b") - F.col("a")) / 1_000_000).alias("delta"))


def first_of_target(imports: DataFrame) -> DataFrame:
    """imports: file, target, line, ord. At most one row of a file and target, the first import of it; imports of itself go."""
    own = imports.where("target is not null and file != target")
    return own.groupBy("file", "target").agg(F.min(F.struct("ord", "line")).alias("f")).select("file", "target", F.col("f.line").alias("line"))


def paired(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Rows of both sides that are the only ones of their `by` on their side, next to each other (b_*, a_*); null keys pair with nothing."""
    alone = Window.partitionBy(by)
    one = lambda d, p: d.where(F.col(by).isNotNull()).withColumn("__n", F.count("*").over(alone)).where("__n = 1").select(F.col(by), *(F.col(c).alias(f"{p}_{c}") for c in d.columns if c != by))
    return one(before, "b").join(one(after, "a"), by)


def cited(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citations: claim, cited; evidence: claim, n. Citations E<n>, spaces and case aside, with `known` for those that exist, each once."""
    wanted = citations.select("claim", F.upper(F.trim("cited")).alias("key")).distinct()
    there = evidence.select("claim", F.concat(F.lit("E"), F.col("n").cast("string")).alias("key"), F.lit(True).alias("known"))
    return wanted.join(there, ["claim", "key"], "left").select("claim", "key", F.coalesce("known", F.lit(False)).alias("known"))
