"""Change impact: callers, owners, APIs, events, data, downstream services and tests, and what of it can be known at all.

nodes: label, id, name, path; edges: start_label, start_id, rel_type, end_label, end_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_test_path
from .graph import containers, downstream, reach
from .needles import substring_hits
from .tables import written

#: Which relationship to which label makes which category.
OWNED = [("EXPOSES", "API", "API"), ("PUBLISHES", "Event", "EVENT"), ("CONSUMES", "Event", "EVENT"), ("ACCESSES", "Database", "DATABASE"), ("ACCESSES", "Table", "TABLE")]
#: The links that each category needs, as (start label, relationship, end label), null: any.
NEEDED = {
    "SERVICE": [("Service", "CONTAINS", None)],
    "API": [(None, "EXPOSES", "API")],
    "EVENT": [(None, "PUBLISHES", "Event"), (None, "CONSUMES", "Event")],
    "DATABASE": [(None, "ACCESSES", "Database"), (None, "ACCESSES", "Table")],
    "TABLE": [("Database", "CONTAINS", "Table"), (None, "ACCESSES", "Table")],
    "DOWNSTREAM_SERVICE": [("Service", "DEPENDS_ON", "Service"), ("Service", "CALLS", "Service")],
    "TEST": [("Test", "VALIDATES", None)],
}


def coverage(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(category, status): KNOWN if the graph has any link that the category needs (for tests also a test file), else UNRESOLVED.

    One pass over the edges: an aggregate of flags.
    """

    def has(start, rel, end):
        hit = F.col("rel_type") == rel
        for c, label in (("start_label", start), ("end_label", end)):
            hit = hit & (F.col(c) == label) if label else hit
        return hit

    def any_of(links):
        out = F.lit(False)
        for link in links:
            out = out | has(*link)
        return F.coalesce(F.bool_or(out), F.lit(False))

    flags = edges.agg(*(any_of(links).alias(c) for c, links in NEEDED.items()))
    if files is not None:
        tests = files.agg(F.coalesce(F.bool_or(is_test_path(F.col("path"))), F.lit(False)).alias("has_tests"))
        flags = _with_tests(flags, tests)
    return flags.select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.when(F.col(c), "KNOWN").otherwise("UNRESOLVED").alias("status")) for c in NEEDED))).alias("x")).select("x.*")


def _with_tests(flags: DataFrame, tests: DataFrame) -> DataFrame:
    """Both have one row."""
    return flags.withColumn("one", F.lit(1)).join(tests.withColumn("one", F.lit(1)), "one").withColumn("TEST", F.col("TEST") | F.col("has_tests"))


def callers(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, category, depth): PRIMARY_CHANGE, DIRECT_CALLER, INDIRECT_CALLER, and TEST for callers in test files."""
    calls = edges.where("rel_type = 'CALLS'").select(F.col("start_id").alias("src"), F.col("end_id").alias("dst"))
    found = reach(calls, changed.select(F.col("id").alias("node")), max_depth)
    known = found.join(nodes.select(F.col("id").alias("node"), "path"), "node", "left")
    category = F.when(F.col("depth") == 0, "PRIMARY_CHANGE").when(is_test_path(F.col("path")), "TEST").when(F.col("depth") == 1, "DIRECT_CALLER").otherwise("INDIRECT_CALLER")
    return known.select(F.col("node").alias("id"), category.alias("category"), "depth")


def analyze(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 3, downstream_depth: int = 3) -> DataFrame:
    """changed: id. (category, id, depth, relationship): everything that a change touches, each item at its least depth.
    A start that is no known node is still reported, at depth 0.

    Code by callers; its classes and files; services that contain it within four steps; APIs, events, databases and tables that code, classes,
    files or services lead to, and tables of those databases; services downstream of the owning ones; tests that validate code.
    """
    code = written(callers(nodes, edges, changed, max_depth), "impact-code")  # read by all that follows
    link = lambda *rels: edges.where(F.col("rel_type").isin(*rels))
    holds = link("CONTAINS").select(F.col("start_id").alias("src"), F.col("end_id").alias("dst"), "start_label")
    inner = code.where("category != 'TEST'").select("id", "depth")
    up = holds.select(F.col("src").alias("owner"), F.col("dst").alias("id"), "start_label")
    classes = up.where("start_label = 'Class'").join(inner, "id").select(F.col("owner").alias("id"), "depth")
    files = up.where("start_label = 'File'").join(inner.unionByName(classes), "id").select(F.col("owner").alias("id"), "depth")
    anchors = written(inner.unionByName(classes).unionByName(files).groupBy("id").agg(F.min("depth").alias("depth")), "impact-anchors")
    service = nodes.where("label = 'Service'").select(F.col("id").alias("owner"))
    owned = containers(holds.select("src", "dst"), owners=service)
    services = owned.join(anchors.withColumnRenamed("id", "node"), "node").groupBy("owner").agg(F.min(F.col("depth") + F.col("hops")).alias("depth")).select(F.col("owner").alias("id"), "depth")
    services = written(services, "impact-services")
    every = anchors.unionByName(services)
    legal = F.lit(False)
    category = F.lit(None).cast("string")
    for rel, label, name in OWNED:
        own = (F.col("rel_type") == rel) & (F.col("end_label") == label)
        legal, category = legal | own, F.when(own, name).otherwise(category)
    things = edges.where(legal).select(F.col("start_id").alias("id"), F.col("end_id").alias("thing"), "rel_type", category.alias("category"))
    things = things.join(every, "id").select("category", F.col("thing").alias("id"), (F.col("depth") + 1).alias("depth"), F.col("rel_type").alias("relationship"))
    inside = edges.where("rel_type = 'CONTAINS' and start_label = 'Database' and end_label = 'Table'").select(F.col("start_id").alias("id"), F.col("end_id").alias("thing"))
    tables = things.where("category = 'DATABASE'").join(inside, "id").select(F.lit("TABLE").alias("category"), F.col("thing").alias("id"), (F.col("depth") + 1).alias("depth"), F.lit("CONTAINS").alias("relationship"))
    links = edges.where("rel_type in ('DEPENDS_ON', 'CALLS') and start_label = 'Service' and end_label = 'Service'").select(F.col("start_id").alias("src"), F.col("end_id").alias("dst"))
    below = downstream(links, services.select(F.col("id").alias("node")), downstream_depth).select(F.lit("DOWNSTREAM_SERVICE").alias("category"), F.col("node").alias("id"), "depth", F.col("directness").alias("relationship"))
    checks = link("VALIDATES").select(F.col("end_id").alias("id"), F.col("start_id").alias("test")).join(anchors, "id").select(F.lit("TEST").alias("category"), F.col("test").alias("id"), (F.col("depth") + 1).alias("depth"), F.lit("VALIDATES").alias("relationship"))
    level = lambda d, c, rel: d.select(F.lit(c).alias("category"), "id", "depth", F.lit(rel).alias("relationship"))
    out = code.select("category", "id", "depth", F.when(F.col("depth") > 0, "CALLS").alias("relationship"))
    # what contains the changed code itself is no impact
    for more in (level(classes.where("depth > 0"), "CLASS", "CONTAINS"), level(files.where("depth > 0"), "FILE", "CONTAINS"), level(services, "SERVICE", "CONTAINS"), things, tables, below, checks):
        out = out.unionByName(more)
    return out.groupBy("category", "id").agg(F.min(F.struct("depth", "relationship")).alias("x")).select("category", "id", "x.depth", "x.relationship")


def naming_convention_tests(files: DataFrame, functions: DataFrame, targets: DataFrame, known: DataFrame) -> DataFrame:
    """files: path; functions: path, name; targets: name; known: path, name. Functions of test files whose name has a target's name in it, without the known ones.

    Names are searched for all targets at once by an automaton.
    """
    tests = functions.join(files.where(is_test_path(F.col("path"))).select("path"), "path", "left_semi").select("path", "name").distinct()
    hits = substring_hits(tests.withColumn("__name", F.col("name")), "__name", targets.select(F.col("name").alias("target")), "target")
    return hits.join(known.select("path", "name"), ["path", "name"], "left_anti").select("path", "name", "target")


def name_call_impact(calls: DataFrame, chunks: DataFrame, start: str, max_depth: int = 3) -> DataFrame:
    """calls: src, dst by name; chunks: id, is_test. (id, depth, relation): callers by name; tests are reported but nothing is reached through them."""
    spread = written(calls.join(chunks.where("is_test").select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "name-calls")  # read twice
    found = reach(spread, calls.sparkSession.createDataFrame([(start,)], "node string"), max_depth).where("depth > 0")
    return found.join(chunks.select(F.col("id").alias("node"), "is_test"), "node").select(F.col("node").alias("id"), "depth", F.when(F.col("is_test"), "tests").otherwise("calls").alias("relation"))
