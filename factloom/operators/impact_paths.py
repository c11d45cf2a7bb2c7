"""How a change reaches what it touches: each element with the routes from the changed code to it, and what the graph cannot tell.

A route is an array of steps (id, name, category, label, relationship, direction), the changed code first. Of an element's routes the
first `limit` by their steps are kept. What a route is built on is cut to limit + 1 too, which loses none that would stay: routes grow at their
end, so their order is decided by what they are built on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_test_path
from .facts import unresolved_call_sites
from .graph import callers_beyond, containers, shortest_chains, shortest_predecessors
from .impact import OWNED, callers, coverage, naming_convention_tests
from .rules import status_of
from .tables import written

STEP = "struct<id:string,name:string,category:string,label:string,relationship:string,direction:string>"


def _step(id_: Column, name: Column, category: Column, label: Column, rel: Column, direction: Column) -> Column:
    return F.struct(id_.cast("string").alias("id"), F.coalesce(name, id_).cast("string").alias("name"), category.alias("category"), label.alias("label"), rel.cast("string").alias("relationship"), direction.cast("string").alias("direction"))


def _cut(routes: DataFrame, limit: int) -> DataFrame:
    """routes: category, id, steps. The limit + 1 first of each element."""
    own = Window.partitionBy("category", "id").orderBy("steps")
    return routes.distinct().withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= limit + 1).drop("__r")


def _longer(routes: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """links: id, next, name, category, label, relationship, direction. Routes to the next elements."""
    more = links.select("id", F.col("next"), F.col("category").alias("to"), _step(F.col("next"), F.col("name"), F.col("category"), F.col("label"), F.col("relationship"), F.col("direction")).alias("step"))
    grown = routes.select("id", "steps").join(more, "id").select(F.col("to").alias("category"), F.col("next").alias("id"), F.array_append("steps", F.col("step")).alias("steps"))
    return _cut(grown, limit)


def code_routes(nodes: DataFrame, calls: DataFrame, code: DataFrame, max_depth: int, limit: int) -> DataFrame:
    """code: id, category, depth, as callers() gives it. (category, id, steps): the shortest chains of calls back to the changed code."""
    depths = code.select(F.col("id").alias("node"), "depth")
    start = code.where("depth = 0").select(F.col("id").alias("node"))
    chains = shortest_chains(shortest_predecessors(calls, depths), start, max_depth, limit + 1)
    each = chains.withColumn("route", F.monotonically_increasing_id())
    each = written(each.select("route", "node", "chain"), "routes")  # the number of a route must not change
    steps = each.select("route", F.posexplode("chain").alias("pos", "id")).join(code.select("id", "category"), "id").join(nodes.select("id", "name", "label"), "id", "left")
    first = F.col("pos") == 0
    one = _step(F.col("id"), F.col("name"), F.col("category"), F.col("label"), F.when(~first, "CALLS"), F.when(~first, "REVERSE"))
    whole = steps.groupBy("route").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", one.alias("s")))), lambda x: x["s"]).alias("steps"))
    return each.join(whole, "route").join(code.select(F.col("id").alias("node"), "category"), "node").select("category", F.col("node").alias("id"), "steps")


def impact_routes(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 3, downstream_depth: int = 3, limit: int = 10) -> DataFrame:
    """nodes: label, id, name, path; edges: start_label, start_id, rel_type, end_label, end_id; changed: id. (category, id, steps, capped), capped where an element has more routes.

    Elements are those of impact.analyze(), and tests that only their names tie to the changed code (relationship NAMING_CONVENTION, without a
    direction). The changed code itself, its class and its file are no elements.
    """
    code = written(callers(nodes, edges, changed, max_depth), "route-code")
    calls = edges.where("rel_type = 'CALLS'").select(F.col("start_id").alias("src"), F.col("end_id").alias("dst"))
    routes = written(code_routes(nodes, calls, code, max_depth, limit), "route-chains")
    inner = routes.where("category != 'TEST'")
    named = nodes.select(F.col("id").alias("next"), "name")
    holds = edges.where("rel_type = 'CONTAINS'").select(F.col("start_id").alias("next"), F.col("end_id").alias("id"), "start_label")

    def links(rows: DataFrame, category: Column | str, label: Column | str, rel: Column | str, direction: str | None) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
        return rows.join(named, "next", "left").select("id", "next", "name", lit(category).alias("category"), lit(label).alias("label"), lit(rel).alias("relationship"), F.lit(direction).cast("string").alias("direction"))

    up = lambda label: links(holds.where(F.col("start_label") == label), label.upper(), label, "CONTAINS", "REVERSE")
    classes = written(_longer(inner, up("Class"), limit), "route-classes")
    files = written(_cut(_longer(inner, up("File"), limit).unionByName(_longer(classes, up("File"), limit)), limit), "route-files")
    anchors = inner.unionByName(classes).unionByName(files)
    service = nodes.where("label = 'Service'").select(F.col("id").alias("owner"))
    owned = containers(holds.select(F.col("next").alias("src"), F.col("id").alias("dst")), owners=service).select(F.col("owner").alias("next"), F.col("node").alias("id")).distinct()
    services = written(_longer(anchors, links(owned, "SERVICE", "Service", "CONTAINS", "REVERSE"), limit), "route-services")
    legal, category = F.lit(False), F.lit(None).cast("string")
    for rel, label, name in OWNED:
        own = (F.col("rel_type") == rel) & (F.col("end_label") == label)
        legal, category = legal | own, F.when(own, name).otherwise(category)
    owners = edges.where(legal).select(F.col("start_id").alias("id"), F.col("end_id").alias("next"), "end_label", "rel_type", category.alias("kind"))
    things = written(_longer(anchors.unionByName(services), links(owners, F.col("kind"), F.col("end_label"), F.col("rel_type"), "FORWARD"), limit), "route-things")
    inside = edges.where("rel_type = 'CONTAINS' and start_label = 'Database' and end_label = 'Table'").select(F.col("start_id").alias("id"), F.col("end_id").alias("next"))
    tables = _longer(things.where("category = 'DATABASE'"), links(inside, "TABLE", "Table", "CONTAINS", "FORWARD"), limit)
    between = edges.where("rel_type in ('DEPENDS_ON', 'CALLS') and start_label = 'Service' and end_label = 'Service'").select(F.col("start_id").alias("id"), F.col("end_id").alias("next"), "rel_type")
    seen, level, below = services.select("id").distinct(), services, []
    for depth in range(1, downstream_depth + 1):
        fresh = between.join(seen.select(F.col("id").alias("next")), "next", "left_anti")
        level = written(_longer(level, links(fresh, "DOWNSTREAM_SERVICE", "Service", F.col("rel_type"), "FORWARD"), limit), f"route-downstream-{depth}")
        if level.isEmpty():
            break
        below.append(level)
        seen = seen.unionByName(level.select("id").distinct())
    checks = edges.where("rel_type = 'VALIDATES'").select(F.col("end_id").alias("id"), F.col("start_id").alias("next"))
    tests = _longer(anchors, links(checks, "TEST", "Test", "VALIDATES", "REVERSE"), limit)
    own = changed.select("id").distinct()
    outside = lambda d: d.join(holds.join(own, "id", "left_semi").select(F.col("next").alias("id")), "id", "left_anti")
    first_files = holds.where("start_label = 'File'").join(holds.where("start_label = 'Class'").join(own, "id", "left_semi").select(F.col("next").alias("id")), "id", "left_semi").select(F.col("next").alias("id"))
    parts = [routes.where("category != 'PRIMARY_CHANGE'"), outside(classes), outside(files).join(first_files, "id", "left_anti"), services, things, tables, *below, tests]
    # read twice, and a plan of all branches once more would take longer than they do
    whole = written(reduce(DataFrame.unionByName, [p.select("category", "id", "steps") for p in parts]), "route-all")
    known = whole.where("category = 'TEST'").select("id").distinct()
    whole = whole.unionByName(_by_name(nodes, routes.where("category = 'PRIMARY_CHANGE'"), known))
    per = Window.partitionBy("category", "id")
    ranked = whole.distinct().withColumn("__r", F.row_number().over(per.orderBy("steps"))).withColumn("__n", F.count("*").over(per))
    return ranked.where(F.col("__r") <= limit).select("category", "id", "steps", (F.col("__n") > limit).alias("capped"))


def _by_name(nodes: DataFrame, primary: DataFrame, known: DataFrame) -> DataFrame:
    """Routes to the functions and methods of test files with the changed code's name in theirs, which no edge has found."""
    code = nodes.where("label in ('Function', 'Method')").select("id", "path", "name")
    targets = code.join(primary.select("id").distinct(), "id", "left_semi").select("name")
    files = code.select("path").distinct()
    hits = naming_convention_tests(files, code.select("path", "name"), targets, code.join(known, "id", "left_semi").select("path", "name"))
    start = primary.join(code.select("id", F.col("name").alias("target")), "id").select("target", "steps").join(hits, "target")
    id_ = F.concat("path", F.lit("::"), "name")
    step = _step(id_, F.col("name"), F.lit("TEST"), F.lit("Function"), F.lit("NAMING_CONVENTION"), F.lit(None))
    return start.select(F.lit("TEST").alias("category"), id_.alias("id"), F.array_append("steps", step).alias("steps"))


def unresolved(nodes: DataFrame, edges: DataFrame, changed: DataFrame, routes: DataFrame, max_depth: int = 3, limit: int = 10) -> DataFrame:
    """(category, reason): what the graph cannot tell: categories without any link, callers beyond max_depth, calls of the name that were not resolved, cut routes.

    nodes with unresolved_calls (an array) too. A changed id that is no method or function is the one reason that there is then.
    """
    code = nodes.where("label in ('Method', 'Function')")
    primary = code.join(changed.select("id").distinct(), "id", "left_semi")
    lost = changed.select("id").distinct().join(code.select("id"), "id", "left_anti").select(F.lit("PRIMARY_CHANGE").alias("category"), F.concat("id", F.lit(" is no method or function of the graph")).alias("reason"))
    depths = written(callers(nodes, edges, changed, max_depth).select(F.col("id").alias("node"), "depth"), "unresolved-depths")
    files = nodes.where("label = 'File'").select("path")
    gaps = coverage(edges, files).where("status = 'UNRESOLVED'").select("category", F.lit("the graph has no link of this kind").alias("reason"))
    calls = edges.where("rel_type = 'CALLS'").select(F.col("start_id").alias("src"), F.col("end_id").alias("dst"))
    more = callers_beyond(calls, depths, max_depth).where("n > 0").select(F.lit("INDIRECT_CALLER").alias("category"), F.format_string(f"%d callers lie beyond depth {max_depth}", F.col("n")).alias("reason"))
    found = unresolved_call_sites(code.join(depths.select(F.col("node").alias("id")), "id", "left_anti"), primary.select("name")).withColumnRenamed("name", "ends")
    reason = F.concat("name", F.lit(" has an unresolved call "), "call", F.lit(" that ends in "), "ends")
    sites = found.join(code.select("id", "name"), "id").select(F.lit("DIRECT_CALLER").alias("category"), reason.alias("reason"))
    capped = routes.where("capped").limit(1).select(F.lit("PRIMARY_CHANGE").alias("category"), F.lit(f"some elements have over {limit} routes").alias("reason"))
    return reduce(DataFrame.unionByName, [lost, gaps, more, sites, capped])


def status(items: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row (status): UNRESOLVED if the changed code is not known, PARTIALLY_RESOLVED if anything is missing, else RESOLVED."""
    found = items.where("category = 'PRIMARY_CHANGE'").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    missing = gaps.agg(F.count("*").alias("m"), F.count_if((F.col("category") == "PRIMARY_CHANGE") & F.contains("reason", F.lit("no method or function"))).alias("lost"), F.lit(1).alias("one"))
    return found.join(missing, "one").select(status_of(F.col("n") - F.col("lost"), F.col("m")).alias("status"))


#: The kinds of the elements in the impact contract; callers have the kind of their label.
KINDS = {"CLASS": "class", "FILE": "file", "SERVICE": "service", "API": "api", "EVENT": "event", "DATABASE": "database", "TABLE": "table", "DOWNSTREAM_SERVICE": "service", "TEST": "test"}


def contract(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """items: category, id, depth, relationship, as analyze() gives them. (id, kind, name, location, depth, relation) of all but the changed code."""
    out = items.where("category != 'PRIMARY_CHANGE'").join(nodes.select("id", "label", "name", "path"), "id", "left")
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("category")], F.lower("label"), F.lit("function"))
    location = F.when(F.col("category") == "FILE", F.col("path")).when((F.col("path") != "") & F.col("name").isNotNull(), F.concat("path", F.lit("::"), "name"))
    relation = F.when(F.col("relationship").isin("VALIDATES", "NAMING_CONVENTION"), "tests").otherwise(F.lower(F.coalesce("relationship", F.lit("calls"))))
    return out.select("id", kind.alias("kind"), F.coalesce("name", "id").alias("name"), location.alias("location"), "depth", relation.alias("relation"))


def grouped(contract_rows: DataFrame) -> DataFrame:
    """Rows of contract() with `part`: tests, direct (one step away) or potential, each in just one."""
    return contract_rows.withColumn("part", F.when(F.col("kind") == "test", "tests").when(F.col("depth") <= 1, "direct").otherwise("potential"))


def is_test_chunk(path: Column, name: Column) -> Column:
    """Whether a chunk is a test: its file's or its own last name begins with test_."""
    return F.startswith(F.substring_index(path, "/", -1), F.lit("test_")) | F.startswith(F.substring_index(name, ".", -1), F.lit("test_"))


def in_order(items: DataFrame) -> DataFrame:
    """Items by depth, name and id."""
    return items.orderBy("depth", "name", "id")


__all__ = ["code_routes", "contract", "grouped", "impact_routes", "in_order", "is_test_chunk", "is_test_path", "status", "unresolved"]
