"""Architecture snapshots: merging what several files declare, and the difference of two revisions.

Entities are (key, entity_type, name, properties, meta), relationships (rel_type, source, target, properties),
evidence (owner, file); maps are string to string, and are compared by their sorted entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import relationship_id

#: Entity types in their order.
ENTITY_TYPES = ["SERVICE", "API", "EVENT", "DATABASE", "TABLE", "DEPENDENCY", "RELATIONSHIP"]


def entries(m: Column) -> Column:
    """A map as its sorted entries, which can be compared and hashed; null counts as empty."""
    return F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))


def merged_properties(declared: DataFrame, key: list[str]) -> DataFrame:
    """declared: key, properties, ord. Properties of each key; where values differ, all distinct ones in order, joined by ", "."""
    each = declared.select(*key, "ord", F.explode("properties").alias("property", "value"))
    split = each.select(*key, "property", F.explode(F.split("value", ", ")).alias("part"), "value")
    several = split.groupBy(*key, "property").agg(
        F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(F.array_join(F.array_sort(F.collect_set("part")), ", ")).alias("value")
    )
    return several.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "value")))).alias("properties"))


def merge_entities(declared: DataFrame) -> DataFrame:
    """declared: key, entity_type, name, properties, meta, ord. One entity for each key: the first declaration's type and name,
    merged properties, and of each meta entry the first value."""
    first = declared.groupBy("key").agg(F.min_by(F.struct("entity_type", "name"), "ord").alias("f"))
    meta = declared.select("key", "ord", F.explode("meta").alias("k", "v")).groupBy("key", "k").agg(F.min_by("v", "ord").alias("v"))
    meta = meta.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("meta"))
    empty = F.create_map().cast("map<string,string>")
    out = first.join(merged_properties(declared, ["key"]), "key", "left").join(meta, "key", "left")
    return out.select("key", "f.entity_type", "f.name", F.coalesce("properties", empty).alias("properties"), F.coalesce("meta", empty).alias("meta"))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """evidence: owner, source, file, line, details, relationship, ord. Each piece of an owner once, at its first place."""
    own = ["owner", "source", "file", "line", "details", "relationship"]
    return evidence.groupBy(*own).agg(F.min("ord").alias("ord"))


def content_hash(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row (hash): a digest of a snapshot that no order of its rows changes.

    Rows are hashed where they are, the rows of a bucket of hashes are combined in order, then the 256 buckets.
    """
    a = entities.select(F.sha2(F.to_json(F.struct(F.lit("e"), "key", "entity_type", "name", entries(F.col("properties")), entries(F.col("meta")))), 256).alias("h"))
    b = relationships.select(F.sha2(F.to_json(F.struct(F.lit("r"), "rel_type", "source", "target", entries(F.col("properties")))), 256).alias("h"))
    sums = a.unionByName(b).groupBy(F.substring("h", 1, 2).alias("bucket"))
    # a bucket's digest adds up four parts of its rows' hashes, so no list of rows is gathered
    part = lambda i: F.sum(F.conv(F.substring("h", 3 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    digests = sums.agg(F.count("*").alias("n"), *(part(i).alias(f"s{i}") for i in range(4)))
    one = digests.select(F.concat_ws(":", "bucket", "n", "s0", "s1", "s2", "s3").alias("d"))
    return one.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ";"), 256).alias("hash"))


def _sides(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    struct = lambda d, name: d.select(*key, F.struct(*(c for c in d.columns if c not in key)).alias(name))
    return struct(previous, "before").join(struct(current, "after"), key, "full_outer")


def pair_apis(previous: DataFrame, current: DataFrame) -> DataFrame:
    """APIs that moved: (before_key, after_key, category) of a removed and an added API with one handler, both the only ones of it,
    that differ in the path alone or in the method alone."""
    gone, new = (a.where("entity_type = 'API'").join(b.select("key"), "key", "left_anti") for a, b in ((previous, current), (current, previous)))
    handled = lambda d: d.where(F.coalesce(F.col("meta")["handler"], F.lit("")) != "").select(F.concat(F.coalesce(F.col("meta")["service"], F.lit("")), F.lit("::"), F.col("meta")["handler"]).alias("handler"), "key", "properties").withColumn("n", F.count("*").over(Window.partitionBy("handler"))).where("n = 1")
    a = handled(gone).select("handler", F.col("key").alias("before_key"), F.col("properties").alias("b"))
    b = handled(new).select("handler", F.col("key").alias("after_key"), F.col("properties").alias("a"))
    method, path = F.col("a")["method"].eqNullSafe(F.col("b")["method"]), F.col("a")["path"].eqNullSafe(F.col("b")["path"])
    both = a.join(b, "handler").where(method != path)
    return both.select("before_key", "after_key", F.when(method, "API_PATH_CHANGED").otherwise("API_METHOD_CHANGED").alias("category"))


def _relationship_category(rel: Column, source_type: Column, target_type: Column, direction: Column) -> tuple[Column, Column]:
    library = (rel == "DEPENDS_ON") & (target_type == "DEPENDENCY")
    category = (
        F.when((rel == "EXPOSES") & (target_type == "API"), "API_RELATIONSHIP_CHANGED")
        .when(rel == "PUBLISHES", "EVENT_PUBLISHER_CHANGED")
        .when(rel == "CONSUMES", "EVENT_CONSUMER_CHANGED")
        .when((rel == "ACCESSES") & target_type.isin("DATABASE", "TABLE"), F.concat(F.lit("DATABASE_ACCESS_"), direction))
        .when((source_type == "SERVICE") & (target_type == "SERVICE") & rel.isin("CALLS", "DEPENDS_ON"), F.concat(F.lit("SERVICE_RELATIONSHIP_"), direction))
        .when(library, F.concat(F.lit("DEPENDENCY_"), direction))
        .otherwise(F.concat(F.lit("RELATIONSHIP_"), direction))
    )
    # the rules above are tried in their order, so a library is one only if none of them comes first
    return category, F.when(category.isin("DEPENDENCY_ADDED", "DEPENDENCY_REMOVED"), "DEPENDENCY").otherwise("RELATIONSHIP")


def entity_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(change_type, entity_type, category, entity_id, name): added, removed and modified entities, moved APIs as one change.

    Dependencies are told by their relationships, never alone.
    """
    sides = _sides(previous, current, ["key"])
    kind, name = F.coalesce("after.entity_type", "before.entity_type"), F.coalesce("after.name", "before.name")
    change = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").when(entries(F.col("before.properties")) != entries(F.col("after.properties")), "MODIFIED")
    all_ = sides.select("key", kind.alias("entity_type"), name.alias("name"), change.alias("change_type")).where("change_type is not null and entity_type != 'DEPENDENCY'")
    pairs = pair_apis(previous, current)
    moved = pairs.select(F.col("before_key").alias("key"), F.lit("REMOVED").alias("change_type")).unionByName(pairs.select(F.col("after_key").alias("key"), F.lit("ADDED").alias("change_type")))
    plain = all_.join(moved, ["key", "change_type"], "left_anti")
    category = F.when(F.col("change_type") == "MODIFIED", "ENTITY_MODIFIED").otherwise(F.concat_ws("_", "entity_type", "change_type"))
    plain = plain.select("change_type", "entity_type", category.alias("category"), F.col("key").alias("entity_id"), "name")
    named = lambda d, c, n: d.select(F.col("key").alias(c), F.col("name").alias(n))
    both = pairs.join(named(previous, "before_key", "b"), "before_key").join(named(current, "after_key", "a"), "after_key")
    return plain.unionByName(both.select(F.lit("MODIFIED").alias("change_type"), F.lit("API").alias("entity_type"), "category", F.col("after_key").alias("entity_id"), F.concat_ws(" -> ", "b", "a").alias("name")))


def relationship_changes(previous: DataFrame, current: DataFrame, previous_entities: DataFrame, current_entities: DataFrame) -> DataFrame:
    """Like entity_changes for relationships; an EXPOSES of an entity that is itself new or gone is implied by that."""
    sides = _sides(previous, current, ["rel_type", "source", "target"])
    change = F.when(F.col("before").isNull(), "ADDED").when(F.col("after").isNull(), "REMOVED").when(entries(F.col("before.properties")) != entries(F.col("after.properties")), "MODIFIED")
    own = sides.withColumn("change_type", change).where("change_type is not null")
    a, b = previous_entities.select("key"), current_entities.select("key")
    implied = a.join(b, "key", "left_anti").unionByName(b.join(a, "key", "left_anti")).select(F.col("key").alias("target"), F.lit("EXPOSES").alias("rel_type"))
    own = own.where("change_type = 'MODIFIED'").unionByName(own.where("change_type != 'MODIFIED'").join(implied, ["target", "rel_type"], "left_anti").select(*own.columns))
    # names and types as of the side that has the relationship
    known = previous_entities.select("key", "entity_type", "name", F.lit("REMOVED").alias("side")).unionByName(current_entities.select("key", "entity_type", "name", F.lit("CURRENT").alias("side")))
    own = own.withColumn("side", F.when(F.col("change_type") == "REMOVED", "REMOVED").otherwise("CURRENT"))
    end = lambda c: known.select(F.col("key").alias(c), "side", F.col("entity_type").alias(f"{c}_type"), F.col("name").alias(f"{c}_name"))
    own = own.join(end("source"), ["source", "side"], "left").join(end("target"), ["target", "side"], "left")
    rel, modified = F.col("rel_type"), F.col("change_type") == "MODIFIED"
    category, kind = _relationship_category(rel, F.col("source_type"), F.col("target_type"), F.col("change_type"))
    library = (rel == "DEPENDS_ON") & (F.col("target_type") == "DEPENDENCY")
    version = ~F.col("before.properties")["version"].eqNullSafe(F.col("after.properties")["version"])
    return own.select(
        "change_type",
        F.when(modified, F.when(library, "DEPENDENCY").otherwise("RELATIONSHIP")).otherwise(kind).alias("entity_type"),
        F.when(modified, F.when(library & version, "DEPENDENCY_VERSION_CHANGED").otherwise("RELATIONSHIP_MODIFIED")).otherwise(category).alias("category"),
        relationship_id(rel, F.col("source"), F.col("target")).alias("entity_id"),
        F.concat(F.col("source_name"), F.lit(" -["), rel, F.lit("]-> "), F.col("target_name")).alias("name"),
    )


def unknown_changes(changes: DataFrame, evidence: DataFrame, blocked_previous: DataFrame, blocked_current: DataFrame) -> DataFrame:
    """evidence: entity_id, file; blocked: file, those that couldn't be analysed at a revision. changes with `blocked_file`, the first
    file, by name, that makes a change unknown (an addition: unreadable before, a removal: unreadable now, else either), null where it is known."""
    files = blocked_previous.select("file", F.lit("p").alias("at")).unionByName(blocked_current.select("file", F.lit("c").alias("at"))).where("file is not null").distinct()
    counts = files.select("file", F.explode(F.when(F.col("at") == "p", F.array(F.lit("ADDED"), F.lit("MODIFIED"))).otherwise(F.array(F.lit("REMOVED"), F.lit("MODIFIED")))).alias("change_type")).distinct()
    hit = evidence.select("entity_id", "file").distinct().join(counts, "file").groupBy("entity_id", "change_type").agg(F.min("file").alias("blocked_file"))
    return changes.join(hit, ["entity_id", "change_type"], "left").select(*changes.columns, "blocked_file")


def summary(changes: DataFrame) -> DataFrame:
    """(kind, value, n): the number of all changes, and by change type, entity type and category, in one pass."""
    sets = changes.groupingSets([[], ["change_type"], ["entity_type"], ["category"]], "change_type", "entity_type", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "change_type").when(F.col("g") == 5, "entity_type").otherwise("category")
    return sets.select(kind.alias("kind"), F.coalesce("change_type", "entity_type", "category", F.lit("")).alias("value"), "n")


def in_order(changes: DataFrame) -> DataFrame:
    """Changes by entity type (in the order of the types), category, id and change type."""
    return changes.orderBy(F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), F.col("entity_type")), "category", "entity_id", "change_type")


def same_repository(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Both one row with `repository`. One row (repository); an error is raised if the two differ, for such snapshots cannot be compared."""
    both = previous.select(F.col("repository").alias("a"), F.lit(1).alias("one")).join(current.select(F.col("repository").alias("b"), F.lit(1).alias("one")), "one")
    wrong = F.raise_error(F.format_string("snapshots of different repositories: %s and %s", F.col("a"), F.col("b"))).cast("string")
    return both.select(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("a")).otherwise(wrong).alias("repository"))


#: How statuses of files are told, and how many commits of a file are.
WORDING, COMMITS_A_FILE = {"A": "added", "M": "modified", "D": "deleted"}, 3


def git_evidence(files: DataFrame, file_changes: DataFrame, commits: DataFrame, previous: str, current: str) -> DataFrame:
    """files: owner, file; file_changes: path, status, old_path; commits: commit_hash, committed_at, message, changed_files, ord (0: the newest).

    (owner, source, file, details, commit, at): how each file of the evidence changed between the revisions (by its path, else by its old one), and
    up to three commits that touched it or what it became.
    """
    files = files.where("file is not null").distinct()
    by = lambda c, rank: file_changes.where(F.col(c).isNotNull()).select(F.col(c).alias("file"), F.lit(rank).alias("r"), "path", "status", "old_path")
    change = by("path", 0).unionByName(by("old_path", 1)).groupBy("file").agg(F.min(F.struct("r", "path", "status", "old_path")).alias("c")).select("file", "c.path", "c.status", "c.old_path")
    asked = files.select("file").distinct().join(change, "file", "left")
    wording = F.coalesce(F.create_map(*(F.lit(x) for kv in WORDING.items() for x in kv))[F.col("status")], F.col("status"))
    detail = F.when(F.col("status") == "R", F.concat(F.lit("file renamed "), "old_path", F.lit(" -> "), "path")).otherwise(F.concat(F.lit("file "), wording))
    diff = asked.where("status is not null").select("file", F.lit("git_diff").alias("source"), F.concat(detail, F.lit(f" between {previous[:12]} and {current[:12]}")).alias("details"), F.lit(None).cast("string").alias("commit"), F.lit(None).cast("timestamp").alias("at"))
    names = asked.select("file", F.explode(F.array_distinct(F.array_compact(F.array("file", "path")))).alias("name"))
    each = commits.select("commit_hash", "committed_at", "message", "ord", F.explode("changed_files").alias("name"))
    hits = names.join(each, "name").select("file", "commit_hash", "committed_at", "message", "ord")
    # a rank that repeated rows share is cut where the rows are, so few are left to be told apart
    newest = hits.withColumn("rank", F.dense_rank().over(Window.partitionBy("file").orderBy("ord", "commit_hash"))).where(F.col("rank") <= COMMITS_A_FILE).drop("rank").distinct()
    top = newest.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("ord", "commit_hash"))).where(F.col("rank") <= COMMITS_A_FILE)
    line = F.element_at(F.split(F.coalesce("message", F.lit("")), r"\r\n|\r|\n", 2), 1)
    told = top.select("file", F.lit("git_commit").alias("source"), F.concat(F.lit("commit "), F.substring("commit_hash", 1, 12), F.lit(" touched "), "file", F.lit(": "), line).alias("details"), F.col("commit_hash").alias("commit"), F.col("committed_at").cast("timestamp").alias("at"))
    return files.join(diff.unionByName(told), "file").select("owner", "source", "file", "details", "commit", "at")


#: How an empty and another comparison are told.
NO_CHANGES, CHANGES = "No architecture changes between the two revisions.", " change(s): "


def told(changes: DataFrame) -> DataFrame:
    """One row (status, n, text): whether and how much changed, with the number of each category, by name."""
    per = changes.groupBy("category").agg(F.count("*").alias("n"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("category", "n"))).alias("c"))
    listed = F.array_join(F.transform("c", lambda x: F.concat(x["n"].cast("string"), F.lit(" x "), x["category"])), ", ")
    none = F.col("n") == 0
    text = F.when(none, NO_CHANGES).otherwise(F.concat(F.col("n").cast("string"), F.lit(CHANGES), listed))
    return one.select(F.when(none, "NO_CHANGES").otherwise("CHANGES_DETECTED").alias("status"), "n", text.alias("text"))


def of_type(entities: DataFrame, entity_type: str) -> DataFrame:
    """The entities of a type, by key."""
    return entities.where(F.col("entity_type") == entity_type).orderBy("key")


def unresolved_in_order(unresolved: DataFrame) -> DataFrame:
    """What could not be told, by file and reason."""
    return unresolved.orderBy(F.coalesce("file", F.lit("")), "reason")


def plain(rows: DataFrame) -> DataFrame:
    """One column `json`: each row as JSON, times in ISO form, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("json"))
