"""Where a change or failure is: repositories and changed nodes by name, their tests, dependencies, history and source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_test_path
from .needles import substring_hits

#: Lines of a block by which ranges and lines are joined.
BLOCK_LINES = 64


def _only(found: DataFrame, asked: DataFrame, value: str, none: Column, several: Column) -> DataFrame:
    """asked (row, ...) with value where found (row, value) has just one for the row, and reason otherwise. `n` is known to none and several."""
    return _told(asked, asked.join(_counted(found, ["row"], value), "row", "left"), value, none, several)


def _counted(found: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, value): how many different values there are, and the least one."""
    return found.select(*by, value).distinct().groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias(value))


def _told(asked: DataFrame, counted: DataFrame, value: str, none: Column, several: Column) -> DataFrame:
    """counted: the columns of asked, n (null: 0) and value. asked with value where n is 1, and reason otherwise."""
    out = counted.na.fill(0, ["n"])
    return out.select(*asked.columns, F.when(F.col("n") == 1, F.col(value)).alias(value), F.when(F.col("n") == 0, none).when(F.col("n") > 1, several).alias("reason"))


def repository_of(asked: DataFrame, repositories: DataFrame) -> DataFrame:
    """asked: row, wanted; repositories: id, name, remote_url, root_path. asked with repository_id of the only repository with that name, remote or root.

    A null or empty wish means the only repository that there is. No or several matches leave it null, with a reason.
    The three ways are one equi join: a repository stands under each of its names.
    """
    names = repositories.select("id", F.explode(F.array_distinct(F.array_compact(F.array("name", "remote_url", "root_path")))).alias("wanted"))
    named = asked.where("wanted != ''").join(names, "wanted").select("row", F.col("id").alias("repository_id"))
    any_ = repositories.select(F.col("id").alias("repository_id"), F.lit(1).alias("one")).limit(2)  # two tell that there are several
    open_ = asked.where("coalesce(wanted, '') = ''").select("row", F.lit(1).alias("one")).join(F.broadcast(any_), "one").select("row", "repository_id")
    given = F.coalesce("wanted", F.lit("")) != ""
    none = F.when(given, F.concat(F.lit("no repository matches "), "wanted")).otherwise("there is no repository")
    several = F.when(given, F.format_string("%d repositories match %s", F.col("n"), F.col("wanted"))).otherwise("there are several repositories and none was named")
    return _only(named.unionByName(open_), asked, "repository_id", none, several)


def changed_node(asked: DataFrame, definitions: DataFrame) -> DataFrame:
    """asked: row, repository_id, file, class_name, method (file and class_name null: any); definitions: repository_id, file, class_name (null for functions), name, id.

    asked with node_id of the only method or function that fits; Class.method in method names the class. Functions fit only where
    no class is named. No or several leave it null, with a reason.
    A definition stands under its name alone, with its file, with its class and with both, and is counted there once; a row looks up the one
    place that it asks for. So neither side is multiplied by the other, however many definitions have a name.
    """
    dotted = F.col("class_name").isNull() & F.contains("method", F.lit("."))
    owner = F.regexp_extract("method", r"^(.*)\.[^.]*$", 1)
    a = asked.withColumns({"class_name": F.when(dotted, owner).otherwise(F.col("class_name")), "method": F.when(dotted, F.substring_index("method", ".", -1)).otherwise(F.col("method"))})
    place = ["repository_id", "__name", "__file", "__class"]
    # a name is wrapped where it is given, so that none is not the empty one
    wrapped = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    ways = lambda c: F.explode(F.when(F.col(c).isNull(), F.array(F.lit(""))).otherwise(F.array(F.lit(""), wrapped(F.col(c)))))
    stands = definitions.select("repository_id", F.col("name").alias("__name"), ways("file").alias("__file"), "class_name", F.col("id").alias("node_id"))
    stands = stands.select(*place[:3], ways("class_name").alias("__class"), "node_id")
    looked = a.withColumns({"__name": F.col("method"), "__file": wrapped(F.col("file")), "__class": wrapped(F.col("class_name"))})
    none = F.concat(F.lit("no method or function is named "), "method")
    several = F.format_string("%d methods or functions are named %s: give a file or class", F.col("n"), F.col("method"))
    return _told(a, looked.join(_counted(stands, place, "node_id"), place, "left"), "node_id", none, several)


def related_tests(targets: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """targets: repository_id, target; functions, methods: repository_id, path, name. (repository_id, target, test_file, test_function) of test files' functions and methods with the target's name in theirs.

    Names are searched for all targets at once by an automaton; what it finds meets the targets of the test's repository by an equi join.
    """
    tests = functions.select("repository_id", "path", "name").unionByName(methods.select("repository_id", "path", "name")).where(is_test_path(F.col("path"))).distinct()
    asked = targets.select("repository_id", "target").where("target != ''").distinct()
    hits = substring_hits(tests.withColumn("__name", F.col("name")), "__name", asked, "target")
    return hits.join(asked, ["repository_id", "target"]).select("repository_id", "target", F.col("path").alias("test_file"), F.col("name").alias("test_function"))


def dependencies_of(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files: file; imports: file, target. (file, imports, imported_by, status): the files one step away, sorted; PARTIALLY_RESOLVED if there are none."""
    asked = files.select("file").distinct()
    side = lambda near, far, name: imports.select(F.col(near).alias("file"), F.col(far).alias("x")).where("x is not null").join(asked, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_set("x")).alias(name))
    out = asked.join(side("file", "target", "imports"), "file", "left").join(side("target", "file", "imported_by"), "file", "left")
    empty = F.array().cast("array<string>")
    a, b = F.coalesce("imports", empty), F.coalesce("imported_by", empty)
    return out.select("file", a.alias("imports"), b.alias("imported_by"), F.when(F.size(a) + F.size(b) > 0, "RESOLVED").otherwise("PARTIALLY_RESOLVED").alias("status"))


def touching(commits: DataFrame, files: DataFrame, before: str | None = None) -> DataFrame:
    """commits: commit_hash, committed_at, changed_files and more; files: file and, if given, the column `before`. (file, the commit's columns) of commits that changed the file, with before only earlier ones."""
    each = commits.withColumn("file", F.explode(F.array_distinct("changed_files"))).drop("changed_files")
    asked = files.select("file", *([F.col(before).alias("__before")] if before else [])).distinct()
    out = each.join(asked, "file")
    return out.where(F.col("committed_at") < F.col("__before")).drop("__before") if before else out


def without_known(changes: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """changes of a method's own lines (by, commit_hash, ...) that the file's history (by, commit_hash) doesn't have."""
    return changes.join(known.select(by, "commit_hash").distinct(), [by, "commit_hash"], "left_anti")


def relevant_code(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """asked: row, file, first, last; lines: file, n, text. (row, file, first, last, lines, status): the lines of the range that there are; none: UNRESOLVED.

    A range meets its file's lines by an equi join on blocks of BLOCK_LINES lines.
    """
    block = lambda n: F.floor(n / BLOCK_LINES)
    wanted = asked.where("first is not null and last >= first").select("row", "file", "first", "last", F.explode(F.sequence(block(F.col("first")), block(F.col("last")))).alias("b"))
    hits = wanted.join(lines.select("file", "n", "text", block(F.col("n")).alias("b")), ["file", "b"]).where("n between first and last")
    own = hits.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("lines"))
    out = asked.select("row", "file", "first", "last").join(own, "row", "left")
    return out.select("row", "file", "first", "last", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), F.when(F.col("lines").isNull(), "UNRESOLVED").otherwise("RESOLVED").alias("status"))
