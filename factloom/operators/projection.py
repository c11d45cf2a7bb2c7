"""The graph of repositories: nodes of six labels and their edges, by ids, out of parsed files, resolved calls and commits.

All tables have `repository` (a repository's id). files: path, name, line_count; classes, functions: file_path, name, line; methods: with
class_name too; calls: file_path, class_name, name (who calls), target, raw, resolved, ord; imports: file, target; commits: commit_hash,
message, author_name, author_email, committed_at, changed_files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import class_id, commit_id, file_id, function_id, method_id, module_name, qualified_name, repository_id


def _columns(label: str, id_: Column, name: Column, properties: dict[str, Column]) -> list[Column]:
    pairs = [x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))]
    return [F.lit(label).alias("label"), id_.alias("id"), name.alias("name"), F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("properties")]


def _node(rows: DataFrame, label: str, id_: Column, name: Column, **properties: Column) -> DataFrame:
    return rows.select(*_columns(label, id_, name, properties))


def _edge(rows: DataFrame, start: str, start_id: Column, rel: str, end: str, end_id: Column) -> DataFrame:
    return rows.select(F.lit(start).alias("start_label"), start_id.alias("start_id"), F.lit(rel).alias("rel_type"), F.lit(end).alias("end_label"), end_id.alias("end_id"))


def _file() -> Column:
    return file_id(F.col("repository"), F.col("file_path"))


def _class(name: str = "name") -> Column:
    return class_id(_file(), F.col(name))


def _method() -> Column:
    return method_id(_class("class_name"), F.col("name"))


def _function() -> Column:
    return function_id(_file(), F.col("name"), F.col("line"))


def repositories(rows: DataFrame) -> DataFrame:
    """rows: name, root_path, remote_url, with `repository`, their id: the remote's where there is one, else the local root's."""
    return rows.withColumn("repository", repository_id(F.col("remote_url"), F.col("root_path")))


def symbols(classes: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """(repository, file_path, module, symbol, label, id): what a name in a file stands for; of equal names functions come before classes, then the last line."""
    c = classes.select("repository", "file_path", F.col("name").alias("symbol"), F.lit(0).alias("r"), "line", F.lit("Class").alias("label"), _class().alias("id"))
    m = methods.select("repository", "file_path", qualified_name(F.col("class_name"), F.col("name")).alias("symbol"), F.lit(1).alias("r"), "line", F.lit("Method").alias("label"), _method().alias("id"))
    f = functions.select("repository", "file_path", F.col("name").alias("symbol"), F.lit(2).alias("r"), "line", F.lit("Function").alias("label"), _function().alias("id"))
    last = c.unionByName(m).unionByName(f).groupBy("repository", "file_path", "symbol").agg(F.max(F.struct("r", "line", "label", "id")).alias("x"))
    return last.select("repository", "file_path", module_name(F.col("file_path")).alias("module"), "symbol", "x.label", "x.id")


def unresolved_calls(calls: DataFrame) -> DataFrame:
    """(repository, file_path, symbol, unresolved_calls): what each caller calls without a known target, as written, in order."""
    mine = calls.where("not resolved").select("repository", "file_path", qualified_name(F.col("class_name"), F.col("name")).alias("symbol"), "ord", F.coalesce("raw", "target").alias("text"))
    lists = mine.groupBy("repository", "file_path", "symbol").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return lists.select("repository", "file_path", "symbol", F.transform("x", lambda r: r["text"]).alias("unresolved_calls"))


def nodes(repos: DataFrame, files: DataFrame, classes: DataFrame, methods: DataFrame, functions: DataFrame, calls: DataFrame, commits: DataFrame) -> DataFrame:
    """(label, id, name, properties, unresolved_calls): Repository, File, Class, Method, Function and Commit nodes. unresolved_calls is empty where a node has none."""
    f = files.withColumnRenamed("path", "file_path")
    name = F.col("name")
    parts = [
        _node(repos, "Repository", F.col("repository"), name, root_path=F.col("root_path"), remote_url=F.col("remote_url")),
        _node(f, "File", _file(), name, path=F.col("file_path"), line_count=F.col("line_count"), repository_id=F.col("repository")),
        _node(classes, "Class", _class(), name, file_id=_file(), line_number=F.col("line")),
        _node(commits, "Commit", commit_id(F.col("repository"), F.col("commit_hash")), F.col("commit_hash"), message=F.col("message"), author=F.col("author_name"), author_email=F.col("author_email"), repository_id=F.col("repository")),
    ]
    plain = reduce(DataFrame.unionByName, parts).withColumn("unresolved_calls", F.array().cast("array<string>"))
    open_ = unresolved_calls(calls)

    def with_calls(rows: DataFrame, label: str, symbol: Column, id_: Column, **properties: Column) -> DataFrame:
        told = rows.withColumn("symbol", symbol).join(open_, ["repository", "file_path", "symbol"], "left")
        return told.select(*_columns(label, id_, name, properties), F.coalesce("unresolved_calls", F.array().cast("array<string>")).alias("unresolved_calls"))

    own = with_calls(methods, "Method", qualified_name(F.col("class_name"), name), _method(), class_id=_class("class_name"), file_id=_file(), line_number=F.col("line"))
    free = with_calls(functions, "Function", name, _function(), file_id=_file(), line_number=F.col("line"))
    return plain.unionByName(own).unionByName(free)


def edges(files: DataFrame, classes: DataFrame, methods: DataFrame, functions: DataFrame, calls: DataFrame, imports: DataFrame, commits: DataFrame) -> DataFrame:
    """(start_label, start_id, rel_type, end_label, end_id): CONTAINS, CALLS, IMPORTS and MODIFIES. Edges to what is not there are left out."""
    f = files.withColumnRenamed("path", "file_path")
    holds = [
        _edge(f, "Repository", F.col("repository"), "CONTAINS", "File", _file()),
        _edge(classes, "File", _file(), "CONTAINS", "Class", _class()),
        _edge(methods, "Class", _class("class_name"), "CONTAINS", "Method", _method()),
        _edge(functions, "File", _file(), "CONTAINS", "Function", _function()),
    ]
    return reduce(DataFrame.unionByName, [*holds, call_edges(calls, symbols(classes, methods, functions)), import_edges(imports, files), modified_edges(commits, files)])


def call_edges(calls: DataFrame, names: DataFrame) -> DataFrame:
    """CALLS of resolved calls whose both ends are known: a target is a symbol of the same file, else, by what stands before its last dot, of that module."""
    here = names.select("repository", "file_path", F.col("symbol").alias("target"), F.struct("label", "id").alias("near"))
    there = names.where("label != 'Method'").groupBy("repository", "module", "symbol").agg(F.max(F.struct("file_path", "label", "id")).alias("x"))
    there = there.select("repository", F.concat_ws(".", "module", "symbol").alias("target"), F.struct("x.label", "x.id").alias("far"))
    source = names.select("repository", "file_path", F.col("symbol").alias("caller"), F.struct("label", "id").alias("start"))
    mine = calls.where("resolved").select("repository", "file_path", qualified_name(F.col("class_name"), F.col("name")).alias("caller"), "target")
    # the end first: calls without one are dropped before they are dealt by their callers
    ends = mine.join(here, ["repository", "file_path", "target"], "left").join(there, ["repository", "target"], "left")
    ends = ends.select("repository", "file_path", "caller", F.coalesce("near", "far").alias("end")).where("end is not null")
    out = ends.join(source, ["repository", "file_path", "caller"])
    return out.select(F.col("start.label").alias("start_label"), F.col("start.id").alias("start_id"), F.lit("CALLS").alias("rel_type"), F.col("end.label").alias("end_label"), F.col("end.id").alias("end_id"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS between files of the repository."""
    known = files.select("repository", F.col("path").alias("file_path")).distinct()
    both = imports.join(known.withColumnRenamed("file_path", "file"), ["repository", "file"], "left_semi").join(known.withColumnRenamed("file_path", "target"), ["repository", "target"], "left_semi")
    return _edge(both, "File", file_id(F.col("repository"), F.col("file")), "IMPORTS", "File", file_id(F.col("repository"), F.col("target")))


def modified_edges(commits: DataFrame, files: DataFrame) -> DataFrame:
    """MODIFIES of known commits and known files."""
    changed = commits.select("repository", "commit_hash", F.explode("changed_files").alias("file_path")).distinct()
    known = changed.join(files.select("repository", F.col("path").alias("file_path")).distinct(), ["repository", "file_path"], "left_semi")
    return _edge(known, "Commit", commit_id(F.col("repository"), F.col("commit_hash")), "MODIFIES", "File", _file())

