"""Facts from parsed files and commits: containment, modification and call edges, nodes with their identities, evidence and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import absolute_module, class_id, file_id, function_id, method_id, module_name, qualified_name
from .resolve import first_of_target, first_rule


def modifies(commits: DataFrame) -> DataFrame:
    """commits: commit_hash, changed_files. (source, relationship_type, target, line), a row for each changed file; line 0 stands for the whole file."""
    return commits.select(F.col("commit_hash").alias("source"), F.lit("MODIFIES").alias("relationship_type"), F.explode("changed_files").alias("target"), F.lit(0).alias("line"))


def contains(classes: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """(source, relationship_type, target, source_file, line): files hold classes and functions, classes hold methods."""
    row = lambda d, source, target: d.select(source.alias("source"), F.lit("CONTAINS").alias("relationship_type"), target.alias("target"), F.col("file_path").alias("source_file"), "line")
    path, name = F.col("file_path"), F.col("name")
    return row(classes, path, name).unionByName(row(methods, F.col("class_name"), qualified_name(F.col("class_name"), name))).unionByName(row(functions, path, name))


def code_nodes(files: DataFrame, classes: DataFrame, methods: DataFrame, functions: DataFrame, repository: str) -> DataFrame:
    """(label, id, name, path, line) of files, classes, methods and functions; ids follow from the repository's id, path, names and (functions) line."""
    repo, path, name = F.lit(repository), F.col("file_path"), F.col("name")
    own_file = file_id(repo, path)
    row = lambda d, label, id_, line=None: d.select(F.lit(label).alias("label"), id_.alias("id"), "name", F.col("file_path").alias("path"), (F.col("line") if line is None else line).cast("int").alias("line"))
    f = files.select(F.col("path").alias("file_path"), F.substring_index("path", "/", -1).alias("name"))
    out = row(f, "File", own_file, F.lit(None))
    for d, label, id_ in ((classes, "Class", class_id(own_file, name)), (methods, "Method", method_id(class_id(own_file, F.col("class_name")), name)), (functions, "Function", function_id(own_file, name, F.col("line")))):
        out = out.unionByName(row(d, label, id_))
    return out


def node_details(nodes: DataFrame, classes: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """nodes: id, name, class_id, file_id, repository_id. Names of what a node lies in, null where it has none or the graph doesn't know it."""
    of = lambda d, key, name: d.select(F.col("id").alias(key), F.col("name").alias(name))
    out = nodes.join(of(classes, "class_id", "class_name"), "class_id", "left").join(of(files, "file_id", "file_name"), "file_id", "left").join(of(repositories, "repository_id", "repository_name"), "repository_id", "left")
    return out.select("id", "name", "class_name", "file_name", "repository_name")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: file_path, module, name, line, ord. (file, target, line): which repository file a file imports, the first import of each.

    `import a.b` names the module itself; `from a import b` names the module a.b where there is one, else a.
    """
    modules = files.select(module_name(F.col("path")).alias("wanted"), F.col("path").alias("target")).where("wanted != ''")
    base = absolute_module(F.col("file_path"), F.col("module"))
    wanted = F.when(F.col("module").isNull(), F.array("name")).otherwise(F.array_compact(F.array(F.concat_ws(".", base, "name"), base)))
    each = imports.select(F.col("file_path").alias("file"), "line", "ord", F.posexplode(wanted).alias("pos", "wanted"))
    hit = each.join(modules, "wanted").groupBy("file", "line", "ord").agg(F.min_by("target", "pos").alias("target"))
    return first_of_target(hit)


def resolve_calls(calls: DataFrame, imports: DataFrame, classes: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """calls: row, file_path, class_name, base, attr, raw. Each call with target and resolved.

    The first rule that holds decides: self.m() of a method of the same class; a name that is a function of the same file; a name that
    `from x import name` brings from a repository module which defines it; m.attr() of a plainly imported repository module. What
    is left keeps what was written: no object is guessed.
    """
    symbols = functions.select(module_name(F.col("file_path")).alias("module"), "name").unionByName(classes.select(module_name(F.col("file_path")).alias("module"), "name")).distinct()
    slim = calls.select("row", "file_path", "class_name", "base", "attr")
    name, bare = F.col("attr"), slim.where("base is null and attr is not null")
    self_calls = slim.where("base = 'self' and class_name is not null")
    by_self = self_calls.join(methods.select("file_path", "class_name", F.col("name").alias("attr")).distinct(), ["file_path", "class_name", "attr"]).select("row", qualified_name(F.col("class_name"), name).alias("target"))
    by_file = bare.join(functions.select("file_path", F.col("name").alias("attr")).distinct(), ["file_path", "attr"]).select("row", name.alias("target"))
    # a later import of a name hides an earlier one
    bound = lambda d, n: d.withColumn("__r", F.row_number().over(Window.partitionBy("file_path", n).orderBy(F.col("ord").desc()))).where("__r = 1").drop("__r")
    brought = bound(imports.where("module is not null").select("file_path", "ord", F.coalesce("alias", "name").alias("attr"), absolute_module(F.col("file_path"), F.col("module")).alias("module"), F.col("name").alias("original")), "attr")
    by_import = bare.join(brought, ["file_path", "attr"]).join(symbols.select("module", F.col("name").alias("original")), ["module", "original"]).select("row", qualified_name(F.col("module"), F.col("original")).alias("target"))
    plain = bound(imports.where("module is null").select("file_path", "ord", F.coalesce("alias", F.substring_index("name", ".", 1)).alias("base"), F.col("name").alias("module")), "base")
    of_module = slim.where("base is not null and base != 'self'").join(plain.drop("ord"), ["file_path", "base"])
    by_module = of_module.join(symbols.select("module", F.col("name").alias("attr")), ["module", "attr"]).select("row", qualified_name(F.col("module"), name).alias("target"))
    out = first_rule(calls, "row", [("self", by_self), ("file", by_file), ("import", by_import), ("module", by_module)], "target")
    written = out.join(of_module.select("row", F.concat_ws(".", "module", "attr").alias("as_module")), "row", "left")
    return written.select(*calls.columns, F.coalesce("target", "as_module", F.nullif(F.concat_ws(".", "base", "attr"), F.lit("")), "raw").alias("target"), F.col("rule").isNotNull().alias("resolved"), "rule")


def unresolved_call_sites(nodes: DataFrame, names: DataFrame, limit: int = 25) -> DataFrame:
    """nodes: id, unresolved_calls; names: name. (name, id, call): for each name up to `limit` nodes, by id, one of whose unresolved calls is the name or ends with "." and it, and the first such call.

    A call stands under each of its dotted ends, so this is an equi join for any number of names. Null and empty names have no sites.
    """
    parts = F.split("call", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = nodes.select("id", F.posexplode("unresolved_calls").alias("pos", "call")).where("call is not null")
    under = each.select("id", "pos", "call", F.explode(ends).alias("name")).join(names.select("name").where("name != ''").distinct(), "name")
    first = under.groupBy("name", "id").agg(F.min(F.struct("pos", "call")).alias("f")).select("name", "id", "f.call")
    return first.withColumn("__r", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("__r") <= limit).drop("__r")


def numbered(evidence: DataFrame, by: str, order: list[str], letter: str = "E") -> DataFrame:
    """Evidence with `label`: E1, E2, ... within `by`."""
    return evidence.withColumn("label", F.concat(F.lit(letter), F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("string")))


def report(sections: DataFrame, key: str) -> DataFrame:
    """sections: key, section_no, title, ord, line. (key, report): a Markdown text for each key; a key's lines are one report, not one table."""
    part = sections.groupBy(key, "section_no", "title").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("ls"))
    body = part.select(key, "section_no", F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["line"])), "\n")).alias("text"))
    whole = body.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section_no", "text"))).alias("parts"))
    return whole.select(key, F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("report"))
