"""Evidence: what an investigation found as rows of one form, with a status that says how sure it is.

All builders return (key, type, source, status, details, file, line, method, commit, at); key says whose evidence it is. What is not resolved has
no row, but for an unresolved location, which says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import dealt

FACT, RELEVANT, UNRESOLVED = "FACT", "POTENTIALLY_RELEVANT", "UNRESOLVED"
_TYPES = {"key": "string", "type": "string", "source": "string", "status": "string", "details": "string", "file": "string", "line": "int", "method": "string", "commit": "string", "at": "timestamp"}

# The sentences in the functions below, word for word, are the wording of the evidence that is asked for.


def _rows(df: DataFrame, type_: Column | str, source: str, status: Column | str, details: Column, **more: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    own = {"key": F.col("key"), "type": lit(type_), "source": F.lit(source), "status": lit(status), "details": details, **more}
    return df.select(*(own.get(c, F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))


def _if(c: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", _text(*parts)).otherwise("")


def _short(c: Column) -> Column:
    return F.substring(c, 1, 12)


def of_stack_trace(exceptions: DataFrame, frames: DataFrame) -> DataFrame:
    """exceptions: key, exception_type, message; frames: key, file, line, function, snippet."""
    e = exceptions.where("exception_type is not null")
    a = _rows(e, "stack_trace", "stack_trace", FACT, _text("Parsed exception ", F.col("exception_type"), _if(F.col("message"), ": ", F.col("message"))))
    told = _text("Frame: ", F.col("file"), ":", F.col("line"), " in ", F.col("function"), _if(F.col("snippet"), " -- `", F.col("snippet"), "`"))
    return a.unionByName(_rows(frames, "stack_trace", "stack_trace", FACT, told, file=F.col("file"), line=F.col("line"), method=F.col("function")))


def of_locations(locations: DataFrame) -> DataFrame:
    """locations: key, status (RESOLVED, PARTIALLY_RESOLVED, UNRESOLVED), label, qualified_name, file, line, reason."""
    c, known, part = F.col, F.col("status") == "RESOLVED", F.col("status") == "PARTIALLY_RESOLVED"
    details = (
        F.when(known, _text("Resolved to ", c("label"), " `", c("qualified_name"), "` (", c("file"), ":", c("line"), ")"))
        .when(part, _text("File resolved (", c("file"), ") but the exact definition could not be pinned down", _if(c("reason"), " -- ", c("reason"))))
        .otherwise(F.coalesce("reason", F.lit("Stack frame could not be resolved to a location in the code graph")))
    )
    status = F.when(known, FACT).when(part, RELEVANT).otherwise(UNRESOLVED)
    return _rows(locations, "code_location", "graph", status, details, file=F.when(known | part, c("file")), line=F.when(known | part, c("line")), method=F.when(known, c("qualified_name")))


def of_calls(calls: DataFrame, forward: bool = True) -> DataFrame:
    """calls: key, source_name, target_name, depth. Steps after the first are only potentially relevant."""
    near, far = (F.col("source_name"), F.col("target_name"))[:: 1 if forward else -1]
    details = _text("(depth ", F.col("depth"), ") ", near, " calls " if forward else " is called by ", far)
    return _rows(calls, "call_graph", "graph", F.when(F.col("depth") == 1, FACT).otherwise(RELEVANT), details, method=far)


def of_dependencies(dependencies: DataFrame) -> DataFrame:
    """dependencies: key, file, imports, imported_by (arrays), as dependencies_of() gives them."""
    each = dependencies.select("key", "file", F.explode(F.concat(F.transform("imports", lambda d: _text(F.col("file"), " imports ", d)), F.transform("imported_by", lambda d: _text(d, " imports ", F.col("file"))))).alias("told"))
    return _rows(each, "dependency", "graph", RELEVANT, F.col("told"), file=F.col("file"))


def of_history(last: DataFrame, before: DataFrame) -> DataFrame:
    """Both: key, file, commit_hash, author_name, message, committed_at; the last commit of a file, and those before a failure."""
    c, extra = F.col, {"file": F.col("file"), "commit": F.col("commit_hash"), "at": F.col("committed_at")}
    a = _rows(last, "git_history", "git", FACT, _text("Last commit to modify this file: ", _short(c("commit_hash")), " by ", c("author_name"), ": ", c("message")), **extra)
    b = _rows(before, "recent_change", "git", RELEVANT, _text("Commit ", _short(c("commit_hash")), " modified this file before the failure (does not by itself establish causation): ", c("message")), **extra)
    return a.unionByName(b)


def of_blame(blame: DataFrame) -> DataFrame:
    """blame: key, file, line, commit_hash, author_name, message, committed_at."""
    c = F.col
    details = _text("Line ", c("line"), " of ", c("file"), " was last changed by commit ", _short(c("commit_hash")), " (", c("author_name"), "): ", c("message"))
    return _rows(blame.where("commit_hash is not null"), "blame", "git", FACT, details, file=c("file"), line=c("line"), commit=c("commit_hash"), at=c("committed_at"))


def of_logs(matches: DataFrame) -> DataFrame:
    """matches: key, matched_on, raw, ts."""
    return _rows(matches, "log", "log", RELEVANT, _text("Log line correlated via ", F.col("matched_on"), ": ", F.col("raw")), at=F.col("ts"))


def of_candidates(candidates: DataFrame) -> DataFrame:
    """candidates: key, role (PRIMARY, RELATED), reason, qualified_name, file, line; method_name, method_class, first, last, class_name, class_first, class_last (null: not localised)."""
    c = F.col
    place = {"file": c("file"), "line": c("line"), "method": c("qualified_name")}
    a = _rows(candidates, "candidate_location", "graph", FACT, _text(F.when(c("role") == "PRIMARY", "Primary").otherwise("Related"), " location: ", c("reason"), " -> ", c("qualified_name"), " (", c("file"), ":", c("line"), ")"), **place)
    told = _text("Line ", c("line"), " belongs to ", _if(c("method_class"), c("method_class"), "."), c("method_name"), "() (lines ", c("first"), "-", c("last"), ")")
    b = _rows(candidates.where("method_name is not null"), "method_localization", "parser", FACT, told, **place)
    told = _text("Owning class: ", c("class_name"), " (lines ", c("class_first"), "-", c("class_last"), ")")
    return a.unionByName(b).unionByName(_rows(candidates.where("class_name is not null"), "class_localization", "parser", FACT, told, file=c("file"), method=c("class_name")))


def of_code(code: DataFrame) -> DataFrame:
    """code: key, file, first, last, lines, status, as localize.relevant_code() gives it."""
    c = F.col
    told = _text("Retrieved lines ", c("first"), "-", c("last"), " of ", c("file"), " (", F.size("lines"), " lines) from the actual repository source")
    return _rows(code.where("status = 'RESOLVED'"), "relevant_code", "repository", FACT, told, file=c("file"), line=c("first"))


def of_changes(changes: DataFrame) -> DataFrame:
    """changes: key, label (historical_change, previous_change, related_commit), file, commit_hash, author_name, message, committed_at, method."""
    c = F.col
    told = _text("[", c("label"), "] ", _short(c("commit_hash")), " by ", c("author_name"), ": ", c("message"), _if(c("method"), " (scoped to ", c("method"), ")"))
    return _rows(changes, c("label"), "git", F.when(c("label") == "related_commit", FACT).otherwise(RELEVANT), told, file=c("file"), commit=c("commit_hash"), at=c("committed_at"), method=c("method"))


def of_tests(tests: DataFrame) -> DataFrame:
    """tests: key, test_file, test_function, target."""
    c = F.col
    return _rows(tests, "related_test", "graph", FACT, _text(c("test_file"), "::", c("test_function"), " references ", c("target")), file=c("test_file"), method=c("test_function"))


def contract(evidence: DataFrame, base_names: bool = False) -> DataFrame:
    """Evidence as (key, source, description, location): its type, its status and details, file::method; base_names: files without their folders."""
    file = F.substring_index("file", "/", -1) if base_names else F.col("file")
    location = F.when(F.coalesce("file", F.lit("")) != "", F.when(F.coalesce("method", F.lit("")) != "", F.concat(file, F.lit("::"), "method")).otherwise(file))
    return evidence.select("key", F.col("type").alias("source"), _text("[", F.col("status"), "] ", F.col("details")).alias("description"), location.alias("location"))


def hit_contract(hits: DataFrame) -> DataFrame:
    """hits: key, kind, name, start_line, end_line, location, score. Retrieved chunks in the same form, with their score."""
    c = F.col
    return hits.select("key", F.lit("semantic").alias("source"), _text(c("kind"), " ", c("name"), " (lines ", c("start_line"), "-", c("end_line"), ")").alias("description"), "location", F.round("score", 4).alias("score"))


def with_new_only(evidence: DataFrame, retrieved: DataFrame) -> DataFrame:
    """evidence, then what was retrieved at other locations; both: key, location, ord and the same other columns. Retrieved rows without a location stay.

    `part` and `ord` give the order: evidence (0) before what was retrieved (1).
    """
    known = evidence.where("coalesce(location, '') != ''").select("key", "location").distinct()
    new = retrieved.join(known, ["key", "location"], "left_anti").select(*retrieved.columns)
    return evidence.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)))


def in_first_order(items: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, values): the distinct values of a key in the order of their first place (the columns of order)."""
    first = dealt(items.where(F.col(value).isNotNull()), key).groupBy(key, value).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", F.col(value).alias("v")))).alias("x")).select(key, F.transform("x", lambda r: r["v"]).alias("values"))
