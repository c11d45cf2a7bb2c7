"""Decision tables over recorded runs and claims: ordered CASE expressions, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import location_file
from .resolve import cited
from .tables import dealt

#: Exit codes that say a command could not run; levels of confidence.
COULD_NOT_RUN, CONFIDENCE = (126, 127), ("low", "medium", "high")


def run_status(exit_code: Column, timed_out: Column) -> Column:
    return F.when(F.coalesce(timed_out, F.lit(False)), "TIMEOUT").when(exit_code.isNull() | exit_code.isin(*COULD_NOT_RUN), "ERROR").when(exit_code == 0, "PASSED").otherwise("FAILED")


def evaluate(validations: DataFrame, runs: DataFrame) -> DataFrame:
    """validations: id, unexpected_error, infrastructure_error, startup (NOT_REQUIRED, READY, TIMEOUT, FAILED), overall_timeout, tests_expected;
    runs: id, seq, kind (build, test), exit_code, timed_out, passed, failed, errored.

    (id, status, exit_code, tests_passed, tests_failed). What comes first decides: errors, the build, the start, the overall time, then the
    tests (a timeout before a run that could not start, before a failure); no test run where some were expected is an error, never a pass.
    Counts are null where no run could be counted.
    """
    run = runs.withColumn("status", run_status(F.col("exit_code"), F.col("timed_out")))
    test, build = F.col("kind") == "test", F.col("kind") == "build"
    first = lambda status: F.min(F.when(test & (F.col("status") == status), F.struct("seq", "exit_code")))
    counted = test & F.col("passed").isNotNull()
    per = run.groupBy("id").agg(
        F.max_by(F.struct("status", "exit_code"), F.when(build, F.col("seq"))).alias("build"),
        *(first(s).alias(s.lower()) for s in ("TIMEOUT", "ERROR", "FAILED")),
        F.count_if(test).alias("n"),
        F.sum(F.when(counted, F.col("passed"))).alias("tests_passed"),
        F.sum(F.when(counted, F.coalesce("failed", F.lit(0)) + F.coalesce("errored", F.lit(0)))).alias("tests_failed"),
    )
    v = validations.join(per, "id", "left")
    none = F.lit(None).cast("int")
    b = lambda f: F.col(f"build.{f}")
    table = [
        (F.col("unexpected_error").isNotNull(), "ERROR", none),
        (F.col("infrastructure_error").isNotNull(), "INFRASTRUCTURE_FAILED", none),
        (b("status") == "TIMEOUT", "TIMEOUT", none),
        (b("status").isNotNull() & b("exit_code").isNull(), "INFRASTRUCTURE_FAILED", none),
        (b("status") != "PASSED", "BUILD_FAILED", b("exit_code")),
        (F.col("startup") == "TIMEOUT", "TIMEOUT", none),
        (F.col("startup") == "FAILED", "STARTUP_FAILED", none),
        (F.coalesce("overall_timeout", F.lit(False)), "TIMEOUT", none),
        (F.col("timeout").isNotNull(), "TIMEOUT", none),
        (F.col("error").isNotNull(), "ERROR", F.col("error.exit_code")),
        (F.col("failed").isNotNull(), "FAILED", F.col("failed.exit_code")),
        ((F.coalesce("n", F.lit(0)) == 0) & F.coalesce("tests_expected", F.lit(False)), "ERROR", none),
    ]
    decided = F.struct(F.lit("PASSED").alias("status"), F.lit(0).alias("exit_code"))
    for when, status, code in reversed(table):
        decided = F.when(when, F.struct(F.lit(status).alias("status"), code.cast("int").alias("exit_code"))).otherwise(decided)
    return v.select("id", decided.alias("d"), "tests_passed", "tests_failed").select("id", "d.status", "d.exit_code", "tests_passed", "tests_failed")


def grounded(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims: claim, confidence, insufficient; citations: claim, cited; evidence: claim, n.

    (claim, confidence, insufficient, supporting, dropped): citations of evidence that isn't there are dropped; a claim without support is insufficient,
    and what is insufficient or of no known confidence has a low one.
    """
    said = cited(citations, evidence).groupBy("claim").agg(F.count_if("known").alias("supporting"), F.count_if(~F.col("known")).alias("dropped"))
    out = claims.join(said, "claim", "left").na.fill(0, ["supporting", "dropped"])
    level = F.lower(F.trim("confidence"))
    lacks = F.col("insufficient") | (F.col("supporting") == 0)
    return out.select("claim", F.when(lacks | ~level.isin(*CONFIDENCE), "low").otherwise(level).alias("confidence"), lacks.alias("insufficient"), "supporting", "dropped")


def evidence_location(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims: claim, location_id, location; evidence: claim, n, source, description, location. (claim, location, rule): the first of
    the cited evidence's location, an exact one, a file (with or without a line) that just one evidence location has (several: the localised one),
    and the localised known one; null if none fits, for free text is never taken.
    """
    ev = evidence.where("location is not null").withColumn("localised", F.col("source") == "fix_localization")
    c = claims.withColumn("wanted", F.upper(F.trim("location_id"))).withColumn("bare", F.regexp_replace(F.trim("location"), r":[0-9][0-9-]*$", ""))
    both = c.join(ev.select("claim", "n", F.col("location").alias("known"), "localised", F.contains("description", F.lit("[KNOWN]")).alias("sure")), "claim", "left")
    fits = (F.col("bare") == location_file(F.col("known"))) & ~F.contains("bare", F.lit("::"))
    per = both.groupBy("claim").agg(
        F.min(F.when(F.col("wanted") == F.concat(F.lit("E"), F.col("n").cast("string")), F.col("known"))).alias("by_id"),
        F.min(F.when(F.col("location") == F.col("known"), F.col("known"))).alias("exact"),
        F.min(F.when(fits, F.col("known"))).alias("fit"),
        F.max(F.when(fits, F.col("known"))).alias("last_fit"),
        F.min(F.when(fits & F.col("localised"), F.struct("n", "known"))).alias("own"),
        F.min(F.when(F.col("localised") & F.col("sure"), F.struct("n", "known"))).alias("default"),
    )
    loose = F.when(F.col("fit") == F.col("last_fit"), F.col("fit")).when(F.col("fit").isNotNull(), F.col("own.known"))
    names = ["evidence_id", "exact", "file", "localised"]
    found = [F.col("by_id"), F.col("exact"), loose, F.col("default.known")]
    rule = F.coalesce(*(F.when(x.isNotNull(), n) for n, x in zip(names, found, strict=True)))
    return per.select("claim", F.coalesce(*found).alias("location"), rule.alias("rule"))


def status_of(n: Column, n_unresolved: Column) -> Column:
    """RESOLVED, PARTIALLY_RESOLVED or UNRESOLVED by how much was found and how much was not."""
    return F.when((n > 0) & (n_unresolved == 0), "RESOLVED").when(n > 0, "PARTIALLY_RESOLVED").otherwise("UNRESOLVED")


def scenario_status(status: Column) -> Column:
    """A validation's status in the terms of scenarios: passed, failed, and error for all else."""
    return F.when(status == "PASSED", "passed").when(status == "FAILED", "failed").otherwise("error")


def risk_level(raw: Column) -> Column:
    """low, medium or high, case and blanks aside; what is none of them counts as medium."""
    level = F.lower(F.trim(raw))
    return F.when(level.isin(*CONFIDENCE), level).otherwise("medium")


#: Why a fix is not tried, in the order of the tests.
SKIPPED = ["No root cause analysis available.", "Root cause is not established (insufficient evidence).", "Root cause has no exact code location to fix.", "Source code for the location is not indexed."]


def skipped_fix(insufficient: Column, location: Column, indexed: Column) -> Column:
    """Why a fix is not tried, null if it is: insufficient is null without an analysis."""
    tests = [insufficient.isNull(), insufficient, F.coalesce(location, F.lit("")) == "", ~F.coalesce(indexed, F.lit(False))]
    return F.coalesce(*(F.when(t, reason) for t, reason in zip(tests, SKIPPED, strict=True)))


def validation_request(requests: DataFrame, tests: DataFrame, prefix: str = "pytest") -> DataFrame:
    """requests: id, commands (an array), file, qualified_name; tests: id, test_file, ord. (id, commands, changed_files, target).

    Given commands win; else one command over the linked test files, each once, in order, quoted for a shell where that is needed. A request
    with neither raises an error, for no command is guessed.
    """
    first = dealt(tests.where("test_file is not null"), "id").groupBy("id", "test_file").agg(F.min("ord").alias("ord"))
    bare = F.col("test_file").rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    quoted = F.when(bare, F.col("test_file")).otherwise(F.concat(F.lit("'"), F.replace("test_file", F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
    listed = first.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", quoted.alias("f")))), lambda x: x["f"]), " ").alias("files"))
    given = F.size(F.coalesce("commands", F.array().cast("array<string>"))) > 0
    none = F.raise_error(F.lit("no commands were given and no linked tests were found")).cast("array<string>")
    commands = F.when(given, F.col("commands")).when(F.col("files").isNotNull(), F.array(F.concat(F.lit(f"{prefix} "), "files"))).otherwise(none)
    target = F.when(F.col("file").isNotNull() & F.col("qualified_name").isNotNull(), F.concat("file", F.lit("::"), "qualified_name")).otherwise(F.coalesce("file", "qualified_name"))
    return requests.join(listed, "id", "left").select("id", commands.alias("commands"), F.array_compact(F.array("file")).alias("changed_files"), target.alias("target"))
