"""Stack traces, log lines and test output as rows, and the rules that tie logs to a failure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .needles import substring_hits
from .resolve import band
from .tables import ROWS_A_TASK, written

#: A frame line, an exception line with and without a message, a time, an id.
FRAME = r'^\s*File "([^"]+)", line (\d+), in (\S+)\s*$'
EXCEPTION = r"^([A-Za-z_][A-Za-z0-9_.]*)\s*:\s*(.*)$"
BARE_EXCEPTION = r"^[A-Za-z_][A-Za-z0-9_.]*$"
TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
CORRELATION = r"(?i)(?:correlation[_-]?id|request[_-]?id|trace[_-]?id)[=:]\s*([A-Za-z0-9_-]+)"
NEW_LINE = r"\r\n|\r|\n"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def stack_frames(traces: DataFrame) -> DataFrame:
    """traces: trace_id, raw. (trace_id, frame_no, file, line, function, snippet), frame_no from 1.

    A frame's snippet is the next line, unless that is blank, a frame, or looks like an exception. Null and empty traces
    have no frames. Lines are looked at inside their row, so nothing is shuffled.
    """
    lines = F.split(F.coalesce("raw", F.lit("")), NEW_LINE)
    looked = traces.select("trace_id", lines.alias("ls"))
    at = F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.get("ls", i).rlike(FRAME))
    each = looked.select("trace_id", "ls", F.posexplode(at).alias("pos", "i"))
    line, after = F.get("ls", F.col("i")), F.get("ls", F.col("i") + 1)
    code = _trimmed(after)
    plain = after.isNotNull() & (code != "") & ~after.rlike(FRAME) & ~code.rlike(EXCEPTION) & ~code.rlike(BARE_EXCEPTION)
    return each.select(
        "trace_id",
        (F.col("pos") + 1).alias("frame_no"),
        F.regexp_extract(line, FRAME, 1).alias("file"),
        F.try_to_number(F.regexp_extract(line, FRAME, 2), F.lit("9999999999")).cast("int").alias("line"),
        F.regexp_extract(line, FRAME, 3).alias("function"),
        F.when(plain, code).alias("snippet"),
    )


def exceptions(traces: DataFrame) -> DataFrame:
    """(trace_id, exception_type, message) by the last line that isn't blank; both null if that is no exception."""
    full = F.filter(F.split(F.coalesce("raw", F.lit("")), NEW_LINE), lambda x: _trimmed(x) != "")
    last = traces.select("trace_id", F.try_element_at(full, F.lit(-1)).alias("raw_line")).withColumn("line", _trimmed(F.col("raw_line")))
    no = F.col("raw_line").isNull() | F.col("raw_line").rlike(FRAME) | F.startswith("line", F.lit("Traceback (most recent call last)"))
    told = F.col("line").rlike(EXCEPTION)
    kind = F.when(no, None).when(told, F.regexp_extract("line", EXCEPTION, 1)).when(F.col("line").rlike(BARE_EXCEPTION), F.col("line"))
    message = F.when(~no & told, F.nullif(_trimmed(F.regexp_extract("line", EXCEPTION, 2)), F.lit("")))
    return last.select("trace_id", kind.alias("exception_type"), message.alias("message"))


def log_entry(raw: Column) -> Column:
    """(ts, correlation_id) of a log line: its first time (without an offset: UTC) and its first id, null where it has none."""
    found = F.regexp_extract(raw, TIME, 0)
    zoned = F.when(found.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.regexp_replace(found, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(found, F.lit("Z")))
    return F.struct(zoned.try_cast("timestamp").alias("ts"), F.nullif(F.regexp_extract(raw, CORRELATION, 1), F.lit("")).alias("correlation_id"))


#: Rules that tie a log line to a failure, the first one that fits counts.
RULES = ["correlation_id", "timestamp_window", "exception_type", "exception_message", "file_path", "method"]


#: Lines and failures of one needle that a tile holds, failures that a row of it holds, and pairs that a task makes, about.
TILE_LINES, TILE_FAILURES, PIECE, PAIRS_A_TASK = 2_000, 20_000, 128, 50_000_000


def _met(hits: DataFrame, needles: DataFrame) -> DataFrame:
    """hits: log_id, raw, l_at, l_id, needle; needles: failure_id, f_id, f_at, rule, needle and the strings of RULES[2:].

    (log_id, l_at, l_id, failure_id, f_id, f_at, rule): failures and lines of the same needle, but for those that a string of an earlier rule ties.
    A needle's pairs are cut into tiles of some lines and some failures, which are dealt evenly, however common a needle is: lines and failures are repeated
    once for thousands of pairs, pairs themselves never move. Failures with the same strings stand in rows of PIECE at most, and each such row meets the
    lines of its tile one after the other: so ids repeat at short distances, which files that pairs are written to encode in a small part of a byte.
    """
    spark, strings = hits.sparkSession, RULES[2:-1]
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    size = hits.groupBy("needle").agg(F.count("*").alias("lines")).join(needles.groupBy("needle").agg(F.count("*").alias("failures")), "needle")
    size = written(size.withColumns({"across": parts("lines", TILE_LINES), "down": parts("failures", TILE_FAILURES)}), "log-tiles")
    times = lambda a, b: F.coalesce(F.sum(F.col(a).cast("double") * F.col(b)), F.lit(0.0))
    total = size.agg(times("lines", "failures").alias("pairs"), (times("lines", "down") + times("failures", "across")).alias("rows")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total["pairs"] // PAIRS_A_TASK) + 1, int(total["rows"] // ROWS_A_TASK) + 1)
    # at most one for TILE_LINES hits or TILE_FAILURES failures
    cut = F.broadcast(size.where("across > 1 or down > 1").select("needle", "across", "down"))
    many = lambda c: F.coalesce(c, F.lit(1))
    own = lambda c, of: F.pmod(F.xxhash64(c), many(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), many(of) - 1))

    told = [F.when(F.col("rule") > i, F.col(r)).alias(r) for i, r in enumerate(strings, 2)]
    alike = needles.join(cut, "needle", "left").select("needle", "across", own("failure_id", "down").alias("y"), "rule", *told, F.struct("failure_id", "f_id", "f_at").alias("f"))
    alike = alike.groupBy("needle", "across", "y", "rule", *strings).agg(F.collect_list("f").alias("fs"))
    starts = F.sequence(F.lit(1), F.size("fs"), F.lit(PIECE))
    pieces = written(alike.select("needle", "across", "y", "rule", *strings, F.explode(F.transform(starts, lambda i: F.slice("fs", i, PIECE))).alias("fs")), "log-pieces")
    pieces = pieces.select("needle", every("across").alias("x"), "y", "rule", *strings, "fs")
    lines = hits.join(cut, "needle", "left").select("needle", own("log_id", "across").alias("x"), every("down").alias("y"), "log_id", "l_at", "l_id", "raw")
    tile = ["needle", "x", "y"]
    # the rows of the first side are gone through, those of the second are held
    met = pieces.repartition(n, *tile).hint("merge").join(lines.repartition(n, *tile), tile)
    earlier = reduce(Column.__or__, (F.coalesce(F.contains("raw", F.col(r)), F.lit(False)) for r in strings))
    # as many partitions as before, the same ones: a join's stage holds all rows that come of one row of its first side, so pairs are made in a stage of their own
    return met.where(~earlier).select("log_id", "l_at", "l_id", "rule", "fs").coalesce(n).select("log_id", "l_at", "l_id", "rule", F.inline("fs"))


def correlate_all(logs: DataFrame, failures: DataFrame, seconds: int = 5) -> DataFrame:
    """logs: log_id, raw; failures: failure_id and correlation_id, ts, exception_type, message, file_path, qualified_name, each of which may be null.

    (failure_id, log_id, matched_on): each pair that a rule ties, with the first rule that does: the id, the time (at most `seconds` away), then exception type,
    message, file name and method name as parts of the line. Ids meet by an equi join, times by a band join, strings by an automaton over the distinct
    strings of all failures; empty ones tie nothing. A log_id or failure_id that is there twice is one.
    A pair that a rule finds is left out where an earlier rule ties it, which its own two rows tell: so pairs, of which there may be as many as failures times lines,
    leave the join that makes them and are neither shuffled nor gathered, unless an id is there twice. The join of strings is one of tiles (see _met()).
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    entry = log_entry(F.col("raw"))
    read = logs.select("log_id", "raw", entry.alias("entry")).select("log_id", "raw", micros("entry.ts").alias("l_at"), F.col("entry.correlation_id").alias("l_id"))
    read = written(read, "log-entries")
    last = lambda c, sep: F.substring_index(c, sep, -1)
    wanted = [F.col("exception_type"), F.col("message"), last("file_path", "/"), last("qualified_name", ".")]
    given = [F.nullif(c.cast("string"), F.lit("")).alias(r) for r, c in zip(RULES[2:], wanted, strict=True)]
    asked = written(failures.select("failure_id", F.nullif("correlation_id", F.lit("")).alias("f_id"), micros("ts").alias("f_at"), *given), "log-failures")
    width = seconds * 1_000_000
    by_both = [F.col("f_id") == F.col("l_id"), F.abs(F.col("f_at") - F.col("l_at")) <= width]
    ties = [F.coalesce(t, F.lit(False)) for t in by_both]

    by_id = read.join(asked.select("failure_id", F.col("f_id").alias("l_id")), "l_id").select("failure_id", "log_id", F.lit(0).alias("rule"))
    # of the two sides band() lays out the failures
    at = lambda c: F.timestamp_micros(F.col(c)).alias("ts")
    near = band(read.select(F.struct("log_id", "l_id").alias("row"), at("l_at")), asked.select(F.struct("failure_id", "f_id").alias("other"), at("f_at")), seconds)
    by_time = near.select("row.*", "other.*").where(~ties[0]).select("failure_id", "log_id", F.lit(1).alias("rule"))
    needles = F.explode(F.array(*(F.struct(F.lit(RULES.index(r)).alias("rule"), F.col(r).alias("needle")) for r in RULES[2:]))).alias("x")
    needles = asked.select("*", needles).select(*asked.columns, "x.rule", "x.needle").where("needle is not null")
    hits = substring_hits(read.withColumn("text", F.col("raw")), "text", needles, "needle")
    by_part = _met(hits, needles).where(~ties[0] & ~ties[1]).select("failure_id", "log_id", "rule")
    found = by_id.unionByName(by_time).unionByName(by_part)
    twice = lambda d, c: not d.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if twice(asked, "failure_id") or twice(read, "log_id"):
        found = found.groupBy("failure_id", "log_id").agg(F.min("rule").alias("rule"))
    return found.select("failure_id", "log_id", F.element_at(F.array(*map(F.lit, RULES)), F.col("rule") + 1).alias("matched_on"))


def correlate(logs: DataFrame, failure: dict, seconds: int = 5) -> DataFrame:
    """correlate_all() of one failure, a dict: (log_id, matched_on)."""
    names = ["correlation_id", "ts", "exception_type", "message", "file_path", "qualified_name"]
    row = [(0, *(failure.get(n) for n in names))]
    schema = "failure_id int, " + ", ".join(f"{n} {'timestamp' if n == 'ts' else 'string'}" for n in names)
    return correlate_all(logs, logs.sparkSession.createDataFrame(row, schema), seconds).select("log_id", "matched_on")


def test_counts(output: Column) -> Column:
    """(passed, failed, errored, failed_tests) of pytest or unittest output; counts are null, not 0, where no summary is found."""
    lines = F.split(output, NEW_LINE)
    summary = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"\bin \d+(?:\.\d+)?s\b") & x.rlike(r"(\d+) (passed|failed|errors?)\b")), F.lit(-1))
    number = lambda word: F.coalesce(F.try_element_at(F.regexp_extract_all(summary, F.lit(rf"(\d+) {word}\b"), F.lit(1)), F.lit(-1)).cast("long"), F.lit(0))
    names = F.array_distinct(F.regexp_extract_all(output, F.lit(r"(?m)^(?:FAILED|ERROR) (\S+)"), F.lit(1)))
    ran = F.regexp_extract(output, r"(?m)^Ran (\d+) tests? in ", 1).try_cast("long")
    result = F.regexp_extract(output, r"(?m)^FAILED \(([^)]*)\)", 1)
    part = lambda key: F.coalesce(F.regexp_extract(result, rf"{key}=(\d+)", 1).try_cast("long"), F.lit(0))
    dotted = F.array_distinct(F.regexp_extract_all(output, F.lit(r"(?m)^(?:FAIL|ERROR): \S+ \(([^)]+)\)"), F.lit(1)))
    as_struct = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("passed", "failed", "errored", "failed_tests"), strict=True)))
    none = F.lit(None).cast("long")
    return (
        F.when(summary.isNotNull(), as_struct(number("passed"), number("failed"), number("errors?"), names))
        .when(ran.isNotNull(), as_struct(F.greatest(ran - part("failures") - part("errors"), F.lit(0)), part("failures"), part("errors"), dotted))
        .otherwise(as_struct(none, none, none, F.array().cast("array<string>")))
    )


def line_window(lines: DataFrame, points: DataFrame, around: int = 3) -> DataFrame:
    """lines: file, n, text; points: row, file, line. (row, n, text) of the lines up to `around` away from each point."""
    near = points.select("row", "file", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - around), F.greatest(F.lit(1), F.col("line") + around))).alias("n"))
    return near.join(lines, ["file", "n"]).select("row", "n", "text")


def numbered_lines(files: DataFrame) -> DataFrame:
    """files: path, text. (file, n, text), n from 1; a last line end begins no further line."""
    lines = F.split(F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""), NEW_LINE)
    return files.where("text != ''").select(F.col("path").alias("file"), F.posexplode(lines).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("n"), "text")


def first_line_with(files: DataFrame, needle: Column) -> DataFrame:
    """(path, line): the first line of each file that holds its needle, null if none does."""
    hit = lambda x, i: F.when(F.contains(x, needle), i + 1)
    return files.select("path", F.array_min(F.transform(F.split("text", NEW_LINE), hit)).alias("line"))


def recent(changes: DataFrame, by: str, n: int = 5) -> DataFrame:
    """changes: by, commit_hash, committed_at. The n newest of each `by` with their rank; ties by hash."""
    own = Window.partitionBy(by).orderBy(F.col("committed_at").desc(), "commit_hash")
    return changes.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n)


def merged_history(changes: DataFrame, precedence: list[str]) -> DataFrame:
    """changes: label, commit_hash, committed_at and more. Each commit once, under the first label of `precedence` that it has."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("label"))
    names = changes.columns
    best = changes.groupBy("commit_hash").agg(F.min(F.struct(rank.alias("__rank"), *(c for c in names if c != "commit_hash"))).alias("b"))
    return best.select(*(F.col("commit_hash") if c == "commit_hash" else F.col(f"b.{c}") for c in names))
