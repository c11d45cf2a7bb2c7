"""What a task holds and what is read again must not grow with the tables: plans and partitions of the queries, and odd rows through the same steps."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import evidence, logs, projection, rules, snapshot, tables
from factloom.plans import code_queries, facts, graph_queries, resolve_queries


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain(mode="simple")
    return capsys.readouterr().out


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 10)


def test_log_pairs_are_not_shuffled(spark, capsys):
    """what the rules find is not grouped again, unless an id is there twice."""
    schema = "failure_id int, correlation_id string, ts timestamp, exception_type string, message string, file_path string, qualified_name string"
    lines = [(1, "2024-01-01T00:00:00Z boom in a.py trace_id=u-1"), (2, "boom"), (3, None), (4, "nothing a.py")]
    fails = spark.sql("SELECT 1 AS failure_id, 'u-1' AS correlation_id, timestamp '2024-01-01 00:00:03' AS ts, 'boom' AS exception_type, 'boom' AS message, 'x/a.py' AS file_path, 'a.py' AS qualified_name UNION ALL SELECT 2, '', timestamp '2024-01-01 00:00:05', '', 'boom', 'x/a.py', NULL")
    assert fails.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    rows = spark.createDataFrame(lines, "log_id int, raw string")
    found = logs.correlate_all(rows, fails, 5)
    want = {(1, 1, "correlation_id"), (1, 2, "exception_type"), (2, 1, "timestamp_window"), (2, 2, "exception_message"), (2, 4, "file_path")}
    got = [tuple(r) for r in found.collect()]
    assert set(got) - {(1, 4, "method"), (1, 4, "file_path")} == want and len(got) == 6 and (1, 4, "file_path") in got
    assert "failure_id" not in "".join(line for line in plan_of(found, capsys).splitlines() if "Aggregate" in line)
    twice = logs.correlate_all(rows.union(spark.createDataFrame([(2, "2024-01-01T00:00:00Z u")], rows.schema)), fails, 5).collect()
    assert len(twice) == 6 and (1, 2, "timestamp_window") in {tuple(r) for r in twice}


def test_log_pairs_take_little_disk(spark, tmp_path):
    """two million pairs of one needle are written in a quarter of a byte each; an id stands near where it stood before."""
    lines = spark.range(400).select(F.col("id").alias("log_id"), F.lit("boom").alias("raw"))
    none = F.lit(None).cast("string")
    fails = spark.range(5003).select(F.col("id").alias("failure_id"), none.alias("correlation_id"), none.cast("timestamp").alias("ts"), F.lit("boom").alias("exception_type"), none.alias("message"), none.alias("file_path"), none.alias("qualified_name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        logs.correlate_all(lines, fails).write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = spark.read.parquet(str(tmp_path / "pairs"))
    assert kept.count() == kept.distinct().count() == 400 * 5003
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 400 * 5003 / 4


def test_log_pairs_in_tiles(spark, monkeypatch, capsys):
    """common needles are cut by lines and by failures, each pair is met once, and tasks follow the number of pairs."""
    for name, n in (("TILE_LINES", 7), ("TILE_FAILURES", 5), ("PIECE", 2), ("PAIRS_A_TASK", 100)):
        monkeypatch.setattr(logs, name, n)
    lines = [(i, "boom in a.py" if i % 3 else "rare") for i in range(60)] + [(None, "boom")]
    fails = [(i, f"u{i}", "boom" if i % 2 else None, "in a" if i % 4 == 1 else "rare" if i == 2 else None, "x/a.py" if i % 5 == 0 else None, "q.boom") for i in range(33)]
    schema = "failure_id int, correlation_id string, exception_type string, message string, file_path string, qualified_name string"
    found = logs.correlate_all(spark.createDataFrame(lines, "log_id int, raw string"), spark.createDataFrame(fails, schema).withColumn("ts", F.lit(None).cast("timestamp")), 5)
    assert "27), REPARTITION_BY_NUM" in plan_of(found, capsys)  # 2,629 pairs
    want = []
    for f, _, kind, message, path, name in fails:
        parts = [("exception_type", kind), ("exception_message", message), ("file_path", path and path[2:]), ("method", name[2:])]
        want += [(f, k, rule) for k, raw in lines if (rule := next((r for r, x in parts if x and x in raw), None))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_calls_are_made_once(spark, sf, capsys):
    """F8, F9, F10: the start and the chunks come out of the written calls, not out of the lines again."""
    assert "lineitem" not in facts.for_duckdb("SELECT * FROM start", ["calls"]) and "lineitem" in facts.for_duckdb("SELECT * FROM start")
    for df in graph_queries.impact_graph(spark, sf):
        assert "lineitem" not in plan_of(df, capsys)
def test_first_order_is_dealt_once(spark, capsys, small_tasks):
    """one shuffle, into as many partitions as the rows ask for."""
    items = spark.range(1000).select((F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("v"), F.col("id").alias("o"))
    out = evidence.in_first_order(items, "k", "v", ["o"])
    told = plan_of(out, capsys)
    assert told.count("Exchange") == 1 and "100), REPARTITION_BY_NUM" in told
    assert {r["k"]: r["values"] for r in out.collect()}[3] == [3, 4, 5, 6, 0, 1, 2]


def test_linked_tests_are_dealt_once(spark, capsys, small_tasks):
    """the tests of requests are dealt once, by request."""
    tests = spark.range(1000).select((F.col("id") % 50).alias("id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("test_file"), F.col("id").alias("ord"))
    asked = spark.range(50).select("id", F.lit(None).cast("array<string>").alias("commands"), F.lit("f.py").alias("file"), F.lit("q").alias("qualified_name"))
    out = rules.validation_request(asked, tests)
    assert "100), REPARTITION_BY_NUM" in plan_of(out, capsys)
    assert {r["id"]: r["commands"] for r in out.collect()}[3] == ["pytest t3 t4 t5 t6 t0 t1 t2"]


def test_evidence_location_by_claim(spark, sf, capsys, small_tasks):
    """the lines are dealt by their order before they are numbered; no count of distinct locations gathers a claim's rows again."""
    told = plan_of(resolve_queries.evidence_location(spark, sf), capsys)
    assert "REPARTITION_BY_NUM" in told and "count(distinct" not in told and "count(CASE" not in told
    claims = spark.createDataFrame([(1, None, "f.py:3"), (2, None, "f.py"), (3, None, "f.py")], "claim int, location_id string, location string")
    known = spark.createDataFrame([(1, 1, "rca", "d", "f.py::a"), (1, 2, "rca", "d", "f.py::a"), (2, 1, "rca", "d", "f.py::a"), (2, 2, "fix_localization", "d", "f.py::b"), (3, 1, "rca", "d", "g.py")], "claim int, n int, source string, description string, location string")
    assert {tuple(r) for r in rules.evidence_location(claims, known).collect()} == {(1, "f.py::a", "file"), (2, "f.py::b", "file"), (3, None, None)}


def test_git_evidence_ranks_before_it_tells_apart(spark, capsys, small_tasks):
    """repeated commits and files under two names count once, and no distinct over all commits of all files is shuffled."""
    files = spark.createDataFrame([("o", "a"), ("o", "a"), ("p", "b")], "owner string, file string")
    status = spark.createDataFrame([("c", "R", "a")], "path string, status string, old_path string")
    rows = [(f"h{i}", None, "m", ["a", "c", "a"] if i % 2 else ["c"], i // 2) for i in range(9)] * 2
    commits = spark.createDataFrame(rows, "commit_hash string, committed_at timestamp, message string, changed_files array<string>, ord int")
    out = snapshot.git_evidence(files, status, commits, "0", "1")
    assert sorted((r["owner"], r["details"]) for r in out.collect()) == [("o", f"commit h{i} touched a: m") for i in range(3)] + [("o", "file renamed a -> c between 0 and 1")]
    changed = code_queries._changed_files(spark, "/root/testdata/sf0.001")
    assert plan_of(changed, capsys).count("Exchange") == 1
    assert changed.select(F.explode("changed_files")).count() == facts.fact(spark, "/root/testdata/sf0.001", "src_changes").count()


def test_calls_without_an_end_are_dropped_first(spark, sf, capsys):
    """calls meet their callers last, when those without a known target are gone."""
    _, table, _ = code_queries._parsed(spark, sf)
    names = projection.symbols(table("src_classes"), table("src_methods"), table("src_functions"))
    joins = [line for line in plan_of(projection.call_edges(table("src_calls"), names), capsys).splitlines() if "Join [" in line]
    assert "caller" in joins[0] and not any("caller" in j for j in joins[1:])
