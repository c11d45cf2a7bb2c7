import pytest
from pyspark.sql import functions as F

from factloom.operators import adjacency, graph, impact, rules, snapshot


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def start(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


@pytest.mark.parametrize(
    ("pairs", "node", "depth", "want"),
    [
        (("AB", "BC"), "C", 5, {"C": 0, "B": 1, "A": 2}),
        (("AB", "CB"), "B", 2, {"B": 0, "A": 1, "C": 1}),
        (("AB", "BC", "CD"), "D", 2, {"D": 0, "C": 1, "B": 2}),
        (("AB",), "B", 0, {"B": 0}),
        (("AB", "BC", "CA"), "A", 10, {"A": 0, "C": 1, "B": 2}),
        (("AA",), "A", 3, {"A": 0}),
        ((), "A", 3, {"A": 0}),
    ],
)
def test_reach(spark, pairs, node, depth, want):
    assert {r["node"]: r["depth"] for r in graph.reach(edges(spark, *pairs), start(spark, node), depth).collect()} == want


def test_reach_of_nulls_and_repeats(spark):
    e = spark.createDataFrame([("A", "B"), ("A", "B"), (None, "B"), ("A", None)], "src string, dst string")
    assert {r["node"] for r in graph.reach(e, start(spark, "B", "B", None), 3).collect()} == {"A", "B"}


def test_stored_edges_stay_where_they_are(spark, monkeypatch, tmp_path):
    """A level shuffles its frontier, not the edges; a hub lies in several buckets; what is stored is opened again."""
    monkeypatch.setattr(adjacency, "HUB", 50)
    pairs = [("hub", f"n{i}") for i in range(1000)] + [(f"n{i}", f"n{i // 2}") for i in range(1000)] + [("hub", "n1"), (None, "x")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    adjacency.Adjacency.store(e, root=str(tmp_path / "a")).drop()
    own = adjacency.Adjacency.open(spark, str(tmp_path / "a"))
    files = own.edges().where("node = 'hub'").select(F.input_file_name()).distinct().count()
    assert own.edges().count() == 2000 and files > 3 and own.hubs.count() == 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = spark.createDataFrame([("hub",), ("n7",)], "node string")
        plan = own.from_(frontier)._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("FileScan parquet spark_catalog")].splitlines()
        assert "Bucketed: true" in plan and not any("Exchange" in x for x in scan[scan.index(next(x for x in scan if "SortMergeJoin" in x)) :])
        assert {r["next"] for r in own.from_(frontier).collect()} == {f"n{i}" for i in range(1000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {r["node"]: r["depth"] for r in graph.reach(e, start(spark, "hub"), 3, forward=True).collect()}
    assert {r["node"]: r["depth"] for r in graph.reach(own, start(spark, "hub"), 3, forward=True).collect()} == want and len(want) == 1001
    own.drop()


def test_diamond(spark):
    e = edges(spark, "BD", "CD", "AB", "AC")
    depths = graph.reach(e, start(spark, "D"), 3)
    steps = graph.shortest_predecessors(e, depths)
    assert sorted((r["node"], r["predecessor"]) for r in steps.collect()) == [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]
    whole = [(r["node"], "".join(r["chain"]), r["capped"]) for r in graph.shortest_chains(steps, start(spark, "D"), 3).collect()]
    assert ("A", "DBA", False) in whole and ("A", "DCA", False) in whole
    one = [("".join(r["chain"]), r["capped"]) for r in graph.shortest_chains(steps, start(spark, "D"), 3, 1).where("node = 'A'").collect()]
    assert one == [("DBA", True)]
    assert graph.callers_beyond(e, graph.reach(e, start(spark, "D"), 1), 1).first()[0] == 1


def test_containers_and_downstream(spark):
    found = {(r["owner"], r["node"]): r["hops"] for r in graph.containers(edges(spark, "SF", "FC", "CM", "SM")).collect()}
    assert found["S", "M"] == 1 and found["S", "C"] == 2 and found["F", "M"] == 2
    below = {r["node"]: r["directness"] for r in graph.downstream(edges(spark, "ST", "TU", "US"), start(spark, "S")).collect()}
    assert below == {"T": "DIRECT", "U": "INDIRECT"}


def test_impact(spark):
    nodes = spark.createDataFrame([("Function", n, n, p) for n, p in (("v", "src/a.py"), ("p", "src/a.py"), ("c", "src/b.py"), ("t", "tests/test_a.py"))] + [("Service", "s", "s", None)], "label string, id string, name string, path string")
    e = [("Function", "p", "CALLS", "Function", "v"), ("Function", "c", "CALLS", "Function", "p"), ("Function", "t", "CALLS", "Function", "p"), ("File", "fa", "CONTAINS", "Function", "v"), ("File", "fb", "CONTAINS", "Function", "c")]
    e += [("Service", "s", "CONTAINS", "File", "fa"), ("Service", "s", "DEPENDS_ON", "Service", "s2"), ("Function", "c", "EXPOSES", "API", "api"), ("Function", "p", "ACCESSES", "Database", "db"), ("Database", "db", "CONTAINS", "Table", "tb"), ("Class", "k", "PUBLISHES", "Event", "ev"), ("Test", "tt", "VALIDATES", "Function", "v")]
    all_edges = spark.createDataFrame(e, "start_label string, start_id string, rel_type string, end_label string, end_id string")
    got = {(r["category"], r["id"]): r["depth"] for r in impact.analyze(nodes, all_edges, spark.createDataFrame([("v",)], "id string")).collect()}
    assert got == {
        ("PRIMARY_CHANGE", "v"): 0, ("DIRECT_CALLER", "p"): 1, ("INDIRECT_CALLER", "c"): 2, ("TEST", "t"): 2, ("TEST", "tt"): 1, ("FILE", "fb"): 2,
        ("SERVICE", "s"): 1, ("API", "api"): 3, ("DATABASE", "db"): 2, ("TABLE", "tb"): 3, ("DOWNSTREAM_SERVICE", "s2"): 1,
    }
    known = {r["category"]: r["status"] for r in impact.coverage(all_edges.where("rel_type = 'CALLS'")).collect()}
    assert set(known.values()) == {"UNRESOLVED"} and len(known) == 7


def test_naming_convention_tests(spark):
    files = spark.createDataFrame([("tests/test_a.py",), ("src/a.py",)], "path string")
    functions = spark.createDataFrame([("tests/test_a.py", "test_process_refund"), ("tests/test_a.py", "test_other"), ("src/a.py", "process_refund")], "path string, name string")
    targets = spark.createDataFrame([("process_refund",), ("refund",)], "name string")
    got = impact.naming_convention_tests(files, functions, targets, functions.limit(0)).collect()
    assert sorted((r["name"], r["target"]) for r in got) == [("test_process_refund", "process_refund"), ("test_process_refund", "refund")]
    assert impact.naming_convention_tests(files, functions, targets, functions).count() == 0


def entities(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, entity_type string, name string, properties map<string,string>, meta map<string,string>")


def test_snapshot_difference(spark):
    api = lambda m, p, h: (f"api:{m} {p}", "API", f"{m} {p}", {"method": m, "path": p}, {"handler": h, "service": "s"})
    lib = ("dependency:x", "DEPENDENCY", "x", {}, {})
    old = entities(spark, api("GET", "/a", "h1"), api("GET", "/c", "h2"), api("GET", "/d", "h3"), lib)
    new = entities(spark, api("GET", "/b", "h1"), api("POST", "/c", "h2"), api("PUT", "/e", "h3"))
    got = sorted((r["change_type"], r["category"], r["name"]) for r in snapshot.entity_changes(old, new).collect())
    assert got == [("ADDED", "API_ADDED", "PUT /e"), ("MODIFIED", "API_METHOD_CHANGED", "GET /c -> POST /c"), ("MODIFIED", "API_PATH_CHANGED", "GET /a -> GET /b"), ("REMOVED", "API_REMOVED", "GET /d")]
    assert snapshot.entity_changes(old, old).count() == 0
    rels = spark.createDataFrame([], "rel_type string, source string, target string, properties map<string,string>")
    assert snapshot.content_hash(old, rels).first() == snapshot.content_hash(old.orderBy(F.rand(1)).repartition(4), rels).first()
    assert snapshot.content_hash(old, rels).first() != snapshot.content_hash(new, rels).first()


def test_evaluation_of_nothing(spark):
    v = spark.createDataFrame([("a", None, None, "NOT_REQUIRED", False, True), ("b", None, None, "NOT_REQUIRED", False, False)], "id string, unexpected_error string, infrastructure_error string, startup string, overall_timeout boolean, tests_expected boolean")
    runs = spark.createDataFrame([], "id string, seq int, kind string, exit_code int, timed_out boolean, passed long, failed long, errored long")
    got = {r["id"]: (r["status"], r["exit_code"], r["tests_passed"]) for r in rules.evaluate(v, runs).collect()}
    assert got == {"a": ("ERROR", None, None), "b": ("PASSED", 0, None)}
