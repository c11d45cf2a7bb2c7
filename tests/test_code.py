import subprocess

import pytest
from pyspark.sql import functions as F

from factloom.operators import evidence, impact, impact_paths, localize, projection, snapshot
from factloom.operators import facts as facts_of
from factloom.sources import manifests, python_code, source_tree


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "A B")
    lines = [f"x{i} = {i}" for i in range(9)]
    for n, change in enumerate(((), (1,), (7,), (1, 7))):
        for i in change:
            lines[i] = f"x{i} = {n}00"
        (root / "a,b.py").write_text("\n".join(lines) + "\n")
        run("add", "-A")
        run("commit", "-qm", f"commit {n}\n\nwith a body")
    return str(root)


def test_line_history_and_blame(spark, repo):
    source_tree.register(spark)
    read = lambda name, **o: spark.read.format(name).option("path", repo).options(**o).load()
    log = read("git_line_log", ranges='[["a,b.py", 1, 3], ["a,b.py", 8, 8], ["gone.py", 1, 2], ["a,b.py", 90, 95]]').orderBy("first", "rank").collect()
    assert [(r["first"], r["message"].split("\n")[0]) for r in log] == [(1, "commit 3"), (1, "commit 1"), (1, "commit 0"), (8, "commit 3"), (8, "commit 2"), (8, "commit 0")]
    assert log[0]["author_name"] == "A B" and log[0]["committed_at"] is not None
    blame = {r["line_number"]: (r["author_name"], r["message"].split("\n")[0]) for r in read("git_blame", files='["a,b.py"]').collect()}
    assert blame[2] == ("A B", "commit 3") and blame[1] == ("A B", "commit 0") and len(blame) == 9
    with pytest.raises(Exception, match="not a revision"):
        read("git_line_log", ranges='[["a,b.py", 1, 3]]', revision="--all").collect()


def test_roots_below_excluded_folders(spark, tmp_path):
    source_tree.register(spark)
    (tmp_path / "build" / "src").mkdir(parents=True)
    (tmp_path / "build" / "src" / "a.py").write_text("x = 1\n")
    read = lambda **o: spark.read.format("source_tree").option("path", str(tmp_path / "build" / "src")).options(**o).load().count()
    assert read() == 1 and read(above="true") == 0


def test_chunk_files(spark):
    rows = [("a/b.py", "x"), ("a/.hid/b.py", "x"), ("env/b.py", "x"), ("envs/env.py", "a\ufffdb"), (".top.py", "x")]
    got = {r["path"]: r["text"] for r in python_code.chunk_files(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/b.py": "x", "envs/env.py": "ab", ".top.py": "x"}


def test_declared_apis_and_bad_manifests(spark):
    files = spark.createDataFrame([("b/pyproject.toml", "not toml ["), ("c/pyproject.toml", "[project]\n"), ("own.json", '{"apis": [{"method": "get", "path": "/a"}, {"method": "get", "path": "a"}, 3]}')], "path string, text string")
    assert [r["file"] for r in manifests.unreadable_manifests(files).collect()] == ["b/pyproject.toml"]
    odd = spark.createDataFrame([("a/pyproject.toml", 'project = "x"\n'), ("b/pyproject.toml", '[project]\ndependencies = "abc"\n'), ("c/pyproject.toml", '[project]\ndependencies = ["x", 3]\n'), ("d/pyproject.toml", "")], "path string, text string")
    assert [(r["file"], r["name"]) for r in manifests.declared_dependencies(odd).collect()] == [("c/pyproject.toml", "x")]
    assert sorted((r["file"], r["reason"]) for r in manifests.unreadable_manifests(odd).collect()) == [("a/pyproject.toml", "project is no table"), ("b/pyproject.toml", "dependencies are no list")]
    said = sorted((r["value"] or "", r["method"], r["entity_type"], r["rel_type"], r["line"]) for r in manifests.declarations(files, "own.json").collect())
    assert said == [("", None, "API", "EXPOSES", None)] * 2 + [("/a", "GET", "API", "EXPOSES", 1)]
    calls = spark.createDataFrame([("a.py", "http://me/x", 1), ("a.py", "http://you/x", 2), ("tests/a.py", "http://you/x", 3)], "file_path string, name string, line int")
    services = spark.createDataFrame([("me",), ("You",)], "name string")
    assert [(r["line"], r["service"]) for r in manifests.http_links(calls, services, "me").collect()] == [(2, "You")]


SOURCES = {
    "payment/__init__.py": "",
    "payment/validator.py": "def validate_payment(x):\n    return bool(x)\n",
    "payment/service.py": "from .validator import validate_payment\n\n\nclass PaymentService:\n    def process(self, x):\n        return validate_payment(x)\n",
    "tests/test_service.py": "from payment.service import PaymentService\n\n\ndef test_process():\n    PaymentService().process(1)\n",
}


def test_projection_of_parsed_sources(spark):
    files = spark.createDataFrame([(p, p.rpartition("/")[2], t, t.count("\n")) for p, t in SOURCES.items()], "path string, name string, text string, line_count int")
    parsed = python_code.python_facts(files).cache()
    part = lambda k: parsed.where(F.col("kind") == k).withColumn("repository", F.lit("r"))
    calls = facts_of.resolve_calls(part("call").withColumn("row", F.monotonically_increasing_id()), part("import"), part("class"), part("method"), part("function"))
    imports = facts_of.import_edges(part("import"), files).withColumn("repository", F.lit("r"))
    commits = spark.createDataFrame([("r", "c1", "m", "a", "e", None, ["payment/service.py", "gone.py"])], "repository string, commit_hash string, message string, author_name string, author_email string, committed_at timestamp, changed_files array<string>")
    own = files.withColumn("repository", F.lit("r"))
    repos = spark.createDataFrame([("r", "shop", "/r", None)], "repository string, name string, root_path string, remote_url string")
    nodes = projection.nodes(repos, own, part("class"), part("method"), part("function"), calls, commits)
    name = {r["id"]: (r["label"], r["name"], r["unresolved_calls"]) for r in nodes.collect()}
    assert sorted(label for label, *_ in name.values()) == ["Class", "Commit", "File", "File", "File", "File", "Function", "Function", "Method", "Repository"]
    assert {n: u for _, n, u in name.values() if u} == {"test_process": ["PaymentService().process"], "validate_payment": ["bool"]}
    edges = projection.edges(own, part("class"), part("method"), part("function"), calls, imports, commits)
    got = {(name[r["start_id"]][1], r["rel_type"], name[r["end_id"]][1]) for r in edges.where("rel_type != 'CONTAINS'").collect() if r["start_id"] in name}
    assert got == {("process", "CALLS", "validate_payment"), ("test_process", "CALLS", "PaymentService"), ("service.py", "IMPORTS", "validator.py"), ("test_service.py", "IMPORTS", "service.py"), ("c1", "MODIFIES", "service.py")}


def graph_of(spark, nodes, edges):
    n = spark.createDataFrame([(*x, x[1], p) for *x, p in nodes], "label string, id string, name string, path string")
    return n, spark.createDataFrame([(a.split(":")[0], a, rel, b.split(":")[0], b) for a, rel, b in edges], "start_label string, start_id string, rel_type string, end_label string, end_id string")


def test_routes_of_an_impact(spark):
    """checkout -> process -> validate, twice from `both`; architecture and tests around them."""
    nodes, edges = graph_of(
        spark,
        [("Method", "Method:validate", "a.py"), ("Method", "Method:process", "a.py"), ("Function", "Function:b", "b.py"), ("Function", "Function:c", "b.py"), ("Function", "Function:both", "c.py"), ("Function", "Function:x_Method:validate", "tests/test_a.py"), ("Class", "Class:K", None), ("Service", "Service:s", None)],
        [
            ("Method:process", "CALLS", "Method:validate"), ("Function:b", "CALLS", "Method:process"), ("Function:c", "CALLS", "Method:process"), ("Function:both", "CALLS", "Function:b"), ("Function:both", "CALLS", "Function:c"),
            ("Class:K", "CONTAINS", "Method:validate"), ("Class:L", "CONTAINS", "Method:process"), ("File:a", "CONTAINS", "Class:K"), ("File:a2", "CONTAINS", "Class:L"), ("File:b", "CONTAINS", "Function:b"), ("Service:s", "CONTAINS", "File:b"),
            ("Function:b", "EXPOSES", "API:x"), ("Class:L", "PUBLISHES", "Event:e"), ("Method:validate", "ACCESSES", "Database:d"), ("Database:d", "CONTAINS", "Table:t"), ("Method:validate", "EXPOSES", "Event:no"),
            ("Service:s", "DEPENDS_ON", "Service:t"), ("Service:t", "CALLS", "Service:u"), ("Service:u", "CALLS", "Service:s"), ("Test:v", "VALIDATES", "Method:validate"),
        ],
    )
    start = spark.createDataFrame([("Method:validate",)], "id string")
    found = impact_paths.impact_routes(nodes, edges, start, 3).collect()
    routes = {}
    for r in found:
        routes.setdefault((r["category"], r["id"]), set()).add(" ".join((("<" if s["direction"] == "REVERSE" else ">" if s["direction"] else "~") if i else "") + s["id"].split(":", 1)[1] for i, s in enumerate(r["steps"])))
    assert routes["INDIRECT_CALLER", "Function:both"] == {"validate <process <b <both", "validate <process <c <both"}
    assert routes["DIRECT_CALLER", "Method:process"] == {"validate <process"}
    assert routes["CLASS", "Class:L"] == {"validate <process <L"} and ("CLASS", "Class:K") not in routes
    assert routes["FILE", "File:a2"] == {"validate <process <L <a2"} and routes["FILE", "File:b"] == {"validate <process <b <b"} and ("FILE", "File:a") not in routes
    assert routes["SERVICE", "Service:s"] == {"validate <process <b <s", "validate <process <b <b <s"}
    assert routes["API", "API:x"] == {"validate <process <b >x"} and routes["EVENT", "Event:e"] == {"validate <process <L >e"} and ("EVENT", "Event:no") not in routes
    assert routes["DATABASE", "Database:d"] == {"validate >d"} and routes["TABLE", "Table:t"] == {"validate >d >t"}
    assert routes["DOWNSTREAM_SERVICE", "Service:u"] == {"validate <process <b <s >t >u", "validate <process <b <b <s >t >u"}
    assert routes["TEST", "Test:v"] == {"validate <v"} and routes["TEST", "tests/test_a.py::Function:x_Method:validate"] == {"validate ~:Function:x_Method:validate"}
    items = impact.analyze(nodes, edges, start)
    assert {(r["category"], r["id"]) for r in items.where("category != 'PRIMARY_CHANGE'").collect()} == {k for k in routes if "::" not in k[1]}
    one = impact_paths.impact_routes(nodes, edges, start, 3, limit=1).where("id = 'Function:both'").collect()
    assert len(one) == 1 and one[0]["capped"] and not any(r["capped"] for r in found)
    gaps = impact_paths.unresolved(nodes.withColumn("unresolved_calls", F.array().cast("array<string>")), edges, start, impact_paths.impact_routes(nodes, edges, start, 3), 3)
    assert gaps.count() == 0 and impact_paths.status(items, gaps).first()["status"] == "RESOLVED"
    lost = spark.createDataFrame([("nope",)], "id string")
    gaps = impact_paths.unresolved(nodes.withColumn("unresolved_calls", F.array().cast("array<string>")), edges, lost, found and impact_paths.impact_routes(nodes, edges, lost, 1), 1)
    assert impact_paths.status(impact.analyze(nodes, edges, lost, 1), gaps).first()["status"] == "UNRESOLVED"


def test_snapshots_of_different_repositories(spark):
    one = lambda x: spark.createDataFrame([(x,)], "repository string")
    assert snapshot.same_repository(one("a"), one("a")).first()["repository"] == "a"
    with pytest.raises(Exception, match="different repositories"):
        snapshot.same_repository(one("a"), one("b")).collect()


def test_contract_of_base_names(spark):
    tests = spark.createDataFrame([("k", "a/b/test_x.py", "test_y", "y")], "key string, test_file string, test_function string, target string")
    rows = evidence.of_tests(tests)
    assert [evidence.contract(rows, base).first()["location"] for base in (False, True)] == ["a/b/test_x.py::test_y", "test_x.py::test_y"]


def test_ordering_and_validation_without_tests(spark):
    from factloom.operators import rules

    changes = spark.createDataFrame([("ADDED", "EVENT", "b", "1"), ("ADDED", "SERVICE", "z", "2"), ("REMOVED", "EVENT", "a", "3")], "change_type string, entity_type string, category string, entity_id string")
    assert [r["entity_id"] for r in snapshot.in_order(changes).collect()] == ["2", "3", "1"]
    asked = spark.createDataFrame([("a", None, "f.py", None)], "id string, commands array<string>, file string, qualified_name string")
    with pytest.raises(Exception, match="no linked tests"):
        rules.validation_request(asked, spark.createDataFrame([], "id string, test_file string, ord int")).collect()


def test_relevant_code_beyond_the_file(spark):
    lines = spark.createDataFrame([("a", i, f"l{i}") for i in range(1, 130)], "file string, n int, text string")
    asked = spark.createDataFrame([(1, "a", 60, 70), (2, "a", 128, 500), (3, "a", 200, 210), (4, "b", 1, 2), (5, "a", None, None)], "row int, file string, first int, last int")
    got = {r["row"]: (r["lines"], r["status"]) for r in localize.relevant_code(asked, lines).collect()}
    assert got[1] == ([f"l{i}" for i in range(60, 71)], "RESOLVED") and got[2][0] == ["l128", "l129"]
    assert [got[i] for i in (3, 4, 5)] == [([], "UNRESOLVED")] * 3


def test_changed_node_makes_no_pairs(spark, capsys):
    """Every row looks up one counted place: no join is left with a condition that has to look at all definitions of a name."""
    defs = [("r", "a.py", "A", "run", "A.run"), ("r", "b.py", "A", "run", "A.run"), ("r", "b.py", "B", "run", "B.run"), ("r", "b.py", None, "go", "go"), ("r", None, "", "odd", "odd"), ("r", "", None, "odd", "odd2"), ("s", "a.py", "A", "run", "s"), ("r", "a.py", None, None, "none")]
    asked = [(1, "r", None, None, "run"), (2, "r", "a.py", None, "run"), (3, "r", "b.py", None, "run"), (4, "r", None, "A", "run"), (5, "r", None, None, "B.run"), (6, "r", "b.py", "A", "go"), (7, "r", None, None, "go"), (8, "r", None, "", "odd"), (9, "r", "", None, "odd"), (10, "r", "a.py", None, None), (11, "t", "a.py", None, "run")]
    df = localize.changed_node(
        spark.createDataFrame(asked, "row int, repository_id string, file string, class_name string, method string"),
        spark.createDataFrame(defs, "repository_id string, file string, class_name string, name string, id string"),
    )
    several = "2 methods or functions are named run: give a file or class"
    missing = "no method or function is named "
    assert {r["row"]: (r["node_id"], r["reason"]) for r in df.collect()} == {
        1: (None, several), 2: ("A.run", None), 3: (None, several), 4: ("A.run", None), 5: ("B.run", None), 6: (None, missing + "go"), 7: ("go", None), 8: ("odd", None), 9: ("odd2", None), 10: (None, None), 11: (None, missing + "run"),
    }
    df.explain(mode="formatted")
    plan = capsys.readouterr().out
    assert "Join condition: None" in plan and plan.count("Join condition: None") == plan.count("Join condition:")
