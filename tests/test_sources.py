import datetime
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import facts
from factloom.sources import manifests, python_code, source_tree, store

FILES = {
    "payment/__init__.py": "",
    "payment/validator.py": "def validate(x, *rest, flag=True, **more):\n    return bool(x)\n",
    "payment/service.py": "import json\nfrom .validator import validate as check\n\n\nclass Service(Base):\n    async def process(self, x):\n        check(x)\n        self.save(x)\n        self.gone()\n        other.thing()\n        def inner():\n            hidden()\n\n    def save(self, x):\n        json.dumps(x)\n        helper()\n\n\ndef helper():\n    return Service().process(1)\n",
    "api/routes.py": 'router = APIRouter(prefix="/v1")\nimport payment.validator as pv\n\n\n@router.get("/orders")\ndef orders():\n    pv.validate(1)\n    client.get(f"http://service-b:80/x/{1}")\n\n\n@router.route("/both", methods=["POST", "PUT"])\ndef both(): ...\n\n\n@router.get(PATH)\ndef odd(): ...\n\n\nclass Row:\n    __tablename__ = "rows"\n',
    "broken.py": "def x(:\n",
    "venv/skip.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_DATE": "2026-01-02T03:04:05Z", "GIT_COMMITTER_DATE": "2026-01-02T03:04:05Z"})
    run("init", "-q")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "A B")
    for i, (path, text) in enumerate(FILES.items()):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
        if i == 2:
            run("add", "-A")
            run("commit", "-qm", "first")
    run("mv", "payment/validator.py", "payment/checks.py")
    run("add", "-A")
    run("commit", "-qm", "second")
    run("mv", "payment/checks.py", "payment/validator.py")
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, repo):
    source_tree.register(spark)
    files = spark.read.format("source_tree").option("path", repo).load()
    return files, python_code.python_facts(files).cache()


def test_source_tree(parsed):
    files, _ = parsed
    got = {r["path"]: r["line_count"] for r in files.collect()}
    assert set(got) == set(FILES) - {"venv/skip.py"} and got["payment/__init__.py"] == 0 and got["broken.py"] == 1


def test_git_sources(spark, repo, parsed):
    read = lambda name, **o: spark.read.format(name).option("path", repo).options(**o).load()
    commits = read("git_commits").collect()
    assert [c["message"] for c in commits] == ["second", "first"]
    assert commits[1]["changed_files"] == ["payment/__init__.py", "payment/service.py", "payment/validator.py"]
    assert commits[0]["author_name"] == "A B" and commits[0]["committed_at"] == datetime.datetime(2026, 1, 2, 3, 4, 5)
    between = read("git_commits", revisions=f"{commits[1]['commit_hash']}..HEAD").collect()
    assert len(between) == 1 and read("git_commits", max_count=1).count() == 1
    changes = {r["path"]: (r["status"], r["old_path"]) for r in read("git_changes", previous="HEAD~1", current="HEAD").collect()}
    assert changes["payment/checks.py"] == ("R", "payment/validator.py") and changes["broken.py"] == ("A", None)
    tree = {r["path"]: r["text"] for r in read("git_tree", revision="HEAD~1").collect()}
    assert tree == {p: FILES[p] for p in list(FILES)[:3]}
    blame = read("git_blame", files="payment/service.py,none.py").collect()
    assert len(blame) == FILES["payment/service.py"].count("\n") and {b["commit_hash"] for b in blame} == {commits[1]["commit_hash"]}
    with pytest.raises(Exception, match="not a revision"):
        read("git_tree", revision="--help").collect()


def test_revisions(spark, repo, parsed, tmp_path):
    read = lambda path, *names: {r["revision"]: (r["is_repository"], r["commit_hash"]) for r in spark.read.format("git_revisions").option("path", str(path)).option("revisions", json.dumps(names)).load().collect()}
    newest = spark.read.format("git_commits").option("path", repo).load().first()["commit_hash"]
    found = read(repo, "HEAD", newest[:8], "gone", "--help", "")
    assert found == {"HEAD": (True, newest), newest[:8]: (True, newest), "gone": (True, None), "--help": (True, None), "": (True, None)}
    assert read(tmp_path, "HEAD") == read(f"{repo}/payment", "HEAD") == read(tmp_path / "none", "HEAD") == {"HEAD": (False, None)}


def test_a_thousand_commits_are_read_by_a_process_for_each_partition(spark, tmp_path, monkeypatch):
    """Merges, empty commits, odd names and messages; one log process for 200 commits."""
    run = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=e@x", *a], check=True, capture_output=True, **k)
    run("init", "-q", "-b", "main")
    stream = []
    for i in range(1000):
        text = f"subject {i}\n\nbody\x01 with a line\nfile{i}.py\n".encode()
        stream.append(b"commit refs/heads/main\ncommitter N <e@x> %d +0000\ndata %d\n%s\n" % (1_700_000_000 + i, len(text), text))
        if i % 10:
            stream.append(b'M 100644 inline "d\303\251/a\\tb %d.py"\ndata 2\n%02d\n' % (i % 7, i % 100))
            stream.append(b"M 100644 inline z%d.py\ndata 2\n%02d\n" % (i % 3, i % 100))
    run("fast-import", "--quiet", input=b"".join(stream))
    run("checkout", "-q", "main")
    run("checkout", "-q", "-b", "side", "HEAD~5")
    (tmp_path / "side.py").write_text("1")
    run("add", "side.py")
    run("commit", "-qm", "side")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "merged", "side")
    reader = source_tree._Commits({"path": str(tmp_path)})
    started = []
    popen = subprocess.Popen
    monkeypatch.setattr(source_tree.subprocess, "Popen", lambda *a, **k: started.append(a[0]) or popen(*a, **k))
    parts = reader.partitions()
    started.clear()
    got = [r for p in parts for r in reader.read(p)]
    assert len(parts) == len(started) == 6 and len(got) == 1002
    for name, author, email, at, message, files in got[:3] + got[3::97]:
        said = run("show", "--no-renames", "--name-only", "-z", "--format=%H%x00%an%x00%ae%x00%ct%x00%B%x00", name).stdout.decode().split("\0")
        assert [name, author, email, str(int(at.timestamp())), message] == [*said[:4], said[4].strip()] and files == sorted(f.strip("\n") for f in said[5:] if f.strip("\n"))
    assert got[0][4] == "merged" and got[0][5] == [] and any(f and "\t" in f[0] for *_, f in got)


def test_python_facts(parsed):
    _, f = parsed
    kind = lambda k, *c: sorted(tuple(r) for r in python_code.of_kind(f, k, *c).collect())
    assert kind("function", "file_path", "name", "line") == [("api/routes.py", "both", 12), ("api/routes.py", "odd", 16), ("api/routes.py", "orders", 6), ("payment/service.py", "helper", 19), ("payment/validator.py", "validate", 1)]
    assert kind("method", "class_name", "name", "is_async") == [("Service", "process", True), ("Service", "save", False)]
    assert f.where("name = 'validate' and kind = 'function'").first()["args"] == ["x", "*rest", "flag", "**more"]
    assert f.where("kind = 'class' and name = 'Service'").first()["bases"] == ["Base"]
    assert [r["file_path"] for r in f.where("kind = 'error'").collect()] == ["broken.py"]
    assert kind("route", "attr", "name", "raw") == [("GET", "/v1/orders", "orders"), ("POST", "/v1/both", "both"), ("PUT", "/v1/both", "both")]
    assert kind("table", "name", "class_name") == [("rows", "Row")] and kind("unresolved", "name") == [("odd",)]
    assert "hidden" not in {r["attr"] for r in f.where("kind = 'call'").collect()}
    ids = {r["id"]: r["text"] for r in python_code.chunks(f).collect()}
    assert ids["payment/service.py::Service.save"].startswith("def save(self, x):")


def test_calls_and_imports_resolve(parsed):
    files, f = parsed
    calls = f.where("kind = 'call'").withColumn("row", F.monotonically_increasing_id())
    part = lambda k: f.where(F.col("kind") == k)
    out = facts.resolve_calls(calls, part("import"), part("class"), part("method"), part("function"))
    got = {(r["raw"], r["target"], r["resolved"], r["rule"]) for r in out.collect()}
    assert got == {
        ("check", "payment.validator.validate", True, "import"), ("self.save", "Service.save", True, "self"), ("self.gone", "self.gone", False, None), ("other.thing", "other.thing", False, None),
        ("json.dumps", "json.dumps", False, None), ("helper", "helper", True, "file"), ("Service().process", "Service().process", False, None), ("Service", "Service", False, None),
        ("pv.validate", "payment.validator.validate", True, "module"), ("client.get", "client.get", False, None),
        ("router.get", "router.get", False, None), ("router.route", "router.route", False, None), ("bool", "bool", False, None),
    }
    links = {(r["file"], r["target"], r["line"]) for r in facts.import_edges(part("import"), files).collect()}
    assert links == {("payment/service.py", "payment/validator.py", 2), ("api/routes.py", "payment/validator.py", 2)}
    nodes = facts.code_nodes(files, part("class"), part("method"), part("function"), "r")
    assert nodes.count() == nodes.select("id").distinct().count() == 5 + 2 + 2 + 5
    assert facts.contains(part("class"), part("method"), part("function")).count() == 9
    known = manifests.http_links(part("http_call"), f.sparkSession.createDataFrame([("Service-B",)], "name string")).collect()
    assert [r["service"] for r in known] == ["Service-B"]


def test_manifests(spark):
    files = spark.createDataFrame(
        [
            ("requirements.txt", "fastapi[all]>=0.1 # web\n-r other.txt\nFoo_Bar\n"),
            ("a/pyproject.toml", '[project]\ndependencies = [\n  "httpx ~= 1.0",\n]\n'),
            ("b/pyproject.toml", "not toml ["),
            ("docker-compose.yml", "services:\n  web:\n    image: me/web:1\n    depends_on: [db, gone]\n  db:\n    image: postgres:16\n"),
            ("compose.bad.yaml", "a: [b\n"),
            ("x/own.json", '{"publishes": ["e1", 3], "tables": "t", "odd": []}'),
        ],
        "path string, text string",
    )
    assert sorted((r["name"], r["version"], r["line"]) for r in manifests.declared_dependencies(files).collect()) == [("fastapi", ">=0.1", 1), ("foo-bar", "", 3), ("httpx", "~=1.0", 3)]
    services = manifests.compose_services(files)
    assert {r["key"] for r in manifests.compose_entities(services).collect()} == {"service:web", "database:db"}
    assert {(r["source"], r["target"], r["known"]) for r in manifests.compose_links(services).collect()} == {("service:web", "database:db", True), ("service:web", "gone", False)}
    assert services.where("error is not null").count() == 1
    said = {(r["field"], r["value"], r["entity_type"], r["reason"]) for r in manifests.declarations(files, "own.json").collect()}
    assert said == {("publishes", "e1", "EVENT", None), ("publishes", None, "EVENT", "not a name"), ("tables", None, "TABLE", "not a list"), ("odd", None, None, "unknown field")}


def test_snapshot_store(spark, tmp_path):
    entity = "key string, entity_type string, name string, properties map<string,string>, meta map<string,string>"
    rels = spark.createDataFrame([("CALLS", "a", "b", {})], "rel_type string, source string, target string, properties map<string,string>")
    one = spark.createDataFrame([("a", "SERVICE", "a", {"k": "v"}, {})], entity)
    two = spark.createDataFrame([("a", "SERVICE", "a", {"k": "w"}, {})], entity)
    s = store.SnapshotStore(spark, str(tmp_path))
    at = datetime.datetime(2026, 1, 1)
    assert s.save("r", "v1", at, one, rels) and not s.save("r", "v1", at, one, rels) and s.save("r", "v0", at - datetime.timedelta(1), two, rels)
    with pytest.raises(store.SnapshotConflict):
        s.save("r", "v1", at, two, rels)
    assert s.load("r", "v1")[0].first()["properties"] == {"k": "v"}
    assert [r["revision"] for r in s.revisions("r").collect()] == ["v0", "v1"]


def test_columns(spark):
    row = spark.range(1).select(
        C.filled(F.lit("{a.x}:{b}"), F.create_map(F.lit("a.x"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("filled"),
        C.new_file_patch(F.lit("a.py"), F.lit("x\ny\n")).alias("patch"),
        C.bounded_text(F.lit("a" * 50), 20).alias("cut"),
        C.scenario_id(F.lit("x")).alias("scenario"),
        C.repository_id(F.lit(""), F.lit("/r")).alias("local"),
    ).first()
    assert row["filled"] == "1:2" and row["patch"].endswith("@@ -0,0 +1,2 @@\n+x\n+y\n")
    assert row["cut"] == "a" * 5 + "\n[... 30 bytes truncated ...]\n" + "a" * 15
    assert row["scenario"].startswith("SC-") and len(row["local"]) == 40


def test_streams(spark, tmp_path):
    from factloom.sources.keyed_table import KeyedTable
    from factloom.streaming import incremental

    schema = "label string, id string, ord long, v string"
    table = KeyedTable(spark, str(tmp_path / "out"), "label string, id string, v string", ["label", "id"], 8)
    run = lambda: incremental.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([("N", "a", 1, "x"), ("N", "a", 2, "y"), ("N", "b", 1, "z")], schema).write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([("N", "a", 1, None), ("N", "c", 1, "q")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted((r["id"], r["v"]) for r in table.read().collect()) == [("a", None), ("b", "z"), ("c", "q")]
    assert sorted((r["id"], r["v"]) for r in table.read(1).collect()) == [("a", "y"), ("b", "z")]
