"""The graph projection, routes of an impact, localisation, evidence, and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evidence as ev
from ..operators import facts as facts_of
from ..operators import impact, impact_paths, localize, logs, projection, rules, snapshot
from ..operators.tables import dealt
from .facts import FACTS, fact, select
from .graph_queries import _IMPACT_SQL, _PAIR_SQL, DEPTH, impact_graph, snapshot_diff
from .register import Queries

_Q = Queries()


def _sid(*parts: str) -> str:
    return f"sha1(concat({', chr(9247), '.join(parts)}))"


_REPO = _sid("'repository'", "'git@x'")
_FILE = _sid("'file'", _REPO, "file_path")
_CLASS = _sid("'class'", _FILE, "name")
_OWNER = _sid("'class'", _FILE, "class_name")
_METHOD = _sid("'method'", _OWNER, "name")
_FUNCTION = _sid("'function'", _FILE, "name", "line")
_COMMIT = _sid("'commit'", _REPO, "commit_hash")


def _changed_files(spark, sf):
    """(commit_hash, changed_files): the rows of src_changes, each once, by commit; dealt once, by the commit, instead of by its rows first."""
    rows = select(spark, sf, FACTS["src_changes"].replace("SELECT DISTINCT", "SELECT", 1))
    return dealt(rows, "commit_hash").groupBy("commit_hash").agg(F.collect_set("path").alias("changed_files"))


def _parsed(spark, sf):
    repo = projection.repositories(spark.createDataFrame([("shop", "/r", "git@x")], "name string, root_path string, remote_url string"))
    own = C.stable_id(F.lit("repository"), F.lit("git@x"))
    table = lambda name: fact(spark, sf, name).withColumn("repository", own)
    known = select(spark, sf, "SELECT CAST(o_orderkey AS STRING) AS commit_hash, o_orderpriority AS message, o_orderstatus AS author_name, o_orderdate AS committed_at FROM orders WHERE o_orderkey % 3 > 0")
    commits = known.join(_changed_files(spark, sf), "commit_hash", "left").withColumn("repository", own).withColumn("author_email", F.lit(None).cast("string"))
    return repo, table, commits


@_Q.add(
    f"""WITH u AS (SELECT file_path, class_name, name, list(coalesce(raw, target) ORDER BY ord, coalesce(raw, target)) AS c FROM src_calls WHERE NOT resolved GROUP BY 1, 2, 3)
    SELECT 'Repository' AS label, {_REPO} AS id, 'shop' AS name, 0 AS n_open, NULL AS first_open UNION ALL SELECT 'File', {_FILE}, name, 0, NULL FROM (SELECT path AS file_path, name FROM src_files) AS x
    UNION ALL SELECT 'Class', {_CLASS}, name, 0, NULL FROM src_classes UNION ALL SELECT 'Function', {_FUNCTION}, name, 0, NULL FROM src_functions
    UNION ALL SELECT 'Method', {_METHOD}, name, coalesce(len(c), 0), c[1] FROM (SELECT m.*, u.c FROM src_methods m LEFT JOIN u ON m.file_path = u.file_path AND m.class_name = u.class_name AND m.name = u.name) AS x
    UNION ALL SELECT 'Commit', {_COMMIT}, commit_hash, 0, NULL FROM (SELECT CAST(o_orderkey AS VARCHAR) AS commit_hash FROM orders WHERE o_orderkey % 3 > 0) AS x"""
)
def projected_nodes(spark, sf):
    repo, table, commits = _parsed(spark, sf)
    nodes = projection.nodes(repo, table("src_files"), table("src_classes"), table("src_methods"), table("src_functions"), table("src_calls"), commits)
    return nodes.select("label", "id", "name", F.size("unresolved_calls").alias("n_open"), F.try_element_at("unresolved_calls", F.lit(1)).alias("first_open"))


@_Q.add(
    f"""WITH f AS (SELECT *, {_FUNCTION} AS id FROM src_functions), c AS (SELECT *, {_METHOD} AS start FROM src_calls WHERE resolved), k AS (SELECT path FROM src_files)
    SELECT 'Repository' AS start_label, {_REPO} AS start_id, 'CONTAINS' AS rel_type, 'File' AS end_label, {_FILE} AS end_id FROM (SELECT path AS file_path FROM src_files) AS x
    UNION ALL SELECT 'File', {_FILE}, 'CONTAINS', 'Class', {_CLASS} FROM src_classes UNION ALL SELECT 'Class', {_OWNER}, 'CONTAINS', 'Method', {_METHOD} FROM src_methods UNION ALL SELECT 'File', {_FILE}, 'CONTAINS', 'Function', id FROM f
    UNION ALL SELECT 'Method', c.start, 'CALLS', 'Function', f.id FROM c JOIN f ON c.target = f.name AND c.file_path = f.file_path OR c.target = concat(replace(replace(f.file_path, '/', '.'), '.py', ''), '.', f.name)
    UNION ALL SELECT 'File', {_FILE.replace("file_path", "file")}, 'IMPORTS', 'File', {_FILE.replace("file_path", "target")} FROM src_imports WHERE file IN (SELECT path FROM k) AND target IN (SELECT path FROM k)
    UNION ALL SELECT 'Commit', {_COMMIT}, 'MODIFIES', 'File', {_FILE.replace("file_path", "path")} FROM src_changes WHERE path IN (SELECT path FROM k) AND CAST(commit_hash AS BIGINT) % 3 > 0"""
)
def projected_edges(spark, sf):
    _, table, commits = _parsed(spark, sf)
    return projection.edges(table("src_files"), table("src_classes"), table("src_methods"), table("src_functions"), table("src_calls"), table("src_imports"), commits)


_ROUTES = """WITH RECURSIVE w AS (SELECT node, 0 AS depth FROM start UNION SELECT c.src, w.depth + 1 FROM w JOIN calls c ON c.dst = w.node WHERE w.depth < 3), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
p AS (SELECT a.node, b.node AS predecessor, a.depth FROM calls c JOIN d a ON c.src = a.node JOIN d b ON c.dst = b.node WHERE a.depth = b.depth + 1), n AS (SELECT node, concat('p', node) AS id FROM d),
c0 AS (SELECT node, [concat('p', node)] AS steps FROM start), c1 AS (SELECT p.node, list_append(steps, concat('p', p.node)) AS steps FROM p JOIN c0 ON p.predecessor = c0.node WHERE p.depth = 1),
c2 AS (SELECT p.node, list_append(steps, concat('p', p.node)) AS steps FROM p JOIN c1 ON p.predecessor = c1.node WHERE p.depth = 2), c3 AS (SELECT p.node, list_append(steps, concat('p', p.node)) AS steps FROM p JOIN c2 ON p.predecessor = c2.node WHERE p.depth = 3),
r AS (SELECT *, 0 AS depth FROM c0 UNION ALL SELECT *, 1 FROM c1 UNION ALL SELECT *, 2 FROM c2 UNION ALL SELECT *, 3 FROM c3), i AS (SELECT * FROM r WHERE depth = 0 OR node % 10 <> 3),
f AS (SELECT node % 50 AS file, list_append(steps, concat('f', node % 50)) AS steps FROM i),
s AS (SELECT (node % 50) % 5 AS service, list_append(steps, concat('s', (node % 50) % 5)) AS steps FROM i UNION ALL SELECT file % 5, list_append(steps, concat('s', file % 5)) FROM f),
g AS (SELECT CASE WHEN node % 10 = 3 THEN 'TEST' WHEN depth = 1 THEN 'DIRECT_CALLER' ELSE 'INDIRECT_CALLER' END AS category, concat('p', node) AS id, steps FROM r WHERE depth > 0
UNION ALL SELECT 'FILE', concat('f', file), steps FROM f WHERE file NOT IN (SELECT node % 50 FROM start) UNION ALL SELECT 'SERVICE', concat('s', service), steps FROM s
UNION ALL SELECT 'API', concat('a', file), list_append(steps, concat('a', file)) FROM f
UNION ALL SELECT 'DOWNSTREAM_SERVICE', concat('s', k), list_concat(steps, [concat('s', x) FOR x IN range(5, k + 1)]) FROM s, (SELECT unnest([5, 6, 7]) AS k) AS y WHERE service = 4),
o AS (SELECT *, row_number() OVER (PARTITION BY category, id ORDER BY steps) AS rank, count(*) OVER (PARTITION BY category, id) AS n FROM (SELECT DISTINCT * FROM g) AS x)
SELECT category, id, array_to_string(steps, '>') AS route, n > 10 AS capped FROM o WHERE rank <= 10"""


@_Q.add(_ROUTES)
def impact_routes(spark, sf):
    routes = impact_paths.impact_routes(*impact_graph(spark, sf), DEPTH)
    return routes.select("category", "id", F.array_join(F.transform("steps", lambda s: s["id"]), ">").alias("route"), "capped")


@_Q.add(
    _IMPACT_SQL.replace("SELECT category, concat('p', CAST(node AS VARCHAR)) AS id, depth, CASE", ", z AS (SELECT category, concat('p', CAST(node AS VARCHAR)) AS id, depth, CASE", 1)
    + """) SELECT id, CASE category WHEN 'TEST' THEN 'test' WHEN 'FILE' THEN 'file' WHEN 'API' THEN 'api' WHEN 'SERVICE' THEN 'service' WHEN 'DOWNSTREAM_SERVICE' THEN 'service' ELSE 'function' END AS kind, id AS name,
    CASE WHEN category = 'FILE' THEN 'f' WHEN id LIKE 'p%' THEN concat(CASE WHEN category = 'TEST' THEN 'tests/' ELSE 'src/' END, substr(id, 2), '.py::', id) END AS location, depth, CASE category WHEN 'DOWNSTREAM_SERVICE' THEN lower(relationship) ELSE lower(relationship) END AS relation,
    CASE WHEN category = 'TEST' THEN 'tests' WHEN depth <= 1 THEN 'direct' ELSE 'potential' END AS part FROM z WHERE category <> 'PRIMARY_CHANGE'"""
)
def impact_contract(spark, sf):
    nodes, edges, start = impact_graph(spark, sf)
    return impact_paths.grouped(impact_paths.contract(impact.analyze(nodes, edges, start, DEPTH), nodes))


@_Q.add(
    """WITH RECURSIVE w AS (SELECT node, 0 AS depth FROM start UNION SELECT c.src, w.depth + 1 FROM w JOIN calls c ON c.dst = w.node WHERE w.depth < 3), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node), e AS (SELECT DISTINCT src AS k FROM calls UNION SELECT dst FROM calls),
    b AS (SELECT count(DISTINCT c.src) AS n FROM calls c JOIN d ON c.dst = d.node WHERE d.depth = 3 AND c.src NOT IN (SELECT node FROM d)),
    o AS (SELECT concat('p', CAST(k AS VARCHAR)) AS id FROM e WHERE k % 7 = 0 AND k NOT IN (SELECT node FROM d) ORDER BY id LIMIT 25)
    SELECT unnest(['EVENT', 'DATABASE', 'TABLE', 'TEST']) AS category, 'the graph has no link of this kind' AS reason UNION ALL SELECT 'INDIRECT_CALLER', concat(n, ' callers lie beyond depth 3') FROM b WHERE n > 0
    UNION ALL SELECT 'DIRECT_CALLER', concat(o.id, ' has an unresolved call x.p', s.node, ' that ends in p', s.node) FROM o, start s UNION ALL SELECT 'PRIMARY_CHANGE', 'some elements have over 0 routes'"""
)
def impact_unresolved(spark, sf):
    nodes, edges, start = impact_graph(spark, sf)
    name = start.first()[0]
    node = F.substring("id", 2, 20).cast("long")
    calls = F.when((F.col("label") == "Function") & (node % 7 == 0), F.array(F.lit("y.z"), F.lit(f"x.{name}"))).otherwise(F.array().cast("array<string>"))
    capped = spark.createDataFrame([(True,)], "capped boolean")
    return impact_paths.unresolved(nodes.withColumn("unresolved_calls", calls), edges, start, capped, DEPTH, 0)


@_Q.add(
    """WITH t AS (SELECT DISTINCT p_brand AS r, split_part(p_name, ' ', 1) AS target FROM part), f AS (SELECT DISTINCT p_brand AS r, concat(CASE WHEN p_size % 3 = 0 THEN 'tests/' ELSE 'src/' END, lower(p_type), CASE WHEN p_size % 5 = 0 THEN '_test.py' ELSE '.py' END) AS path, concat('check_', replace(p_name, ' ', '_')) AS name FROM part)
    SELECT DISTINCT t.r AS repository_id, target, path AS test_file, name AS test_function FROM t JOIN f ON t.r = f.r AND contains(name, target) WHERE path LIKE 'tests/%' OR path LIKE '%_test.py'"""
)
def related_tests(spark, sf):
    targets = select(spark, sf, "SELECT p_brand AS repository_id, split_part(p_name, ' ', 1) AS target FROM part")
    names = select(spark, sf, "SELECT p_brand AS repository_id, concat(CASE WHEN p_size % 3 = 0 THEN 'tests/' ELSE 'src/' END, lower(p_type), CASE WHEN p_size % 5 = 0 THEN '_test.py' ELSE '.py' END) AS path, concat('check_', replace(p_name, ' ', '_')) AS name, p_size FROM part")
    return localize.related_tests(targets, names.where("p_size > 20").drop("p_size"), names.where("p_size <= 20").drop("p_size"))


_ASKED = "SELECT p_partkey AS row, CASE WHEN p_size % 4 = 0 THEN concat('pkg/m', CAST(p_partkey % 41 AS STRING), '.py') END AS file, CASE WHEN p_size % 6 = 1 THEN concat('C', CAST(p_partkey % 50 AS STRING)) END AS class_name, CASE WHEN p_size % 3 = 0 THEN concat('f', CAST(p_partkey AS STRING)) WHEN p_size % 3 = 1 THEN concat('run', CAST(p_size % 9 AS STRING)) ELSE concat('C', CAST(p_partkey % 50 AS STRING), '.run', CAST(p_size % 9 AS STRING)) END AS method FROM part"


@_Q.add(
    f"""WITH a AS (SELECT row, file, CASE WHEN class_name IS NULL AND contains(method, '.') THEN split_part(method, '.', 1) ELSE class_name END AS class_name, CASE WHEN class_name IS NULL AND contains(method, '.') THEN split_part(method, '.', 2) ELSE method END AS method FROM ({_ASKED}) AS x),
    m AS (SELECT file_path AS file, class_name, name, concat(class_name, '.', name) AS id FROM src_methods UNION ALL SELECT file_path, NULL, name, name FROM src_functions),
    h AS (SELECT a.row, count(DISTINCT m.id) AS n, min(m.id) AS id FROM a JOIN m ON m.name = a.method AND (a.file IS NULL OR a.file = m.file) AND (a.class_name IS NULL OR a.class_name = m.class_name) GROUP BY 1)
    SELECT a.row, a.method, CASE WHEN n = 1 THEN id END AS node_id, CASE WHEN n IS NULL THEN concat('no method or function is named ', a.method) WHEN n > 1 THEN concat(n, ' methods or functions are named ', a.method, ': give a file or class') END AS reason FROM a LEFT JOIN h ON a.row = h.row"""
)
def changed_node(spark, sf):
    asked = select(spark, sf, _ASKED).withColumn("repository_id", F.lit("r"))
    defs = select(spark, sf, "SELECT 'r' AS repository_id, file_path AS file, class_name, name, concat(class_name, '.', name) AS id FROM src_methods UNION ALL SELECT 'r', file_path, NULL, name, name FROM src_functions")
    return localize.changed_node(asked, defs).select("row", "method", "node_id", "reason")


@_Q.add(
    """WITH a AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN n_name WHEN s_suppkey % 5 = 2 THEN concat('git@', lower(n_name)) WHEN s_suppkey % 5 = 3 THEN concat('/src/', n_regionkey) ELSE 'nowhere' END AS wanted FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    h AS (SELECT a.row, count(DISTINCT r.id) AS n, min(r.id) AS id FROM a JOIN repos r ON a.wanted IS NULL OR a.wanted IN (r.name, r.remote_url, r.root_path) GROUP BY 1)
    SELECT a.row, wanted, CASE WHEN n = 1 THEN id END AS repository_id, CASE WHEN n IS NULL THEN concat('no repository matches ', wanted) WHEN n > 1 AND wanted IS NULL THEN 'there are several repositories and none was named' WHEN n > 1 THEN concat(n, ' repositories match ', wanted) END AS reason FROM a LEFT JOIN h ON a.row = h.row"""
)
def repository_identity(spark, sf):
    asked = select(spark, sf, "SELECT s_suppkey AS row, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN n_name WHEN s_suppkey % 5 = 2 THEN concat('git@', lower(n_name)) WHEN s_suppkey % 5 = 3 THEN concat('/src/', CAST(n_regionkey AS STRING)) ELSE 'nowhere' END AS wanted FROM supplier JOIN nation ON s_nationkey = n_nationkey")
    return localize.repository_of(asked, fact(spark, sf, "repos"))


@_Q.add(
    """WITH a AS (SELECT file, string_agg(DISTINCT target, ',' ORDER BY target) AS imports FROM src_imports GROUP BY 1), b AS (SELECT target AS file, string_agg(DISTINCT file, ',' ORDER BY file) AS imported_by FROM src_imports GROUP BY 1)
    SELECT f.path AS file, coalesce(imports, '') AS imports, coalesce(imported_by, '') AS imported_by, CASE WHEN imports IS NULL AND imported_by IS NULL THEN 'PARTIALLY_RESOLVED' ELSE 'RESOLVED' END AS status FROM src_files f LEFT JOIN a ON f.path = a.file LEFT JOIN b ON f.path = b.file"""
)
def dependencies_both_ways(spark, sf):
    out = localize.dependencies_of(fact(spark, sf, "src_files").select(F.col("path").alias("file")), fact(spark, sf, "src_imports"))
    return out.select("file", F.array_join("imports", ",").alias("imports"), F.array_join("imported_by", ",").alias("imported_by"), "status")


def _commits(spark, sf):
    known = select(spark, sf, "SELECT CAST(o_orderkey AS STRING) AS commit_hash, o_orderdate AS committed_at, o_orderpriority AS message, o_orderstatus AS author_name, -o_orderkey AS ord FROM orders")
    return known.join(_changed_files(spark, sf), "commit_hash")


@_Q.add("SELECT path AS file, commit_hash FROM src_changes JOIN orders ON commit_hash = CAST(o_orderkey AS VARCHAR) JOIN src_files USING (path) WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' + INTERVAL 1 DAY * line_count")
def commits_before_failure(spark, sf):
    files = select(spark, sf, "SELECT path AS file, timestampadd(DAY, line_count, TIMESTAMP_NTZ '1996-01-01 00:00:00') AS before FROM src_files")
    return localize.touching(_commits(spark, sf), files, "before").select("file", "commit_hash")


@_Q.add("SELECT DISTINCT l_partkey % 40 AS file, CAST(l_orderkey AS VARCHAR) AS commit_hash FROM lineitem WHERE (l_partkey % 40, l_orderkey) NOT IN (SELECT (l_partkey % 40, l_orderkey) FROM lineitem WHERE l_returnflag = 'R')")
def history_without_known(spark, sf):
    own = select(spark, sf, "SELECT DISTINCT l_partkey % 40 AS file, CAST(l_orderkey AS STRING) AS commit_hash FROM lineitem")
    known = select(spark, sf, "SELECT l_partkey % 40 AS file, CAST(l_orderkey AS STRING) AS commit_hash FROM lineitem WHERE l_returnflag = 'R'")
    return localize.without_known(own, known, "file")


@_Q.add(
    r"""WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') END AS x, 1 + doc_id % 3 AS a, doc_id % 3 + doc_id % 90 AS b FROM documents)
    SELECT doc_id AS row, len(x[a:b]) AS n, md5(array_to_string(x[a:b], chr(10))) AS md5, CASE WHEN len(x[a:b]) > 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status FROM l"""
)
def relevant_code(spark, sf):
    docs = select(spark, sf, "SELECT CAST(doc_id AS STRING) AS path, text FROM documents")
    asked = select(spark, sf, "SELECT doc_id AS row, CAST(doc_id AS STRING) AS file, 1 + doc_id % 3 AS first, doc_id % 3 + doc_id % 90 AS last FROM documents")
    out = localize.relevant_code(asked, logs.numbered_lines(docs))
    return out.select("row", F.size("lines").cast("long").alias("n"), F.md5(F.array_join("lines", "\n")).alias("md5"), "status")


@_Q.add(
    r"""WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') END AS x, 1 + doc_id % 7 AS k FROM documents)
    SELECT doc_id AS row, n, md5(x[n]) AS md5 FROM (SELECT *, unnest(range(greatest(1, k - 3), least(len(x), k + 3) + 1)) AS n FROM l) AS y"""
)
def line_windows(spark, sf):
    docs = select(spark, sf, "SELECT CAST(doc_id AS STRING) AS path, text FROM documents")
    points = select(spark, sf, "SELECT doc_id AS row, CAST(doc_id AS STRING) AS file, 1 + doc_id % 7 AS line FROM documents")
    return logs.line_window(logs.numbered_lines(docs), points).select("row", F.col("n").cast("long").alias("n"), F.md5("text").alias("md5"))


@_Q.add(r"SELECT doc_id AS path, nullif(list_position([contains(x, ' the ') FOR x IN regexp_split_to_array(text, '\r\n|\r|\n')], true), 0) AS line FROM documents")
def first_lines(spark, sf):
    docs = select(spark, sf, "SELECT doc_id AS path, text FROM documents")
    return logs.first_line_with(docs, F.lit(" the "))


_EVIDENCE = """SELECT CAST(p_partkey AS VARCHAR) AS key, 'stack_trace' AS type, 'FACT' AS status, concat('Parsed exception ', p_brand, CASE WHEN p_size > 20 THEN concat(': ', p_name) ELSE '' END) AS details, NULL AS file, NULL AS line, NULL AS method FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'stack_trace', 'FACT', concat('Frame: ', p_name, ':', p_size, ' in ', p_brand, CASE WHEN p_size > 20 THEN concat(' -- `', p_type, '`') ELSE '' END), p_name, p_size, p_brand FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'code_location', CASE p_size % 3 WHEN 0 THEN 'FACT' WHEN 1 THEN 'POTENTIALLY_RELEVANT' ELSE 'UNRESOLVED' END, CASE p_size % 3 WHEN 0 THEN concat('Resolved to Method `', p_brand, '` (', p_name, ':', p_size, ')') WHEN 1 THEN concat('File resolved (', p_name, ') but the exact definition could not be pinned down -- ', p_type) ELSE p_type END, CASE WHEN p_size % 3 < 2 THEN p_name END, CASE WHEN p_size % 3 < 2 THEN p_size END, CASE WHEN p_size % 3 = 0 THEN p_brand END FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'call_graph', CASE WHEN p_size % 3 = 1 THEN 'FACT' ELSE 'POTENTIALLY_RELEVANT' END, concat('(depth ', p_size % 3, ') ', p_name, ' is called by ', p_brand), NULL, NULL, p_brand FROM part
UNION ALL SELECT file, 'dependency', 'POTENTIALLY_RELEVANT', concat(file, ' imports ', target), file, NULL, NULL FROM (SELECT DISTINCT * FROM src_imports) AS x UNION ALL SELECT target, 'dependency', 'POTENTIALLY_RELEVANT', concat(file, ' imports ', target), target, NULL, NULL FROM (SELECT DISTINCT * FROM src_imports) AS x WHERE target IN (SELECT file FROM src_imports)
UNION ALL SELECT CAST(o_custkey AS VARCHAR), CASE WHEN o_orderstatus = 'F' THEN 'git_history' ELSE 'recent_change' END, CASE WHEN o_orderstatus = 'F' THEN 'FACT' ELSE 'POTENTIALLY_RELEVANT' END, CASE WHEN o_orderstatus = 'F' THEN concat('Last commit to modify this file: ', left(sha1(CAST(o_orderkey AS VARCHAR)), 12), ' by ', o_orderstatus, ': ', o_orderpriority) ELSE concat('Commit ', left(sha1(CAST(o_orderkey AS VARCHAR)), 12), ' modified this file before the failure (does not by itself establish causation): ', o_orderpriority) END, 'f.py', NULL, NULL FROM orders
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'blame', 'FACT', concat('Line ', o_orderkey % 9, ' of f.py was last changed by commit ', left(sha1(CAST(o_orderkey AS VARCHAR)), 12), ' (', o_orderstatus, '): ', o_orderpriority), 'f.py', o_orderkey % 9, NULL FROM orders
UNION ALL SELECT CAST(user_id AS VARCHAR), 'log', 'POTENTIALLY_RELEVANT', concat('Log line correlated via method: ', event_type), NULL, NULL, NULL FROM events"""


@_Q.add(_EVIDENCE)
def rca_evidence(spark, sf):
    part = select(spark, sf, "SELECT CAST(p_partkey AS STRING) AS key, p_name, p_brand, p_type, p_size FROM part")
    c = F.col
    big = lambda x: F.when(c("p_size") > 20, c(x))
    kind = F.when(c("p_size") % 3 == 0, "RESOLVED").when(c("p_size") % 3 == 1, "PARTIALLY_RESOLVED").otherwise("UNRESOLVED")
    history = select(spark, sf, "SELECT CAST(o_custkey AS STRING) AS key, 'f.py' AS file, CAST(o_orderkey % 9 AS INT) AS line, sha1(CAST(o_orderkey AS STRING)) AS commit_hash, o_orderstatus AS author_name, o_orderpriority AS message, o_orderdate AS committed_at FROM orders")
    imports = fact(spark, sf, "src_imports")
    parts = [
        ev.of_stack_trace(part.select("key", c("p_brand").alias("exception_type"), big("p_name").alias("message")), part.select("key", c("p_name").alias("file"), c("p_size").alias("line"), c("p_brand").alias("function"), big("p_type").alias("snippet"))),
        ev.of_locations(part.select("key", kind.alias("status"), F.lit("Method").alias("label"), c("p_brand").alias("qualified_name"), c("p_name").alias("file"), c("p_size").alias("line"), c("p_type").alias("reason"))),
        ev.of_calls(part.select("key", c("p_brand").alias("source_name"), c("p_name").alias("target_name"), (c("p_size") % 3).alias("depth")), forward=False),
        ev.of_dependencies(localize.dependencies_of(imports.select("file"), imports).withColumn("key", c("file"))),
        ev.of_history(history.where("author_name = 'F'"), history.where("author_name != 'F'")),
        ev.of_blame(history),
        ev.of_logs(select(spark, sf, "SELECT CAST(user_id AS STRING) AS key, 'method' AS matched_on, event_type AS raw, ts FROM events")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("key", "type", "status", "details", "file", "line", "method")


@_Q.add(
    """SELECT key, type, concat('[', status, '] ', details) AS description, CASE WHEN file IS NOT NULL THEN concat(file, CASE WHEN method IS NULL THEN '' ELSE concat('::', method) END) END AS location FROM (
    SELECT p_partkey AS key, 'candidate_location' AS type, 'FACT' AS status, concat(CASE WHEN p_size > 25 THEN 'Primary' ELSE 'Related' END, ' location: ', p_type, ' -> ', p_brand, ' (', p_name, ':', p_size, ')') AS details, p_name AS file, p_brand AS method FROM part
    UNION ALL SELECT p_partkey, 'method_localization', 'FACT', concat('Line ', p_size, ' belongs to ', CASE WHEN p_size % 2 = 0 THEN 'K.' ELSE '' END, 'm() (lines 1-', p_size, ')'), p_name, p_brand FROM part WHERE p_size % 3 > 0
    UNION ALL SELECT p_partkey, 'class_localization', 'FACT', concat('Owning class: K (lines 0-', p_size, ')'), p_name, 'K' FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, 'relevant_code', 'FACT', concat('Retrieved lines 1-', p_size, ' of ', p_name, ' (2 lines) from the actual repository source'), p_name, NULL FROM part WHERE p_size > 10
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'related_commit' ELSE 'historical_change' END, CASE WHEN o_orderstatus = 'F' THEN 'FACT' ELSE 'POTENTIALLY_RELEVANT' END, concat('[', CASE WHEN o_orderstatus = 'F' THEN 'related_commit' ELSE 'historical_change' END, '] ', left(sha1(CAST(o_orderkey AS VARCHAR)), 12), ' by ', o_orderstatus, ': ', o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN ' (scoped to m)' ELSE '' END), 'f.py', CASE WHEN o_orderstatus = 'O' THEN 'm' END FROM orders
    UNION ALL SELECT p_partkey, 'related_test', 'FACT', concat(p_name, '::', p_brand, ' references ', p_type), p_name, p_brand FROM part) AS x"""
)
def localisation_evidence(spark, sf):
    c = F.col
    part = select(spark, sf, "SELECT p_partkey AS key, p_name AS file, p_brand AS qualified_name, p_type AS reason, p_size AS line FROM part")
    some = lambda when, x: F.when(when, x)
    third, even = c("line") % 3 > 0, c("line") % 2 == 0
    candidates = part.select("*", F.when(c("line") > 25, "PRIMARY").otherwise("RELATED").alias("role"), some(third, "m").alias("method_name"), some(even, "K").alias("method_class"), F.lit(1).alias("first"), c("line").alias("last"), some(even, "K").alias("class_name"), F.lit(0).alias("class_first"), c("line").alias("class_last"))
    code = part.select("key", "file", F.lit(1).alias("first"), c("line").alias("last"), F.array(F.lit("a"), F.lit("b")).alias("lines"), F.when(c("line") > 10, "RESOLVED").otherwise("UNRESOLVED").alias("status"))
    changes = select(spark, sf, "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'related_commit' ELSE 'historical_change' END AS label, 'f.py' AS file, sha1(CAST(o_orderkey AS STRING)) AS commit_hash, o_orderstatus AS author_name, o_orderpriority AS message, o_orderdate AS committed_at, CASE WHEN o_orderstatus = 'O' THEN 'm' END AS method FROM orders")
    tests = part.select("key", c("file").alias("test_file"), c("qualified_name").alias("test_function"), c("reason").alias("target"))
    out = ev.of_candidates(candidates).unionByName(ev.of_code(code)).unionByName(ev.of_changes(changes)).unionByName(ev.of_tests(tests))
    return ev.contract(out).select(c("key").cast("long").alias("key"), c("source").alias("type"), "description", "location")


@_Q.add("SELECT p_partkey AS key, 'semantic' AS source, concat('method ', p_name, ' (lines ', p_size, '-', p_size + 3, ')') AS description, p_brand AS location, round(p_retailprice / 7777, 4) AS score FROM part")
def hits_as_evidence(spark, sf):
    return ev.hit_contract(select(spark, sf, "SELECT p_partkey AS key, 'method' AS kind, p_name AS name, p_size AS start_line, p_size + 3 AS end_line, p_brand AS location, p_retailprice / 7777 AS score FROM part"))


@_Q.add(
    """WITH a AS (SELECT l_orderkey AS key, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey % 9 AS VARCHAR) END AS location FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS key, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey % 9 AS VARCHAR) END AS location FROM lineitem WHERE l_returnflag <> 'R')
    SELECT key, location, 0 AS part FROM a UNION ALL SELECT key, location, 1 FROM b WHERE location IS NULL OR NOT EXISTS (SELECT 1 FROM a WHERE a.key = b.key AND a.location = b.location)"""
)
def retrieved_beyond_evidence(spark, sf):
    rows = lambda sign: select(spark, sf, f"SELECT l_orderkey AS key, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_partkey % 9 AS STRING) END AS location, l_linenumber AS ord FROM lineitem WHERE l_returnflag {sign} 'R'")
    return ev.with_new_only(rows("="), rows("<>")).select("key", "location", "part")


@_Q.add("SELECT key, string_agg(v, ',' ORDER BY o, l, v) AS files FROM (SELECT l_orderkey AS key, CAST(l_partkey % 5 AS VARCHAR) AS v, min(l_returnflag) AS o, arg_min(l_linenumber, (l_returnflag, l_linenumber)) AS l FROM lineitem GROUP BY 1, 2) AS x GROUP BY 1")
def linked_files_in_order(spark, sf):
    rows = select(spark, sf, "SELECT l_orderkey AS key, CAST(l_partkey % 5 AS STRING) AS v, l_returnflag, l_linenumber FROM lineitem")
    out = ev.in_first_order(rows, "key", "v", ["l_returnflag", "l_linenumber"])
    return out.select("key", F.array_join("values", ",").alias("files"))


@_Q.add(
    """WITH f AS (SELECT o_custkey AS owner, concat('pkg/m', CAST(o_custkey % 48 AS VARCHAR), '.py') AS file FROM orders GROUP BY 1, 2), s AS (SELECT path, CASE line_count % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'R' ELSE 'D' END AS status, CASE WHEN line_count % 4 = 2 THEN concat('pkg/m', CAST(line_count + 40 AS VARCHAR), '.py') END AS old_path FROM src_files),
    j AS (SELECT DISTINCT f.file, arg_min(s.path, (s.path <> f.file)) OVER w AS path, arg_min(s.status, (s.path <> f.file)) OVER w AS status, arg_min(s.old_path, (s.path <> f.file)) OVER w AS old_path FROM f JOIN s ON s.path = f.file OR s.old_path = f.file WINDOW w AS (PARTITION BY f.file)),
    d AS (SELECT file, 'git_diff' AS source, concat('file ', CASE status WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' WHEN 'D' THEN 'deleted' ELSE concat('renamed ', old_path, ' -> ', path) END, ' between 012345678901 and b') AS details FROM j),
    c AS (SELECT f.file, g.commit_hash, o.o_orderpriority AS message, row_number() OVER (PARTITION BY f.file ORDER BY -o.o_orderkey) AS k FROM (SELECT DISTINCT file FROM f) AS f LEFT JOIN j ON j.file = f.file JOIN (SELECT DISTINCT commit_hash, path FROM src_changes) AS g ON g.path = f.file OR g.path = j.path JOIN orders o ON g.commit_hash = CAST(o.o_orderkey AS VARCHAR) GROUP BY f.file, g.commit_hash, o.o_orderpriority, o.o_orderkey),
    e AS (SELECT * FROM d UNION ALL SELECT file, 'git_commit', concat('commit ', left(commit_hash, 12), ' touched ', file, ': ', message) FROM c WHERE k <= 3) SELECT owner, e.* FROM f JOIN e ON f.file = e.file"""
)
def git_evidence_of_changes(spark, sf):
    files = select(spark, sf, "SELECT o_custkey AS owner, concat('pkg/m', CAST(o_custkey % 48 AS STRING), '.py') AS file FROM orders")
    status = select(spark, sf, "SELECT path, CASE line_count % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'R' ELSE 'D' END AS status, CASE WHEN line_count % 4 = 2 THEN concat('pkg/m', CAST(line_count + 40 AS STRING), '.py') END AS old_path FROM src_files")
    return snapshot.git_evidence(files, status, _commits(spark, sf), "0123456789012345", "b").select("owner", "file", "source", "details")


@_Q.add(f"WITH {_PAIR_SQL} SELECT 'CHANGES_DETECTED' AS status, CAST(sum(n) AS BIGINT) AS n, concat(sum(n), ' change(s): ', string_agg(concat(n, ' x ', category), ', ' ORDER BY category)) AS text FROM (SELECT category, count(*) AS n FROM ee GROUP BY 1) AS x")
def change_text(spark, sf):
    return snapshot.told(snapshot_diff(spark, sf)).withColumn("n", F.col("n").cast("long"))


@_Q.add(r"SELECT doc_id, CASE WHEN trim(text, E' \t\n\r\f\v') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, E' \t\n\r\f\v'), '[ \t\n\r\f\v]+')) END AS words, length(text) AS chars FROM documents")
def text_statistics(spark, sf):
    return select(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", C.text_statistics(F.col("text")).alias("s")).select("doc_id", "s.words", "s.chars")


@_Q.add("SELECT p_partkey, concat_ws(' ', p_name, nullif(CASE WHEN p_size > 20 THEN p_type ELSE '' END, ''), CASE WHEN p_size > 30 THEN p_brand END) AS query, trim(regexp_replace(lower(concat('#', p_brand, ' ', p_type, '!')), '[^a-z0-9]+', '_', 'g'), '_') AS slug, concat('SC-', left(sha1(p_name), 8)) AS scenario FROM part")
def issue_queries(spark, sf):
    rows = select(spark, sf, "SELECT p_partkey, p_name, CASE WHEN p_size > 20 THEN p_type ELSE '' END AS component, array(CASE WHEN p_size > 30 THEN p_brand END) AS keywords, concat('#', p_brand, ' ', p_type, '!') AS raw FROM part")
    query = C.issue_query(F.array("p_name", "component"), F.col("keywords"))
    return rows.select("p_partkey", query.alias("query"), C.slug(F.col("raw")).alias("slug"), C.scenario_id(F.col("p_name")).alias("scenario"))


@_Q.add("SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY o_orderkey)[1:3], ',') AS lessons, greatest(count(*) - 3, 0) AS dropped FROM orders GROUP BY 1")
def capped_lists(spark, sf):
    rows = select(spark, sf, "SELECT o_custkey, transform(sort_array(collect_list(struct(o_orderkey, o_orderpriority))), x -> concat(' ', x.o_orderpriority, ' ')) AS v FROM orders GROUP BY 1")
    rows = rows.withColumn("v", F.array_append("v", F.lit("  ")))
    return rows.select("o_custkey", C.capped(F.col("v"), 3).alias("c")).select("o_custkey", F.array_join("c.values", ",").alias("lessons"), F.col("c.dropped").cast("long").alias("dropped"))


@_Q.add("SELECT c_custkey, concat(lower(c_mktsegment), ':', c_name) AS entity, concat('api:', upper(left(c_mktsegment, 3)), ' /', c_name) AS api, concat(c_name, '@', c_nationkey) AS snapshot, sha1(concat('commit', chr(9247), c_name, chr(9247), c_nationkey)) AS commit FROM customer")
def identity_keys(spark, sf):
    rows = select(spark, sf, "SELECT c_custkey, c_name, lower(c_mktsegment) AS s, c_mktsegment, CAST(c_nationkey AS STRING) AS n FROM customer")
    c = F.col
    return rows.select("c_custkey", C.entity_key(c("c_mktsegment"), c("c_name")).alias("entity"), C.api_key(F.left("s", F.lit(3)), F.concat(F.lit("/"), "c_name")).alias("api"), C.snapshot_id(c("c_name"), c("n")).alias("snapshot"), C.commit_id(c("c_name"), c("n")).alias("commit"))


@_Q.add(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'error' END AS scenario, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS risk,
    CASE o_orderkey % 5 WHEN 0 THEN 'No root cause analysis available.' WHEN 1 THEN 'Root cause is not established (insufficient evidence).' WHEN 2 THEN 'Root cause has no exact code location to fix.' WHEN 3 THEN 'Source code for the location is not indexed.' END AS skipped,
    CASE WHEN o_custkey % 3 = 0 THEN 'UNRESOLVED' WHEN o_custkey % 2 = 0 THEN 'RESOLVED' ELSE 'PARTIALLY_RESOLVED' END AS status FROM orders"""
)
def small_rules(spark, sf):
    rows = select(spark, sf, "SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'PASSED' WHEN 'O' THEN 'FAILED' ELSE 'BUILD_FAILED' END AS s, CASE o_orderpriority WHEN '1-URGENT' THEN ' HIGH ' WHEN '5-LOW' THEN 'Low' ELSE o_orderpriority END AS r, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END AS lacks, CASE WHEN o_orderkey % 5 > 2 THEN 'x' ELSE '' END AS at, o_orderkey % 5 > 3 AS indexed FROM orders")
    c = F.col
    return rows.select("o_orderkey", rules.scenario_status(c("s")).alias("scenario"), rules.risk_level(c("r")).alias("risk"), rules.skipped_fix(c("lacks"), c("at"), c("indexed")).alias("skipped"), rules.status_of(c("o_custkey") % 3, c("o_custkey") % 2).alias("status"))


@_Q.add(
    """WITH t AS (SELECT l_orderkey AS id, concat('tests/t', l_partkey % 7, CASE WHEN l_partkey % 7 = 3 THEN ' x' ELSE '' END, '.py') AS f, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2),
    g AS (SELECT id, string_agg(CASE WHEN contains(f, ' ') THEN concat('''', f, '''') ELSE f END, ' ' ORDER BY o, CASE WHEN contains(f, ' ') THEN concat('''', f, '''') ELSE f END) AS files FROM t GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'make test' ELSE concat('pytest ', files) END AS command, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'f.py' END AS changed, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE concat('f.py::', o_orderpriority) END AS target FROM orders JOIN g ON o_orderkey = id"""
)
def validation_requests(spark, sf):
    tests = select(spark, sf, "SELECT l_orderkey AS id, concat('tests/t', CAST(l_partkey % 7 AS STRING), CASE WHEN l_partkey % 7 = 3 THEN ' x' ELSE '' END, '.py') AS test_file, l_linenumber AS ord FROM lineitem")
    asked = select(spark, sf, "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN array('make test') END AS commands, CASE WHEN o_orderstatus <> 'P' THEN 'f.py' END AS file, o_orderpriority AS qualified_name FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)", deal={"lineitem": "l_orderkey"})
    out = rules.validation_request(asked, tests)
    return out.select("id", F.col("commands")[0].alias("command"), F.array_join("changed_files", ",").alias("changed"), "target")


@_Q.add("SELECT concat('{\"region\":', r_regionkey, ',\"name\":\"', r_name, '\",\"at\":\"1998-01-02T03:04:05Z\",\"none\":null}') AS json FROM region")
def plain_export(spark, sf):
    return snapshot.plain(select(spark, sf, "SELECT r_regionkey AS region, r_name AS name, TIMESTAMP '1998-01-02 03:04:05Z' AS at, CAST(NULL AS STRING) AS none FROM region"))


@_Q.add("SELECT p_partkey, p_size % 4 < 2 AS is_test FROM part")
def test_chunks(spark, sf):
    rows = select(spark, sf, "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN concat('a/test_', p_name) ELSE concat('a/', p_name) END AS path, CASE WHEN p_size % 4 = 1 THEN concat('K.test_', p_brand) ELSE concat('K.my_test_', p_brand) END AS name FROM part")
    return rows.select("p_partkey", impact_paths.is_test_chunk(F.col("path"), F.col("name")).alias("is_test"))


@_Q.add("SELECT concat('m', CAST(file AS VARCHAR)) AS id, concat('x.', f) AS call FROM (SELECT l_suppkey AS file, 'f7' AS f FROM lineitem WHERE l_partkey = 7 GROUP BY 1 ORDER BY concat('m', CAST(l_suppkey AS VARCHAR)) LIMIT 25) AS x")
def unresolved_call_sites(spark, sf):
    nodes = select(spark, sf, "SELECT concat('m', CAST(l_suppkey AS STRING)) AS id, sort_array(collect_set(concat('x.f', CAST(l_partkey AS STRING)))) AS unresolved_calls FROM lineitem GROUP BY 1")
    return facts_of.unresolved_call_sites(nodes, spark.createDataFrame([("f7",)], "name string")).select("id", "call")


@_Q.add(
    """WITH c AS (SELECT DISTINCT concat('m', CAST(l_suppkey AS VARCHAR)) AS id, concat(CASE WHEN l_partkey % 2 = 0 THEN 'x.' ELSE '' END, 'f', CAST(l_partkey % 90 AS VARCHAR)) AS call, concat('f', CAST(l_partkey % 90 AS VARCHAR)) AS name FROM lineitem),
    f AS (SELECT name, id, min(call) AS call FROM c WHERE name IN (SELECT concat('f', CAST(p_size AS VARCHAR)) FROM part) GROUP BY 1, 2)
    SELECT name, id, call FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM f) AS x WHERE n <= 25"""
)
def unresolved_call_sites_of_names(spark, sf):
    nodes = select(spark, sf, "SELECT concat('m', CAST(l_suppkey AS STRING)) AS id, sort_array(collect_set(concat(CASE WHEN l_partkey % 2 = 0 THEN 'x.' ELSE '' END, 'f', CAST(l_partkey % 90 AS STRING)))) AS unresolved_calls FROM lineitem GROUP BY 1")
    return facts_of.unresolved_call_sites(nodes, select(spark, sf, "SELECT concat('f', CAST(p_size AS STRING)) AS name FROM part"))


QUERIES, ORACLE_SQL = _Q.queries, _Q.sql
