"""Graph traversal, upserts, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import facts as facts_of
from ..operators import graph, impact, resolve, snapshot, upsert
from ..operators.tables import written
from .facts import fact, select
from .register import Queries

_Q = Queries()
DEPTH = 3

_WALK = "WITH RECURSIVE w AS (SELECT node, 0 AS depth FROM start UNION SELECT c.{far}, w.depth + 1 FROM w JOIN calls c ON c.{near} = w.node WHERE w.depth < 3), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) "
_UP, _DOWN = _WALK.format(far="src", near="dst"), _WALK.format(far="dst", near="src")


def _calls_and_start(spark, sf):
    """Both written: the calls are a join and a distinct over all lines, which all that follows reads."""
    calls = written(fact(spark, sf, "calls"), "calls")
    return calls, written(fact(spark, sf, "start", calls=calls), "start")


@_Q.add(_UP + "SELECT node, depth FROM d")
def bfs_callers(spark, sf):
    return graph.reach(*_calls_and_start(spark, sf), DEPTH)


@_Q.add(_DOWN + "SELECT node, depth FROM d")
def bfs_callees(spark, sf):
    return graph.reach(*_calls_and_start(spark, sf), DEPTH, forward=True)


@_Q.add(_UP + "SELECT d.depth + 1 AS depth, c.src, c.dst FROM calls c JOIN d ON c.dst = d.node WHERE d.depth < 3")
def walked_call_edges(spark, sf):
    edges, start = _calls_and_start(spark, sf)
    return graph.walked_edges(edges, graph.reach(edges, start, DEPTH), DEPTH)


@_Q.add(_UP + "SELECT a.node, b.node AS predecessor, a.depth FROM calls c JOIN d a ON c.src = a.node JOIN d b ON c.dst = b.node WHERE a.depth = b.depth + 1")
def shortest_predecessors(spark, sf):
    edges, start = _calls_and_start(spark, sf)
    return graph.shortest_predecessors(edges, graph.reach(edges, start, DEPTH))


@_Q.add(_UP + "SELECT count(DISTINCT c.src) AS n FROM calls c JOIN d ON c.dst = d.node WHERE d.depth = 3 AND c.src NOT IN (SELECT node FROM d)")
def frontier_truncated(spark, sf):
    edges, start = _calls_and_start(spark, sf)
    return graph.callers_beyond(edges, graph.reach(edges, start, DEPTH), DEPTH)


@_Q.add(
    _UP
    + """, p AS (SELECT a.node, b.node AS predecessor, a.depth FROM calls c JOIN d a ON c.src = a.node JOIN d b ON c.dst = b.node WHERE a.depth = b.depth + 1),
    c0 AS (SELECT node, [node] AS chain FROM start), c1 AS (SELECT p.node, list_append(chain, p.node) AS chain FROM p JOIN c0 ON p.predecessor = c0.node WHERE p.depth = 1),
    c2 AS (SELECT p.node, list_append(chain, p.node) AS chain FROM p JOIN c1 ON p.predecessor = c1.node WHERE p.depth = 2), c3 AS (SELECT p.node, list_append(chain, p.node) AS chain FROM p JOIN c2 ON p.predecessor = c2.node WHERE p.depth = 3),
    every AS (SELECT *, 0 AS depth FROM c0 UNION ALL SELECT *, 1 FROM c1 UNION ALL SELECT *, 2 FROM c2 UNION ALL SELECT *, 3 FROM c3), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY chain) AS rank, count(*) OVER (PARTITION BY node) AS n FROM every)
    SELECT node, depth, array_to_string(chain, '>') AS chain, n > 10 AS capped FROM r WHERE rank <= 10"""
)
def shortest_paths(spark, sf):
    edges, start = _calls_and_start(spark, sf)
    steps = graph.shortest_predecessors(edges, graph.reach(edges, start, DEPTH))
    return graph.shortest_chains(steps, start, DEPTH).withColumn("chain", F.array_join("chain", ">"))


@_Q.add(_DOWN + "SELECT node, depth, CASE WHEN depth = 1 THEN 'DIRECT' ELSE 'INDIRECT' END AS directness FROM d WHERE depth > 0")
def downstream_services(spark, sf):
    return graph.downstream(*_calls_and_start(spark, sf), DEPTH)


@_Q.add("SELECT src AS owner, dst AS node, 1 AS hops FROM holds UNION ALL SELECT a.src, b.dst, 2 FROM holds a JOIN holds b ON a.dst = b.src")
def service_containment(spark, sf):
    return graph.containers(fact(spark, sf, "holds"))


@_Q.add(
    "SELECT category, terminal, steps, n > 10 AS capped FROM (SELECT o_orderstatus AS category, o_custkey AS terminal, CAST(o_orderkey AS VARCHAR) AS steps, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_orderstatus, o_custkey) AS n FROM orders) AS x WHERE rank <= 10"
)
def capped_paths(spark, sf):
    paths = select(spark, sf, "SELECT o_orderstatus AS category, o_custkey AS terminal, array(o_orderkey) AS steps FROM orders")
    return graph.capped_paths(paths).withColumn("steps", F.array_join("steps", ">"))


@_Q.add("SELECT c_custkey, concat(r_name, ' -[CONTAINS]-> ', n_name, ' <-[LIVES_IN]- ', c_name) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def rendered_paths(spark, sf):
    rows = select(spark, sf, "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
    step = lambda name, rel, way: F.struct(F.col(name).alias("name"), F.lit(rel).cast("string").alias("relationship"), F.lit(way).cast("string").alias("direction"))
    steps = F.array(step("r_name", None, None), step("n_name", "CONTAINS", "FORWARD"), step("c_name", "LIVES_IN", "REVERSE"))
    return rows.select("c_custkey", graph.rendered(steps).alias("path"))


@_Q.add(
    "WITH RECURSIVE w AS (SELECT node, 0 AS depth FROM start UNION SELECT c.src, w.depth + 1 FROM w JOIN calls c ON c.dst = w.node AND c.src <> c.dst WHERE w.depth < 3 AND (w.depth = 0 OR w.node % 10 <> 3)) SELECT concat('p', CAST(node AS VARCHAR)) AS id, min(depth) AS depth, CASE WHEN node % 10 = 3 THEN 'tests' ELSE 'calls' END AS relation FROM w WHERE node IN (SELECT src FROM calls) GROUP BY node HAVING min(depth) > 0"
)
def call_name_bfs(spark, sf):
    edges, first = _calls_and_start(spark, sf)
    chunks = written(select(spark, sf, "SELECT id, id AS name, text FROM code_chunks", calls=edges).withColumn("is_test", F.col("id").rlike("3$")), "chunks")
    start = f"p{first.first()[0]}"
    # the start is expanded even if it is a test
    calls = graph.name_calls(chunks)
    return impact.name_call_impact(calls, chunks.withColumn("is_test", F.col("is_test") & (F.col("id") != start)), start, DEPTH)


@_Q.add("SELECT label, id, n_status AS status, n_priority AS priority FROM (SELECT 'Customer' AS label, c_custkey AS id, CASE WHEN o.k IS NULL THEN NULL ELSE o.s END AS n_status, CASE WHEN o.k IS NULL THEN c_mktsegment ELSE o.p END AS n_priority FROM customer LEFT JOIN (SELECT o_custkey AS k, arg_max(CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) AS o ON c_custkey = o.k) AS x")
def graph_upsert(spark, sf):
    stored = select(spark, sf, "SELECT 'Customer' AS label, c_custkey AS id, CAST(NULL AS STRING) AS status, c_mktsegment AS priority FROM customer")
    batch = select(spark, sf, "SELECT 'Customer' AS label, o_custkey AS id, o_orderkey AS ord, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders")
    return upsert.merge_nodes(stored, batch, ["status", "priority"])


@_Q.add("SELECT DISTINCT e.* FROM graph_edges e JOIN graph_nodes a ON e.start_id = a.id AND e.start_label = a.label JOIN graph_nodes b ON e.end_id = b.id AND e.end_label = b.label")
def edge_upsert(spark, sf):
    batch = fact(spark, sf, "graph_edges")
    return upsert.merge_edges(batch.limit(0), batch, fact(spark, sf, "graph_nodes"))


@_Q.add("SELECT e.start_label, e.start_id, e.rel_type, e.end_label, e.end_id FROM graph_edges e WHERE e.rel_type = 'LIVES_IN' AND e.start_label = 'Customer' UNION SELECT e.* FROM graph_edges e JOIN graph_nodes a ON e.start_id = a.id AND e.start_label = a.label JOIN graph_nodes b ON e.end_id = b.id AND e.end_label = b.label")
def edge_upsert_stored(spark, sf):
    """Stored edges stay, with or without their nodes; the batch repeats some of them."""
    batch = fact(spark, sf, "graph_edges")
    return upsert.merge_edges(batch.where("rel_type = 'LIVES_IN' and start_label = 'Customer'"), batch, fact(spark, sf, "graph_nodes"))


@_Q.add("SELECT 'node' AS kind, label AS name, count(*) AS n FROM graph_nodes GROUP BY label UNION ALL SELECT 'edge', rel_type, count(*) FROM graph_edges GROUP BY rel_type")
def ingestion_summary(spark, sf):
    return upsert.ingestion_summary(fact(spark, sf, "graph_nodes"), fact(spark, sf, "graph_edges"))


@_Q.add("SELECT 'Customer' AS label, o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_ids(spark, sf):
    return upsert.repeated_ids(select(spark, sf, "SELECT 'Customer' AS label, o_custkey AS id FROM orders"))


@_Q.add("SELECT e.start_id, a.name AS start_name, e.end_id, b.name AS end_name FROM graph_edges e JOIN graph_nodes a ON e.start_id = a.id JOIN graph_nodes b ON e.end_id = b.id WHERE rel_type = 'ORDERED_FROM' AND a.label = 'Customer' AND b.label = 'Nation'")
def edge_pattern_join(spark, sf):
    return resolve.edge_pattern(fact(spark, sf, "graph_edges"), fact(spark, sf, "graph_nodes"), "Customer", "ORDERED_FROM", "Nation")


@_Q.add("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source, 'MODIFIES' AS relationship_type, CAST(l_partkey AS VARCHAR) AS target, 0 AS line FROM lineitem")
def explode_modifies(spark, sf):
    commits = select(spark, sf, "SELECT CAST(l_orderkey AS STRING) AS commit_hash, collect_set(CAST(l_partkey AS STRING)) AS changed_files FROM lineitem GROUP BY l_orderkey")
    return facts_of.modifies(commits)


@_Q.add("SELECT o_orderkey AS id, o_orderstatus AS name, c_name AS class_name, n_name AS file_name, r_name AS repository_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON o_orderkey % 40 = n_nationkey LEFT JOIN region ON o_orderkey % 7 = r_regionkey")
def left_outer_node_details(spark, sf):
    nodes = select(spark, sf, "SELECT o_orderkey AS id, o_orderstatus AS name, o_custkey AS class_id, o_orderkey % 40 AS file_id, o_orderkey % 7 AS repository_id FROM orders")
    of = lambda sql: select(spark, sf, sql)
    return facts_of.node_details(nodes, of("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 0"), of("SELECT n_nationkey AS id, n_name AS name FROM nation"), of("SELECT r_regionkey AS id, r_name AS name FROM region"))


@_Q.add(
    "SELECT * FROM (SELECT unnest(['SERVICE', 'API', 'EVENT', 'DATABASE', 'TABLE', 'DOWNSTREAM_SERVICE', 'TEST']) AS category, unnest([(SELECT count(*) FROM supplier) > 0, false, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 0, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 0, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 0, false, true]) AS known) AS x"
    .replace("SELECT * FROM", "SELECT category, CASE WHEN known THEN 'KNOWN' ELSE 'UNRESOLVED' END AS status FROM", 1)
)
def coverage_flags(spark, sf):
    edges = select(
        spark,
        sf,
        "SELECT 'Service' AS start_label, 'CONTAINS' AS rel_type, 'File' AS end_label FROM supplier UNION ALL SELECT 'Class', CASE WHEN o_orderstatus = 'P' THEN 'PUBLISHES' WHEN o_orderstatus = 'F' THEN 'ACCESSES' ELSE 'EXPOSES' END, CASE WHEN o_orderstatus = 'P' THEN 'Event' WHEN o_orderstatus = 'F' THEN 'Table' ELSE 'Page' END FROM orders",
    )
    return impact.coverage(edges, select(spark, sf, "SELECT concat('tests/', p_name) AS path FROM part"))


_IMPACT_SQL = """WITH RECURSIVE w AS (SELECT node, 0 AS depth FROM start UNION SELECT c.src, w.depth + 1 FROM w JOIN calls c ON c.dst = w.node WHERE w.depth < 3), d AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
c AS (SELECT node, depth, CASE WHEN depth = 0 THEN 'PRIMARY_CHANGE' WHEN node % 10 = 3 THEN 'TEST' WHEN depth = 1 THEN 'DIRECT_CALLER' ELSE 'INDIRECT_CALLER' END AS category FROM d),
i AS (SELECT node, depth FROM c WHERE category <> 'TEST'), f AS (SELECT node % 50 AS file, min(depth) AS depth FROM i GROUP BY 1), s AS (SELECT file % 5 AS service, min(depth) + 1 AS depth FROM f GROUP BY 1),
s2 AS (SELECT (node % 50) % 5 AS service, min(depth) + 2 AS depth FROM i GROUP BY 1), sv AS (SELECT service, min(depth) AS depth FROM (SELECT * FROM s UNION ALL SELECT * FROM s2) AS u GROUP BY 1)
SELECT category, concat('p', CAST(node AS VARCHAR)) AS id, depth, CASE WHEN depth > 0 THEN 'CALLS' END AS relationship FROM c
UNION ALL SELECT 'FILE', concat('f', CAST(file AS VARCHAR)), min(depth), 'CONTAINS' FROM (SELECT node % 50 AS file, depth FROM i WHERE depth > 0) AS x GROUP BY file
UNION ALL SELECT 'SERVICE', concat('s', CAST(service AS VARCHAR)), depth, 'CONTAINS' FROM sv
UNION ALL SELECT 'API', concat('a', CAST(file AS VARCHAR)), depth + 1, 'EXPOSES' FROM f
UNION ALL SELECT 'DOWNSTREAM_SERVICE', concat('s', CAST(k AS VARCHAR)), k - 4, CASE WHEN k = 5 THEN 'DIRECT' ELSE 'INDIRECT' END FROM (SELECT unnest([5, 6, 7]) AS k) AS y WHERE 4 IN (SELECT service FROM sv)"""


def impact_graph(spark, sf):
    """Nodes, edges and the changed node: parts call parts, files hold them, services hold files and need each other, files expose APIs."""
    calls, start = _calls_and_start(spark, sf)
    k = written(calls.select(F.col("src").alias("k")).union(calls.select("dst")).distinct(), "parts")
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    of = lambda sql: spark.sql(sql, calls=calls, parts=k, nation=nation)
    nodes = of("SELECT 'Function' AS label, concat('p', k) AS id, concat('p', k) AS name, concat(CASE WHEN k % 10 = 3 THEN 'tests/' ELSE 'src/' END, k, '.py') AS path FROM {parts} UNION ALL SELECT DISTINCT 'File', concat('f', k % 50), concat('f', k % 50), 'f' FROM {parts} UNION ALL SELECT 'Service', concat('s', n_nationkey), concat('s', n_nationkey), '' FROM {nation}")
    edges = of(
        """SELECT 'Function' AS start_label, concat('p', src) AS start_id, 'CALLS' AS rel_type, 'Function' AS end_label, concat('p', dst) AS end_id FROM {calls}
        UNION ALL SELECT 'File', concat('f', k % 50), 'CONTAINS', 'Function', concat('p', k) FROM {parts}
        UNION ALL SELECT DISTINCT 'Service', concat('s', (k % 50) % 5), 'CONTAINS', 'File', concat('f', k % 50) FROM {parts}
        UNION ALL SELECT DISTINCT 'File', concat('f', k % 50), 'EXPOSES', 'API', concat('a', k % 50) FROM {parts}
        UNION ALL SELECT 'Service', concat('s', n_nationkey), 'DEPENDS_ON', 'Service', concat('s', n_nationkey + 1) FROM {nation} WHERE n_nationkey >= 4"""
    )
    start = start.select(F.concat(F.lit("p"), F.col("node").cast("string")).alias("id"))
    return written(nodes, "nodes"), written(edges, "edges"), start


@_Q.add(_IMPACT_SQL)
def analyze_impact(spark, sf):
    return impact.analyze(*impact_graph(spark, sf), DEPTH)


def _entities(spark, sf, revision):
    rows = fact(spark, sf, "revision_entities").where(F.col("revision") == revision)
    return rows.select("key", "entity_type", "name", F.create_map(F.lit("method"), "method", F.lit("path"), "path").alias("properties"), F.create_map(F.lit("handler"), "handler").alias("meta"))


def _rels(spark, sf, revision):
    rows = fact(spark, sf, "revision_rels").where(F.col("revision") == revision)
    return rows.select("rel_type", "source", "target", F.create_map(F.lit("version"), "version").alias("properties"))


_PAIR_SQL = """po AS (SELECT * FROM revision_entities WHERE revision = 'old'), pn AS (SELECT * FROM revision_entities WHERE revision = 'new'),
gone AS (SELECT *, count(*) OVER (PARTITION BY handler) AS n FROM po WHERE entity_type = 'API' AND key NOT IN (SELECT key FROM pn)), fresh AS (SELECT *, count(*) OVER (PARTITION BY handler) AS n FROM pn WHERE entity_type = 'API' AND key NOT IN (SELECT key FROM po)),
pairs AS (SELECT g.key AS before_key, f.key AS after_key, g.name AS b, f.name AS a, CASE WHEN g.method = f.method THEN 'API_PATH_CHANGED' ELSE 'API_METHOD_CHANGED' END AS category FROM gone g JOIN fresh f ON g.handler = f.handler AND g.n = 1 AND f.n = 1 WHERE (g.method = f.method) <> (g.path = f.path)),
ec AS (SELECT CASE WHEN po.key IS NULL THEN 'ADDED' WHEN pn.key IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, coalesce(pn.entity_type, po.entity_type) AS entity_type, coalesce(pn.key, po.key) AS entity_id, coalesce(pn.name, po.name) AS name FROM po FULL JOIN pn ON po.key = pn.key WHERE (po.key IS NULL OR pn.key IS NULL OR po.method <> pn.method OR po.path <> pn.path) AND coalesce(pn.entity_type, po.entity_type) <> 'DEPENDENCY'),
ee AS (SELECT change_type, entity_type, CASE WHEN change_type = 'MODIFIED' THEN 'ENTITY_MODIFIED' ELSE concat(entity_type, '_', change_type) END AS category, entity_id, name FROM ec WHERE NOT (change_type = 'REMOVED' AND entity_id IN (SELECT before_key FROM pairs)) AND NOT (change_type = 'ADDED' AND entity_id IN (SELECT after_key FROM pairs))
UNION ALL SELECT 'MODIFIED', 'API', category, after_key, concat(b, ' -> ', a) FROM pairs)"""
_REL_SQL = """ro AS (SELECT * FROM revision_rels WHERE revision = 'old'), rn AS (SELECT * FROM revision_rels WHERE revision = 'new'),
xor_keys AS (SELECT key FROM po WHERE key NOT IN (SELECT key FROM pn) UNION SELECT key FROM pn WHERE key NOT IN (SELECT key FROM po)),
rc AS (SELECT CASE WHEN ro.source IS NULL THEN 'ADDED' WHEN rn.source IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, coalesce(rn.rel_type, ro.rel_type) AS rel_type, coalesce(rn.source, ro.source) AS source, coalesce(rn.target, ro.target) AS target, ro.version IS DISTINCT FROM rn.version AS moved FROM ro FULL JOIN rn ON ro.rel_type = rn.rel_type AND ro.source = rn.source AND ro.target = rn.target),
rk AS (SELECT rc.*, coalesce(s1.name, s2.name) AS sn, coalesce(t1.name, t2.name) AS tn, coalesce(t1.entity_type, t2.entity_type) AS tt, coalesce(s1.entity_type, s2.entity_type) AS st FROM rc LEFT JOIN pn s1 ON s1.key = source AND change_type <> 'REMOVED' LEFT JOIN po s2 ON s2.key = source AND change_type = 'REMOVED' LEFT JOIN pn t1 ON t1.key = target AND change_type <> 'REMOVED' LEFT JOIN po t2 ON t2.key = target AND change_type = 'REMOVED' WHERE (change_type <> 'MODIFIED' OR moved) AND NOT (change_type <> 'MODIFIED' AND rel_type = 'EXPOSES' AND target IN (SELECT key FROM xor_keys))),
rr AS (SELECT change_type, CASE WHEN rel_type = 'DEPENDS_ON' AND tt = 'DEPENDENCY' THEN 'DEPENDENCY' ELSE 'RELATIONSHIP' END AS entity_type,
CASE WHEN change_type = 'MODIFIED' THEN CASE WHEN rel_type = 'DEPENDS_ON' AND tt = 'DEPENDENCY' THEN 'DEPENDENCY_VERSION_CHANGED' ELSE 'RELATIONSHIP_MODIFIED' END WHEN rel_type = 'EXPOSES' THEN 'API_RELATIONSHIP_CHANGED' WHEN rel_type = 'PUBLISHES' THEN 'EVENT_PUBLISHER_CHANGED' WHEN rel_type = 'CONSUMES' THEN 'EVENT_CONSUMER_CHANGED' WHEN rel_type = 'ACCESSES' THEN concat('DATABASE_ACCESS_', change_type) WHEN tt = 'SERVICE' THEN concat('SERVICE_RELATIONSHIP_', change_type) ELSE concat('DEPENDENCY_', change_type) END AS category,
concat(rel_type, ':', source, '->', target) AS entity_id, concat(sn, ' -[', rel_type, ']-> ', tn) AS name FROM rk)"""


@_Q.add(f"WITH {_PAIR_SQL} SELECT * FROM ee")
def snapshot_diff(spark, sf):
    return snapshot.entity_changes(_entities(spark, sf, "old"), _entities(spark, sf, "new"))


@_Q.add(f"WITH {_PAIR_SQL}, {_REL_SQL} SELECT * FROM rr")
def relationship_diff(spark, sf):
    return snapshot.relationship_changes(_rels(spark, sf, "old"), _rels(spark, sf, "new"), _entities(spark, sf, "old"), _entities(spark, sf, "new"))


@_Q.add(f"WITH {_PAIR_SQL} SELECT before_key, after_key, category FROM pairs")
def api_pairing(spark, sf):
    return snapshot.pair_apis(_entities(spark, sf, "old"), _entities(spark, sf, "new"))


@_Q.add(f"WITH {_PAIR_SQL} SELECT 'total' AS kind, '' AS value, count(*) AS n FROM ee UNION ALL SELECT 'change_type', change_type, count(*) FROM ee GROUP BY 2 UNION ALL SELECT 'entity_type', entity_type, count(*) FROM ee GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM ee GROUP BY 2")
def snapshot_diff_summary(spark, sf):
    return snapshot.summary(snapshot_diff(spark, sf))


@_Q.add(
    f"""WITH {_PAIR_SQL}, ev AS (SELECT key AS entity_id, concat('f', substring(handler, 2, 1), '.py') AS file FROM revision_entities UNION SELECT key, concat('g', substring(handler, 3, 1), '.py') FROM revision_entities),
    bl AS (SELECT 'f1.py' AS file, 'ADDED' AS change_type UNION ALL SELECT 'f1.py', 'MODIFIED' UNION ALL SELECT 'g2.py', 'REMOVED' UNION ALL SELECT 'g2.py', 'MODIFIED')
    SELECT ee.*, h.file AS blocked_file FROM ee LEFT JOIN (SELECT entity_id, change_type, min(ev.file) AS file FROM ev JOIN bl ON ev.file = bl.file GROUP BY 1, 2) AS h ON ee.entity_id = h.entity_id AND ee.change_type = h.change_type"""
)
def unresolved_suppression(spark, sf):
    evidence = select(spark, sf, "SELECT key AS entity_id, concat('f', substring(handler, 2, 1), '.py') AS file FROM revision_entities UNION SELECT key, concat('g', substring(handler, 3, 1), '.py') FROM revision_entities")
    file = lambda x: spark.createDataFrame([(x,)], "file string")
    return snapshot.unknown_changes(snapshot_diff(spark, sf), evidence, file("f1.py"), file("g2.py"))


@_Q.add("SELECT o_custkey AS key, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS version FROM orders GROUP BY o_custkey")
def merge_conflicting_properties(spark, sf):
    declared = select(spark, sf, "SELECT o_custkey AS key, 'SERVICE' AS entity_type, o_orderstatus AS name, map('version', o_orderpriority) AS properties, map('file', o_orderstatus) AS meta, o_orderkey AS ord FROM orders")
    return snapshot.merge_entities(declared).select("key", F.col("properties")["version"].alias("version"))


@_Q.add("SELECT o_custkey AS key, arg_min(o_orderstatus, o_orderkey) AS name, arg_min(o_orderstatus, o_orderkey) AS file FROM orders GROUP BY o_custkey")
def merge_first_declaration(spark, sf):
    declared = select(spark, sf, "SELECT o_custkey AS key, 'SERVICE' AS entity_type, o_orderstatus AS name, map('version', o_orderpriority) AS properties, map('file', o_orderstatus) AS meta, o_orderkey AS ord FROM orders")
    return snapshot.merge_entities(declared).select("key", "name", F.col("meta")["file"].alias("file"))


@_Q.add("SELECT DISTINCT l_orderkey AS owner, l_returnflag AS source, CAST(l_partkey AS VARCHAR) AS file, l_linenumber AS line FROM lineitem")
def evidence_first_seen(spark, sf):
    ev = select(spark, sf, "SELECT l_orderkey AS owner, l_returnflag AS source, CAST(l_partkey AS STRING) AS file, l_linenumber AS line, '' AS details, '' AS relationship, l_suppkey AS ord FROM lineitem")
    return snapshot.first_evidence(ev).select("owner", "source", "file", "line")


@_Q.add(
    "SELECT c_custkey, sha1(concat('repository', chr(9247), r_name)) AS repository, sha1(concat('file', chr(9247), sha1(concat('repository', chr(9247), r_name)), chr(9247), n_name)) AS file, sha1(concat('class', chr(9247), sha1(concat('file', chr(9247), sha1(concat('repository', chr(9247), r_name)), chr(9247), n_name)), chr(9247), c_name)) AS class FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def stable_ids(spark, sf):
    rows = select(spark, sf, "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
    repo = C.repository_id(F.col("r_name"), F.lit("/root"))
    file = C.file_id(repo, F.col("n_name"))
    return rows.select("c_custkey", repo.alias("repository"), file.alias("file"), C.class_id(file, F.col("c_name")).alias("class"))


QUERIES, ORACLE_SQL = _Q.queries, _Q.sql
