"""Facts for the operators out of the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import dealt

#: Facts by name; a fact may use tables and the facts before it.
FACTS = {
    # parts that follow each other in an order are caller and callee
    "calls": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "start": "SELECT dst AS node FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1",
    # regions contain nations, nations contain customers and suppliers
    "holds": "SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier",
    "graph_nodes": "SELECT 'Nation' AS label, concat('n', n_nationkey) AS id, n_name AS name FROM nation UNION ALL SELECT 'Supplier', concat('s', s_suppkey), s_name FROM supplier UNION ALL SELECT 'Customer', concat('c', c_custkey), c_name FROM customer WHERE c_acctbal > 0",
    "graph_edges": "SELECT 'Supplier' AS start_label, concat('s', s_suppkey) AS start_id, 'LIVES_IN' AS rel_type, 'Nation' AS end_label, concat('n', s_nationkey) AS end_id FROM supplier UNION ALL SELECT 'Customer', concat('c', o_custkey), 'ORDERED_FROM', 'Nation', concat('n', c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'Customer', concat('c', c_custkey), 'LIVES_IN', 'Nation', concat('n', c_nationkey) FROM customer",
    # log lines of events
    "log_lines": "SELECT event_id AS log_id, concat(CASE WHEN event_type = 'view' THEN '' ELSE concat(replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T'), CASE WHEN event_type = 'click' THEN 'Z' WHEN event_type = 'error' THEN '+05:30' ELSE '' END, ' ') END, event_type, CASE WHEN event_type = 'signup' THEN ' Request-ID: ' ELSE ' trace_id=' END, 'u-', CAST(user_id AS STRING), ' failed with ', CAST(CAST(floor(value) AS INT) AS STRING)) AS raw FROM events",
    # failures of parts, each with some of what ties log lines to it
    "failures": """SELECT p_partkey AS failure_id, CASE WHEN p_size % 5 = 0 THEN concat('u-', CAST(p_partkey AS STRING)) END AS correlation_id, CASE WHEN p_size % 4 = 1 THEN TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '1' HOUR END AS ts, CASE WHEN p_size % 6 = 1 THEN concat('with ', CAST(200 + p_partkey % 100 AS STRING)) END AS exception_type,
        CASE WHEN p_size % 3 = 0 THEN concat('u-', CAST(p_partkey % 40 AS STRING), ' failed with ', CAST(p_size AS STRING)) ELSE '' END AS message, CASE WHEN p_size % 7 = 2 THEN concat('src/signup Request-ID: u-', CAST(p_partkey % 90 AS STRING)) END AS file_path, CASE WHEN p_size % 8 = 3 THEN concat('Orders.error trace_id=u-', CAST(p_partkey % 70 AS STRING)) END AS qualified_name FROM part""",
    # stack traces of parts
    "traces": "SELECT p_partkey AS trace_id, concat('Traceback (most recent call last):\n', '  File \"/srv/', lower(p_type), '/app.py\", line ', CAST(p_size AS STRING), ', in run\n', CASE WHEN p_size < 20 THEN concat('    ', replace(p_name, ' ', '_'), '(x)\n') WHEN p_size < 30 THEN '    return\n' ELSE '' END, '  File \"lib/', replace(p_name, ' ', '_'), '.py\", line ', CAST(p_size + 7 AS STRING), ', in <module>\n', '    step = ', CAST(p_size AS STRING), '\n', CASE WHEN p_size > 45 THEN '' WHEN p_size > 40 THEN 'KeyError' WHEN p_size > 10 THEN concat('ValueError: bad ', p_name) ELSE 'errors.Timeout:  ' END, '\n') AS raw FROM part",
    # files of parts: nested folders, names that repeat
    "paths": "SELECT DISTINCT concat(lower(p_type), '/', replace(p_name, ' ', '/'), '.py') AS path FROM part UNION SELECT DISTINCT concat(replace(p_name, ' ', '/'), '.py') FROM part WHERE p_size > 40",
    "frame_paths": "SELECT DISTINCT concat(CASE WHEN p_size > 25 THEN '/srv/app/' WHEN p_size > 10 THEN concat('C:', chr(92), 'work', chr(92)) ELSE '' END, lower(p_type), '/', replace(p_name, ' ', '/'), CASE WHEN p_size > 45 THEN '.txt' ELSE '.py' END) AS frame_path FROM part",
    "chunk_ids": "SELECT DISTINCT concat(path, '::', name) AS id FROM paths JOIN (SELECT DISTINCT p_brand AS name FROM part) AS b ON length(path) > 0",
    "locations": "SELECT DISTINCT concat(CASE WHEN p_size > 30 THEN 'repo/' ELSE '' END, CASE WHEN p_size > 20 THEN concat(lower(p_type), '/') ELSE '' END, replace(p_name, ' ', '/'), '.py', CASE WHEN p_size = 7 THEN '' ELSE concat('::', p_brand) END) AS location FROM part",
    # two revisions of an architecture: what customers ordered before and from 1998 on
    "revision_orders": "SELECT o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'old' ELSE 'new' END AS revision, min(o_orderstatus) AS status, min(o_orderpriority) AS priority, count(*) AS n FROM orders GROUP BY 1, 2",
    "revision_entities": """SELECT revision, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'API' WHEN c_mktsegment = 'MACHINERY' THEN 'SERVICE' WHEN c_mktsegment = 'FURNITURE' THEN 'EVENT' WHEN c_mktsegment = 'BUILDING' THEN 'DATABASE' ELSE 'DEPENDENCY' END AS entity_type,
        CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN concat('api:', CASE WHEN status = 'F' THEN 'GET' ELSE 'POST' END, ' /', CAST(o_custkey AS STRING)) ELSE concat('e', CAST(o_custkey AS STRING)) END AS key, c_name AS name,
        CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN CASE WHEN status = 'F' THEN 'GET' ELSE 'POST' END ELSE status END AS method, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN concat('/', CAST(o_custkey AS STRING)) ELSE priority END AS path, concat('h', CAST(o_custkey - o_custkey % 2 AS STRING)) AS handler
        FROM revision_orders JOIN customer ON o_custkey = c_custkey""",
    "revision_rels": """SELECT a.revision, CASE WHEN b.entity_type = 'API' THEN 'EXPOSES' WHEN b.entity_type = 'EVENT' THEN CASE WHEN a.method = 'F' THEN 'PUBLISHES' ELSE 'CONSUMES' END WHEN b.entity_type = 'DATABASE' THEN 'ACCESSES' ELSE 'DEPENDS_ON' END AS rel_type, a.key AS source, b.key AS target, min(b.path) AS version
        FROM revision_entities a JOIN revision_entities b ON a.revision = b.revision AND a.handler = b.handler AND a.key <> b.key WHERE a.entity_type = 'SERVICE' GROUP BY 1, 2, 3, 4""",
    # recorded runs: an order is a validation, its lines are its runs
    "runs": """SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq, CASE WHEN l_linenumber = 1 AND l_tax > 0.06 THEN 'build' ELSE 'test' END AS kind,
        CAST(CASE WHEN l_discount > 0.095 THEN NULL WHEN l_discount > 0.09 THEN 126 + l_suppkey % 2 WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 1 + l_suppkey % 5 ELSE 0 END AS INT) AS exit_code, l_quantity > 48 AND l_tax > 0.05 AS timed_out,
        CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_quantity) AS BIGINT) END AS passed, CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_discount * 100) AS BIGINT) END AS failed, CAST(CASE WHEN l_tax > 0.07 THEN 1 END AS BIGINT) AS errored FROM lineitem""",
    "validations": "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 20000 THEN 'crash' END AS unexpected_error, CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice < 20000 THEN 'no docker' END AS infrastructure_error, CASE WHEN o_orderpriority = '5-LOW' AND o_totalprice > 450000 THEN 'TIMEOUT' WHEN o_orderpriority = '5-LOW' AND o_totalprice > 400000 THEN 'FAILED' WHEN o_orderstatus = 'P' THEN 'READY' ELSE 'NOT_REQUIRED' END AS startup, o_orderpriority = '3-MEDIUM' AND o_totalprice > 450000 AS overall_timeout, o_orderstatus <> 'P' AS tests_expected FROM orders",
    # claims: an order cites evidence by number; its lines are the evidence
    "evidence": "SELECT id AS claim, seq AS n, CASE WHEN kind = 'build' OR coalesce(failed, 0) > 7 THEN 'fix_localization' ELSE 'rca' END AS source, CASE WHEN coalesce(failed, 0) > 4 THEN 'method [KNOWN]' ELSE 'method' END AS description, CASE WHEN coalesce(exit_code, 1) > 0 THEN NULL ELSE concat('f', CAST(id % 7 AS STRING), '.py', CASE WHEN passed IS NULL THEN '' ELSE concat('::m', CAST(seq AS STRING)) END) END AS location FROM runs",
    "claims": "SELECT o_orderkey AS claim, CASE WHEN o_orderstatus = 'F' THEN ' High ' WHEN o_orderstatus = 'P' THEN 'medium' ELSE 'certain' END AS confidence, o_orderpriority = '1-URGENT' AS insufficient, CASE WHEN o_orderpriority = '2-HIGH' THEN ' e2 ' END AS location_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'F' THEN concat('f', CAST(o_orderkey % 7 AS STRING), '.py:12-', CAST(o_custkey AS STRING)) WHEN o_orderstatus = 'P' THEN concat('f', CAST(o_orderkey % 7 AS STRING), '.py::m1') ELSE 'nowhere.py' END AS location FROM orders",
    "citations": "SELECT o_orderkey AS claim, ' e1' AS cited FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, 'E4 ' FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL SELECT o_orderkey, 'E1' FROM orders WHERE o_totalprice > 200000",
    # parsed sources: parts are functions, suppliers classes, their lines methods that call parts
    "src_files": "SELECT concat('pkg/m', CAST(k AS STRING), '.py') AS path, concat('m', CAST(k AS STRING), '.py') AS name, k AS line_count FROM (SELECT DISTINCT p_partkey % 40 AS k FROM part) AS x",
    "src_functions": "SELECT concat('pkg/m', CAST(p_partkey % 40 AS STRING), '.py') AS file_path, concat('f', CAST(p_partkey AS STRING)) AS name, p_size AS line FROM part",
    "src_classes": "SELECT concat('pkg/m', CAST(s_suppkey % 40 AS STRING), '.py') AS file_path, concat('C', CAST(s_suppkey AS STRING)) AS name, s_nationkey AS line FROM supplier",
    "src_methods": "SELECT DISTINCT concat('pkg/m', CAST(l_suppkey % 40 AS STRING), '.py') AS file_path, concat('C', CAST(l_suppkey AS STRING)) AS class_name, concat('run', CAST(l_linenumber AS STRING)) AS name, l_linenumber AS line FROM lineitem",
    "src_calls": "SELECT DISTINCT concat('pkg/m', CAST(l_suppkey % 40 AS STRING), '.py') AS file_path, concat('C', CAST(l_suppkey AS STRING)) AS class_name, concat('run', CAST(l_linenumber AS STRING)) AS name, CASE WHEN l_returnflag = 'R' THEN concat('x.f', CAST(l_partkey AS STRING)) WHEN l_partkey % 40 = l_suppkey % 40 THEN concat('f', CAST(l_partkey AS STRING)) WHEN l_returnflag = 'A' THEN concat('pkg.m', CAST(l_partkey % 40 AS STRING), '.f', CAST(l_partkey AS STRING)) ELSE concat('pkg.m', CAST(l_partkey % 40 AS STRING), '.gone') END AS target, CASE WHEN l_partkey % 2 = 0 THEN concat('x.f', CAST(l_partkey AS STRING), '()') END AS raw, l_returnflag <> 'R' AS resolved, l_partkey AS ord FROM lineitem",
    "src_changes": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS commit_hash, concat('pkg/m', CAST(l_partkey % 45 AS STRING), '.py') AS path FROM lineitem",
    "src_imports": "SELECT DISTINCT concat('pkg/m', CAST(l_suppkey % 40 AS STRING), '.py') AS file, concat('pkg/m', CAST(l_partkey % 50 AS STRING), '.py') AS target FROM lineitem WHERE l_quantity > 40",
    "repos": "SELECT CAST(n_nationkey AS STRING) AS id, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN concat('git@', lower(n_name)) ELSE 'git@shared' END AS remote_url, concat('/src/', CAST(n_regionkey AS STRING)) AS root_path FROM nation",
    # parts whose text calls the parts that follow them
    "code_chunks": "SELECT concat('p', CAST(src AS STRING)) AS id, array_join(sort_array(collect_list(concat('  p', CAST(dst AS STRING), ' (x)'))), ' ') AS text FROM calls GROUP BY src",
    "ranked_lists": "SELECT 1 AS list, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, CAST(c_custkey AS STRING) AS key, c_nationkey AS nation FROM customer UNION ALL SELECT 2, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey), CAST(c_custkey AS STRING), c_nationkey FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) AS o ON c_custkey = o_custkey",
    "requirements": "SELECT p_partkey AS k, CASE WHEN p_size % 10 = 0 THEN concat('-r ', p_name) WHEN p_size % 10 = 1 THEN concat('# ', p_name) WHEN p_size % 10 = 2 THEN concat(replace(p_name, ' ', '_.'), '[extra,', lower(p_type), '] >= ', CAST(p_size AS STRING), ' ; python_version > \"3\"') WHEN p_size % 10 = 3 THEN concat(replace(upper(p_name), ' ', '__'), '==', CAST(p_size AS STRING), ' # ', p_brand) WHEN p_size % 10 = 4 THEN concat('git+https://host/', replace(p_name, ' ', '-')) WHEN p_size % 10 = 5 THEN concat('  ', replace(p_name, ' ', '-'), ' --hash=sha256:', CAST(p_partkey AS STRING)) WHEN p_size % 10 = 6 THEN './local' WHEN p_size % 10 = 7 THEN concat(replace(p_name, ' ', '.'), ' @ https://host/x') ELSE replace(p_name, ' ', '-') END AS line FROM part",
    "test_output": "SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN concat('collected\n', 'FAILED tests/', lower(p_type), '.py::test_a - boom\n', 'FAILED tests/', lower(p_type), '.py::test_a\n', 'ERROR x.py\n', '== ', CAST(p_size AS STRING), ' failed, ', CAST(p_partkey AS STRING), ' passed, 2 errors in 1.25s ==') WHEN p_size % 5 = 1 THEN concat('3 passed in 0.1s\n', CAST(p_size AS STRING), ' passed, 1 error in 3s') WHEN p_size % 5 = 2 THEN concat('FAIL: test_b (pkg.', lower(p_type), ')\n', 'Ran ', CAST(p_size AS STRING), ' tests in 0.5s\n', 'FAILED (failures=2, errors=1)') WHEN p_size % 5 = 3 THEN 'Ran 1 test in 0.1s\nOK' ELSE p_name END AS output FROM part",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def needed(sql: str, given: Iterable[str] = ()) -> list[str]:
    """The facts that a text names, with those that they need, in order, without those that are given."""
    found: set[str] = set()
    for name in reversed(FACTS):
        if name in given:
            continue
        if any(re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", FACTS[x]) for x in found) or re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            found.add(name)
    return [n for n in FACTS if n in found]


def for_duckdb(sql: str, given: Iterable[str] = ()) -> str:
    """The statement with the facts that it needs as common table expressions."""
    ctes = [f"{n} AS ({FACTS[n]})" for n in needed(sql, given)]
    head = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if head and ctes:
        return f"WITH {head[1] or ''}{', '.join(ctes)}, {sql[head.end():]}"
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql


def fact(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A fact as a DataFrame."""
    return select(spark, sf_dir, f"SELECT * FROM {name}", **options)


def select(spark: SparkSession, sf_dir: str, sql: str, deal: dict[str, str] | None = None, **given: DataFrame) -> DataFrame:
    """A statement over tables and facts. given: facts that are there already; deal: columns by which tables are dealt (see dealt()) before anything else."""
    whole = for_duckdb(sql, given)
    used = [t for t in [*TABLES, *given] if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", whole)]
    for t in used:
        whole = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", whole)
    # braces of literals would be taken for names
    deal = deal or {}
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(whole, **{t: given[t] if t in given else dealt(read(t), deal[t]) if t in deal else read(t) for t in used})
