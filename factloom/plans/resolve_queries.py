"""Joins that resolve, logs and traces, decision tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import facts as facts_of
from ..operators import logs, resolve, rules
from ..operators.asof import as_of_above
from .facts import fact, select
from .register import Queries

_Q = Queries()
FAILURE = {"correlation_id": "u-7", "ts": datetime.datetime(2024, 1, 5, tzinfo=datetime.UTC), "exception_type": "purchase", "message": "failed with 12", "file_path": "srv/view", "qualified_name": "Orders.signup"}


@_Q.add("SELECT e.event_id AS row, arg_max(s.event_id, (s.ts, -s.event_id)) AS r_event_id FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.ts <= e.ts AND s.event_type = 'signup' WHERE e.event_type = 'error' GROUP BY e.event_id")
def asof_definition(spark, sf):
    left = select(spark, sf, "SELECT event_id AS row, user_id, ts FROM events WHERE event_type = 'error'")
    right = select(spark, sf, "SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'")
    return resolve.as_of(left, right, "user_id", "ts", [F.col("event_id")]).select("row", "r_event_id")


@_Q.add(
    "SELECT row, r_event_id FROM (SELECT e.event_id AS row, s.event_id AS r_event_id, row_number() OVER (PARTITION BY e.event_id ORDER BY CASE WHEN s.value > e.value THEN 0 ELSE 1 END, s.ts DESC, s.event_id) AS n FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.ts <= e.ts AND s.event_type = 'signup' WHERE e.event_type = 'error') AS x WHERE n = 1"
)
def asof_definition_preferred(spark, sf):
    at = "unix_micros(CAST(ts AS TIMESTAMP)) AS at"
    left = select(spark, sf, f"SELECT event_id AS row, user_id, value, {at} FROM events WHERE event_type = 'error'")
    right = select(spark, sf, f"SELECT user_id, value, event_id, {at} FROM events WHERE event_type = 'signup'")
    return as_of_above(left, right, "user_id", "at", "value", [F.col("event_id")]).select("row", "r_event_id")


@_Q.add(
    "SELECT row, r_event_id FROM (SELECT e.event_id AS row, s.event_id AS r_event_id, row_number() OVER (PARTITION BY e.event_id ORDER BY CASE WHEN floor(s.value) % 4 = floor(e.value) % 4 THEN 0 ELSE 1 END, s.ts DESC, s.event_id) AS n FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.ts <= e.ts AND s.event_type = 'signup' WHERE e.event_type = 'error') AS x WHERE n = 1"
)
def asof_definition_of_name(spark, sf):
    """The last definition of the same name, else the last one at all, by two windows instead of a join of all pairs."""
    rows = lambda kind, id_: select(spark, sf, f"SELECT event_id AS {id_}, user_id, CAST(floor(value) % 4 AS BIGINT) AS name, ts FROM events WHERE event_type = '{kind}'")
    return resolve.as_of_same(rows("error", "row"), rows("signup", "event_id"), "user_id", "name", "ts", [F.col("event_id")]).select("row", "r_event_id")


@_Q.add(
    "SELECT row, name FROM (SELECT p.p_partkey AS row, s.p_partkey AS name, row_number() OVER (PARTITION BY p.p_partkey ORDER BY s.p_size DESC, s.p_size + s.p_partkey % 30, s.p_partkey DESC) AS n FROM part p LEFT JOIN part s ON p.p_brand = s.p_brand AND p.p_size + 5 BETWEEN s.p_size AND s.p_size + s.p_partkey % 30) AS x WHERE n = 1"
)
def interval_enclosing(spark, sf):
    points = select(spark, sf, "SELECT p_partkey AS row, p_brand AS file, CAST(p_size + 5 AS BIGINT) AS line FROM part")
    spans = select(spark, sf, "SELECT p_brand AS file, CAST(p_size AS BIGINT) AS first, p_size + p_partkey % 30 AS last, p_partkey AS name FROM part")
    return resolve.innermost(points, spans, "file").select("row", "name")


@_Q.add("SELECT a.event_id AS row, b.event_id AS other FROM events a JOIN events b ON b.ts BETWEEN a.ts - INTERVAL 60 SECOND AND a.ts + INTERVAL 60 SECOND WHERE a.event_type = 'error' AND b.event_type <> 'error'")
def band_log_correlation(spark, sf):
    left = select(spark, sf, "SELECT event_id AS row, ts FROM events WHERE event_type = 'error'")
    right = select(spark, sf, "SELECT event_id AS other, ts FROM events WHERE event_type <> 'error'")
    return resolve.band(left, right, 60).select("row", "other")


_ENTRY_SQL = r"""e AS (SELECT log_id, raw, regexp_extract(raw, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}') AS t, raw LIKE '%+05:30%' AS zoned, nullif(regexp_extract(raw, '(?:request[_-]?id|trace[_-]?id)[=:]\s*([A-Za-z0-9_-]+)', 1, 'i'), '') AS correlation_id FROM log_lines),
p AS (SELECT log_id, raw, correlation_id, CASE WHEN t <> '' THEN CAST(t AS TIMESTAMP) - CASE WHEN zoned THEN INTERVAL '5 hours 30 minutes' ELSE INTERVAL '0 hours' END END AS ts FROM e)"""


@_Q.add(f"WITH {_ENTRY_SQL} SELECT log_id, CAST(epoch(ts) AS BIGINT) AS at, correlation_id FROM p")
def log_parse(spark, sf):
    return fact(spark, sf, "log_lines").select("log_id", logs.log_entry(F.col("raw")).alias("e")).select("log_id", F.unix_seconds("e.ts").alias("at"), "e.correlation_id")


@_Q.add(
    f"""WITH {_ENTRY_SQL} SELECT * FROM (SELECT log_id, CASE WHEN correlation_id = 'u-7' THEN 'correlation_id' WHEN abs(epoch(ts) - epoch(TIMESTAMP '2024-01-05 00:00:00')) <= 3600 THEN 'timestamp_window' WHEN contains(raw, 'purchase') THEN 'exception_type' WHEN contains(raw, 'failed with 12') THEN 'exception_message' WHEN contains(raw, 'view') THEN 'file_path' WHEN contains(raw, 'signup') THEN 'method' END AS matched_on FROM p) AS x WHERE matched_on IS NOT NULL"""
)
def log_rules_first_match(spark, sf):
    return logs.correlate(fact(spark, sf, "log_lines"), FAILURE, 3600)


@_Q.add(
    f"""WITH {_ENTRY_SQL}, f AS (SELECT failure_id, correlation_id AS wanted, ts AS happened, nullif(exception_type, '') AS kind, nullif(message, '') AS message, nullif(regexp_extract(file_path, '[^/]*$'), '') AS file, nullif(regexp_extract(qualified_name, '[^.]*$'), '') AS method FROM failures)
    SELECT * FROM (SELECT failure_id, log_id, CASE WHEN wanted = correlation_id THEN 'correlation_id' WHEN abs(epoch_us(ts) - epoch_us(happened)) <= 600000000 THEN 'timestamp_window' WHEN contains(raw, kind) THEN 'exception_type' WHEN contains(raw, message) THEN 'exception_message' WHEN contains(raw, file) THEN 'file_path' WHEN contains(raw, method) THEN 'method' END AS matched_on FROM p, f) AS x WHERE matched_on IS NOT NULL"""
)
def log_rules_of_all(spark, sf):
    return logs.correlate_all(fact(spark, sf, "log_lines"), fact(spark, sf, "failures"), 600)


@_Q.add(
    """SELECT p_partkey AS trace_id, 1 AS frame_no, concat('/srv/', lower(p_type), '/app.py') AS file, p_size AS line, 'run' AS function, CASE WHEN p_size < 20 THEN concat(replace(p_name, ' ', '_'), '(x)') END AS snippet FROM part
    UNION ALL SELECT p_partkey, 2, concat('lib/', replace(p_name, ' ', '_'), '.py'), p_size + 7, '<module>', concat('step = ', CAST(p_size AS VARCHAR)) FROM part"""
)
def stack_trace_parse(spark, sf):
    return logs.stack_frames(fact(spark, sf, "traces"))


@_Q.add("SELECT p_partkey AS trace_id, CASE WHEN p_size > 45 THEN NULL WHEN p_size > 40 THEN 'KeyError' WHEN p_size > 10 THEN 'ValueError' ELSE 'errors.Timeout' END AS exception_type, CASE WHEN p_size BETWEEN 11 AND 40 THEN concat('bad ', p_name) END AS message FROM part")
def exception_parse(spark, sf):
    return logs.exceptions(fact(spark, sf, "traces"))


@_Q.add(
    """SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN p_partkey WHEN 1 THEN p_size WHEN 2 THEN greatest(p_size - 3, 0) WHEN 3 THEN 1 END AS passed, CASE p_size % 5 WHEN 0 THEN p_size WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 0 END AS failed,
    CASE p_size % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS errored, CASE p_size % 5 WHEN 0 THEN concat('tests/', lower(p_type), '.py::test_a,x.py') WHEN 2 THEN concat('pkg.', lower(p_type)) ELSE '' END AS failed_tests FROM part"""
)
def test_output_parse(spark, sf):
    parsed = fact(spark, sf, "test_output").select("k", logs.test_counts(F.col("output")).alias("c"))
    return parsed.select("k", "c.passed", "c.failed", "c.errored", F.array_join("c.failed_tests", ",").alias("failed_tests"))


_SUFFIX_SQL = "h AS (SELECT frame_path, path, replace(frame_path, chr(92), '/') = path AS exact FROM frame_paths JOIN paths ON replace(frame_path, chr(92), '/') = path OR ends_with(replace(frame_path, chr(92), '/'), concat('/', path))), b AS (SELECT frame_path, path FROM (SELECT *, bool_or(exact AND frame_path = path) OVER (PARTITION BY frame_path) AS any_exact FROM h) AS x WHERE exact OR NOT any_exact)"


@_Q.add(f"WITH {_SUFFIX_SQL} SELECT * FROM b")
def suffix_path_match(spark, sf):
    return resolve.suffix_matches(fact(spark, sf, "frame_paths"), fact(spark, sf, "paths"))


@_Q.add(f"WITH {_SUFFIX_SQL}, g AS (SELECT frame_path, count(*) AS n, min(path) AS path FROM b GROUP BY 1) SELECT f.frame_path, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN n IS NULL THEN 'no file matches' WHEN n > 1 THEN concat(n, ' files match') END AS reason FROM frame_paths f LEFT JOIN g ON f.frame_path = g.frame_path")
def unique_path_match(spark, sf):
    frames = fact(spark, sf, "frame_paths")
    return resolve.unique_match(frames, resolve.suffix_matches(frames, fact(spark, sf, "paths")), "frame_path", "path", "file")


@_Q.add(
    """WITH l AS (SELECT location, split_part(location, '::', 1) AS file, CASE WHEN contains(location, '::') THEN split_part(location, '::', 2) END AS name FROM locations), i AS (SELECT id, split_part(id, '::', 1) AS file, split_part(id, '::', 2) AS name FROM chunk_ids),
    m AS (SELECT location, count(*) AS n, min(id) AS id FROM l JOIN i ON l.name = i.name AND (l.file = i.file OR ends_with(l.file, concat('/', i.file)) OR ends_with(i.file, concat('/', l.file))) GROUP BY 1)
    SELECT l.location, CASE WHEN l.location IN (SELECT id FROM i) OR coalesce(n, 0) <> 1 THEN l.location ELSE m.id END AS resolved FROM l LEFT JOIN m ON l.location = m.location"""
)
def location_resolve(spark, sf):
    return resolve.resolve_locations(fact(spark, sf, "locations"), fact(spark, sf, "chunk_ids"))


@_Q.add("SELECT l_suppkey AS file, l_partkey AS target, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS line FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def import_first_target(spark, sf):
    return resolve.first_of_target(select(spark, sf, "SELECT l_suppkey AS file, l_partkey AS target, l_linenumber AS line, l_orderkey AS ord FROM lineitem"))


@_Q.add("SELECT c_custkey AS row, coalesce(s_name, CASE WHEN c_acctbal > 5000 THEN n_name END, CASE WHEN c_acctbal > 0 THEN r_name END) AS target, CASE WHEN s_name IS NOT NULL THEN 'supplier' WHEN c_acctbal > 5000 THEN 'nation' WHEN c_acctbal > 0 THEN 'region' END AS rule FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_suppkey = c_custkey")
def prioritised_resolution(spark, sf):
    rows = select(spark, sf, "SELECT c_custkey AS row FROM customer")
    of = lambda sql: select(spark, sf, sql)
    return resolve.first_rule(
        rows,
        "row",
        [
            ("supplier", of("SELECT s_suppkey AS row, s_name AS target FROM supplier")),
            ("nation", of("SELECT c_custkey AS row, n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")),
            ("region", of("SELECT c_custkey AS row, r_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")),
        ],
        "target",
    )


@_Q.add("SELECT concat('k', a.g) AS k, a.c_custkey AS b_c_custkey, b.s_suppkey AS a_s_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT c_custkey, c_custkey * 2 // 3 AS g FROM customer) AS x) a JOIN (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM (SELECT s_suppkey, s_suppkey * 4 // 5 AS g FROM supplier) AS y) b ON a.g = b.g WHERE a.n = 1 AND b.n = 1")
def one_to_one_pairing(spark, sf):
    """Every other key stands for two customers, every fourth for two suppliers."""
    return resolve.paired(select(spark, sf, "SELECT concat('k', CAST(floor(c_custkey * 2 / 3) AS STRING)) AS k, c_custkey FROM customer"), select(spark, sf, "SELECT concat('k', CAST(floor(s_suppkey * 4 / 5) AS STRING)) AS k, s_suppkey FROM supplier"), "k")


@_Q.add("SELECT DISTINCT c.claim, upper(trim(c.cited)) AS key, e.n IS NOT NULL AS known FROM citations c LEFT JOIN evidence e ON e.claim = c.claim AND concat('E', e.n) = upper(trim(c.cited))")
def cited_evidence(spark, sf):
    return resolve.cited(fact(spark, sf, "citations"), fact(spark, sf, "evidence"))


@_Q.add(
    """WITH s AS (SELECT claim, count(*) FILTER (known) AS supporting, count(*) FILTER (NOT known) AS dropped FROM (SELECT DISTINCT c.claim, upper(trim(c.cited)) AS key, e.n IS NOT NULL AS known FROM citations c LEFT JOIN evidence e ON e.claim = c.claim AND concat('E', e.n) = upper(trim(c.cited))) AS x GROUP BY 1)
    SELECT c.claim, CASE WHEN insufficient OR coalesce(supporting, 0) = 0 OR lower(trim(confidence)) NOT IN ('low', 'medium', 'high') THEN 'low' ELSE lower(trim(confidence)) END AS confidence, insufficient OR coalesce(supporting, 0) = 0 AS insufficient, coalesce(supporting, 0) AS supporting, coalesce(dropped, 0) AS dropped FROM claims c LEFT JOIN s ON c.claim = s.claim"""
)
def ground_citations(spark, sf):
    return rules.grounded(fact(spark, sf, "claims"), fact(spark, sf, "citations"), fact(spark, sf, "evidence"))


@_Q.add(
    """WITH b AS (SELECT c.claim, n, e.location AS known, source = 'fix_localization' AS own, contains(description, '[KNOWN]') AS sure, upper(trim(location_id)) AS wanted, c.location, regexp_replace(trim(c.location), ':[0-9][0-9-]*$', '') AS bare FROM claims c LEFT JOIN evidence e ON c.claim = e.claim AND e.location IS NOT NULL),
    f AS (SELECT *, bare = split_part(known, '::', 1) AND NOT contains(bare, '::') AS fits FROM b),
    g AS (SELECT claim, min(CASE WHEN wanted = concat('E', n) THEN known END) AS by_id, min(CASE WHEN location = known THEN known END) AS exact, count(DISTINCT CASE WHEN fits THEN known END) AS n_fits, min(CASE WHEN fits THEN known END) AS fit, arg_min(known, n) FILTER (fits AND own) AS own_fit, arg_min(known, n) FILTER (own AND sure) AS fallback FROM f GROUP BY claim),
    h AS (SELECT *, CASE WHEN n_fits = 1 THEN fit WHEN n_fits > 1 THEN own_fit END AS loose FROM g)
    SELECT claim, coalesce(by_id, exact, loose, fallback) AS location, CASE WHEN by_id IS NOT NULL THEN 'evidence_id' WHEN exact IS NOT NULL THEN 'exact' WHEN loose IS NOT NULL THEN 'file' WHEN fallback IS NOT NULL THEN 'localised' END AS rule FROM h"""
)
def evidence_location(spark, sf):
    return rules.evidence_location(fact(spark, sf, "claims"), fact(spark, sf, "evidence", deal={"lineitem": "l_orderkey"}))


_STATUS = "CASE WHEN timed_out THEN 'TIMEOUT' WHEN exit_code IS NULL OR exit_code IN (126, 127) THEN 'ERROR' WHEN exit_code = 0 THEN 'PASSED' ELSE 'FAILED' END"


@_Q.add(f"SELECT id, kind, {_STATUS} AS status, count(*) AS n FROM runs GROUP BY 1, 2, 3")
def classify_runs(spark, sf):
    runs = fact(spark, sf, "runs").withColumn("status", rules.run_status(F.col("exit_code"), F.col("timed_out")))
    return runs.groupBy("id", "kind", "status").agg(F.count("*").alias("n"))


@_Q.add(
    f"""WITH r AS (SELECT *, {_STATUS} AS status FROM runs), b AS (SELECT id, arg_max(status, seq) AS bs, arg_max(coalesce(exit_code, -1), seq) AS bc FROM r WHERE kind = 'build' GROUP BY 1),
    t AS (SELECT id, count(*) AS n, bool_or(status = 'TIMEOUT') AS late, bool_or(status = 'ERROR') AS err, bool_or(status = 'FAILED') AS bad, nullif(arg_min(coalesce(exit_code, -1), seq) FILTER (status = 'ERROR'), -1) AS ec, arg_min(exit_code, seq) FILTER (status = 'FAILED') AS fc, CAST(sum(passed) AS BIGINT) AS tp, CAST(sum(CASE WHEN passed IS NOT NULL THEN coalesce(failed, 0) + coalesce(errored, 0) END) AS BIGINT) AS tf FROM r WHERE kind = 'test' GROUP BY 1),
    x AS (SELECT v.*, bs, bc, n, late, err, bad, ec, fc, tp, tf, CASE WHEN unexpected_error IS NOT NULL THEN 1 WHEN infrastructure_error IS NOT NULL THEN 2 WHEN bs = 'TIMEOUT' THEN 3 WHEN bc = -1 THEN 2 WHEN bs <> 'PASSED' THEN 4 WHEN startup = 'TIMEOUT' THEN 3 WHEN startup = 'FAILED' THEN 5 WHEN overall_timeout THEN 3 WHEN late THEN 3 WHEN err THEN 6 WHEN bad THEN 7 WHEN coalesce(n, 0) = 0 AND tests_expected THEN 1 ELSE 8 END AS rule FROM validations v LEFT JOIN b ON v.id = b.id LEFT JOIN t ON v.id = t.id)
    SELECT id, ['ERROR', 'INFRASTRUCTURE_FAILED', 'TIMEOUT', 'BUILD_FAILED', 'STARTUP_FAILED', 'ERROR', 'FAILED', 'PASSED'][rule] AS status, CASE rule WHEN 4 THEN bc WHEN 6 THEN ec WHEN 7 THEN fc WHEN 8 THEN 0 END AS exit_code, tp AS tests_passed, tf AS tests_failed FROM x"""
)
def evaluate_runs(spark, sf):
    return rules.evaluate(fact(spark, sf, "validations"), fact(spark, sf, "runs"))


@_Q.add("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) AS x WHERE rank <= 5")
def recent_changes(spark, sf):
    return logs.recent(select(spark, sf, "SELECT o_custkey, o_orderkey AS commit_hash, o_orderdate AS committed_at FROM orders"), "o_custkey").select("o_custkey", F.col("commit_hash").alias("o_orderkey"), "rank")


@_Q.add("SELECT l_orderkey AS commit_hash, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' ELSE 'N' END AS label FROM lineitem GROUP BY 1")
def history_precedence(spark, sf):
    return logs.merged_history(select(spark, sf, "SELECT l_returnflag AS label, l_orderkey AS commit_hash, l_shipdate AS committed_at FROM lineitem"), ["R", "A", "N"]).select("commit_hash", "label")


@_Q.add("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, concat('E', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) AS label FROM lineitem")
def number_evidence(spark, sf):
    rows = select(spark, sf, "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
    return facts_of.numbered(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@_Q.add("SELECT o_custkey, string_agg(text, chr(10) || chr(10) ORDER BY o_orderstatus) AS report FROM (SELECT o_custkey, o_orderstatus, concat('## ', o_orderstatus, chr(10), string_agg(concat('- ', o_orderpriority), chr(10) ORDER BY o_orderkey)) AS text FROM orders GROUP BY 1, 2) AS x GROUP BY 1")
def render_reports(spark, sf):
    return facts_of.report(select(spark, sf, "SELECT o_custkey, o_orderstatus AS section_no, o_orderstatus AS title, o_orderkey AS ord, o_orderpriority AS line FROM orders"), "o_custkey")


QUERIES, ORACLE_SQL = _Q.queries, _Q.sql
