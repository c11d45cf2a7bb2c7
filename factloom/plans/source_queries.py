"""Calls of parsed sources, tests by their names, hashes of revisions, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import facts as facts_of
from ..operators import impact, snapshot
from .facts import fact, select
from .graph_queries import _entities, _rels
from .register import Queries

_Q = Queries()

#: Calls of three kinds: of a method of the own class, of a bare name, of a name of a module; imports of names and of modules.
_CALLS = "SELECT DISTINCT concat(CAST(l_suppkey AS STRING), '/', CAST(l_partkey AS STRING), '/', l_returnflag) AS row, l_suppkey AS s, l_partkey AS p, l_returnflag AS kind, concat('pkg/m', CAST(l_suppkey % 40 AS STRING), '.py') AS file_path, concat('C', CAST(l_suppkey AS STRING)) AS class_name, CASE WHEN l_returnflag = 'R' THEN 'self' WHEN l_returnflag = 'N' THEN concat('m', CAST(l_partkey % 45 AS STRING)) END AS base, CASE WHEN l_returnflag = 'R' THEN concat('run', CAST(l_partkey % 9 AS STRING)) ELSE concat('f', CAST(l_partkey AS STRING)) END AS attr FROM lineitem"
_NAMED = "SELECT DISTINCT concat('pkg/m', CAST(l_suppkey % 40 AS STRING), '.py') AS file_path, concat('pkg.m', CAST(l_partkey % 40 AS STRING)) AS module, concat('f', CAST(l_partkey AS STRING)) AS name, l_partkey AS ord FROM lineitem WHERE l_quantity > 30"
_PLAIN = "SELECT DISTINCT concat('pkg/m', CAST(l_suppkey % 40 AS STRING), '.py') AS file_path, concat('pkg.m', CAST(l_partkey % 45 AS STRING)) AS name, concat('m', CAST(l_partkey % 45 AS STRING)) AS alias, l_partkey % 45 AS ord FROM lineitem WHERE l_quantity > 35 AND l_partkey % 4 < 3"


@_Q.add(
    f"""WITH c AS ({_CALLS}), i AS ({_NAMED}), m AS ({_PLAIN}), j AS (SELECT c.*, k.name IS NOT NULL AS own, f.name IS NOT NULL AS here, i.name IS NOT NULL AS brought, m.name AS module FROM c LEFT JOIN src_methods k ON k.file_path = c.file_path AND k.class_name = c.class_name AND k.name = c.attr
    LEFT JOIN src_functions f ON f.file_path = c.file_path AND f.name = c.attr LEFT JOIN i ON i.file_path = c.file_path AND i.name = c.attr LEFT JOIN m ON m.file_path = c.file_path AND m.alias = c.base)
    SELECT row, CASE WHEN kind = 'R' THEN concat(CASE WHEN own THEN class_name ELSE 'self' END, '.', attr) WHEN kind = 'A' THEN CASE WHEN here OR NOT brought THEN attr ELSE concat('pkg.m', p % 40, '.', attr) END ELSE concat(coalesce(module, base), '.', attr) END AS target,
    CASE WHEN kind = 'R' AND own THEN 'self' WHEN kind = 'A' AND here THEN 'file' WHEN kind = 'A' AND brought THEN 'import' WHEN kind = 'N' AND module IS NOT NULL AND p % 40 = p % 45 THEN 'module' END AS rule,
    (kind = 'R' AND own) OR (kind = 'A' AND (here OR brought)) OR (kind = 'N' AND module IS NOT NULL AND p % 40 = p % 45) AS resolved FROM j"""
)
def call_resolution(spark, sf):
    calls = select(spark, sf, _CALLS).withColumn("raw", F.col("attr"))
    named = select(spark, sf, _NAMED).withColumn("alias", F.lit(None).cast("string"))
    imports = named.unionByName(select(spark, sf, _PLAIN).withColumn("module", F.lit(None).cast("string")))
    out = facts_of.resolve_calls(calls, imports, fact(spark, sf, "src_classes"), fact(spark, sf, "src_methods"), fact(spark, sf, "src_functions"))
    return out.select("row", "target", "rule", "resolved")


_TESTS = "SELECT DISTINCT concat(CASE WHEN p_size % 3 = 0 THEN 'tests/' ELSE 'src/' END, lower(p_brand), '.py') AS path, concat('test_', replace(p_name, ' ', '_'), CAST(p_size AS STRING)) AS name, p_size FROM part"


@_Q.add(f"WITH t AS ({_TESTS}), n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS target FROM part WHERE p_size > 10) SELECT DISTINCT path, name, target FROM t JOIN n ON target <> '' AND contains(name, target) WHERE path LIKE 'tests/%' AND (path, name) NOT IN (SELECT (path, name) FROM t WHERE p_size % 4 = 0)")
def naming_convention_tests(spark, sf):
    tests = select(spark, sf, _TESTS)
    targets = select(spark, sf, "SELECT split_part(p_name, ' ', 2) AS name FROM part WHERE p_size > 10")
    return impact.naming_convention_tests(tests.select("path").distinct(), tests.select("path", "name"), targets, tests.where("p_size % 4 = 0").select("path", "name"))


def _json(pairs: str) -> str:
    return f"concat('[', {pairs}, ']')"


_ENTRY = "concat('{{\"key\":\"{0}\",\"value\":\"', {0}, '\"}}')"
_HASH_SQL = f"""h AS (SELECT revision, sha256(concat('{{"col1":"e","key":"', key, '","entity_type":"', entity_type, '","name":"', name, '","col5":', {_json(f"{_ENTRY.format('method')}, ',', {_ENTRY.format('path')}")}, ',"col6":', {_json(_ENTRY.format('handler'))}, '}}')) AS h FROM revision_entities
UNION ALL SELECT revision, sha256(concat('{{"col1":"r","rel_type":"', rel_type, '","source":"', source, '","target":"', target, '","col5":', {_json(_ENTRY.format('version'))}, '}}')) FROM revision_rels),
b AS (SELECT revision, substring(h, 1, 2) AS bucket, count(*) AS n, {', '.join(f"sum(CAST(concat('0x', substring(h, {3 + 15 * i}, 15)) AS UBIGINT)::HUGEINT) AS s{i}" for i in range(4))} FROM h GROUP BY 1, 2)"""


@_Q.add(f"WITH {_HASH_SQL} SELECT revision, sha256(string_agg(concat_ws(':', bucket, n, s0, s1, s2, s3), ';' ORDER BY concat_ws(':', bucket, n, s0, s1, s2, s3))) AS hash FROM b GROUP BY revision")
def revision_hashes(spark, sf):
    of = lambda r: snapshot.content_hash(_entities(spark, sf, r), _rels(spark, sf, r)).select(F.lit(r).alias("revision"), "hash")
    return of("old").unionByName(of("new"))


@_Q.add("SELECT key, name, method, path FROM (SELECT key, name, method, path FROM revision_entities WHERE revision = 'new' AND entity_type = 'API') AS x")
def entities_of_type(spark, sf):
    return snapshot.of_type(_entities(spark, sf, "new"), "API").select("key", "name", F.col("properties")["method"].alias("method"), F.col("properties")["path"].alias("path"))


@_Q.add("SELECT c_custkey, concat(c_name, ' of ', n_name, ' buys in ', c_mktsegment, '; ', c_name, ' {is} known') AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def filled_templates(spark, sf):
    rows = select(spark, sf, "SELECT c_custkey, c_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")
    values = F.create_map(F.lit("c.name"), "c_name", F.lit("nation"), "n_name", F.lit("segment_1"), "c_mktsegment", F.lit("is"), F.lit("{is}"))
    return rows.select("c_custkey", C.filled(F.lit("{c.name} of {nation} buys in {segment_1}; {c.name} {is} known"), values).alias("text"))


@_Q.add("SELECT min(concat('repo-', r_name)) AS repository FROM region")
def same_repository(spark, sf):
    side = lambda: select(spark, sf, "SELECT min(concat('repo-', r_name)) AS repository FROM region")
    return snapshot.same_repository(side(), side())


QUERIES, ORACLE_SQL = _Q.queries, _Q.sql
