"""Scalar functions and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import retrieval, vector_index
from .facts import fact, select
from .register import Queries

_Q = Queries()
_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
_WORDS = f"SELECT doc_id, w FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][a-z]*|[0-9]+'))) AS w FROM documents) AS x WHERE length(w) > 1 AND w NOT IN ({_STOP})"


@_Q.add(f"WITH w AS ({_WORDS}), c AS (SELECT doc_id AS id, CAST(CAST(('0x' || right(md5(w), 3)) AS INT) % 1024 AS INT) AS bucket, count(*) AS c FROM w GROUP BY 1, 2) SELECT id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY id)), 6) AS weight FROM c")
def hash_embed(spark, sf):
    docs = select(spark, sf, "SELECT doc_id AS id, text FROM documents")
    return retrieval.hashed_vectors(docs).withColumn("weight", F.round("weight", 6))


@_Q.add(f"SELECT doc_id, count(*) AS n, count(DISTINCT w) AS n_distinct FROM ({_WORDS}) AS x GROUP BY 1")
def identifier_words(spark, sf):
    docs = select(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", C.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return docs.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@_Q.add("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 5) AS x WHERE score >= 0.15")
def knn_cosine(spark, sf):
    vectors = select(spark, sf, "SELECT vec_id, embedding FROM embeddings")
    query = vectors.orderBy("vec_id").select(F.col("embedding").cast("array<double>")).first()[0]
    return retrieval.nearest(vectors, F.lit(query), 5, "vec_id", "embedding", retrieval.MIN_SCORE).withColumn("score", F.round("score", 6))


@_Q.add("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s WHERE score > 0) SELECT query_id, place, vec_id, round(score, 6) AS score FROM t WHERE place <= 5 AND score >= 0.15")
def knn_cosine_of_each(spark, sf):
    vectors = select(spark, sf, "SELECT vec_id, embedding FROM embeddings")
    found = retrieval.nearest_of_each(vectors, vectors.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", retrieval.MIN_SCORE)
    return found.withColumn("score", F.round("score", 6))


@_Q.add("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s WHERE score > 0) SELECT query_id, place, vec_id, round(score, 6) AS score FROM t WHERE place <= 5 AND score >= 0.15")
def knn_index_all_cells(spark, sf):
    """The inverted file with all its cells probed: the exact result."""
    vectors = select(spark, sf, "SELECT vec_id, embedding FROM embeddings")
    index = vector_index.VectorIndex(vectors, "vec_id", "embedding")
    return index.nearest(vectors.where("vec_id % 50 = 0"), "embedding", 5, index.cells, retrieval.MIN_SCORE).withColumn("score", F.round("score", 6))


@_Q.add("SELECT key, round(sum(1.0 / (60 + rank)), 6) AS score, min(list) AS first_list FROM ranked_lists GROUP BY key")
def rrf_scores(spark, sf):
    return retrieval.fuse(fact(spark, sf, "ranked_lists"), None).select("key", F.round("score", 6).alias("score"), "first_list")


@_Q.add("SELECT nation, place, key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, f) AS place FROM (SELECT nation, key, sum(1.0 / (60 + rank)) AS score, min((list, rank)) AS f FROM ranked_lists GROUP BY 1, 2) AS x) AS y WHERE place <= 5")
def rrf_fuse(spark, sf):
    return retrieval.fuse(fact(spark, sf, "ranked_lists"), 5, ["nation"]).select("nation", "place", "key", F.round("score", 6).alias("score"))


@_Q.add("WITH t AS (SELECT c_custkey, [c_mktsegment, n_name, lower(c_mktsegment), c_name, ' ', upper(n_name)] AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), e AS (SELECT c_custkey, unnest(range(6)) AS pos, unnest(t) AS term FROM t) SELECT c_custkey, CAST(min(pos) AS INT) AS pos, arg_min(term, pos) AS term FROM e WHERE trim(term) <> '' GROUP BY c_custkey, lower(term)")
def dedupe_terms(spark, sf):
    rows = select(spark, sf, "SELECT c_custkey, array(c_mktsegment, n_name, lower(c_mktsegment), c_name, ' ', upper(n_name)) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey")
    return retrieval.terms(rows, "c_custkey", "t")


@_Q.add("SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'new' ELSE 'old' END AS version, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN label % 2 = 0 THEN -x ELSE x END)[3] AS third FROM embeddings WHERE label % 3 <> 0 OR label % 2 = 0")
def vector_upsert(spark, sf):
    """Stored vectors of two thirds of the labels; a batch that has the even labels' vectors twice, the last time negated."""
    old = select(spark, sf, "SELECT vec_id AS id, 'old' AS version, CAST(embedding AS ARRAY<DOUBLE>) AS v FROM embeddings WHERE label % 3 <> 0")
    new = select(spark, sf, "SELECT vec_id AS id, CASE WHEN n = 1 THEN 'new' ELSE 'newer' END AS version, transform(CAST(embedding AS ARRAY<DOUBLE>), x -> CASE WHEN n = 1 THEN -x ELSE 0D END) AS v, -n AS ord FROM (SELECT vec_id, label, embedding, explode(array(1, 2)) AS n FROM embeddings) AS x WHERE label % 2 = 0")
    return retrieval.upsert_vectors(old, new).select("id", "version", F.col("v")[2].alias("third"))


@_Q.add(
    # what the lines of `requirements` were made of, case by case
    """SELECT p_partkey AS k, CASE WHEN p_size % 10 IN (2, 3, 5, 7, 8, 9) THEN lower(replace(p_name, ' ', '-')) END AS name,
    CASE p_size % 10 WHEN 2 THEN concat('>=', p_size) WHEN 3 THEN concat('==', p_size) WHEN 7 THEN '@https://host/x' WHEN 5 THEN '' WHEN 8 THEN '' WHEN 9 THEN '' END AS spec FROM part"""
)
def requirement_parse(spark, sf):
    return fact(spark, sf, "requirements").select("k", C.requirement(F.col("line")).alias("r")).select("k", "r.name", "r.spec")


_MODULES = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat(lower(p_type), '/__init__.py') WHEN p_size % 3 = 1 THEN concat(lower(p_type), '/', replace(p_name, ' ', '_'), '.py') ELSE '__init__.py' END AS path FROM part"


@_Q.add(rf"SELECT p_partkey, replace(CASE WHEN path = '__init__.py' THEN '' WHEN path LIKE '%/__init__.py' THEN left(path, length(path) - 12) ELSE left(path, length(path) - 3) END, '/', '.') AS module FROM ({_MODULES}) AS x")
def module_names(spark, sf):
    rows = select(spark, sf, _MODULES)
    return rows.select("p_partkey", C.module_name(F.col("path")).alias("module"))


@_Q.add(
    """WITH p AS (SELECT p_partkey, p_size % 5 AS k, lower(p_type) AS a, split_part(p_name, ' ', 1) AS b, split_part(p_name, ' ', 2) AS c FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN concat_ws('.', a, b, c) WHEN 1 THEN a WHEN 2 THEN concat(c, '.y') WHEN 3 THEN concat(c, '.path') END AS module FROM p"""
)
def relative_imports(spark, sf):
    """Imports in files two folders deep: of a sibling, of the folder above, of the root, by a whole name, and beyond the root."""
    rows = select(spark, sf, "SELECT p_partkey, concat(lower(p_type), '/', split_part(p_name, ' ', 1), '/c.py') AS path, split_part(p_name, ' ', 2) AS c, p_size % 5 AS k FROM part")
    module = F.when(F.col("k") == 0, F.concat(F.lit("."), "c")).when(F.col("k") == 1, F.lit("..")).when(F.col("k") == 2, F.concat(F.lit("..."), "c", F.lit(".y"))).when(F.col("k") == 3, F.concat("c", F.lit(".path"))).otherwise(F.concat(F.lit("...."), "c"))
    return rows.select("p_partkey", C.absolute_module(F.col("path"), module).alias("module"))


_PATHS = "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN concat('src/test_', replace(p_name, ' ', '_'), '.py') WHEN p_size % 4 = 1 THEN concat(replace(p_name, ' ', '_'), '_test.py') WHEN p_size % 4 = 2 THEN concat('pkg/tests/', replace(p_name, ' ', '/'), '.py') ELSE concat('latest/', replace(p_name, ' ', '_'), '/contest.py') END AS path FROM part"


@_Q.add(f"SELECT p_partkey, len(list_intersect(string_split(path, '/')[:-2], ['test', 'tests'])) > 0 OR split_part(path, '/', -1) LIKE 'test\\_%' ESCAPE '\\' OR path LIKE '%\\_test.py' ESCAPE '\\' AS is_test FROM ({_PATHS}) AS x")
def test_paths(spark, sf):
    rows = select(spark, sf, _PATHS)
    return rows.select("p_partkey", C.is_test_path(F.col("path")).alias("is_test"))


_BOUNDED = r"""WITH h AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents), c AS (SELECT doc_id, text, octet_length(encode(text)) AS n, regexp_replace(left(h, 200), '^((?:..)*?)(?:[CDEF].|E.[89AB].|F.[89AB].|F.[89AB].[89AB].)$', '\1EFBFBD') AS head, right(h, 600) AS t, length(regexp_extract(right(h, 600), '^(?:[89AB].)*')) AS cut FROM h)
    SELECT doc_id, octet_length(encode(b)) AS n_bytes, md5(b) AS md5 FROM (SELECT doc_id, CASE WHEN n <= 400 THEN text ELSE concat(decode(unhex(head)), chr(10), '[... ', n - 400, ' bytes truncated ...]', chr(10), decode(unhex(concat(repeat('EFBFBD', CAST(cut / 2 AS INT)), substr(t, cut + 1))))) END AS b FROM c) AS x"""


@_Q.add(f"SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes FROM ({_BOUNDED}) AS x")
def bounded_texts(spark, sf):
    return bounded_texts_of_all(spark, sf).select("doc_id", "n_bytes")


@_Q.add(_BOUNDED)
def bounded_texts_of_all(spark, sf):
    rows = select(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", C.bounded_text(F.col("text"), 400).alias("b"))
    return rows.select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), F.md5("b").alias("md5"))


@_Q.add("SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages")
def url_hosts(spark, sf):
    return select(spark, sf, "SELECT page_id, url FROM pages").select("page_id", C.url_host(F.col("url")).alias("host"))


_IMAGES = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('registry.io/', lower(p_type), '/Postgres:', CAST(p_size AS STRING)) WHEN p_size % 3 = 1 THEN 'mongo@sha256' ELSE 'redis:7' END AS image FROM part"


@_Q.add(f"SELECT p_partkey, nullif(regexp_extract(lower(split_part(image, '/', -1)), '^(postgres|mysql|mariadb|mongo|neo4j)([:@].*)?$', 1), '') AS engine FROM ({_IMAGES}) AS x")
def database_engines(spark, sf):
    rows = select(spark, sf, _IMAGES)
    return rows.select("p_partkey", C.database_engine(F.col("image")).alias("engine"))


@_Q.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def embedded_json(spark, sf):
    rows = select(spark, sf, "SELECT event_id, concat('Answer: ', props, ' done') AS text FROM events")
    return rows.select("event_id", F.get_json_object(C.outer_json(F.col("text")), "$.k").cast("long").alias("k"))


QUERIES, ORACLE_SQL = _Q.queries, _Q.sql
