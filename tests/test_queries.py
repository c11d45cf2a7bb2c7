"""Every registered query against its SQL, run by DuckDB on the same tables."""

import duckdb
import pytest

from factloom.plans.facts import TABLES
from factloom.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(names, found):
    return names, sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    said = db.sql(ORACLE_SQL[name])
    got = rows(names, df.select(*names).collect())
    assert got == rows(sorted(said.columns), said.select(*(f'"{c}"' for c in sorted(said.columns))).fetchall())
    assert got[1]


def test_nearest_of_each_ties_and_blocks(spark, monkeypatch):
    """Several blocks of queries and batches of rows give the k best of each query, ties by id; zero and null vectors are never found."""
    from factloom.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROWS", 4)
    data = [(i, [1.0, float(i % 3), 0.5] if i % 7 else [0.0, 0.0, 0.0] if i else None) for i in range(40)]
    vectors = spark.createDataFrame(data, "vec_id long, v array<float>").repartition(3)
    got = {(r["query_id"], r["place"]): r["vec_id"] for r in retrieval.nearest_of_each(vectors, vectors.where("vec_id % 5 = 0"), 4, "vec_id", "v").collect()}
    full = [i for i, v in data if v and any(v)]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(q, n + 1): i for q in full if q % 5 == 0 for n, i in enumerate(sorted(full, key=lambda i: (-round(cosine(data[q][1], data[i][1]), 9), i))[:4])}
    assert got == want


def test_bounded_text_cuts_inside_characters(spark):
    from pyspark.sql import functions as F

    from factloom.functions.columns import bounded_text

    texts = [None, "", "é" * 30, *("a" * i + c * 40 + "z" * j for c in "é日🎉" for i in range(4) for j in range(4))]

    def brute(t):
        data = (t or "").encode()
        if t is None or len(data) <= 40:
            return t
        return data[:10].decode("utf-8", "replace") + f"\n[... {len(data) - 40} bytes truncated ...]\n" + data[-30:].decode("utf-8", "replace")

    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {r["i"]: r["b"] for r in docs.select("i", bounded_text(F.col("text"), 40).alias("b")).collect()} == dict(enumerate(map(brute, texts)))
