"""Joins by an automaton, by dyadic blocks and by dominance, against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import asof, logs, needles, resolve


def test_substring_hits(spark, monkeypatch):
    """Several blocks of needles and overlapping needles give what `in` says, each once a row."""
    monkeypatch.setattr(needles, "NEEDLES", 7)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé.*\\🎉") for _ in range(n))
    wanted = [None, "", "a", "aa", "aaa", *(word(rng.randint(1, 4)) for _ in range(40))]
    texts = [None, "", "aaaa", "a" * 1000, *(word(rng.randint(0, 60)) for _ in range(60))]
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "row int, text string, extra int").repartition(4)
    got = sorted((r["row"], r["extra"], r["x"]) for r in needles.substring_hits(rows, "text", spark.createDataFrame([(w,) for w in wanted], "x string"), "x").collect())
    assert got == sorted((i, i % 3, w) for i, t in enumerate(texts) for w in set(wanted) - {None, ""} if t is not None and w in t)
    none = spark.createDataFrame([], "x string")
    assert needles.substring_hits(rows, "text", none, "x").count() == 0 == needles.substring_hits(rows.limit(0), "text", none, "x").count()


def test_correlate_all(spark):
    """Thousands of failures: first rule wins, empty and null parts tie nothing, no failure is a literal of the plan."""
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    stamp = lambda s: (at + datetime.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [(i, f"{stamp(i * 3) if i % 4 else ''} trace_id=t{i} failure number{i * 7 % 50} in m{i}.py done{i}") for i in range(150)] + [(900, None), (901, "")]
    fails = [(i, f"t{i}" if i % 5 == 0 else None, at + datetime.timedelta(seconds=i * 3) if i % 7 == 0 else None, f"number{i}" if i % 3 == 0 else "", f"failure number{i % 50} in" if i % 4 == 0 else None, f"src/m{i}.py" if i % 11 == 0 else "src/", f"Orders.done{i}" if i % 13 == 0 else None) for i in range(3000)]
    schema = "failure_id int, correlation_id string, ts timestamp, exception_type string, message string, file_path string, qualified_name string"
    found = logs.correlate_all(spark.createDataFrame(lines, "log_id int, raw string").repartition(3), spark.createDataFrame(fails, schema), 5)
    want = set()
    for f, cid, ts, kind, message, path, name in fails:
        parts = [("exception_type", kind), ("exception_message", message), ("file_path", path.rpartition("/")[2]), ("method", name and name.rpartition(".")[2])]
        for k, raw in lines[:150]:
            own = at + datetime.timedelta(seconds=k * 3) if k % 4 else None
            rule = "correlation_id" if cid == f"t{k}" else "timestamp_window" if ts and own and abs((ts - own).total_seconds()) <= 5 else next((r for r, x in parts if x and x in raw), None)
            if rule:
                want.add((f, k, rule))
    assert {tuple(r) for r in found.collect()} == want and {r for _, _, r in want} == set(logs.RULES)
    assert "number1500" not in found._jdf.queryExecution().toString()
    one = dict(zip(["correlation_id", "ts", "exception_type", "message", "file_path", "qualified_name"], fails[0][1:], strict=True))
    assert {tuple(r) for r in logs.correlate(spark.createDataFrame(lines, "log_id int, raw string"), one).collect()} == {(k, r) for f, k, r in want if f == 0}


def test_dyadic_blocks(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.randint(-1, 300)) for a in (rng.randint(-200, 200) for _ in range(300))] + [(0, 0), (-1, 0), (5, 4), (0, 2**40 - 1), (-(2**40) - 7, 2**40 + 9), (1, 10**9)]
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "i int, a long, b long").select("i", resolve.dyadic_blocks(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        a, b = spans[r["i"]]
        parts = sorted((x["block"] << x["level"], (x["block"] + 1) << x["level"]) for x in r["x"])
        assert len(parts) <= 2 * max(b - a + 1, 1).bit_length()
        assert (not parts and a > b) or (parts[0][0] == a and parts[-1][1] == b + 1)
        assert all(p[1] == q[0] for p, q in zip(parts, parts[1:], strict=False))


def test_innermost_of_long_spans(spark):
    rng = random.Random(3)
    spans = [("f", a, a + rng.choice([0, 3, 10**4, 10**9]), f"s{i}") for i, a in enumerate(rng.randint(-(10**6), 10**9) for _ in range(200))] + [("f", 5, 4, "empty"), (None, 0, 9, "no file"), ("g", None, 9, "no start"), ("g", 1, 10, "b"), ("g", 1, 10, "a"), ("g", 1, 12, "wide")]
    points = [(i, "f", rng.choice([s[1] for s in spans[:200]]) + rng.randint(-5, 5)) for i in range(300)] + [(400, "g", 10), (401, "g", 12), (402, "g", 13), (403, None, 3), (404, "g", None), (405, "h", 1)]
    got = {r["row"]: (r["name"], r["first"], r["last"]) for r in resolve.innermost(spark.createDataFrame(points, "row int, file string, line long"), spark.createDataFrame(spans, "file string, first long, last long, name string"), "file").collect()}
    for i, file, line in points:
        around = [(a, -b, n) for f, a, b, n in spans if f == file is not None and None not in (a, line) and a <= line <= b]
        best = max(around, default=None)
        assert got[i] == ((best[2], best[0], -best[1]) if best else (None, None, None))


@pytest.mark.parametrize("seconds", [0, 1, 60])
def test_band(spark, seconds):
    rng = random.Random(seconds)
    at = datetime.datetime(2024, 1, 1)
    some = lambda n: [(i, at + datetime.timedelta(seconds=rng.randint(0, 300)) if i % 9 else None) for i in range(n)]
    a, b = some(50), some(70)
    got = sorted((r["row"], r["other"]) for r in resolve.band(spark.createDataFrame(a, "row int, ts timestamp"), spark.createDataFrame(b, "other int, ts timestamp"), seconds).collect())
    assert got == sorted((i, j) for i, s in a for j, t in b if s and t and abs((s - t).total_seconds()) <= seconds)


def above_by_definition(left, right):
    """The last right row not after each left row with a greater value, else the last one; of one time the smallest id is the last."""
    out = {}
    for row, k, t, v in left:
        before = [(s, -i, w) for j, s, w, i in right if j == k is not None and None not in (s, t) and s <= t]
        over = [x for x in before if None not in (x[2], v) and x[2] > v]
        best = max(over or before, default=None, key=lambda x: x[:2])
        out[row] = best and -best[1]
    return out


@pytest.mark.parametrize("copies", [1, 7])
def test_as_of_above(spark, monkeypatch, copies):
    """Keys of one to many rows, ties of time and value, nulls and NaN; ranges that split a key and stacks that are asked in several copies."""
    monkeypatch.setattr(asof, "ASKED", 200_000 if copies == 1 else 20)
    rng = random.Random(copies)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    value = lambda: rng.choice([None, float("nan"), *range(12), *range(12)])
    real = lambda v: None if v is None else float(v)
    left = [(i, key(), rng.choice([None, *range(400)]), real(value())) for i in range(700)]
    right = [(key(), rng.choice([None, *range(400)]), real(value()) if i % 40 else 50.0 - i / 40, i) for i in range(700)]
    got = asof.as_of_above(spark.createDataFrame(left, "row int, k string, t int, v double").repartition(3), spark.createDataFrame(right, "k string, t int, v double, id int").repartition(3), "k", "t", "v", [F.col("id")])
    clean = lambda rows, at: [tuple(None if j == at and x != x else x for j, x in enumerate(r)) for r in rows]
    assert {r["row"]: r["r_id"] for r in got.collect()} == above_by_definition(clean(left, 3), clean(right, 2)) and got.columns == ["row", "r_t", "r_v", "r_id"]
    none = spark.createDataFrame([], "k string, t int, v double, id int")
    assert asof.as_of_above(spark.createDataFrame(left, "row int, k string, t int, v double"), none, "k", "t", "v", [F.col("id")]).where("r_id is null").count() == 700


def test_as_of_above_is_linear_in_a_hot_key(spark):
    """60,000 rows of each side under one key: falling values keep all of them on the stacks; pairs would be 1.8e9."""
    n = 60_000
    right = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("t"), (n - F.col("id")).alias("v"), "id")
    left = spark.range(n).select(F.col("id").alias("row"), F.lit("k").alias("k"), (n + F.col("id")).alias("t"), F.col("id").alias("v"))
    got = asof.as_of_above(left, right, "k", "t", "v", [F.col("id")])
    # the last right row with n - id > row is id = n - row - 1
    assert got.where("r_id != 60000 - row - 1 or r_id is null").count() == 0 and got.count() == n
