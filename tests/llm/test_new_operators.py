"""Filter audit, resampling and suffix dedup against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import filter_audit, suffix_dedup, target_resample
from factloom.llm.queries import QUERIES

from .fixtures import odd_documents, odd_texts


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def failing(rows):
    """rows (doc_id, text, part): the set of failed letters of each."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any((o or "") == t and (i is not None and (doc_id is None or i < doc_id)) for i, o, _ in rows)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller]
        out.append({c for c, f in zip("ABCDE", tests, strict=True) if f})
    return out


def audit_by_definition(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts, fails = defaultdict(list), failing(rows)
    for (doc_id, _, part), f in zip(rows, fails, strict=True):
        parts[part or ""].append((doc_id, f))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                removed = [d for d in left if c in d[1]]
                gone = [d for d in docs if c in d[1] and set(order[: step - 1]) & d[1]]
                left = [d for d in left if c not in d[1]]
                shapley[c] += len(removed)
                alone = [d for d in docs if d[1] == {c}]
                out[part, "".join(order), step] = [len(left), len(removed), len(gone), len(alone), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed)]
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[c])
    return out


FIELDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit_on_odd_documents(spark):
    texts = odd_texts() + ["A B c", "a#b", "word " * 250, "same same " * 200]
    rows = [(i % 50, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(texts)] + [(None, None, "s1"), (None, "one", "s1"), (None, "one", "s2"), (3, "one", None), (3, "one", None)]
    labels = [(i, i % 2, (i + 1) % 3 % 2) for i in range(0, 60, 2)] + [(4, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n int, mask int").repartition(4)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[f] for f in FIELDS] for r in filter_audit.filter_audit(docs, said).collect()}
    assert got == audit_by_definition(rows, labels)
    assert filter_audit.filter_audit(docs.limit(0), said).count() == 0


def test_filter_audit_has_no_python_and_shuffles_no_text(spark, sf):
    plan = filter_audit.mask_cells(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_filter_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (2, "bb", "p"), (3, "a", "p")], "doc_id long, text string, source string")
    out = filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), lambda t: {"L": F.length(t) > 1}, "X")
    assert sorted((r["filter_order"], r["step"], r["removed"], r["kept"]) for r in out.collect()) == [("LX", 1, 1, 2), ("LX", 2, 1, 1), ("XL", 1, 1, 2), ("XL", 2, 1, 1)]


def resample_by_definition(rows, target, percent=10, least=20, max_words=1):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for doc_id, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i for i, r in enumerate(order[: percent * len(order) // 100], 1)}
    return Counter((*r[:4], drawn.get(id(r))) for r in out)


@pytest.mark.parametrize("max_words", [1, 2, 3])
def test_resample(spark, sf, max_words):
    rows = list(enumerate(odd_texts())) + [(r["doc_id"] + 1000, r["text"]) for r in documents(spark, sf).collect()] + [(None, "a b " * 30), (5, "twice " * 40), (5, "twice " * 40), (6, "é9é É ñandú_x" * 9)]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, weight int, row int, score int").repartition(5)
    out = target_resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_words=max_words)
    assert Counter(map(tuple, out.select("doc_id", "n_features", "weight", "score", "rank").collect())) == resample_by_definition(rows, target, max_words=max_words)


def test_resample_edges(spark, sf):
    docs = odd_documents(spark)
    empty = docs.limit(0)
    assert target_resample.resample(empty, docs).count() == 0
    assert target_resample.resample(docs, empty).count() == docs.count()
    assert target_resample.resample(docs, empty, percent=100, least_words=0).where("rank is null").count() == 0
    same = spark.createDataFrame([(1, "word " * 30)] * 500, "doc_id long, text string").repartition(6)
    assert sorted(r["rank"] for r in target_resample.resample(same, docs, percent=50).collect() if r["rank"]) == list(range(1, 251))


def test_resample_prefers_the_target(spark, sf):
    """A feature of texts made of benchmark words gains more than nearly all other documents' features do."""
    words = " ".join(r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(3).collect())
    docs = documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame([(10_000, words)], "doc_id long, text string"))
    gain = {r["doc_id"]: r["weight"] / max(1, r["n_features"]) for r in target_resample.resample(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert sum(g >= gain[10_000] for g in gain.values()) <= len(gain) / 10


def repeats_by_definition(rows, length, keep):
    """rows (doc_id, text): the removed bytes of each, by a table of all strings."""
    raw = [(t or "").encode() for _, t in rows]
    places = defaultdict(list)
    for i, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((i, p))
    gone = [np.zeros(len(b), bool) for b in raw]
    for at in places.values():
        at.sort()
        for i, p in at if keep == "none" and len(at) > 1 else at[1:]:
            gone[i][p : p + length] = True
    return gone


def check_repeats(spark, rows, length, keep):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, mark int").repartition(5)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, length, keep).collect()}
    assert len(got) == len(rows)
    for (i, t), gone in zip(rows, repeats_by_definition(rows, length, keep), strict=True):
        raw, r = (t or "").encode(), got[i]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2).tolist()
        assert r["n_bytes"] == len(raw)
        assert [[s["start"], s["end"]] for s in r["spans"]] == edge, i
        assert bytes(r["kept"]) == np.frombuffer(raw, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("length", [5, 50, 200, 203])
def test_suffix_dedup(spark, length, keep):
    rng = np.random.default_rng(length)
    say = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared, line = say(700), say(length)
    texts = [t for t in odd_texts() if t is None or len(t) < 60_000][:40] + ["a" * 3000, "ab" * 1500, say(180) + "abcdefghijklmno" * 24 + say(90), "x" + "a" * (length - 1), "a" * length, line, line[:-1], say(300) + shared + say(300), shared[:450] + say(90) + shared[200:], say(100) + shared[100:500], shared[300:300 + length] + "é", say(40) + line + say(30), line + line]
    check_repeats(spark, list(enumerate(texts)), length, keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup_by_windows_and_pieces(spark, monkeypatch, keep):
    """The ways for minimisers with too many bytes and for very long texts give the same."""
    monkeypatch.setattr(suffix_dedup, "ORDER_BYTES", 900)
    rng = np.random.default_rng(1)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = say(80)
    rows = [(i, say(150) + line + say(150)) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:330] + say(20)) for i in range(20)] + [(200, say(400) + rows[3][1] + rows[4][1])]
    check_repeats(spark, rows, 200, keep)
    monkeypatch.undo()
    raw = np.frombuffer((say(5000) + "b" * 3000 + say(2000)).encode(), np.uint8)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    starts = np.zeros(len(raw), int)
    for part, offsets, _, base in suffix_dedup._pieces(raw, np.array([0, len(raw)]), 200):
        _, start, many, *_ = suffix_dedup.segments(part, offsets, 200)
        for s, n in zip(start.tolist(), many.tolist(), strict=True):
            starts[base + s : base + s + n] += 1
    assert starts[: len(raw) - 199].tolist() == [1] * (len(raw) - 199) and not starts[len(raw) - 199 :].any()


def test_suffix_dedup_edges(spark):
    docs = odd_documents(spark)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    text = "".join(np.random.default_rng(2).choice(list("abcdef"), 900))
    rows = spark.createDataFrame([(None, text), (7, text), (7, text), (8, "short"), (None, None)], "doc_id long, text string")
    told = lambda keep: sorted((r["doc_id"] or 0, r["n_bytes"], len(r["kept"])) for r in suffix_dedup.remove_repeats(rows, keep=keep).collect())
    assert told("none") == [(0, 0, 0), (0, 900, 0), (7, 900, 0), (7, 900, 0), (8, 5, 5)]
    assert told("first") == [(0, 0, 0), (0, 900, 0), (7, 900, 900), (7, 900, 900), (8, 5, 5)]
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(rows, keep="last")


def test_suffix_dedup_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    got = {r["doc_id"]: r for r in QUERIES["op13_suffix_dedup"](spark, sf).collect()}
    for (i, t), gone in zip(rows, repeats_by_definition(rows, 200, "none"), strict=True):
        kept = np.frombuffer((t or "").encode(), np.uint8)[~gone].tobytes()
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
