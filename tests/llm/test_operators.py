"""Each operator against a brute-force version, on odd documents and on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, exact_dedup, language_id, licenses, lm_score, secrets, simhash, simhash_wide, token_counts, token_files
from factloom.llm.queries import ORACLE_SQL, QUERIES

from .fixtures import odd_documents, odd_texts

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def empty(spark):
    return odd_documents(spark).limit(0)


def shingles(text, k):
    w = words_of(lower(text))
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(text, k=3):
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf):
    own = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    texts = odd_texts() + own
    fp = [fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    want = {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fp, components(len(fp), links), strict=True))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(odd_documents(spark, texts)).collect()}
    assert got == want
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_simhash_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "zz yy")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.simhash_components(docs).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]


def test_simhash_overfull_buckets(monkeypatch):
    """Large buckets go on to finer ones, and no pair is lost."""
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 62, 40, np.uint64) & np.uint64(0xFFFFFFFFFFFFF000) | rng.integers(0, 1 << 12, 40, np.uint64))
    masks = simhash._masks(0, 3)
    assert len(masks) == 20 and all(m.bit_count() >= 30 for m in masks)
    for a in fp[:10]:
        b = int(a) ^ (1 << 3) ^ (1 << 40) ^ (1 << 63)
        assert any(int(a) & m == b & m for m in masks)


def test_simhash_small_buckets_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    fps = sorted({base ^ int(x) for x in rng.integers(0, 1 << 9, 300)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for size in (1024, 8):
        monkeypatch.setattr(simhash, "BUCKET", size)
        place = {f: i for i, f in enumerate(fps)}
        links = [(place[r["u"] % (1 << 64)], place[r["v"] % (1 << 64)]) for r in simhash.hamming_links(frame).collect()]
        assert components(len(fps), links) == want


def test_near_dedup_by_similarity(spark):
    texts = [t for t in odd_texts() if words_of(t or "")]
    sets = [set(shingles(t, 5)) for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.similar_components(odd_documents(spark, texts)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            similar = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if similar >= 0.85:
                assert got[i] == got[j], (i, j, similar)
            if similar == 0:
                assert got[i] != got[j]
    kept = {r["doc_id"] for r in simhash_wide.drop_similar(odd_documents(spark, texts)).collect()}
    assert kept == {i for i in got if got[i] == i}
    assert simhash_wide.drop_similar(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t, public_tokenizers.path("word_bpe_49k.json")


def test_token_files(spark, sf, tokenizer, tmp_path):
    t, path = tokenizer
    texts = odd_texts() + ["<|endoftext|> a", "A<|ENDOFTEXT|>b", "x.y...", "don't stop's", "Σίσυφος ΣΑΣ.", "İ,"] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want, start = {}, 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shards = token_files.write_token_files(odd_documents(spark, texts), lambda: token_files.ChunkEncoder(path), 1, 49_408, uri=str(tmp_path / "t"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(shards, 1).collect()}
    assert got == want
    none = token_files.write_token_files(empty(spark), lambda: token_files.ChunkEncoder(path), 1, 49_408, uri=str(tmp_path / "e"))
    assert none.count() == 0 and token_files.read_token_files(none, 1).count() == 0


def test_token_files_shards_and_repeats(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", (28, 1 << 30))
    t, path = tokenizer
    rows = [(i // 2, f"text {i % 5}") for i in range(30)] + [(None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shards = token_files.write_token_files(docs, lambda: token_files.ChunkEncoder(path), 1, 49_408, uri=str(tmp_path / "t"))
    assert shards.count() > 3
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(shards, 1).collect()), key=lambda x: x[0])
    assert [g[1] for g in got] == [None, *(i // 2 for i in range(30))]
    assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]


def test_token_files_of_one_repeated_id(spark, tokenizer, tmp_path, monkeypatch):
    """Rows of one doc_id, or of none, are dealt to several shards, and stand side by side all the same."""
    monkeypatch.setattr(token_files, "SHARD_BYTES", (200, 1 << 30))
    t, path = tokenizer
    rows = [(5 if i % 3 else None, f"text number {i}") for i in range(300)] + [(i, "one") for i in (1, 9)]
    shards = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), lambda: token_files.ChunkEncoder(path), 1, 49_408, uri=str(tmp_path / "t"))
    assert shards.count() > 10
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(shards, 1).collect())
    assert [g[1] for g in got] == [None] * 100 + [1] + [5] * 200 + [9]
    assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    crc = Counter((d, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, x in rows)
    assert Counter((g[1], g[3]) for g in got) == crc


def test_paths_without_a_scheme_are_the_default_file_systems(spark, tmp_path):
    assert token_files.qualified(spark, f"{tmp_path}/x") == f"file:{tmp_path}/x"
    assert token_files._store(f"file:{tmp_path}/x")[1] == token_files._store(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"


def test_token_counts(spark, tokenizer, monkeypatch):
    t, path = tokenizer
    monkeypatch.setattr(token_counts.scan_counts, "__defaults__", (7,))
    texts = odd_texts()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(odd_documents(spark, texts), lambda: token_files.ChunkEncoder(path), 49_407, 49_408).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert token_counts.token_counts(empty(spark), lambda: token_files.ChunkEncoder(path), 49_407, 49_408).count() == 0


def test_flat_file_without_closing_separator(spark, tmp_path):
    np.array([5, 9, 9, 4, 4, 4, 9, 3], "<u2").tofile(tmp_path / "a.bin")
    np.zeros(0, "<u2").tofile(tmp_path / "b.bin")
    files = token_counts.list_flat(spark, str(tmp_path), "<u2")
    for block in (1, 3, 100):
        got = sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in token_counts.scan_counts(files, 9, "<u2", block).collect())
        assert got == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 3, True), (3, 7, 1, False)]


def test_byte_bpe(spark, sf):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    alphabet = list("aA1'stmdrevl \n\t 　é.-_²五🎉́") + ["'re", "'s", "  "]
    texts = odd_texts() + ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(3000)] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(odd_documents(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        ids = np.array(enc.encode_ordinary(x or ""), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()), (i, (x or "")[:80])
    two = bpe.decode(bpe.encode(odd_documents(spark), path), path)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in two.collect()} == {i: x or "" for i, x in enumerate(odd_texts())}
    assert bpe.round_trip(empty(spark), path).count() == 0


def test_language_id(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    said = language_id.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(said) == docs.count()
    tested = [r for r in said if r["held_out"] and r["lang"] and re.search(r"[^\W\d_]{20}|(\w+\W+){8}", r["text"] or "")]
    assert sum(r["lang_pred"] == r["lang"] for r in tested) / len(tested) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in said)
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(odd_documents(spark)).collect()}
    for i, x in enumerate(odd_texts()):
        assert (odd[i] == "und") == (x is None or not any(c.isalpha() for c in x)), (i, x[:50] if x else x)
    assert language_id.language_id(empty(spark)).count() == 0
    untaught = language_id.language_id(odd_documents(spark, ["abc", None], (None,))).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}
    kept = language_id.keep_languages(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert {r["doc_id"] for r in kept.collect()} <= {i for i, p in odd.items() if p != "und"}


def expectation_maximised(p):
    """p: a column of estimates for each held-out token."""
    w = np.full(len(p), 1 / len(p))
    for _ in range(200):
        part = w[:, None] * p
        w = (part / part.sum(axis=0)).mean(axis=1)
    return w


def brute_lm(texts):
    """Counts by dictionaries, and weights by expectation-maximisation over single held-out tokens."""
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    toks = [[*words_of(lower(t)), None] for t in texts]
    c, pair, triple, n_docs = Counter(), Counter(), Counter(), 0
    steps = lambda t: zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False)
    for h, t in zip(held, toks, strict=True):
        if not h:
            n_docs += 1
            c.update(t)
            pair.update(zip(["<s>", *t], t, strict=False))
            triple.update(steps(t))
    n, v = sum(c.values()), len(c)
    of_one = lambda b: n_docs if b == "<s>" else c[b]
    of_two = lambda a, b: n_docs if b == "<s>" else pair[a, b]
    bucket = lambda k: min(24, math.ceil(math.log2(k + 1)))
    share = lambda x, k: x / k if k else 0

    def learned(parts, empty):
        cells, weights = defaultdict(list), {}
        for h, t in zip(held, toks, strict=True):
            if not h:
                for a, b, w in steps(t):
                    k, p = parts(a, b, w)
                    cells[bucket(k)].append(p)
        for k in range(25):
            weights[k] = expectation_maximised(np.array(cells[k]).T) if k in cells else weights.get(k - 1, np.array(empty))
        return weights

    below = lambda a, b, w: (of_one(b) - 1, (share(pair[b, w] - 1, of_one(b) - 1), (c[w] - 1) / max(n - 1, 1), 1 / (v + 1)))
    weights = learned(below, (0, 0.5, 0.5))

    def higher(a, b, w):
        k, p = below(a, b, w)
        return of_two(a, b) - 1, (share(triple[a, b, w] - 1, of_two(a, b) - 1), float(weights[bucket(k)] @ p))

    top = learned(higher, (0, 1))
    out = []
    for i, t in enumerate(toks):
        score = 0
        for a, b, w in steps(t):
            low = weights[bucket(of_one(b))] @ (share(pair[b, w], of_one(b)), c[w] / n, 1 / (v + 1))
            x = top[bucket(of_two(a, b))] if of_two(a, b) else (0, 1)
            score += math.log10(x[0] * share(triple[a, b, w], of_two(a, b)) + x[1] * low)
        out.append((held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), score))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_lm_score(spark, sf, monkeypatch, small):
    if small:  # several blocks, ranges, groups and buckets
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", 20_000)
        monkeypatch.setattr(lm_score, "BUCKET_CHARS", 30_000)
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in lm_score.lm_scores(odd_documents(spark, texts)).collect()}
    for i, (held, n, known, total, base, score) in enumerate(brute_lm(texts)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total), i
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=0.02, abs=0.1), i
    assert lm_score.lm_scores(empty(spark)).count() == 0


def test_lm_requests_grow_far_slower_than_blocks_times_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_CHARS", 8_000)
    rng = np.random.default_rng(3)
    rows = []
    for n in (200, 800):
        docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 150)), False) for i in range(n)], "doc_id long, text string, held boolean").coalesce(1)
        blocks = docs.mapInArrow(lambda it: lm_score._blocks(it, 4000), "block string, data binary").cache()
        routes = lm_score.Routes(sum(len(r["text"]) for r in docs.collect()))
        asked = blocks.mapInArrow(lm_score._asks(routes, lm_score.TRIPS[0]), "part int, block string, data binary").count()
        assert asked <= blocks.count() * routes.ranges and routes.groups * routes.buckets <= 2 * routes.buckets**1.5
        rows.append((blocks.count(), routes.buckets, asked))
    (b0, k0, a0), (b1, k1, a1) = rows
    assert b1 / b0 > 3.5 and k1 / k0 > 3.5 and a1 / a0 < 2.5 * b1 / b0  # blocks x buckets grow 16-fold


def test_lm_null_ids_and_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(held, "a b c"), (held, "a b c"), (held, None)], "doc_id long, text string")
    got = [tuple(r) for r in lm_score.lm_scores(docs).orderBy("n_tokens").collect()]
    assert [g[1:5] for g in got] == [(True, 1, 0, 0), (True, 4, 0, 0), (True, 4, 0, 0)] and all(g[6] == 0 for g in got)
    docs = spark.createDataFrame([(None, "a b a b"), (None, "a b a b"), (held, "a b")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_score.lm_scores(docs).collect()}
    assert got[held, 3]["n_known"] == 3 and got[None, 5]["train_tokens"] == 10 and got[None, 5]["score"] > got[None, 5]["base_score"]


def brute_secrets(text):
    text = text or ""
    spans = []
    for k, (kind, p, g, least) in enumerate((("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        spans += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text) if len(m.group(g)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]


def test_secrets(spark, sf):
    texts = odd_texts() + ["🎉 password = 'abcdefg' token=x secret:abcdef", "deadbeef" * 4, "AKIA" + "Z" * 16, "my Tok9enLikeValueWithoutAnyWord12345 here"] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    docs = odd_documents(spark, texts)
    path = docs.sparkSession.conf.get("spark.checkpoint.dir") + "/odd-documents"
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for r in secrets.op7_secrets(spark, path).collect():
        want = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r["spans"].split(","))
        if "Tok9en" in (texts[r["doc_id"]] or ""):
            assert "mixed:3:35" in r["spans"] or r["n_added"] == 1
    assert secrets.secrets(empty(spark)).count() == 0


def test_secret_ownership(spark):
    rows = [(i, f"token=shared{i % 2}value", f"owner{i}/repo") for i in range(6)] + [(9, "token=alone99", "a/x"), (10, "token=alone99", "a/y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: [(s["repos"], s["owners"], s["owned"]) for s in r["spans"]] for r in secrets.secrets(docs).collect()}
    assert got[0] == [(3, 3, False)] and got[9] == got[10] == [(2, 1, True)]
    docs = spark.createDataFrame([(i, "token=nobodys1", None) for i in range(3)], "doc_id long, text string, source string")
    assert {(s["repos"], s["owners"]) for r in secrets.secrets(docs).collect() for s in r["spans"]} == {(3, 3)}  # each null is a repository of its own


def test_mixed_secrets_by_brute_force(spark):
    """Strings of upper and lower case and digits that few own, outside all base spans; also in a text that is a dump of keys."""
    rng = np.random.default_rng(8)
    mixed = lambda: "Aa0" + "".join(rng.choice(list("ABCxyz123_-"), 24))
    shared = mixed()
    texts = [f"x {mixed()} y token={mixed()} {shared} {'0af3' * 8}", f"{shared}", f"{shared} {mixed()}", " ".join(f"key{i}: {mixed()} secret={mixed()}" for i in range(400))]
    docs = spark.createDataFrame([(i, t, f"o{i}/r") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.secrets(docs).collect()}
    for i, t in enumerate(texts):
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_secrets(t))]
        added = [("mixed", m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{24,}", t) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and m[0] != shared and not re.search(secrets.PLACEHOLDER, m[0])]
        added = [x for x in added if not any(b[1] <= x[1] and x[2] <= b[2] for b in base)]
        assert sorted(got[i]) == sorted(base + added), i


def test_licenses(spark):
    t = licenses.TEMPLATES
    pad = " ".join(f"w{i}" for i in range(500))
    texts = [None, "", "mit", pad, f"{pad} {t['MIT'][0]} {pad}", f"{pad} {t['GPL-3.0'][1].upper()} {pad}", t["Apache-2.0"][1].replace("software", "code"), "Permission is hereby granted, free of charge, to any", f"{t['MIT'][0]} {pad} {t['MIT'][0]}", t["BSD-3-Clause"][0].replace("permitted", "allowed")]
    rows = [(r["doc_id"], r["license"], r["containment"]) for r in licenses.license_scan(odd_documents(spark, texts)).collect()]
    by = defaultdict(list)
    for i, name, _ in rows:
        by[i].append(name)
    assert not {0, 1, 2, 3, 7} & set(by)
    assert by[4] == ["MIT"] and set(by[5]) == {"GPL-3.0", "GPL-2.0"} and by[8] == ["MIT", "MIT"]
    # against containment of every template in every window of the whole text
    for i, text in enumerate(texts):
        own = set(brute_grams(text or ""))
        for name, several in t.items():
            for one in several:
                want = set(brute_grams(one))
                if len(want & own) < 0.8 * len(want):
                    assert not [1 for x, n, c in rows if x == i and n == name and len(several) == 1]
    assert licenses.license_scan(empty(spark)).count() == 0


def brute_grams(text):
    w = [x for x in (y.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for y in text.lower().split()) if x]
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def brute_alignment(a, b):
    best = 0
    above = [0] * (len(a) + 1)
    for y in b:
        now = [0]
        for i, x in enumerate(a):
            now.append(max(0, above[i] + (2 if x == y else -1), above[i + 1] - 1, now[-1] - 1))
        best = max(best, *now)
        above = now
    return best / (2 * len(b))


def test_decontamination(spark, sf):
    items = [r for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    pad = " ".join(f"u{i} v{i % 7}" for i in range(200))
    edited = items[2]["text"].split()
    for k in range(4, len(edited), 9):
        edited[k] = "other"
    texts = [None, "", pad, f"{pad} {items[0]['text']} {pad}", items[1]["text"].upper().replace(" ", "\n"), f"{pad} {' '.join(edited)}", items[3]["text"][: len(items[3]["text"]) // 4], f"{items[4]['text']} {pad} {items[5]['text']}"]
    bench = spark.createDataFrame([(r["item_id"], r["text"]) for r in items] + [(None, "a b c d"), (99, None), (100, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(odd_documents(spark, texts), bench).collect()}
    strip = lambda t: [x for x in (y.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for y in (t or "").lower().split()) if x]
    want = {}
    for i, t in enumerate(texts):
        for r in items:
            s = brute_alignment(strip(t), strip(r["text"])) if strip(t) else 0
            if s >= decontaminate.MIN_SCORE:
                want[i, r["item_id"]] = s
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    kept = decontaminate.drop_contaminated(odd_documents(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {k[0] for k in want}
    null = spark.createDataFrame([(None, texts[3]), (None, "clean words"), (7, texts[3]), (7, "clean words")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.drop_contaminated(null, bench).orderBy("doc_id").collect()] == [(None, "clean words"), (7, "clean words")]
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(odd_documents(spark), bench.limit(0)).count() == 0


def test_exact_dedup(spark, sf):
    texts = odd_texts() + ["a  b", "a\tb", "a b ", "A b"] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, size = {}, Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    for width in (32, 1):  # short index keys collide, and the byte verification tells them apart
        got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_dedup(odd_documents(spark, texts), digest_bytes=width).collect()}
        assert got == {i: (first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}
    kept = exact_dedup.drop_copies(odd_documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, None)], "doc_id long, text string")
    got = sorted(map(str, exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert sum("kept=True" in x for x in got) == 3 and len(got) == 6
    assert exact_dedup.drop_copies(docs).count() == 3


def keys_of(spark, names):
    return spark.createDataFrame([(bytes(n, "ascii"),) for n in names], "key binary").selectExpr("unhex(sha2(key, 256)) as key")


def test_digest_index(spark, monkeypatch):
    """Generations, their filters, levels merged by size, and lookups."""
    name = lambda k: hashlib.sha256(k.encode()).digest()
    index = exact_dedup.DigestIndex(spark)
    batches = [[f"a{i}" for i in range(600)], [f"b{i}" for i in range(200)] + ["a7", "b3"], [f"c{i}" for i in range(50)] + ["a7", "a8"], [f"d{i}" for i in range(400)], []]
    sizes = []
    for j, batch in enumerate(batches):
        rows = keys_of(spark, batch).withColumn("doc_id", F.monotonically_increasing_id() + 10_000 * j)
        index.add(rows)
        sizes.append([x.size for x in index.levels])
    assert sizes == [[600], [600, 201], [600, 201, 52], [1250], [1250]]
    assert {bytes(r["key"]): r["n"] for r in index.repeated().collect()} == {name("a7"): 3, name("a8"): 2, name("b3"): 2}
    got = {bytes(r["key"]): (r["keep_id"], r["n"]) for r in index.lookup(keys_of(spark, ["a7", "d0", "zz"])).collect()}
    assert set(got) == {name("a7"), name("d0")} and got[name("a7")][1] == 3 and got[name("a7")][0] < 10_000
    # a filter never denies what a level has, and denies nearly all that it has not
    level = index.levels[0]
    asked = keys_of(spark, [f"q{i}" for i in range(2000)])
    for small in (1024, 0):
        monkeypatch.setattr(exact_dedup, "MAX_FILTER_BLOCKS", small)
        assert level.may_have(level.keys.select("key")).count() == 1250
        assert level.may_have(asked).count() < 200


def test_digest_index_reads_only_ranges_that_are_asked(spark, monkeypatch):
    """A level of 100,000 digests in 128 ranges: a lookup of a few keys reads the files of their ranges, keys that the filter denies read none."""
    monkeypatch.setattr(exact_dedup, "RANGE_BYTES", 100_000 * exact_dedup.DIGEST_BYTES // 64)
    index = exact_dedup.DigestIndex(spark)
    index.add(spark.range(100_000).selectExpr("unhex(sha2(concat('k', id), 256)) as key", "id as doc_id"))
    (level,) = index.levels
    every = level.keys.inputFiles()
    assert len({f.rpartition("/")[0] for f in every}) == 128
    found = level.find(keys_of(spark, ["k5", "k77", "k999", *(f"none{i}" for i in range(3))]))
    assert found.count() == 3 and {f.rpartition("/")[0] for f in found.inputFiles() if "range=" in f} <= {f.rpartition("/")[0] for f in every}
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = found.select(F.col("key"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "range" in read
    used = level.keys.join(found.select("key"), "key", "left_semi").select("range").distinct().count()
    assert used == 3 and {r["range"] for r in level.keys.select("range").distinct().collect()} == set(range(128))
    assert {r["keep_id"] for r in index.lookup(keys_of(spark, ["k5", "k77", "zz"])).collect()} == {5, 77}


def test_memtables_are_bounded(spark, monkeypatch):
    """Runs make up as many memtables as their digests' bytes need, two at least, and every row is in one."""
    rows = spark.range(3000).repartition(12).selectExpr("unhex(sha2(cast(id as string), 256)) as key", "unhex(sha2(cast(id as string), 256)) as sha", "id as doc_id")
    for size, n in ((8 << 30, 2), (1000 * exact_dedup.DIGEST_BYTES, 3), (1, exact_dedup.MEMTABLES)):
        monkeypatch.setattr(exact_dedup, "MEMTABLE_BYTES", size)
        run, memtables = exact_dedup.DigestIndex(spark).flush(rows)
        assert len(memtables) == n and run.count() == 3000
        if n < 10:
            assert sum(m.count() for m in memtables) == 3000


def test_registered_queries(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_sql_of_exact_dedup(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(map(tuple, QUERIES["op10_exact_dedup"](spark, sf).collect()))
    assert got == sorted(db.sql(ORACLE_SQL["op10_exact_dedup"]).fetchall())


def overlapping_texts(rng, n, pairs):
    """Two texts of n shingles each for each number of shared ones in pairs."""
    out = []
    for shared in pairs:
        word = lambda: "".join(rng.choice(list("abcdefghij"), 9))
        same = [word() for _ in range(shared + 4)]
        out += [" ".join(same + [word() for _ in range(n - shared)]) for _ in range(2)]
    return out


def exact_components(texts):
    sets = [set(shingles(t, 5)) for t in texts]
    return components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])


def test_near_dedup_is_exact_at_its_similarity(spark):
    """At 0.8 to 0.82 pairs are linked, under 0.8 none is."""
    n = 200
    shared = [178 + i % 3 for i in range(120)] + [171 + i % 7 for i in range(80)]  # 178 of 222: 0.802; 177 of 223: 0.794; 171: 0.747
    texts = overlapping_texts(np.random.default_rng(7), n, shared)
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.similar_components(odd_documents(spark, texts)).collect()}
    want = dict(enumerate(exact_components(texts)))
    assert sum(got[i] != want[i] for i in got) <= 1  # a pair right at 0.8 is found with a chance of 0.998
    assert all(got[i] in (i, want[i]) for i in got)


def near_copies(rng, n):
    """Three families of texts that differ from their first in a few words; in a family all share many blocks."""
    out = []
    for _ in range(3):
        base = ["".join(rng.choice(list("abcdefghij"), 9)) for _ in range(300)]
        for _ in range(n):
            own = list(base)
            for at in rng.integers(0, 300, rng.integers(0, 9)):
                own[at] = "".join(rng.choice(list("klmnop"), 9))
            out.append(" ".join(own))
    return out


def test_near_dedup_overfull_buckets(spark, monkeypatch):
    """Buckets of near copies are cut into groups of a bounded size, and no pair is lost or joined wrongly."""
    texts = near_copies(np.random.default_rng(4), 60)
    want = dict(enumerate(exact_components(texts)))
    monkeypatch.setattr(simhash_wide, "BUCKET", 8)
    # the largest component of a bucket meets the other rows alone, and these meet all
    rows = [(7, i, i if i < 60 else 1000, 3) for i in range(200)] + [(8, i, 5, 3) for i in range(100)] + [(9, i, i, 3) for i in range(50)]
    root = {(k, i): r for k, i, r, _ in rows}
    dealt = simhash_wide._dealt(spark.createDataFrame(rows, "key long, node long, root long, m long")).collect()
    size, meet = Counter((r["key"], r["i"], r["j"]) for r in dealt), defaultdict(set)
    for r in dealt:
        meet[r["key"], r["i"], r["j"]].add((r["part"], r["node"]))
    assert max(size.values()) <= 6 * 8 and all(len(meet[g]) == size[g] for g in size) and not any(k == 8 for k, *_ in size)
    for key, n in ((7, 200), (9, 50)):
        met = Counter(frozenset((a, b)) for g, own in meet.items() if g[0] == key for p, a in own for q, b in own if a < b and (p != q or len({p for p, _ in own}) == 1))
        wanted = {frozenset((a, b)) for a in range(n) for b in range(a) if root[key, a] != root[key, b]}
        assert wanted <= set(met) and set(met.values()) == {1}
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.similar_components(odd_documents(spark, texts)).collect()}
    assert got == want


def test_a_group_of_near_copies_costs_its_rows(spark):
    """20,000 distinct near copies in one bucket: the rows that are dealt follow the copies, not their pairs."""
    n = 20_000
    large = spark.range(n).selectExpr("7 as key", "id as node", "300L as m")
    assert simhash_wide._with_pivots(large.selectExpr("cast(key as long) key", "node", "node AS root", "m")).count() <= (simhash_wide.PIVOTS + 1) * n
    linked = large.selectExpr("cast(key as long) key", "node", "if(node % 1000 = 7, node, 0L) as root", "m")
    assert simhash_wide._dealt(linked).count() <= n + 20 * (n // simhash_wide.BUCKET + 3)
    assert simhash_wide._dealt(linked.where("root = 0")).count() == 0


def most_dealt(spark, run):
    """run's result, and how many rows the stage of it that wrote most wrote for a shuffle."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty()

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}

    before = stages()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, max(n for k, n in stages().items() if k not in before)


def test_near_dedup_deals_its_blocks_in_passes(spark, monkeypatch):
    """What lies on disk at once follows the texts, not their number times that of the blocks; the components are those of all blocks at once."""
    texts = near_copies(np.random.default_rng(11), 60) + overlapping_texts(np.random.default_rng(12), 40, [178 + i % 20 for i in range(40)])
    found = lambda: {r["doc_id"]: r["component_id"] for r in simhash_wide.similar_components(odd_documents(spark, texts)).collect()}
    got, most = most_dealt(spark, found)
    assert most <= 50 * len(texts)
    monkeypatch.setattr(simhash_wide, "PASS", 1000)
    once, all_at_once = most_dealt(spark, found)
    assert got == once
    assert all_at_once > 60 * len(texts)  # texts of one fingerprint are one node


def test_token_files_special_tokens(spark, tmp_path):
    """The registered query gives the ids of the unchanged tokenizer, strings of special tokens included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*odd_texts(), "a <|endoftext|> b", "A.<|endoftext|>,B", "x<|startoftext|><|endoftext|>y...", "<|ENDOFTEXT|> <| endoftext |>", "<|endoftext|", "\t<|endoftext|>\n\n<|startoftext|>ΣΑΣ", "é<|endoftext|>s's"]
    odd_documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want, start = {}, 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op2_token_files"](spark, str(tmp_path)).collect()} == want


def test_licenses_whole_texts_and_versions(spark):
    pad = " ".join(f"w{i}" for i in range(300))
    names = sorted(n for n, own in licenses.TEMPLATES.items() if len(own[-1].split()) >= licenses.WHOLE_WORDS)
    texts = [f"{pad} {licenses.TEMPLATES[n][-1]} {pad}" for n in names]
    texts += [f"This work is licensed under the GNU General Public License, version {v}." for v in (2, 3)]
    texts += ["This work is licensed under the GNU General Public License, version 9."]
    by = defaultdict(set)
    for r in licenses.license_scan(odd_documents(spark, texts)).collect():
        by[r["doc_id"]].add(r["license"])
    assert {"LGPL-2.1", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "BSL-1.0", "Zlib", "MIT"} <= set(names)
    assert [by[i] for i in range(len(texts))] == [*({n} for n in names), {"GPL-2.0"}, {"GPL-3.0"}, set()]
    headers = [licenses.TEMPLATES["AGPL-3.0"][0], licenses.TEMPLATES["CC-BY-SA-4.0"][0], licenses.TEMPLATES["LGPL-2.1"][0]]
    assert [r["license"] for r in licenses.license_scan(odd_documents(spark, headers)).orderBy("doc_id").collect()] == ["AGPL-3.0", "CC-BY-SA-4.0", "LGPL-2.1"]


def test_chunk_encoder_of_every_code_point_before_punctuation(tokenizer):
    """Each code point up to U+2FFFF behind a letter and before punctuation gets the ids of the library."""
    import pyarrow as pa

    t, path = tokenizer
    own = token_files.ChunkEncoder(path)
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for tail in (".", ",", ".,", "!)"):
        for s in range(0, len(points), 20_000):
            texts = [f"ल{c}{tail}" for c in points[s : s + 20_000]]
            ids, starts = own.batch(pa.array(texts))
            want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
            assert np.array_equal(np.diff(starts), [len(w) for w in want])
            assert np.array_equal(ids, np.concatenate([np.array(w, np.uint32) for w in want]))


def test_chunk_encoder_keeps_pieces_between_tasks(tokenizer, monkeypatch):
    """Tasks of a process share an encoder: known pieces are not encoded again, few and short ones are kept, and ids stay those of the library."""
    import pyarrow as pa

    t, path = tokenizer
    own = token_files.shared(path)
    assert own is token_files.shared(path)
    asked = []
    encode = own._encode
    monkeypatch.setattr(own, "_encode", lambda pieces: asked.extend(pieces) or encode(pieces))
    monkeypatch.setattr(token_files, "CACHE_PIECES", 40)
    own._clear()
    texts = ["The quick, brown fox's \u0301x don't", "brown\tfox. quick 12345", "", "x" * 300 + " The!", "\n \n", "a<|endoftext|>b c"]
    more = [f"word{i} The" for i in range(60)]
    for batch, new in ((texts, True), (texts, False), (more, True), (texts, None), (more, None)):
        asked.clear()
        ids, starts = own.batch(pa.array(batch))
        want = [e.ids for e in t.encode_batch(batch, add_special_tokens=False)]
        assert [ids[i:j].tolist() for i, j in zip(starts, starts[1:], strict=False)] == want
        assert new is None or bool([p for p in asked if len(p) < 100]) == new
        assert len(own.known) <= 40
        assert max(map(len, own.known.to_pylist()), default=0) < 300
    own._clear()
