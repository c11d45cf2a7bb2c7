"""The corpus pipeline: each stage against a brute-force version of its decision, and the whole run."""

import base64
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from factloom.llm import decontaminate

from .fixtures import CLASHING, odd_texts
from .test_operators import brute_alignment, exact_components, lower, words_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, sf, tmp_path_factory):
    """Documents of the smallest tables, odd texts, other scripts, copies, near copies and benchmark passages; doc_ids that repeat or are null."""
    rng = np.random.default_rng(1)
    own = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    rows = [(r["text"], r["lang"]) for r in own]
    rows += [(t, None) for t in odd_texts() if t is None or len(t) < 60_000]
    greek = "".join(map(chr, range(0x3B1, 0x3C9)))
    rows += [(" ".join("".join(rng.choice(list(greek), 6)) for _ in range(40)), None) for _ in range(5)]
    base = next(t for t, _ in rows if t and len(t.split()) > 250)
    for k in range(6):
        words = base.split()
        words[5 + 20 * k] = "changed"
        rows.append((" ".join(words), "en"))
    rows += [(f"{base[:300]} {x} {base[300:600]}", "en") for x in items[:3]] + [(rows[0][0], "en"), (rows[0][0].replace(" ", "  "), "en")]
    data = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)]
    data += [(3, "a repeated row of the same identifier with some english words in it", "en", "s", 1)] * 2 + [(None, data[1][1], "en", "s", 2), (None, "nobody knows who wrote this but it is all plain english text", "en", "s", 3)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(data, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(6).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect())


def test_stages_and_run(spark, corpus):
    import public_tokenizers
    import tiktoken

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontaminate", "byte_bpe"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    every = rows_of(docs)

    docs = stage("language_id")(spark, docs, corpus)
    kept = rows_of(docs)
    letters = [x for x in every if any(c.isalpha() for c in x[1])]
    greek = [x for x in every if re.match("[α-ω]{6}[α-ω ]+$", x[1])]
    assert docs.columns == columns and len(greek) == 5 and not set(kept) & set(greek)
    labelled = {(r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in spark.read.parquet(f"{corpus}/documents.parquet").where("lang is not null").collect()}
    assert set(letters) & labelled <= set(kept) <= set(letters) and len(labelled) > 200

    docs = stage("exact_dedup")(spark, docs, corpus)
    unique = {}
    for i, t in sorted(kept, key=lambda x: x[0] if x[0] >= 0 else 1 << 60):
        unique.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    left = rows_of(docs)
    assert docs.columns == columns and sorted((re.sub(r"[\x20\x09-\x0D]+", " ", t), i) for i, t in left) == sorted(unique.items())

    docs = stage("simhash_near_dedup")(spark, docs, corpus)
    known = sorted((x for x in left if words_of(x[1])), key=lambda x: x[0] if x[0] >= 0 else 1 << 60)
    stay = {}
    for x, c in zip(known, exact_components([t for _, t in known]), strict=True):
        stay.setdefault(c, x)
    after = rows_of(docs)
    assert docs.columns == columns and len(known) - len(stay) >= 6
    assert after == sorted([*stay.values(), *(x for x in left if not words_of(x[1]))])

    docs = stage("decontaminate")(spark, docs, corpus)
    strip = lambda t: [x for x in (y.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for y in t.lower().split()) if x]
    items = [strip(r["text"]) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    sets = [set(x) for x in items]

    def copied(text):
        w = strip(text)
        return any(len(s & set(w)) >= 0.4 * len(s) and brute_alignment(w, x) >= decontaminate.MIN_SCORE for x, s in zip(items, sets, strict=True))

    clean = rows_of(docs)
    dropped = set(after) - set(clean)
    assert docs.columns == columns and {x for x in after if copied(x[1])} == dropped and len(dropped) >= 3

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest()) for i, t in clean)
    for out in (stage("byte_bpe")(spark, docs, corpus), corpus_pipeline.run(spark, corpus)):
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids_sha256"]) for r in out.collect()) == want
        assert all(hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"] for r in out.collect())


def test_stages_of_nothing_and_clashing_columns(spark, corpus):
    """An empty table gives an empty table, and other columns stay as they are."""
    empty = spark.createDataFrame([], COLUMNS)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, corpus).count() == 0, name
    more = "key long, fp string, n int, mask int, shard int, kind string, row long, hash string, repo string, norm string, node long, held boolean, bucket int"
    assert CLASHING.endswith(more)
    values = (1, "f", 2, 3, 4, "k", 5, "h", "r", "n", 6, True, 7)
    text = "plain english words that say nothing much about anything at all in this place"
    docs = spark.createDataFrame([(i, f"{text} {i}", "en", "s", 1, *values) for i in range(6)], CLASHING)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, corpus)
        assert out.columns == docs.columns and all(tuple(r)[5:] == values for r in out.collect()), name
    assert lower("A") == "a"


def test_near_dedup_judges_rows_by_their_own_texts(spark):
    """Rows of one doc_id, or of none, with different texts: each text keeps one surviving near copy, and only one row of it."""
    from factloom.llm import simhash_wide

    rng = np.random.default_rng(4)
    say = lambda: ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(120)]
    a, b, c, d = say(), say(), say(), say()
    edit = lambda w, i: " ".join([*w[:i], "edited", *w[i + 1 :]])
    rows = [(1, " ".join(a)), (2, edit(a, 5)), (2, " ".join(b)), (7, edit(b, 9)), (None, edit(a, 60)), (None, " ".join(c)), (None, edit(c, 70)), (9, " ".join(d)), (9, " ".join(d)), (9, edit(d, 3)), (3, None), (3, None), (4, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(4)
    kept = rows_of(simhash_wide.drop_similar(docs))
    texts = [t for _, t in kept]
    assert (1, " ".join(a)) in kept and (2, " ".join(b)) in kept and len(kept) == 7
    assert sum(t in (" ".join(c), edit(c, 70)) for t in texts) == 1 and sum(t in (" ".join(d), edit(d, 3)) for t in texts) == 1
    assert texts.count("") == 2 and texts.count(" ") == 1
    said = {(r["doc_id"], r["component_id"]) for r in simhash_wide.similar_components(docs).collect()}
    assert said == {(1, 1), (2, 1), (2, 2), (7, 2), (None, 1), (None, None), (9, 9)}


def test_stages_hand_small_batches_to_python(spark, corpus):
    """60 texts of 100 KB and one of 5 MB in one partition: every stage bounds what an Arrow batch holds, whole texts stay, and a setting of the session's own counts."""
    from factloom.llm.common import ARROW_BYTES

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "size"])

    docs = spark.range(0, 61, 1, 1).selectExpr("id AS doc_id", "repeat('a', if(id = 30, 5000000, 100000)) AS text")
    few = spark.read.parquet(f"{corpus}/documents.parquet").limit(20)
    for name, f in corpus_pipeline.STAGES:
        spark.conf.unset(ARROW_BYTES)
        f(spark, few, corpus)
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 61, name
        assert sum(r["size"] for r in got) >= 11_000_000, name
        assert all(r["size"] < 2_400_000 for r in got if r["size"] < 5_000_000), name
        assert max(r["size"] for r in got) < 7_400_000, name
    spark.conf.set(ARROW_BYTES, "500000")
    dict(corpus_pipeline.STAGES)["byte_bpe"](spark, few, corpus)
    assert spark.conf.get(ARROW_BYTES) == "500000"
    spark.conf.unset(ARROW_BYTES)
