"""How much the searches find, against brute force: licenses by window bands, benchmark items by rare seeds, near copies by blocks."""

import numpy as np

from factloom.llm import decontaminate, licenses, simhash_wide

from .fixtures import odd_documents
from .test_operators import brute_alignment, brute_grams, exact_components, overlapping_texts


def word(rng):
    return "".join(rng.choice(list("abcdefghijklmnop"), 8))


def test_licenses_are_found_where_containment_says_so(spark):
    """Templates of 6 to 400 words with edits, laid into other words: what holds 0.8 of a template is found, and nothing else."""
    rng = np.random.default_rng(2)
    templates = {f"L{i}": [" ".join(word(rng) for _ in range(n))] for i, n in enumerate([*range(13, 40, 2), 60, 90, 140, 200, 280, 400])}
    texts = []
    for name, (text,) in templates.items():
        for rate in (0, 0.01, 0.02, 0.03, 0.04, 0.06):
            words = [word(rng) if rng.random() < rate else w for w in text.split()]
            texts.append((" ".join([word(rng) for _ in range(rng.integers(0, 200))] + words + [word(rng) for _ in range(rng.integers(0, 200))]), name))
    want = set()
    for i, (text, _) in enumerate(texts):
        own = set(brute_grams(text))
        want |= {(i, n) for n, (t,) in templates.items() if len(own & set(brute_grams(t))) >= licenses.CONTAINMENT * len(set(brute_grams(t)))}
    got = {(r["doc_id"], r["license"]) for r in licenses.license_scan(odd_documents(spark, [t for t, _ in texts]), templates).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want) and len(want) > 60


def edited(rng, words, rate):
    return [word(rng) if rng.random() < rate else w for w in words]


def test_edited_benchmark_items_are_found(spark, sf):
    items = [r for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    strip = lambda t: [x for x in (y.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for y in t.lower().split()) if x]
    rng = np.random.default_rng(3)
    texts, want = [], set()
    for r in items:
        for rate in (0.05, 0.1, 0.15, 0.2):
            for _ in range(3):
                words = edited(rng, strip(r["text"]), rate)
                texts.append(" ".join([word(rng) for _ in range(60)] + words + [word(rng) for _ in range(60)]))
                if brute_alignment(strip(texts[-1]), strip(r["text"])) >= decontaminate.MIN_SCORE:
                    want.add((len(texts) - 1, r["item_id"]))
    bench = spark.createDataFrame([(r["item_id"], r["text"]) for r in items], "item_id long, text string")
    docs = odd_documents(spark, texts)
    found = lambda share: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, seed_share=share).collect()} & want
    assert len(want) > 100
    assert len(found(decontaminate.SEED_SHARE)) >= 0.95 * len(want) and len(found(1.0)) >= 0.98 * len(want)


def test_near_copies_are_found_from_their_similarity_on(spark):
    """Of pairs at 0.80, 0.82 and 0.85, at least 0.9 (in fact nearly all) are linked, and those under 0.8 are not."""
    for shared, least in ((178, 0.97), (181, 0.99), (184, 0.99), (174, 0.0)):
        texts = overlapping_texts(np.random.default_rng(shared), 200, [shared] * 60)
        want = exact_components(texts)
        got = {r["doc_id"]: r["component_id"] for r in simhash_wide.similar_components(odd_documents(spark, texts)).collect()}
        linked = sum(got[i] == want[i] != i for i in got)
        assert linked >= least * sum(w != i for i, w in enumerate(want)) and all(got[i] in (i, want[i]) for i in got)
