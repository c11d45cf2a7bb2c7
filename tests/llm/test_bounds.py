"""What the operators need at most: memory, time and rows on inputs that would be large for a dense form."""

import resource
import time

import numpy as np
import pyarrow as pa

from factloom.llm import bpe, decontaminate, language_id

from .test_operators import brute_alignment


def peak_mb(f):
    """How far f raises this process's peak memory."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    f()
    return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024


def chinese(rng, n, size):
    return ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, size))) for _ in range(n)]


def test_language_vectors_of_many_short_texts_are_bounded():
    texts = pa.array(chinese(np.random.default_rng(1), 10_000, 30))
    unit = np.ones((2, language_id.DIMENSIONS), np.float32) / 32
    language_id.letters()
    assert peak_mb(lambda: language_id.scores(texts, unit)) < 1000


def plain_bundle(texts):
    """Vectors by the definition: a sum over n-grams of products of rotated letter vectors."""
    out = []
    for t in texts:
        points = [0]
        for c in t:
            p = int(language_id.letters()[ord(c)])
            if p or points[-1]:
                points.append(p)
        points += [0] if points[-1] else []
        v = np.zeros(language_id.DIMENSIONS)
        for i in range(len(points) - language_id.GRAM + 1):
            one = np.ones(language_id.DIMENSIONS)
            for k in range(language_id.GRAM):
                one *= np.roll(language_id.letter_vector(points[i + k]), language_id.GRAM - 1 - k)
            v += one
        out.append(v)
    return np.array(out)


def test_language_vectors_by_definition(monkeypatch):
    texts = ["Hello, wörld 12 x", "", "  ", "a", "abc ABC", *chinese(np.random.default_rng(2), 5, 8), "the cat sat on the mat and the cat " * 5]
    want = plain_bundle(texts)
    for cells, grams in ((1 << 23, 1 << 14), (20, 3), (1, 1)):
        monkeypatch.setattr(language_id, "CELLS", cells)
        monkeypatch.setattr(language_id, "GRAMS", grams)
        parts, number, text, _ = language_id.grams(pa.array(texts))
        assert (language_id.bundle(parts, number, text, len(texts)) == want).all()
        order = np.random.default_rng(3).permutation(len(number))
        assert (language_id.bundle(parts, number[order], text[order] % 2, 2) == [want[::2].sum(axis=0), want[1::2].sum(axis=0)]).all()


def test_equal_cosines_take_the_first_language():
    v = np.random.default_rng(4).normal(size=language_id.DIMENSIONS).astype(np.float32)
    unit = np.stack([v, v]) / np.linalg.norm(v)
    best, cos, _ = language_id.scores(pa.array(["some words here"]), unit)
    assert best[0] == 0 and abs(cos[0]) < 1


def test_alignments_beside_a_window_of_a_million_words_are_bounded():
    rng = np.random.default_rng(5)
    words = rng.integers(10, 1000, 1_020_000).astype(np.uint64)
    item = rng.integers(10, 1000, 30).astype(np.uint64)
    words[500_000:500_030] = item
    lo = np.concatenate([[0], 1_000_000 + 50 * np.arange(400)])
    hi = np.concatenate([[1_000_000], lo[1:] + 50])
    zero = np.zeros(len(lo), np.int64)

    def run():
        doc, its, begin, end = decontaminate.pieces_of(np.arange(len(lo)), zero, lo, hi, zero + 30)
        assert (end - begin).max() <= 180
        share, first, last = decontaminate.score_windows(words, begin, end, item, np.array([0, 30]), its, 0.5)
        best = share.argmax()
        assert share[best] == 1 and (first[best], last[best]) == (500_000, 500_030) and doc[best] == 0

    assert peak_mb(run) < 1000


def test_pieces_hold_every_alignment():
    rng = np.random.default_rng(6)
    item = rng.integers(0, 6, 8).astype(np.uint64)
    for _ in range(60):
        words = rng.integers(0, 6, 150).astype(np.uint64)
        zero = np.zeros(1, np.int64)
        doc, its, lo, hi = decontaminate.pieces_of(zero, zero, zero, zero + 150, zero + 8)
        share, *_ = decontaminate.score_windows(words, lo, hi, item, np.array([0, 8]), its, 0.0)
        assert share.max() == brute_alignment(words.tolist(), item.tolist())


def test_windows_of_a_document_and_item_are_their_own():
    doc, item = np.array([0, 0, 0, 1]), np.array([0, 0, 1, 1])
    lo, hi = np.array([0, 400, 0, 10]), np.array([500, 520, 20, 30])
    got = list(zip(*(x.tolist() for x in decontaminate.pieces_of(doc, item, lo, hi, np.array([500, 500, 10, 10]))), strict=True))
    assert got == [(0, 0, 0, 520), (0, 1, 0, 20), (1, 1, 10, 30)]


def test_long_letter_runs_are_merged_fast():
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(path)
    texts = chinese(np.random.default_rng(7), 300, 120)
    own.batch(pa.array(["warm " + texts[0] * 2]))
    t = time.perf_counter()
    ids, starts = own.batch(pa.array(texts))
    took = time.perf_counter() - t
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [enc.encode_ordinary(x) for x in texts]
    assert took < 1.5  # a pair table for each piece took 7 s
