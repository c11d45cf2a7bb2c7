"""Language ID by hyperdimensional profiles (operator 3).

Every letter has a random vector of +1 and -1, made from its code point. An n-gram's vector binds (multiplies) its
letters' vectors, each rotated by its place; a text's vector bundles (adds up) those of all its n-grams; a language's
prototype bundles the n-grams of all its training documents. A text gets the language whose prototype has the greatest
cosine with its vector. Bundling is linear, so texts and prototypes are made from n-gram counts by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import shake_256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .words import slices

DIMENSIONS = 1024
GRAM = 3
SEED = 7
#: Prototypes go to every task, so their number has a bound; more languages raise an error.
MAX_LANGUAGES = 500
#: Vectors with nothing in common have a cosine of 0 with a deviation of 1 / sqrt(DIMENSIONS); the greatest of several such seldom is over this.
NOISE = 3.2 / DIMENSIONS**0.5
#: For a text without a letter.
UNKNOWN = "und"
#: Texts are worked on in slices of this many bytes; a count matrix has a row for each text and a column for each n-gram.
SLICE = 1 << 20
#: Cells of a count matrix, and n-grams whose vectors are made at once.
CELLS, GRAMS = 1 << 23, 1 << 14


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point its lower-case letter's code point, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0]) if low else c
    return out


@lru_cache(20_000)
def letter_vector(point: int) -> np.ndarray:
    raw = shake_256(f"{SEED}:{point}".encode()).digest(DIMENSIONS // 8)
    return (np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int8) << 1) - 1


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the distinct n-grams as rows of code points (0: between words), each n-gram's number and text, and which texts have a letter.

    Runs of other characters count as one boundary, and a text begins and ends with one.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    low = letters()[points]
    own = np.repeat(np.arange(len(sizes)), sizes)
    has = np.bincount(own[low > 0], minlength=len(sizes)) > 0
    # a boundary before and after each text
    n = len(low) + 2 * len(sizes)
    line, text = np.zeros(n, np.uint32), np.repeat(np.arange(len(sizes)), sizes + 2)
    line[np.arange(len(low)) + 2 * own + 1] = low
    keep = np.ones(n, bool)
    keep[1:] = (line[1:] > 0) | (line[:-1] > 0) | (text[1:] != text[:-1])
    line, text = line[keep], text[keep]
    used = np.flatnonzero(np.bincount(line)) if len(line) else np.zeros(0, np.int64)
    rank = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
    rank[used] = np.arange(len(used))
    code = rank[line]
    m = max(0, len(code) - GRAM + 1)
    key = np.zeros(m, np.int64)
    for i in range(GRAM):
        key = key * len(used) + code[i : i + m]
    inside = text[:m] == text[GRAM - 1 :] if m else np.zeros(0, bool)
    key, text = key[inside], text[:m][inside]
    space = len(used) ** GRAM
    if space <= 1 << 22:
        seen = np.flatnonzero(np.bincount(key, minlength=space))
        place = np.zeros(space, np.int64)
        place[seen] = np.arange(len(seen))
        number = place[key]
    else:
        seen, number = np.unique(key, return_inverse=True)
    parts = np.stack([used[seen // len(used) ** (GRAM - 1 - i) % len(used)] for i in range(GRAM)], axis=1) if len(used) else np.zeros((0, GRAM), np.int64)
    return parts, number, text, has


def gram_vectors(parts: np.ndarray) -> np.ndarray:
    """Bind: the product of the letters' vectors, the i-th letter's rotated by n - 1 - i."""
    points, where = np.unique(parts, return_inverse=True)
    book = np.stack([letter_vector(int(p)) for p in points]) if len(points) else np.zeros((0, DIMENSIONS), np.int8)
    where = where.reshape(parts.shape)
    out = np.ones((len(parts), DIMENSIONS), np.int8)
    for i in range(GRAM):
        out *= np.roll(book, GRAM - 1 - i, axis=1)[where[:, i]]
    return out.astype(np.float32)


def bundle(parts: np.ndarray, number: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The bundled vectors of `rows` texts (or classes), in a slice of n-grams.

    Rows are taken by halves until rows x distinct n-grams is at most CELLS, and a row's n-grams in pieces of GRAMS, so memory is bounded
    whatever the number of texts or n-grams.
    """
    out = np.zeros((rows, DIMENSIONS), np.float32)
    if (np.diff(row) < 0).any():
        order = np.argsort(row, kind="stable")
        number, row = number[order], row[order]
    at = np.searchsorted(row, np.arange(rows + 1))
    todo = [(0, rows)]
    while todo:
        lo, hi = todo.pop()
        own, local = row[at[lo] : at[hi]] - lo, number[at[lo] : at[hi]]
        known = np.arange(len(parts))
        if hi - lo < rows:
            known, local = np.unique(local, return_inverse=True)
        if hi - lo > 1 and (hi - lo) * len(known) > CELLS:
            mid = (lo + hi) // 2
            todo += [(lo, mid), (mid, hi)]
            continue
        for g in range(0, len(known), GRAMS):
            piece = known[g : g + GRAMS]
            here = slice(None) if len(known) <= GRAMS else (local >= g) & (local < g + GRAMS)
            counts = np.bincount(own[here] * len(piece) + local[here] - g, minlength=(hi - lo) * len(piece))
            out[lo:hi] += counts.reshape(hi - lo, len(piece)).astype(np.float32) @ gram_vectors(parts[piece])
    return out


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """The prototypes of all languages of docs; rows without a language or a letter teach nothing.

    Each task bundles its rows; the sums of a language and dimension are added up by Spark, so the driver gets one
    row for each language.
    """
    data = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, size=SLICE):
            coded = b["lang"].dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            parts, number, text, _ = grams(b["text"])
            for name, v in zip(names, bundle(parts, number, code[text], len(names)), strict=True):
                sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            if v.any():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tolist()])], ["lang", "v"])

    sums = data.mapInArrow(run, "lang string, v array<double>")
    whole = sums.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    whole = materialise(whole.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")), "prototypes")
    rows = whole.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in sorted(rows, key=lambda r: r["lang"])}


def scores(texts: pa.Array, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's best prototype, its cosine with it, and whether it has a letter."""
    parts, number, text, has = grams(texts)
    v = bundle(parts, number, text, len(texts))
    norm = np.linalg.norm(v, axis=1)
    cos = v @ unit.T / np.where(norm > 0, norm, 1)[:, None]
    best = cos.argmax(axis=1)
    return best, cos[np.arange(len(best)), best], has


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 where it is negative) of every row, from the whole text alone.

    `und` and 0 for a null text, a text without a letter, and where nothing was learned. Of languages with equal
    cosines the first by name is taken.
    """
    names = list(prototypes)
    unit = np.stack([v / np.linalg.norm(v) for v in prototypes.values()]).astype(np.float32) if names else None

    def run(batches):
        for b in slices(batches, size=SLICE):
            if unit is None:
                pred, score = [UNKNOWN] * len(b), np.zeros(len(b))
            else:
                best, score, has = scores(b["text"], unit)
                pred = [names[i] if h else UNKNOWN for i, h in zip(best, has, strict=True)]
                score = np.where(has, np.clip(score, 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return data.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows with a language that are not held out, then predict every row: doc_id, held_out, lang_pred, score."""
    prototypes = train(docs.where(~held_out(F.col(id_col))), lang_col, text_col)
    said = predict(docs, prototypes, id_col, text_col)
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, min_score: float = NOISE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that language ID rejects; all columns stay as they are.

    Rejected are null texts, texts without a letter, and texts with a cosine of min_score or less with every prototype. Texts in a
    script that no prototype holds have only noise; short clean texts have cosines of 0.11 and more, so no more is asked. If no row
    teaches a language, every text with a letter stays.
    """
    prototypes = train(docs.where(~held_out(F.col(id_col))), lang_col, text_col)
    names = list(prototypes)
    unit = np.stack([v / np.linalg.norm(v) for v in prototypes.values()]).astype(np.float32) if names else None

    def run(batches):
        for b in slices(batches, text_col, SLICE):
            if unit is None:
                keep = grams(b[text_col])[3]
            else:
                _, score, has = scores(b[text_col], unit)
                keep = has & (score > min_score)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return language_id(table(spark, sf_dir, "documents"))
