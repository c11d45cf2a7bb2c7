"""Words of Arrow text columns, a column at a time: what the word-based operators do inside their tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, however large Spark's batches are.
SLICE_BYTES = 2 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps what it keeps
        return None


def release() -> None:
    """Give freed memory back to the machine: a Python worker lives on after its task, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            # a copy: some Arrow kernels don't mind the offset of a slice
            yield batch.take(pa.array(np.arange(at, to))) if to - at < n else batch
            at = to
        del batch
        release()


def lowered(texts: pa.Array) -> pa.Array:
    """Only A-Z become a-z; null: empty."""
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in one array, and where each text's words start in it (one more: the end)."""
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.values, parts.offsets.to_numpy().astype(np.int64)
    first, last = offsets[0], offsets[-1]
    flat, offsets = flat.slice(first, last - first), offsets - first
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return flat, offsets


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as its index in the distinct words, and the distinct words."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and where each text's words start (one more: the end)."""
    from xxhash import xxh64_intdigest

    words, starts = words_of(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    code, distinct = codes_of(words)
    trimmed = pc.utf8_trim(distinct, PUNCTUATION)
    h = np.array([xxh64_intdigest(w) for w in trimmed.to_pylist()], np.uint64)
    full = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        keep = full[code]
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        code = code[keep]
    return (h[code] if len(h) else np.zeros(0, np.uint64)), starts


def seeds_of(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of texts, and the places (in words) where they start."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.flatnonzero(text[:m] == text[n - 1 :])
    return out[inside], inside
