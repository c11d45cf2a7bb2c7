"""SimHash near-dedup by pigeonhole blocks (operator 1).

Fingerprints are made where the text is read. Equal fingerprints are one node of the link graph, so a group of copies
never becomes pairs. A node's 64 bits are cut into six blocks; two fingerprints that differ in three bits or fewer
agree on three blocks at least, so each node goes to the 20 buckets of its triples of blocks and meets all its
partners there. A bucket is streamed, not gathered: up to BUCKET fingerprints are compared (Hamming distance) and
only a spanning star of each local component leaves the task; a larger bucket's members go on to the next level, where
the bits that are still free are cut into six blocks again. Members of a bucket agree on 31 bits at least at the first level,
46 at the second and 55 at the third, so the third level's buckets have 512 members at most: no cap drops a pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, id_and_text, materialise, table
from .components import connected_components
from .words import lowered, ranges, slices, words_of

#: Fingerprints of one bucket that a task compares at once.
BUCKET = 1024
SEED = 42
LEVELS = 3


def _lanes() -> np.ndarray:
    """For each byte, its bits in the eight lanes of an unsigned 64-bit integer (bit k in lane k)."""
    out = np.zeros(256, np.uint64)
    for k in range(8):
        out |= ((np.arange(256, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k)
    return out


def shingle_hashes(texts: pa.Array, k: int = 3, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the k-word shingles of lower-cased texts (fewer words: of the whole sequence), and where each text's start."""
    from functools import partial

    from xxhash import xxh64_intdigest

    words, starts = words_of(lowered(texts))
    n = np.diff(starts)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size + 1) - 1  # words joined by one space
    begins = ends - size
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")[0].as_py().encode() if len(words) else b""
    count = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    first = ranges(starts[:-1], count)
    last = first + np.repeat(np.minimum(k, n) - 1, count)
    h = partial(xxh64_intdigest, seed=seed)
    found = [h(joined[a:b]) for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)]
    return np.array(found, np.uint64), np.concatenate([[0], np.cumsum(count)])


def fingerprints_of(hashes: np.ndarray, starts: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's hashes; no hash: zero."""
    n = np.diff(starts)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    blocks = -(-n[full] // 255)  # a lane counts to 255
    own = np.repeat(np.arange(len(full)), blocks)
    cuts = starts[full][own] + 255 * (np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    bits = np.zeros((len(cuts), 8), np.uint64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        bits[:, byte] = np.add.reduceat(lanes[raw[:, byte]], cuts)
    counts = np.add.reduceat(bits.view(np.uint8).astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    out[full] = np.packbits(counts * 2 > n[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row; null texts are empty, and a text without words has fp 0."""

    def run(batches):
        lanes = _lanes()
        for b in slices(batches, size=1 << 20):  # the shingles are Python objects
            fp = fingerprints_of(*shingle_hashes(b["text"], k), lanes)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _cut(bits: list[int], parts: int = 6) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, parts)]


def _masks(fixed: int, max_bits: int) -> list[int]:
    """Masks of the fixed bits and of each choice of three of the six blocks of the free ones (for three differing bits)."""
    parts = 2 * max_bits
    blocks = _cut([i for i in range(64) if not fixed >> i & 1], parts)
    return [fixed | sum(1 << int(i) for b in chosen for i in b) for chosen in combinations(blocks, parts - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def local_stars(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of one bucket: each that isn't the first of its local component, and that first one."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= max_bits
    label, n = np.arange(len(fp)), len(fp)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    own = np.flatnonzero(label != np.arange(n))
    return fp[own], fp[label[own]]


def bucket_links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """keyed: mask, key, fp. Rows (mask null, u, v): a link between two fingerprints; (mask, u, null): a member of a bucket too large for this level."""

    def run(batches):
        held: list[np.ndarray] = []
        now, over = None, False

        def flush(group):
            fp = np.unique(np.concatenate(group))
            u, v = local_stars(fp, max_bits)
            return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["mask", "u", "v"])

        def excess(mask, group):
            u = np.concatenate(group)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), mask, np.int64)), pa.array(u.view(np.int64)), pa.nulls(len(u), pa.int64())], ["mask", "u", "v"])

        for b in batches:
            mask, key, fp = (b[c].to_numpy() for c in ("mask", "key", "fp"))
            fp = fp.view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1, [len(key)]])
            size = np.diff(cuts)
            # groups of two inside the batch, all at once
            inner = np.arange(1, len(size) - 1)
            two = cuts[inner[size[inner] == 2]]
            hit = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(hit), pa.int64()), pa.array(fp[hit + 1].view(np.int64)), pa.array(fp[hit].view(np.int64))], ["mask", "u", "v"])
            for g in sorted({0, len(size) - 1, *inner[size[inner] > 2].tolist()}):
                i, j = cuts[g], cuts[g + 1]
                if i == j:
                    continue
                if now != (mask[i], key[i]):
                    if held and not over:
                        yield flush(held)
                    held, now, over = [], (mask[i], key[i]), False
                held.append(fp[i:j])
                if over or sum(map(len, held)) > BUCKET:
                    yield excess(now[0], held)
                    held, over = [], True
        if held and not over:
            yield flush(held)

    return keyed.mapInArrow(run, "mask long, u long, v long")


def hamming_links(fps: DataFrame, max_bits: int = 3, parts: int | None = None) -> DataFrame:
    """fps: distinct fp. Links (u, v) with the same connected components as all pairs that differ in max_bits bits or fewer."""
    level = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in _masks(0, max_bits)))).alias("mask"))
    links = None
    for k in range(LEVELS):
        keyed = level.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = materialise(bucket_links(dealt, max_bits), f"links-{k}")
        mine = found.where("mask is null").select("u", "v").distinct()
        links = mine if links is None else links.unionByName(mine)
        rest = found.where("mask is not null").select("mask", F.col("u").alias("fp"))
        used = [r[0] for r in rest.select("mask").distinct().collect()] if k + 1 < LEVELS else []  # at most 20, then 400 masks
        if not used:
            break
        finer_of = F.array(*(F.struct(F.lit(x).alias("was"), F.array(*(F.lit(_signed(m)) for m in _masks(x % (1 << 64), max_bits))).alias("to")) for x in used))
        table_of = rest.sparkSession.range(1).select(F.explode(finer_of).alias("s")).select("s.was", F.explode("s.to").alias("next"))
        level = rest.join(F.broadcast(table_of), rest["mask"] == table_of["was"]).select("fp", F.col("next").alias("mask")).distinct()
    return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Null texts are empty texts; all texts without words share fingerprint zero and so one component. Rows with a null
    doc_id take part; a component of such rows alone has a null component_id.
    """
    fp = materialise(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    parts = materialise(connected_components(hamming_links(nodes.select("fp"), max_bits)), "components")
    of_root = parts.join(nodes, parts["node"] == nodes["fp"]).select("node", "root", "first", "n")
    least = materialise(of_root.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("m")), "roots")
    reached = attach(parts, least, "root", "m").select(F.col("node").alias("fp"), "least")
    known = materialise(nodes.join(reached, "fp", "left").where("n > 1 or least is not null").select("fp", F.coalesce("least", "first").alias("component_id"), "n"), "known")
    out = attach(fp, known, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null texts and texts without words have the fingerprint zero and are linked like any other."""
    return simhash_components(table(spark, sf_dir, "documents"))
