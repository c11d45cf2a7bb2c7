"""SimHash near-dedup for a given similarity of word shingles: wide fingerprints and blocks propose pairs, exact Jaccard decides.

A 64-bit fingerprint tells apart little at a similarity of 0.8 (ten of its bits differ on average), so here a text has BITS bits,
of its distinct k-word shingles. Two texts whose shingle sets have the Jaccard similarity J differ in a share
acos(2 J / (1 + J)) / pi of the bits on average. A pair within REACH standard deviations over that share of the wanted similarity
is a candidate: 999 of 1,000 pairs right at the similarity, and nearly all closer ones. Blocks of bits are the join keys; their
width follows the number of texts, so that unrelated texts seldom meet, and their number follows from the width, so that a pair
at the wanted similarity shares a block with a chance of RECALL (closer pairs: nearly always; within BITS / width differing bits:
always, as the first blocks are disjoint).

Candidates are links only if the shingle sets of their texts have a Jaccard similarity of at least the wanted one. The pairs of small
buckets are made distinct and joined to the shingles. Blocks come in two rounds. In the first one, of a few blocks, the rows of a larger bucket are compared
with a few of them, its pivots: that links most of a group of near copies in as many comparisons as it has rows. Then the components so far are known. In the
second round, of all blocks, a bucket's rows go on only if they may have a partner of another component, so a group does not stand in all of its buckets again, and of a
larger bucket only the rows outside its largest component meet all others, each pair of components at most until it is linked. What is too large for one
task is cut into parts, each two of which are a group, and only a spanning forest of verified pairs leaves a group.

The blocks are dealt in passes of PASS at most, and what a pass wrote for them is gone when the next one begins. So the rows that lie on disk at once grow as the
number of texts, though the number of blocks grows too; a bucket is of one block, so passes find what all blocks at once would.

To the buckets go keys, nodes and the first SKETCH bits alone. A row that differs from all others of its small bucket in more of
those than a candidate can (but for a chance of 10^-9) has no partner there; the other rows meet again with whole fingerprints.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, attach, discard, id_and_text, materialise
from .components import connected_components
from .simhash import _lanes, fingerprints_of, shingle_hashes
from .words import release, slices

BITS = 640
RECALL = 0.999
#: By how many standard deviations a candidate's distance may exceed the mean at the wanted similarity.
REACH = 3.1
#: Rows of a bucket whose pairs leave it as they are; those of larger buckets are verified inside.
SMALL = 32
#: Rows and bytes of shingles of a part of a larger bucket, about.
BUCKET, BUCKET_BYTES = 2048, 8 << 20
#: Rows of a larger bucket that all its rows are compared with first.
PIVOTS = 4
#: Candidates of a larger bucket that are verified at once, and the most bytes of bit sets for that.
PAIRS, BIT_BYTES = 4096, 32 << 20
#: So many blocks come first: what they link is one component when all blocks are looked at, whose buckets then hold few rows of a group of copies.
FIRST = 6
#: So many blocks at most are dealt at once: a row of about 24 bytes for each of them and each text.
PASS = 48
#: Bits of a fingerprint that go to its buckets, and by how many standard deviations a link's distance there may exceed its mean.
SKETCH, DEVIATIONS = 128, 6


def differing_share(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def reach(similarity: float) -> int:
    """How many bits of a candidate's fingerprints may differ."""
    share = differing_share(similarity)
    return math.ceil(BITS * share + REACH * math.sqrt(BITS * share * (1 - share)))


def _distinct_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and where each text's start."""
    h, starts = shingle_hashes(texts, k)
    own = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.searchsorted(own[new], np.arange(len(texts) + 1))


def wide_fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), fp (BITS bits) and m (distinct shingles) of every row that has a word."""

    def run(batches):
        lanes = _lanes()
        for b in slices(batches, size=1 << 20):
            h, starts = _distinct_shingles(b["text"], k)
            parts = []
            for i in range(BITS // 64):
                x = (h ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(31)
                x *= np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(29)
                parts.append(fingerprints_of(x, starts, lanes))
            full = np.flatnonzero(np.diff(starts))
            fp = np.ascontiguousarray(np.stack(parts, axis=1)[full])
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(full), [None, pa.py_buffer(fp)]).cast(pa.binary())
            own = pa.array(full)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(own), b["mark"].take(own), data, pa.array(np.diff(starts)[full])], ["doc_id", "mark", "fp", "m"])

    return _marked(docs, id_col, text_col).mapInArrow(run, "doc_id long, mark long, fp binary, m long")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, mark: what a row is told by, for a doc_id may be null or repeated."""
    return id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def shingles_of(docs: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """nodes: node, doc_id, mark, each text once. node and sh (its distinct shingle hashes in ascending order, 64 bit each)."""

    def run(batches):
        for b in slices(batches, size=1 << 20):
            h, starts = _distinct_shingles(b["text"], k)
            full = np.flatnonzero(np.diff(starts))
            data = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(starts.astype(np.int64) * 8), pa.py_buffer(np.ascontiguousarray(h))]).take(pa.array(full)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b["node"].take(pa.array(full)), data], ["node", "sh"])

    n = nodes.count()
    named = nodes.select("node", F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    rows = _marked(docs, id_col, text_col).join(F.broadcast(named) if n <= MAX_BROADCAST_ROWS else named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    out = materialise(rows.select("node", "text").mapInArrow(run, "node long, sh binary"), "wide-shingles")
    return out if out.count() == n else materialise(out.distinct(), "wide-shingles")


def block_bits(width: int, blocks: int) -> np.ndarray:
    """Which bits each block has: first disjoint ones, then those of further orders of all bits."""
    rng, out = np.random.default_rng(5), []
    order = np.arange(BITS)
    while len(out) < blocks:
        out += [order[i : i + width] for i in range(0, BITS - width + 1, width)][: blocks - len(out)]
        order = rng.permutation(BITS)
    return np.stack(out)


def _keys(fp: np.ndarray, blocks: np.ndarray, first: int) -> np.ndarray:
    """The value of each block of each fingerprint (rows of bytes), 64-bit hashes that include the block's number, which is first and so on."""
    bits = np.unpackbits(fp, axis=1, bitorder="little")
    out = np.zeros((len(fp), len(blocks)), np.uint64)
    for j, own in enumerate(blocks):
        v = np.zeros(len(fp), np.uint64)
        for i in own:
            v = v << np.uint64(1) | bits[:, i]
        out[:, j] = v
    number = np.arange(first, first + len(blocks), dtype=np.uint64)
    out = (out ^ (number << np.uint64(56))) * np.uint64(0xBF58476D1CE4E5B9) + number
    return out ^ out >> np.uint64(31)


def _sketches(batches, blocks: np.ndarray, first: int):
    """Rows (key, node, root, a, b) for each block, whose numbers are first and so on: the first SKETCH bits as two longs."""
    for rows in batches:
        for s in range(0, len(rows), 2000):
            part = rows.slice(s, 2000)
            fp = np.frombuffer(b"".join(part["fp"].to_pylist()), np.uint8).reshape(-1, BITS // 8)
            a, b = np.ascontiguousarray(fp[:, : SKETCH // 8]).view(np.int64).T
            row = np.repeat(np.arange(len(part)), len(blocks))
            keys = _keys(fp, blocks, first).ravel().view(np.int64)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys), part["node"].take(at), part["root"].take(at), pa.array(a[row]), pa.array(b[row])], ["key", "node", "root", "a", "b"])


def sketch_distance(most: int) -> int:
    """How far apart the sketches of two fingerprints that differ in `most` bits may be."""
    share = most / BITS
    return math.ceil(SKETCH * share + DEVIATIONS * math.sqrt(SKETCH * share * (1 - share) * (1 - SKETCH / BITS)))


def _near_rows(batches, most: int):
    """Rows sorted by key: (key, node, root) of those that may have a partner of another root. Larger buckets of several roots and those at a batch's ends go on untested."""
    for rows in batches:
        key, node, root, a, b = (rows[c].to_numpy() for c in ("key", "node", "root", "a", "b"))
        if not len(key):
            continue
        sketch = np.stack([a, b], axis=1).view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key) != 0) + 1, [len(key)]])
        size = np.diff(cuts)
        group = np.repeat(np.arange(len(size)), size)
        tested = size <= SMALL
        tested[[0, -1]] = False
        mixed = np.minimum.reduceat(root, cuts[:-1]) != np.maximum.reduceat(root, cuts[:-1])
        mixed[[0, -1]] = True
        near = (~tested & mixed)[group]
        for o in range(1, int(size[tested].max(initial=1))):
            i = np.flatnonzero((group[o:] == group[:-o]) & tested[group[o:]] & (root[o:] != root[:-o]))
            i = i[_distance(sketch[i], sketch[i + o]) <= most]
            near[i] = near[i + o] = True
        yield pa.RecordBatch.from_arrays([pa.array(key[near]), pa.array(node[near]), pa.array(root[near])], ["key", "node", "root"])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _small_pairs(batches, most: int):
    """Rows (key, node, root, fp) sorted by key, buckets of SMALL rows or fewer: all pairs (u, v) of different roots within `most` bits."""
    key, node, root, fp = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BITS // 64), np.uint64)

    def pairs(key, node, root, fp):
        for o in range(1, len(key)):
            i = np.flatnonzero(key[o:] == key[:-o])
            if not len(i):
                break
            i = i[root[i] != root[i + o]]
            i = i[_distance(fp[i], fp[i + o]) <= most]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[i + o])), pa.array(np.minimum(node[i], node[i + o]))], ["u", "v"])

    for b in batches:
        key = np.concatenate([key, b["key"].to_numpy()])
        node = np.concatenate([node, b["node"].to_numpy()])
        root = np.concatenate([root, b["root"].to_numpy()])
        fp = np.concatenate([fp, np.frombuffer(b"".join(b["fp"].to_pylist()), np.uint64).reshape(-1, BITS // 64)])
        done = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
        yield from pairs(key[:done], node[:done], root[:done], fp[:done])
        key, node, root, fp = key[done:], node[done:], root[done:], fp[done:]
    yield from pairs(key, node, root, fp)


def _similar(both, size_u, size_v, similarity: float):
    return both >= similarity * (size_u + size_v - both) - 1e-9


def _verified(batches, similarity: float):
    """Rows (u, v, a, b) with the shingles of u and v: the pairs (u, v) whose similarity is great enough."""
    for rows in batches:
        keep = np.zeros(len(rows), bool)
        for i, (a, b) in enumerate(zip(rows["a"], rows["b"], strict=True)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            keep[i] = _similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), similarity)
        yield rows.select(["u", "v"]).filter(pa.array(keep))


class Overlaps:
    """How many shingles pairs of some texts share; by bit sets over the shingles that several texts hold, if those are small enough."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size, self.bits = sets, np.fromiter(map(len, sets), np.int64, len(sets)), None
        every, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        width = -(-int((times > 1).sum()) // 64) * 64
        if width * len(sets) <= BIT_BYTES * 8:
            own = np.repeat(np.arange(len(sets)), self.size)
            hit = times[code] > 1
            own, code = own[hit], shared[code[hit]]
            self.bits = np.zeros((len(sets), width // 64), np.uint64)
            for i in range(64):
                at = code % 64 == i
                self.bits[own[at], code[at] // 64] |= np.uint64(1 << i)

    def of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(u, v, strict=True)], np.int64)
        step = max(1, (8 << 20) // max(1, self.bits.shape[1] * 8))
        return np.concatenate([_distance_and(self.bits[u[s : s + step]], self.bits[v[s : s + step]]) for s in range(0, len(u), step)])


def _distance_and(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a & b).sum(axis=-1, dtype=np.int64)


def forest(fp: np.ndarray, sets: list[np.ndarray], side: np.ndarray, root: np.ndarray, most: int, similarity: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs that connect what all verified pairs do. side: part of a text; if there are two, only pairs of both are looked at.
    root: component of a text so far; pairs inside one are not looked at.

    Pairs are compared in squares of step rows and verified in the order of their distances, but not if they are connected already.
    """
    overlaps = Overlaps(sets)
    _, head, own = np.unique(root, return_index=True, return_inverse=True)
    parent, out = head[own], []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    parts = [np.flatnonzero(side == x) for x in np.unique(side)]
    left, right = parts[0], parts[-1]
    for i in range(0, len(left), step):
        for j in range(i if len(parts) == 1 else 0, len(right), step):
            d = _distance(fp[left[i : i + step], None, :], fp[None, right[j : j + step], :])
            u, v = np.nonzero(d <= most)
            order = np.argsort(d[u, v], kind="stable")
            u, v = left[u[order] + i], right[v[order] + j]
            while len(u):
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                apart = parent[u] != parent[v]
                u, v = u[apart], v[apart]
                x, y = u[:PAIRS], v[:PAIRS]
                u, v = u[PAIRS:], v[PAIRS:]
                good = _similar(overlaps.of(x, y), overlaps.size[x], overlaps.size[y], similarity) if len(x) else np.zeros(0, bool)
                for a, b in zip(x[good].tolist(), y[good].tolist(), strict=True):
                    ra, rb = find(a), find(b)
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
                        out.append((a, b))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _forests(batches, most: int, similarity: float):
    """Rows (key, i, j, part, node, root, fp, sh) sorted by key, i and j: each group's spanning forest of verified pairs (u, v)."""
    held, now = [], None

    def links():
        *columns, sh = (list(x) for x in zip(*held, strict=True))
        part, node, root, fp = map(np.concatenate, columns)
        a, b = forest(fp, [np.frombuffer(x, np.uint64) for y in sh for x in y], part, root, most, similarity)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], ["u", "v"])

    for b in batches:
        key, i, j = (b[c].to_numpy() for c in ("key", "i", "j"))
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1), len(key)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            if now != (key[x], i[x], j[x]):
                if held:
                    yield links()
                    release()
                held, now = [], (key[x], i[x], j[x])
            some = b.slice(x, y - x)
            fp = np.frombuffer(b"".join(some["fp"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            held.append((some["part"].to_numpy(), some["node"].to_numpy(), some["root"].to_numpy(), fp, some["sh"].to_pylist()))
    if held:
        yield links()
        held.clear()
        release()


def _parts(rows: Column, shingles: Column) -> Column:
    """How many parts so many rows with so many shingles are cut into."""
    return F.greatest(F.ceil(F.greatest(rows / F.lit(BUCKET), shingles * 8 / F.lit(BUCKET_BYTES))), F.lit(1)).cast("int")


def _with_pivots(large: DataFrame) -> DataFrame:
    """large: key, node, root, m. Groups (key, i, j) of a pivot (part 0) and rows of its buckets (part 1) that are of other roots; key is the pivot.

    Pivots are the rows of the least hashes, whatever the bucket, so that buckets of one group of copies have the same ones and
    each pair is compared once.
    """
    least = F.array(*(F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node", "root")) for k in range(PIVOTS)))
    named = F.array_distinct(F.transform(least, lambda x: F.struct(x["node"].alias("node"), x["root"].alias("root"))))
    of_key = materialise(large.groupBy("key").agg(named.alias("pivots"), F.count("*").alias("rows")), "wide-pivots")
    pairs = attach(large, of_key, "key", "rows").select(F.explode("pivots").alias("p"), "node", "root", "m")
    pairs = materialise(pairs.where("root != p.root").select(F.col("p.node").alias("key"), F.col("p.root").alias("own"), "node", "root", "m").distinct(), "wide-pivot-pairs")
    size = materialise(pairs.groupBy("key", "own").agg(_parts(F.count("*"), F.sum("m")).alias("parts"), F.count("*").alias("rows")), "wide-pivot-parts")
    rows = attach(pairs.select("key", "node", "root"), size.select("key", "parts", "rows"), "key", "rows").select("key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), F.lit(1).alias("part"), "node", "root")
    heads = size.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("part"), F.col("key").alias("node"), F.col("own").alias("root"))
    return rows.unionByName(heads).select("key", "i", F.lit(0).alias("j"), "part", "node", "root")


def _dealt(labelled: DataFrame) -> DataFrame:
    """labelled: key, node, root, m. The rows with the groups (key, i, j) and the part that they are compared in.

    Rows outside a bucket's largest component meet all its rows; those inside meet only these. Both are cut into parts
    of about BUCKET rows or BUCKET_BYTES of shingles by a hash, and each two parts that have to meet are a group, so every pair of
    different components meets in one group, none grows with its bucket, and a bucket of one component has no group.
    """
    by_root = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    top = F.max(F.struct("n", "root", "m"))
    sums = by_root.groupBy("key").agg(top.alias("top"), F.sum("n").alias("rows"), F.sum("m").alias("m")).where("rows > top.n")
    size = sums.select("key", F.col("top.root").alias("top"), _parts(F.col("rows") - F.col("top.n"), F.col("m") - F.col("top.m")).alias("outer"), _parts(F.col("top.n"), F.col("top.m")).alias("inner"), "rows")
    cut = attach(labelled.select("key", "node", "root"), materialise(size, "wide-parts"), "key", "rows").where("top is not null")
    h, outside = F.xxhash64("node", "key"), F.col("root") != F.col("top")
    cut = cut.withColumn("part", F.when(outside, F.pmod(h, F.col("outer"))).otherwise(F.col("outer") + F.pmod(h, F.col("inner"))).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)))
    return cut.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "root")


def _proposed(labelled: DataFrame, nodes: DataFrame, blocks: np.ndarray, first: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """What these blocks, whose numbers are first and so on, propose: distinct candidates (u, v) of small buckets, and the rows (key, node, root, m) of larger ones, if there are any."""
    apart = sketch_distance(most)
    met = labelled.select("node", "fp", "root").mapInArrow(lambda it: _sketches(it, blocks, first), "key long, node long, root long, a long, b long")
    met = met.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _near_rows(it, apart), "key long, node long, root long")
    near = materialise(met, "wide-near")
    many = materialise(near.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL), "wide-large")
    small, large, read = near, None, [near]
    if not many.isEmpty():
        marked = materialise(attach(near, many, "key", "n"), "wide-marked")
        small, large = marked.where("n is null").select("key", "node", "root"), marked.where("n is not null")
        large = materialise(large.join(nodes.select("node", "m"), "node").select("key", "node", "root", "m"), "wide-rows")
        read.append(marked)
    whole = small.join(nodes.select("node", "fp"), "node").select("key", "node", "root", "fp").repartition("key").sortWithinPartitions("key", "node")
    pairs = materialise(whole.mapInArrow(lambda it: _small_pairs(it, most), "u long, v long").where("u != v").distinct(), "wide-pairs")
    discard(*read)
    return pairs, large


def _components_by(docs: DataFrame, nodes: DataFrame, parts: DataFrame | None, sh: DataFrame | None, blocks: np.ndarray, k: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the links so far (parts) and of those that the blocks propose, and the shingles that were read so far (sh). Nodes of one root are not compared.

    Without parts, rows of larger buckets meet their pivots alone; with them, all that they have to.
    """
    most = reach(similarity)
    root = F.col("node").alias("root") if parts is None else F.coalesce("root", "node").alias("root")
    labelled = (nodes if parts is None else nodes.join(parts, "node", "left")).select("node", "fp", root)
    passes = np.array_split(np.arange(len(blocks)), -(-len(blocks) // PASS))
    labelled = labelled if len(passes) == 1 else materialise(labelled, "wide-labelled")
    said = [_proposed(labelled, nodes, blocks[own], int(own[0]), most) for own in passes]
    pairs, larges = reduce(DataFrame.unionByName, (p for p, _ in said)), [x for _, x in said if x is not None]
    pairs = pairs if len(said) == 1 else materialise(pairs.distinct(), "wide-pairs")
    asked = reduce(DataFrame.unionByName, [pairs.select(F.col("u").alias("node")), pairs.select(F.col("v").alias("node")), *(x.select("node") for x in larges)]).distinct()
    asked = asked if sh is None else asked.join(sh.select("node"), "node", "left_anti")
    more = shingles_of(docs, materialise(nodes.select("node", "least.doc_id", "least.mark").join(asked, "node", "left_semi"), "wide-asked"), k, id_col, text_col)
    sh = more if sh is None else sh.unionByName(more)
    of = lambda end, name: sh.select(F.col("node").alias(end), F.col("sh").alias(name))
    links = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(lambda it: _verified(it, similarity), "u long, v long")
    links = links if parts is None else links.unionByName(parts.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = materialise(links, "wide-links")
    deal, held = _with_pivots if parts is None else _dealt, sh
    if len(larges) > 1:  # each of them is joined to the shingles, of which few are theirs
        held = materialise(sh.join(reduce(DataFrame.unionByName, [x.select("node") for x in larges]).distinct(), "node", "left_semi"), "wide-held")
    for large in larges:
        rows = deal(large).join(nodes.select("node", "fp"), "node").join(held, "node").select("key", "i", "j", "part", "node", "root", "fp", "sh")
        rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        links = links.unionByName(materialise(rows.mapInArrow(lambda it: _forests(it, most, similarity), "u long, v long"), "wide-forests"))
    return materialise(connected_components(links), "wide-components"), sh


def similar_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs that has a word: doc_id, mark (a hash of its text), component_id, stays.

    A link is a candidate whose shingle sets have a Jaccard similarity of `similarity` or more. Texts with equal fingerprints are one
    node. A text of fewer than k words has its whole sequence as its one shingle. Null texts and texts without words are no copies of
    each other and have no row. Rows are judged by their own texts: rows of one doc_id with different texts need not be of one component. Of a component the
    text of the smallest doc_id stays (null is the largest; of texts of one doc_id that of the smallest hash), and component_id is its doc_id.
    """
    fp = materialise(wide_fingerprints(docs, k, id_col, text_col), "wide")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    nodes = fp.groupBy("fp").agg(least.alias("least"), F.max("m").alias("m"), F.count("*").alias("n"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
    n = nodes.count()
    width = max(16, math.ceil(math.log2(max(n, 2))))
    share = differing_share(similarity)
    blocks = block_bits(width, max(BITS // width, math.ceil(math.log(1 / (1 - RECALL)) / (1 - share) ** width)))
    parts = sh = None
    for own in (blocks[:FIRST], blocks):
        parts, sh = _components_by(docs, nodes, parts, sh, own, k, similarity, id_col, text_col)
    linked = nodes.select("node", "least").join(parts, "node")
    first = materialise(linked.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("size")), "wide-firsts")
    of_node = attach(linked, first, "root", "size").select("node", "first")
    told = nodes.join(of_node, "node", "left").where("n > 1 or first is not null").select("fp", F.coalesce("first", "least").alias("first"), "n")
    out = attach(fp.select("doc_id", "mark", "fp"), materialise(told, "wide-told"), "fp", "n")
    stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    return out.select("doc_id", "mark", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), stays.alias("stays"))


def drop_similar(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of similar_components, the one that stays; of rows equal in doc_id and text one. Rows without a word stay."""
    said = materialise(similar_components(docs, k, similarity), "similar-rows")
    named = lambda d: d.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__told")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__told"))
    small = lambda d: F.broadcast(d) if d.count() <= MAX_BROADCAST_ROWS else d
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    out = marked.join(small(materialise(named(said.where("not stays")), "similar")), same, "left_anti")
    twice = materialise(named(said.where("stays").groupBy("doc_id", "mark").count().where("count > 1")), "similar-twice")
    if not twice.isEmpty():
        some = small(twice)
        out = out.join(some, same, "left_anti").unionByName(out.join(some, same, "left_semi").dropDuplicates(["doc_id", "__mark"]))
    return out.select(*docs.columns)
