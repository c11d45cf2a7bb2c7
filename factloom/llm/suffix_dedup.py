"""Repeated strings out of texts by suffix order and longest-previous-factor tests (operator 13).

A string of `length` bytes that stands in two places has the same least K-gram hash in both (its minimiser). So the window starts of a text
are cut into runs of one minimiser, its segments; the windows of a segment meet the windows of other segments of that minimiser and no others. Segments are
a hundredth of all bytes in number, and only their hashes are shuffled:

1. Segments whose bytes are equal (group by their hash) are repeated whole: every occurrence but the first has an earlier factor of full length.
2. Of each distinct segment whose minimiser has other distinct segments, or stands several times in it, one occurrence is read again, with its bytes. All segments of a minimiser
   go to one suffix order: windows sorted by their bytes (prefix doubling) and, if equal, by their place in the corpus. There the nearest place in
   the order with a smaller position and a common prefix of `length` is the neighbour before (an earlier factor: later copies), and the one with a
   larger position is the neighbour after (with both: any copy).
3. Minimisers with more bytes than a task should hold (a line that stands in millions of different texts) send a hash of each of their windows instead:
   equal windows are one group, whatever its size.

Texts are numbered by (doc_id, hash of the text); their spans are joined back to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, attach, discard, id_and_text, materialise, table
from .words import ranges, slices

#: Bytes of the grams whose least hash is a window's minimiser (fewer for short lengths).
K = 32
#: Windows of a segment at most.
SEGMENT = 512
#: Bytes of segments of one minimiser that a suffix order takes; beyond, its windows are grouped by their hashes.
ORDER_BYTES = 1 << 20
#: Spans in all that are broadcast to the texts; more are joined by a shuffle.
MAX_BROADCAST_SPANS = 4 * MAX_BROADCAST_ROWS
#: Bytes of a text that are looked at together; longer ones go in pieces.
PIECE = 4 << 20
_BYTE = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on, by doubling; at the end, where k bytes do not fit, there is none."""
    h, have = _BYTE[raw], 1
    while 2 * have <= k and len(h) > have:
        h = _mixed(h[:-have] * np.uint64(0x9E3779B97F4A7C15) + h[have:])
        have *= 2
    n, rest = len(raw) - k + 1, k - have
    return _mixed(h[:n] * np.uint64(0x94D049BB133111EB) + h[rest : rest + n]) if n > 0 else h[:0]


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values that follow each other, by doubling."""
    have = 1
    while 2 * have <= width and len(h) > have:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return h if not rest else np.minimum(h[:-rest], h[rest:]) if len(h) > rest else h[:0]


def segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts of one minimiser in texts that lie behind each other: text, first start in it, number of windows, minimiser, whether it has that several times."""
    k = min(K, -(-length // 2))
    grams = gram_hashes(raw, k)
    least = window_minima(grams, length - k + 1)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    at = ranges(offsets[:-1], sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(at)))
    cuts = -(-run // SEGMENT)  # long runs (one letter again and again) go in pieces
    piece = ranges(np.zeros(len(cuts), np.int64), cuts)
    head = np.repeat(head, cuts) + piece * SEGMENT
    many = np.minimum(np.repeat(run, cuts) - piece * SEGMENT, SEGMENT)
    text, start, own = owner[head], at[head], value[head]
    ends = (start + many + length - k).tolist()
    twice = np.fromiter((np.count_nonzero(grams[s:e] == h) > 1 for s, e, h in zip(start.tolist(), ends, own, strict=True)), bool, len(own))
    return text, start - offsets[text], many, own, twice


def order_repeats(raw: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of `length` bytes of raw from `starts` on: whether an equal one stands at a smaller place, and whether another is equal at all.

    place: the windows' order in the corpus. The windows are put into suffix order, as far as `length` bytes tell, by prefix doubling: the rank of 2 n
    bytes is that of the pair of ranks of n bytes, and two such ranks that overlap rank `length` bytes. In that order equal windows stand
    together, by place: a window's previous smaller position shares its `length` bytes if it is not the first of them (its longest previous factor is
    that long), its next larger one if it is not the last.
    """
    have, padded = min(8, length), np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.zeros(len(raw), np.uint64)
    for i in range(have):
        key = key << np.uint64(8) | padded[i : i + len(raw)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while 2 * have <= length:
        pair = rank << np.uint64(32)
        pair[:-have] |= rank[have:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        have *= 2
    key = rank[starts] << np.uint64(32) | rank[starts + (length - have)]
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(key)))
    earlier, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order] = place > np.repeat(place[head], size)
    other[order] = np.repeat(size, size) > 1
    return earlier, other


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and where each starts (one more: the end)."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, number of the first text, its bytes before): all texts at once, or a single very long one in overlapping pieces."""
    if len(raw) <= PIECE or len(offsets) > 2:
        yield raw, offsets, 0, 0
        return
    for at in range(0, max(1, len(raw) - length + 1), PIECE):
        part = raw[at : at + PIECE + length - 1]
        yield part, np.array([0, len(part)]), 0, at


def _long(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as binary values."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x) // 16, [None, pa.py_buffer(x)]).cast(pa.binary())


def _segment_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, start, many, h (minimiser), twice, c (128-bit hash of the bytes) of each segment of the texts."""
    for b in slices(batches):
        for raw, offsets, _, base in _pieces(*_bytes_of(b["text"]), length):
            text, start, many, h, twice = segments(raw, offsets, length)
            view, digest, at = memoryview(np.ascontiguousarray(raw)), xxhash.xxh3_128_digest, offsets[text] + start
            c = b"".join(digest(view[s:e]) for s, e in zip(at.tolist(), (at + many + length - 1).tolist(), strict=True))
            own = pa.array(text)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(own), b["mark"].take(own), _long(start + base), _long(many), _long(h), pa.array(twice), _fixed(np.frombuffer(c, np.uint8))], ["doc_id", "mark", "start", "many", "h", "twice", "c"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, mark, text, asked): the bytes of each asked segment, or, if its minimiser has too many, the hashes of its windows.

    Rows of windows have as data the 16 bytes of (minimiser, hash), and many = 0.
    """
    for b in slices(batches):
        raw, offsets = _bytes_of(b["text"])
        lists = b["asked"]
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        start, many, h, n, big = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "many", "h", "n", "big"))
        text = np.repeat(np.arange(len(b)), sizes)
        at = offsets[text] + start
        small = np.flatnonzero(~big)
        out = [(text[small], start[small], many[small], h[small], n[small], _slices_of(raw, at[small], many[small] + length - 1))]
        for i in np.flatnonzero(big).tolist():
            own = gram_hashes(raw[at[i] : at[i] + many[i] + length - 1], length)
            pair = np.stack([np.full(len(own), h[i]).view(np.uint64), own], axis=1)
            all_of = lambda x: np.full(len(own), x)  # noqa: B023, E731
            out.append((all_of(text[i]), start[i] + np.arange(len(own)), all_of(0), all_of(h[i]), all_of(n[i]), _fixed(pair.view(np.uint8).ravel())))
        for own, s, m, key, times, data in out:
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(own), b["mark"].take(own), _long(s), _long(m), _long(key), _long(times), data], ["doc_id", "mark", "start", "many", "h", "n", "data"])


def _slices_of(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw[ranges(at, size)])]).cast(pa.binary())


def _ordered(batches: Iterator[pa.RecordBatch], length: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Segments with their bytes, sorted by minimiser: (doc_id, mark, start, end) of what a suffix order of whole minimisers finds repeated."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        raw, offsets = _bytes_of(rows["data"].combine_chunks() if isinstance(rows["data"], pa.ChunkedArray) else rows["data"])
        doc, mark, start, many, n = (rows[c].to_numpy() for c in ("doc_id", "mark", "start", "many", "n"))
        null = rows["doc_id"].is_null().to_numpy()
        place = np.lexsort((start, mark, np.where(null, 0, doc), null))
        number = np.empty(len(rows), np.int64)
        same = np.zeros(len(rows), bool)
        a, z = place[:-1], place[1:]
        same[1:] = (start[a] == start[z]) & (mark[a] == mark[z]) & ((doc[a] == doc[z]) | (null[a] & null[z])) & (null[a] == null[z])
        number[place] = np.cumsum(~same)
        own = np.repeat(np.arange(len(rows)), many)
        inside = ranges(np.zeros(len(rows), np.int64), many)
        # segments of one text do not share starts, so the order of (segment, start) is that of all windows
        earlier, other = order_repeats(raw, offsets[own] + inside, number[own] * (SEGMENT + 1) + inside, length)
        hit = np.flatnonzero(earlier if first else other & (n[own] == 1))
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (own[hit[1:]] != own[hit[:-1]])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hit)) - 1
        whose = own[hit[head]]
        took = pa.array(whose)
        return pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().take(took), rows["mark"].combine_chunks().take(took), _long(start[whose] + inside[hit[head]]), _long(start[whose] + inside[hit[tail]] + length)], ["doc_id", "mark", "start", "end"])

    held, size = [], 0
    for b in batches:
        h = b["h"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
        sizes = np.concatenate([[0], np.cumsum(b["many"].to_numpy() + length - 1)])
        at = 0
        for x in cuts:
            # a slab ends before a new minimiser only
            new = x < len(h) and (x > 0 or not held or held[-1]["h"][-1].as_py() != h[0])
            if new and size + sizes[x] - sizes[at] >= ORDER_BYTES:
                held.append(b.slice(at, x - at))
                yield spans(pa.Table.from_batches([y for y in held if len(y)]))
                held, size, at = [], 0, x
        if at < len(h):
            held.append(b.slice(at))
            size += int(sizes[-1] - sizes[at])
    if held:
        yield spans(pa.Table.from_batches(held))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, spans (start, end): each text's spans, in order, overlapping and touching ones as one."""
    for b in batches:
        sizes = np.diff(b["spans"].offsets.to_numpy())
        flat = b["spans"].flatten()
        start, end = (flat.field(c).to_numpy() for c in ("start", "end"))
        own = np.repeat(np.arange(len(b)), sizes)
        far = int(end.max(initial=0)) + 2
        order = np.lexsort((start, own))
        own, start, end = own[order], start[order] + own[order] * far, end[order] + own[order] * far
        reach = np.maximum.accumulate(end)
        new = np.ones(len(own), bool)
        new[1:] = start[1:] > reach[:-1]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(own)) - 1
        text = own[head]
        values = pa.StructArray.from_arrays([_long(start[head] - text * far), _long(reach[tail] - text * far)], ["start", "end"])
        offsets = pa.array(np.searchsorted(text, np.arange(len(b) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["mark"], pa.ListArray.from_arrays(offsets, values)], ["doc_id", "mark", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, spans, kept: the bytes outside the spans."""
    for b in slices(batches):
        raw, offsets = _bytes_of(b["text"])
        lists = b["spans"]
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        start, end = (flat.field(c).to_numpy() for c in ("start", "end"))
        base = offsets[np.repeat(np.arange(len(b)), sizes)]
        keep = np.ones(len(raw), bool)
        keep[ranges(base + start, end - start)] = False
        ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)[offsets]
        kept = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(raw[keep])]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b["doc_id"], _long(np.diff(offsets)), lists, kept], ["doc_id", "n_bytes", "spans", "kept"])


def _joined(rows: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """rows (doc_id, mark, text) with the list of each (doc_id, mark); few entries are broadcast."""
    count = lists.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("all")).first()
    named = lists.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), column)
    few = count["n"] <= MAX_BROADCAST_ROWS and count["all"] <= MAX_BROADCAST_SPANS
    return rows.join(F.broadcast(named) if few else named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), how).select("doc_id", "mark", "text", column)


def repeated_spans(docs: DataFrame, length: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), spans: for each text that has any, the maximal runs (start, end, in bytes) of strings of `length` that repeat.

    keep="none": every copy; keep="first": all but the first in the order of (doc_id, hash of the text, place), null ids last. A string may overlap its
    copy. Rows that share doc_id and text are copies of each other for "none", one document for "first".
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    first = keep == "first"
    rows = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    found = rows.mapInArrow(lambda it: _segment_rows(it, length), "doc_id long, mark long, start long, many long, h long, twice boolean, c binary")
    found = materialise(found, "suffix-segments")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")
    distinct = materialise(found.groupBy("c").agg(F.min("h").alias("h"), F.min("many").alias("many"), F.max("twice").alias("twice"), F.count("*").alias("n"), F.min(place).alias("least")), "suffix-distinct")
    copies = materialise(distinct.where("n > 1").select("c", "n", "least"), "suffix-copies")
    told = attach(found, copies, "c", "n").where("n > 1")
    whole = (told.where(place != F.col("least")) if first else told).select("doc_id", "mark", "start", (F.col("start") + F.col("many") + length - 1).alias("end"))
    size = F.sum(F.col("many") + length - 1)
    shared = materialise(distinct.groupBy("h").agg(F.count("*").alias("m"), size.alias("bytes"), F.max("twice").alias("twice")).where("m > 1 or twice").select("h", "m", "bytes"), "suffix-minimisers")
    met = attach(distinct.select("h", "many", "n", "least"), shared, "h", "m").where("m is not null")
    each = F.struct("least.start", "many", "h", "n", (F.col("bytes") > ORDER_BYTES).alias("big"))
    asked = materialise(met.groupBy("least.doc_id", "least.mark").agg(F.collect_list(each).alias("asked")), "suffix-asked")
    rows_of = "doc_id long, mark long, start long, many long, h long, n long, data binary"
    contexts = materialise(_joined(rows, asked, "asked", "inner").mapInArrow(lambda it: _contexts(it, length), rows_of), "suffix-contexts")
    by_order = contexts.where("many > 0").repartition("h").sortWithinPartitions("h")
    by_order = by_order.mapInArrow(lambda it: _ordered(it, length, first), "doc_id long, mark long, start long, end long")
    windows = contexts.where("many = 0").select("doc_id", "mark", "start", "n", "data")
    equal = materialise(windows.groupBy("data").agg(F.count("*").alias("times"), F.min(place).alias("least")).where("times > 1"), "suffix-windows")
    hit = attach(windows, equal, "data", "times").where("times > 1")
    hit = (hit.where(place != F.col("least")) if first else hit.where("n = 1")).select("doc_id", "mark", "start", (F.col("start") + length).alias("end"))
    spans = whole.unionByName(by_order).unionByName(hit).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = materialise(spans.mapInArrow(_merged, "doc_id long, mark long, spans array<struct<start:long,end:long>>"), "suffix-spans")
    discard(found, distinct, copies, shared, asked, contexts, equal)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (of its UTF-8 text), spans (removed, see repeated_spans) and kept (the bytes that are left, which may cut a character).

    Null texts are empty, and texts shorter than `length` have no spans; an empty table gives none. Other columns of docs are left behind.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    with_spans = _joined(rows, repeated_spans(docs, length, keep, id_col, text_col), "spans", "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    return with_spans.select("doc_id", "text", F.coalesce("spans", none).alias("spans")).mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document: strings of 200 bytes that stand anywhere else are removed."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
