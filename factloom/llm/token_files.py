"""Flat token-ID files in the shared folder: written in doc_id order with 64-bit offsets, read back memory-mapped (operator 2).

A data set is a folder of shards. Shard k holds the documents whose doc_id lies between the k-th and the next of the
shard bounds, in ascending order, null doc_ids first:

* ``shard-<k>.bin``: the token ids alone, little-endian unsigned 16 bit where the vocabulary fits, else 32 bit;
* ``shard-<k>.idx``: n + 1 little-endian unsigned 64-bit offsets, in ids from the shard's start;
* ``shard-<k>.doc``: n little-endian signed 64-bit doc_ids (NULL_ID for null).

``manifest`` is a Parquet table with one row for each shard; a shard's base (ids of all documents before it) is the
prefix sum of the shards' sizes. A task writes each file under a name of its own and renames it when it is complete, so
a lost or repeated task leaves no half-written shard.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ARROW_BYTES, id_and_text, scratch, settings
from .words import ranges, slices

NULL_ID = -(1 << 63)
#: Bytes of text of a shard, about: at least the first, and from MANY shards on more, up to the second.
SHARD_BYTES, MANY = (16 << 20, 1 << 30), 4096
#: Bytes of text that are encoded at once: of more text fewer words are new.
ENCODE_BYTES = 8 << 20
#: Distinct pieces of text whose ids a process keeps, and the bytes of the longest of them.
CACHE_PIECES, LONGEST_CACHED = 1_000_000, 128
#: Characters of pieces that are encoded as one text.
JOINED = 1 << 15
TAIL = ".,;:!?*&%$#()[]{}<>-+=_/\\\"@^~|`"


class ChunkEncoder:
    """Encodes texts with a ``tokenizers`` file whose pre-tokenizer drops white space.

    Tokens of such a vocabulary never cross white space, so each distinct piece of text between spaces or line ends is
    encoded by the library once (as long as the cache holds it) and a text's ids are put together from its pieces'.
    ASCII punctuation that closes a piece is a piece of its own, and pieces are looked up in lower case, for such a
    vocabulary makes them so anyway; pieces where that could make a difference (letters that NFC changes among them) stay as they are.
    special_as_text: the strings of special tokens in a text are ordinary text; otherwise they are these tokens, as by the library's default.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self._clear()

    def _clear(self) -> None:
        self.known, self.uses = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all their ids.

        Many pieces go to the library as one text with spaces between them, which costs less than a text for each; an id's
        place in that text says whose it is.
        """
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        size, flat, lo = [], [], 0
        while lo < len(pieces):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + JOINED, side="right")))
            made = self.tok.encode(" ".join(pieces[lo:hi]), add_special_tokens=False)
            ids = made.ids
            at = np.fromiter((x for x, _ in made.offsets), np.int64, len(ids))
            size.append(np.bincount(np.searchsorted(ends[lo:hi] - before, at, side="right"), minlength=hi - lo))
            flat.append(np.array(ids, np.uint32))
            lo = hi
        return np.concatenate(size), np.concatenate(flat)

    def _forget(self) -> None:
        """Drop long pieces; of too many, those that few slices had."""
        keep = pc.binary_length(self.known).to_numpy(zero_copy_only=False) <= LONGEST_CACHED
        if np.count_nonzero(keep) > CACHE_PIECES:
            keep &= self.uses > 1
            if np.count_nonzero(keep) > CACHE_PIECES // 2:
                often = np.argsort(np.where(keep, -self.uses, 0), kind="stable")[: CACHE_PIECES // 2]
                keep[:] = False
                keep[often] = True
            self.uses = self.uses >> 1
        if not keep.all():
            self.flat = self.flat[ranges((np.cumsum(self.size) - self.size)[keep], self.size[keep])]
            self.known, self.uses, self.size = self.known.filter(pa.array(keep)), self.uses[keep], self.size[keep]

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of some distinct pieces' ids start, how many they are, and the array they lie in."""
        found = pc.index_in(pieces, value_set=self.known)
        own, had = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), found.is_valid().to_numpy(zero_copy_only=False)
        self.uses[own[had]] += 1
        if not had.all():
            new = pieces.filter(found.is_null())
            size, ids = self._encode(new.to_pylist())
            own[~had] = np.arange(len(self.known), len(self.known) + len(new))
            self.known, self.uses = pa.concat_arrays([self.known, new]), np.concatenate([self.uses, np.ones(len(new), np.int64)])
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        out = (np.cumsum(self.size) - self.size)[own], self.size[own], self.flat
        if not had.all():
            self._forget()
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's start (one more: the end)."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        whole = flat.dictionary
        core = pc.utf8_rtrim(whole, TAIL)
        safe = pc.and_not(pc.match_substring_regex(core, r"[\pL\pN]$"), pc.match_substring_regex(whole, "<\\||\u03a3|\u0130"))
        # a letter that composition takes apart ends in a mark, which stays with the punctuation after it
        foreign = core.filter(pc.invert(pc.string_is_ascii(core)))
        changed = foreign.filter(pc.not_equal(foreign, pc.utf8_normalize(foreign, "NFC")))
        safe = pc.and_not(safe, pc.is_in(core, changed)) if len(changed) else safe
        keep = pc.binary_length(core).to_numpy(zero_copy_only=False)
        ok = safe.to_numpy(zero_copy_only=False)
        rest = pc.binary_length(whole).to_numpy(zero_copy_only=False) - keep
        long_tail = np.flatnonzero(ok & (rest > 0))
        tails = [w[-k:] for w, k in zip(whole.take(pa.array(long_tail)).to_pylist(), rest[long_tail].tolist(), strict=True)]
        n = len(whole)
        coded = pa.concat_arrays([pc.if_else(safe, pc.utf8_lower(core), whole), pa.array(tails, pa.large_string())]).dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False)
        at, size, ids = self.pieces(coded.dictionary)
        # ids of a chunk: of its head, then of its tail
        two, two_size = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        two[:, 0], two_size[:, 0] = at[place[:n]], size[place[:n]]
        two[long_tail, 1], two_size[long_tail, 1] = at[place[n:]], size[place[n:]]
        ids = ids[ranges(two.ravel(), two_size.ravel())]
        size = two_size.sum(axis=1)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        lengths = size[codes]
        return ids[ranges((np.cumsum(size) - size)[codes], lengths)], np.concatenate([[0], np.cumsum(lengths)])[offsets]


@lru_cache(1)
def shared(path: str, special_as_text: bool = True) -> ChunkEncoder:
    """One for all tasks of a process."""
    return ChunkEncoder(path, special_as_text)


def closed(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with end_id appended."""
    n = len(starts) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    sizes = np.diff(starts)
    to = starts[:-1] + np.arange(n)
    out[ranges(to, sizes)] = ids
    return out, starts + np.arange(n + 1)


def packed(ids: np.ndarray, starts: np.ndarray, dtype: str) -> pa.Array:
    """One binary value for each text."""
    size = np.dtype(dtype).itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids.astype(dtype)))]).cast(pa.binary())


def qualified(spark: SparkSession, uri: str) -> str:
    """The path with its scheme: one without is of the cluster's default file system, as for Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a qualified path."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme == "s3a" else uri)


def _put(fs: pafs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
    """Write under another name, then rename: a file under its own name is complete."""
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as f:
        for x in parts:
            f.write(x)
    fs.move(own, path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array; memory-mapped where the store is a file system of the machine."""
    fs, path = _store(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return np.frombuffer(f.read_buffer(), dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def dtype_for(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _ordered(doc_id: pa.Array, mark: pa.Array) -> np.ndarray:
    """(doc_id, mark) as values that can be compared, null ids first."""
    out = np.zeros(len(doc_id), [("doc_id", np.int64), ("mark", np.int64)])
    out["doc_id"], out["mark"] = (pc.fill_null(x, NULL_ID).to_numpy(zero_copy_only=False) for x in (doc_id, mark))
    return out


def shard_bounds(data: DataFrame, shards: int) -> np.ndarray:
    """The first (doc_id, mark) of each shard but the first one; Spark's range partitioner deals the ids, and a row for each shard comes back."""
    if shards == 1:
        return _ordered(pa.array([], pa.int64()), pa.array([], pa.int64()))
    dealt = data.select("doc_id", "mark").repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "mark")
    own = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "mark")
    first = dealt.groupBy(F.spark_partition_id().alias("shard")).agg(F.min(own).alias("x")).select("x.doc_id", "x.mark").toArrow()
    return np.sort(_ordered(first["doc_id"].combine_chunks(), first["mark"].combine_chunks()))[1:]


def write_token_files(docs: DataFrame, make_encoder: Callable, end_id: int, vocabulary: int, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every document (null text: empty) and end_id after each; returns the manifest.

    make_encoder: called once in each task, gives an object with batch(texts), which may be one for all tasks of a process. Ids are made where the text is read;
    only the packed ids are shuffled, once, to the shard of their doc_id. Shards follow the bytes of text. Repeated doc_ids stand side by side,
    in the order of a hash of their texts, and may go on in the next shard; null doc_ids come first; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    uri = qualified(spark, uri or scratch(spark, "tokens"))
    data = id_and_text(docs, id_col, text_col, F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    size = data.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // min(max(SHARD_BYTES[0], size // MANY), SHARD_BYTES[1])))
    bounds = shard_bounds(data, shards)
    dtype = dtype_for(vocabulary)

    def encode(batches):
        enc = make_encoder()
        for b in slices(batches, size=ENCODE_BYTES):
            ids, starts = closed(*enc.batch(b["text"]), end_id)
            shard = np.searchsorted(bounds, _ordered(b["doc_id"], b["mark"]), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b["doc_id"], b["mark"], packed(ids, starts, dtype)], ["shard", "doc_id", "mark", "ids"])

    def write(batches):
        made: dict = {}
        fs, root = _store(uri)
        fs.create_dir(root, recursive=True)

        def close():
            if made:
                made["f"].close()
                fs.move(made["own"], f"{root}/shard-{made['k']}.bin")
                sizes = np.concatenate(made["n"])
                _put(fs, f"{root}/shard-{made['k']}.idx", iter([np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()]))
                _put(fs, f"{root}/shard-{made['k']}.doc", iter([np.concatenate(made["id"]).astype("<i8").tobytes()]))
                yield pa.RecordBatch.from_arrays([pa.array([made["k"]], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], ["shard", "n_docs", "n_ids"])
                made.clear()

        for b in batches:
            shard = b["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if made.get("k") != shard[i]:
                    yield from close()
                    own = f"{root}/shard-{shard[i]}.bin.{uuid.uuid4().hex}.part"
                    made.update(k=int(shard[i]), own=own, f=fs.open_output_stream(own), n=[], id=[])
                part = b.slice(i, j - i)
                made["n"].append(pc.binary_length(part["ids"]).to_numpy().astype(np.int64) // np.dtype(dtype).itemsize)
                made["id"].append(pc.fill_null(part["doc_id"], NULL_ID).to_numpy(zero_copy_only=False))
                for x in part["ids"]:
                    made["f"].write(x.as_buffer())
        yield from close()

    coded = data.mapInArrow(encode, "shard int, doc_id long, mark long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "mark")
    with settings(spark, **{ARROW_BYTES.replace(".", "__"): str(ENCODE_BYTES)}):
        dealt.mapInArrow(write, "shard int, n_docs long, n_ids long").withColumn("dtype", F.lit(dtype)).write.parquet(f"{uri}/manifest")
    return manifest(spark, uri)


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """The shards with their bases. There is a row for each shard (100,000 of 1 GB for 100 TB of text), so the one window over all of them is small."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    m = spark.read.schema("shard int, n_docs long, n_ids long, dtype string").parquet(f"{uri}/manifest")
    return m.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).withColumn("uri", F.lit(uri))


def read_token_files(shards: DataFrame, end_id: int | None = None) -> DataFrame:
    """Each document's place in the files of a manifest, and the CRC-32 of its ids as little-endian unsigned 32 bit.

    Columns: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. end_id: where
    given, a document that doesn't end with it raises an error.
    """

    def read(batches):
        for b in batches:
            for s in b.to_pylist():
                name = f"{s['uri']}/shard-{s['shard']}"
                ids, at, doc = mapped(f"{name}.bin", s["dtype"]), mapped(f"{name}.idx", "<u8").astype(np.int64), mapped(f"{name}.doc", "<i8")
                if end_id is not None and len(doc) and (ids[at[1:] - 1] != end_id).any():
                    raise ValueError(f"{name}: a document without its end id")
                crc = np.array([zlib.crc32(ids[i:j].astype("<u4")) for i, j in zip(at, at[1:], strict=False)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(at[:-1] + s["base"]), pa.array(np.diff(at)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    import public_tokenizers

    from .common import table

    path = public_tokenizers.path("word_bpe_49k.json")
    shards = write_token_files(table(spark, sf_dir, "documents"), lambda: shared(path, special_as_text=False), end_id=1, vocabulary=49_408)
    return read_token_files(shards, end_id=1)
