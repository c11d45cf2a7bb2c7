"""Token counts by a separator scan over flat token files that have no index (operator 5).

Files are cut into blocks of a fixed size, whatever documents they hold. Each block is searched for the end-of-document
id with one vector comparison; a prefix scan over the blocks' summaries (separators so far, place of the last one)
stitches the documents that cross block borders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialise, scratch, table
from .token_files import ENCODE_BYTES, ChunkEncoder, _store, closed, dtype_for, qualified
from .words import slices

#: Ids in a block.
BLOCK_IDS = 1 << 21


def write_flat(docs: DataFrame, make_encoder: Callable, end_id: int, vocabulary: int, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every document and end_id after it, one file a task, in the order of the rows that it reads.

    Returns (file, n_ids, doc_ids): which documents a file holds, in their order, not where they are. A null text is an
    empty text. A repeated task writes a file of another name, and only the file of the task that counts is listed.
    """
    uri = qualified(docs.sparkSession, uri or scratch(docs.sparkSession, "flat"))
    dtype = dtype_for(vocabulary)

    def write(batches):
        enc, fs_root, f, own, n, ids_of = make_encoder(), _store(uri), None, f"{uri}/{uuid.uuid4().hex}.bin", 0, []
        fs, root = fs_root
        for b in slices(batches, size=ENCODE_BYTES):
            if f is None:
                fs.create_dir(root, recursive=True)
                f = fs.open_output_stream(f"{root}/{own.rpartition('/')[2]}")
            ids, _ = closed(*enc.batch(b["text"]), end_id)
            f.write(np.ascontiguousarray(ids.astype(dtype)))
            n += len(ids)
            ids_of.append(b["doc_id"])
        if f is not None:
            f.close()
            whole = pa.concat_arrays(ids_of)
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)], ["file", "n_ids", "doc_ids"])

    rows = id_and_text(docs, id_col, text_col).mapInArrow(write, "file string, n_ids long, doc_ids array<long>")
    return materialise(rows, "flat-files")


def list_flat(spark: SparkSession, uri: str, dtype: str) -> DataFrame:
    """(file, n_ids) of the .bin files of a folder, for files that someone else wrote."""
    uri = qualified(spark, uri)
    fs, root = _store(uri)
    size = np.dtype(dtype).itemsize
    found = [(f"{uri}/{x.base_name}", x.size // size) for x in fs.get_file_info(pafs.FileSelector(root)) if x.extension == "bin"]
    return spark.createDataFrame(sorted(found), "file string, n_ids long")


def scan_counts(files: DataFrame, end_id: int, dtype: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """files: file, n_ids. A row for each document: file, ordinal (from 0), start (its first id's place), n_tokens (without end_id), closed.

    What follows a file's last end_id is a document with closed = false; an empty file has no document.
    """

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, path = _store(r["file"])
                size = np.dtype(dtype).itemsize
                if isinstance(fs, pafs.LocalFileSystem):
                    ids = np.memmap(path, dtype, "r", r["lo"] * size, (r["hi"] - r["lo"],))
                else:
                    with fs.open_input_file(path) as f:
                        ids = np.frombuffer(f.read_at((r["hi"] - r["lo"]) * size, r["lo"] * size), dtype)
                ends = np.flatnonzero(ids == end_id) + r["lo"]
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["lo"]], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "lo", "ends"])

    cuts = files.select("file", "n_ids", F.explode(F.expr(f"sequence(0L, greatest(n_ids - 1, 0L), {block_ids}L)")).alias("lo")).where("n_ids > 0")
    cuts = cuts.select("file", "lo", F.least(F.col("lo") + block_ids, "n_ids").alias("hi"))
    blocks = materialise(cuts.repartition(F.col("file"), F.col("lo")).mapInArrow(search, "file string, lo long, ends array<long>"), "token-blocks")
    # the scan over a file's blocks carries two numbers of each, not its ends
    sums = blocks.select("file", "lo", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("end"))
    before = Window.partitionBy("file").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("file", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.last("end", ignorenulls=True).over(before), F.lit(-1)).alias("last"))
    stitched = blocks.where(F.size("ends") > 0).join(carried, ["file", "lo"])
    starts = F.concat(F.array(F.col("last") + 1), F.transform(F.expr("slice(ends, 1, size(ends) - 1)"), lambda e: e + 1))
    spans = F.zip_with("ends", starts, lambda e, s: F.struct(s.alias("start"), (e - s).alias("n_tokens")))
    found = stitched.select("file", "base", F.posexplode(spans).alias("pos", "span")).select("file", (F.col("base") + F.col("pos")).cast("long").alias("ordinal"), "span.start", "span.n_tokens", F.lit(True).alias("closed"))
    whole = sums.groupBy("file").agg(F.max("end").alias("last"), F.sum("n").alias("ordinal"))
    open_ = files.join(whole, "file").withColumn("start", F.coalesce(F.col("last") + 1, F.lit(0))).where("n_ids > start")
    return found.unionByName(open_.select("file", "ordinal", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def token_counts(docs: DataFrame, make_encoder: Callable, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as flat files, then count by the scan: doc_id, n_tokens (without end_id) for each row; repeated rows have a row each."""
    files = write_flat(docs, make_encoder, end_id, vocabulary, None, id_col, text_col)
    counts = scan_counts(files.select("file", "n_ids"), end_id, dtype_for(vocabulary))
    names = files.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id")).withColumn("ordinal", F.col("ordinal").cast("long"))
    return counts.join(names.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, by the scan."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(table(spark, sf_dir, "documents"), lambda: ChunkEncoder(path), end_id=49_407, vocabulary=49_408)
