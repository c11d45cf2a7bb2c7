"""From raw documents to token ids: language ID, exact dedup, near dedup, decontamination, byte-level BPE.

Each stage takes the documents that its predecessor kept, with all their columns, and decides over all of them; the last one returns
a row of token ids for each document that is left. The stages set the session's Arrow batches to a few megabytes:
beside a full heap an executor has little memory for them and for its Python workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, decontaminate, exact_dedup, language_id, simhash_wide
from factloom.llm.common import materialise, small_batches, table

#: SQL cannot express the language model, fingerprints, alignments or merges; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which language ID finds a language."""
    small_batches(spark)
    return language_id.keep_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    small_batches(spark)
    return simhash_wide.drop_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32 bit), ids_sha256, decoded_sha256."""
    import public_tokenizers

    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontaminate", decontaminated),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each over what its predecessor wrote: a row of tokens() for each document that is left.

    Null texts and texts without a letter go with the first stage; rows with a null or repeated doc_id are judged by their own texts in every stage; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
