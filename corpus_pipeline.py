"""The corpus pipeline: quality classifier, exact and near deduplication, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; other columns of docs are not passed on. Null texts count
as empty, repeated rows as copies, and an empty table gives an empty result at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forecastlab.llm import bpe, exact_dedup, mixing, near_copies, quality, token_files
from forecastlab.llm.common import DOCUMENT_COLUMNS, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels that are not held out, scores at 0.3 or more."""
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.keep_good(docs.select(DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"), training=labelled)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs.select(DOCUMENT_COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a similarity of 5-word shingles of 0.8 or more the document with the smallest doc_id."""
    return near_copies.drop_near_copies(docs.select(DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: what it takes of each document in each epoch, sources weighing 5, 2, 1 by code point, 150% of all words."""
    return mixing.mix_documents(docs.select(DOCUMENT_COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids (little-endian unsigned 32-bit), their number and digest, and the digest of what they decode to."""
    return bpe.encode_documents(docs.select(DOCUMENT_COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can express neither the classifier, nor XXH64, nor BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = token_files.new_folder(shared_dir(spark), "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
