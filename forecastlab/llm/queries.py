"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, cws, exact_dedup, html_extract, mixing, packing, quality, sharding, simhash, token_align, token_files, url_filter, whitening
from .common import shared_dir, table

#: Bytes of text that a shard holds at most.
SHARD_BYTES = 1 << 20


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare_edited(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_folder(shared_dir(spark), "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, path)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids", "offsets")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_align.alignment_report(table(spark, sf_dir, "documents"), *paths)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


_ALL = (
    op1_mixing, op2_html_extraction, op3_sharding, op4_simhash, op5_fingerprints, op6_exact_dedup, op7_url_filter, op8_token_files, op9_quality,
    op10_bpe, op11_whitening, op12_alignment, op13_packing,
)
QUERIES = {f.__name__: f for f in _ALL}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op3_sharding": f"""
        WITH d AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b,
                   ('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '\\N') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
            FROM documents),
        buckets AS (
            SELECT CAST(g.depth AS INTEGER) AS depth, d.h >> CAST(60 - g.depth AS INTEGER) AS prefix, CAST(sum(b) AS BIGINT) AS shard_bytes, count(*) AS shard_docs,
                   sum(b) <= {SHARD_BYTES} OR min(h) = max(h) OR g.depth = 60 AS fits
            FROM d, range(0, 61) AS g(depth) GROUP BY 1, 2, g.depth),
        placed AS (
            SELECT d.doc_id, d.h, d.b, min(k.depth) AS depth
            FROM d JOIN buckets k ON k.fits AND k.prefix = d.h >> (60 - k.depth) GROUP BY 1, 2, 3)
        SELECT p.doc_id, CASE WHEN p.depth = 0 THEN '' ELSE right(lpad(bin(k.prefix), 60, '0'), p.depth) END AS shard, p.depth, p.b AS doc_bytes,
               k.shard_bytes, k.shard_docs, k.shard_bytes > {SHARD_BYTES} AS oversized
        FROM placed p JOIN buckets k ON k.depth = p.depth AND k.prefix = p.h >> (60 - p.depth)""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
