"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each compressed with zstandard, with a chunk index."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from struct import Struct
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_buckets, in_buckets
from .piece_table import PieceTable

MAGIC, HEAD = b"IDPLANE1", Struct("<8sIIQQ")
#: Ids in a block, and what a block is cut into: 4 byte planes or 32 bit planes.
BLOCK, PLANES = 65_536, 4


def planes_of(ids: np.ndarray, planes: int) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of 32-bit ids."""
    data = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [data[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(data, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, dtype=np.uint8) for p in parts], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def pack_ids(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, planes: int = PLANES, level: int = 1) -> bytes:
    """A file: header, the index of its chunks (offset and size of each plane of each block), the documents' lengths, the planes."""
    press = zstandard.ZstdCompressor(level=level)
    blocks = [planes_of(ids[at : at + block], planes) for at in range(0, len(ids), block)]
    chunks = [press.compress(p) if any(p) else b"" for parts in blocks for p in parts]
    sizes = np.array([len(c) for c in chunks], dtype="<u8")
    lens = press.compress(np.asarray(lengths, dtype="<u8").tobytes())
    return b"".join([HEAD.pack(MAGIC, block, planes, len(ids), len(lengths)), Struct("<Q").pack(len(lens)), sizes.tobytes(), lens, *chunks])


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and documents' lengths of a file of pack_ids."""
    magic, block, planes, n, docs = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    (lens_size,) = Struct("<Q").unpack_from(data, HEAD.size)
    blocks, at = -(-n // block), HEAD.size + 8
    sizes = np.frombuffer(data, dtype="<u8", count=blocks * planes, offset=at)
    at += sizes.nbytes
    open_ = zstandard.ZstdDecompressor()
    lengths = np.frombuffer(open_.decompress(data[at : at + lens_size], max_output_size=8 * docs), dtype="<u8") if docs else np.zeros(0, dtype="<u8")
    at, out, k = at + lens_size, np.empty(n, dtype="<u4"), 0
    for b in range(blocks):
        here = min(block, n - b * block)
        size = here if planes == 4 else -(-here // 8)
        parts = []
        for _ in range(planes):
            s = int(sizes[k])
            parts.append(open_.decompress(data[at : at + s], max_output_size=size) if s else bytes(size))
            at, k = at + s, k + 1
        out[b * block : b * block + here] = from_planes(parts, here)
    return out, lengths


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = byte_letters()


class Library:
    """The tokenizers library's encode(text, add_special_tokens=False) for one tokenizer file.

    A byte-level BPE file without normaliser, whose pre-tokeniser is the usual one, encodes each pre-token by itself, as
    letters for its bytes; so the library's model gets each new pre-token once. Texts are split at the file's added
    tokens, which have ids of their own, as the library does. Any other file's texts go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        how, tokens = json.loads(self.tokenizer.to_str()), self.tokenizer.get_added_tokens_decoder()
        before, model = how["pre_tokenizer"] or {}, how["model"]
        self.by_pieces = (
            how["normalizer"] is None and how["truncation"] is None and how["padding"] is None
            and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk"))
            and not any(t.single_word or t.lstrip or t.rstrip for t in tokens.values())
        )
        self.added = {t.content: np.array([i], dtype=np.uint32) for i, t in tokens.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else lambda text: [text]
        tokenize = self.tokenizer.model.tokenize
        self.table = PieceTable(lambda pieces: [[t.id for t in tokenize(p.decode("latin-1").translate(LETTERS))] for p in pieces])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_pieces:
            return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.split(t) for t in texts]
        between = iter(self.table.encode([t for p in parts for t in p[::2]]))
        whole = [[self.added[t] if k % 2 else next(between) for k, t in enumerate(p)] for p in parts]
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in whole]


@cache
def library(path: str) -> Library:
    """The worker's tokenizer of a file, with its memory; it outlives tasks."""
    return Library(path)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, per_shard: int = 2_000, ids_per_file: int = 1_000_000) -> None:
    """Encodes docs (doc_id, text) and writes path/files and path/index.

    Documents are in ascending doc_id order: ranges of doc_id are shards, sorted inside, and a shard is a run of files
    of whole documents, each closed at ids_per_file ids. Files are rows of a Parquet table (shard, file, first_id and
    last_id, n_ids, data), so Spark's committer writes them to any store and a lost task writes its own again. The index
    has the ids before each shard. Null texts count as empty, null ids come first, and rows with one id are in the order
    of their texts. end_id closes each document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    bounds = id_buckets(keyed.select(F.col("k").cast("double").alias("doc_id")), per_shard)
    sorted_ = in_buckets(keyed, "k", bounds, "shard").repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "k", "text")
    end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
    names = ["shard", "file", "ids", "n_ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, file, ids, parts, size = library(tokenizer_path), None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            all_ids = np.concatenate([x for p in parts for x in (p, end)])
            data = pack_ids(all_ids, np.array([len(p) + len(end) for p in parts]))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([file], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([len(all_ids)], pa.int64()), pa.array([data], pa.binary())], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, s, e in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), known.encode(part.column(1).to_pylist())):
                    if parts and (s != shard or size >= ids_per_file):
                        yield close()
                        file, ids, parts, size = (file + 1 if s == shard else 0), [], [], 0
                    shard = s
                    ids.append(doc)
                    parts.append(e)
                    size += len(e) + len(end)
        if parts:
            yield close()

    sorted_.select("doc_id", "text", "shard").mapInArrow(run, "shard int, file int, ids array<long>, n_ids long, data binary").write.mode("overwrite").parquet(f"{path}/files")
    spark = docs.sparkSession
    sums = spark.read.parquet(f"{path}/files").groupBy("shard", "file").agg(F.sum("n_ids").alias("n_ids"))
    over = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    shards = sums.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", over(Window.orderBy("shard")).alias("before"))  # as many rows as id_buckets makes at most
    files = sums.withColumn("inside", over(Window.partitionBy("shard").orderBy("file"))).join(shards, "shard")
    files.select("shard", "file", (F.col("before") + F.col("inside")).alias("start")).write.mode("overwrite").parquet(f"{path}/index")


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit), from the files."""
    files = spark.read.parquet(f"{path}/files").join(spark.read.parquet(f"{path}/index"), ["shard", "file"])
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, data, start = (batch.column(k)[i].as_py() for k in range(3))
                ids, lengths = unpack_ids(data)
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths.astype(np.int64)
                crcs = [crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths.astype(np.int64), pa.int64()), pa.array(crcs, pa.int64())], names)

    return files.select("ids", "data", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(shared: str, name: str) -> str:
    return f"{shared.rstrip('/')}/{name}-{uuid4().hex}"
