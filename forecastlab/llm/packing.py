"""Packing documents into training sequences along a space-filling curve, so that a sequence holds neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_buckets, in_buckets, shared_dir, slices
from .token_files import library, new_folder

#: Tokens of a sequence.
LENGTH = 2048
#: Buckets of a hashed document vector, and the grid that it is projected to: dimensions and bits of each.
BUCKETS, DIMS, BITS = 1024, 4, 8
#: What a place has below the key of the curve: bits of a digest of the row, then of the row's number.
DIGEST_BITS, SALT_BITS = 14, 6


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Where each row of cells (dims whole numbers below 2 ** bits) is on the Hilbert curve, after Skilling (2004).

    From the highest bit down, the lower bits of the first coordinate are turned over or exchanged with another's as the
    sub-cube demands; what is left is the Gray code of the key, its bits dealt over the coordinates.
    """
    x = np.array(cells, dtype=np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for k in range(dims):
            set_ = (x[k] >> b) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | ((x[k] >> b) & 1)
    return key


@cache
def _projection() -> np.ndarray:
    """Fixed normal directions in the space of hashed vectors."""
    return np.random.default_rng(17).standard_normal((BUCKETS, DIMS))


def _hash(ids: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each id (multiplication by an odd number, and a fold)."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@cache
def _hashes(size: int) -> np.ndarray:
    """The hash of each id below size."""
    return _hash(np.arange(size))


def curve_keys(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The keys of n documents from the hashes of all their ids, of which `of` tells the documents.

    Damped counts in hashed buckets, scaled to length one, are projected and laid on the grid.
    """
    counts = np.bincount(of * BUCKETS + (hashes >> np.uint64(54)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    vectors = np.log1p(counts)
    at = vectors @ _projection() / np.maximum(np.sqrt((vectors * vectors).sum(axis=1)), 1e-12)[:, None]
    # the logistic curve spreads what is about normal evenly over the grid
    cells = np.minimum((2**BITS / (1 + np.exp(-1.702 * at))).astype(np.int64), 2**BITS - 1)
    return hilbert_keys(cells, BITS)


def encode_places(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """doc_id, place, n_tokens, ids (little-endian, 2 bytes each while the vocabulary allows it) of docs (doc_id, text).

    place orders by the key of the curve, then by a digest of the ids and doc_id, then by the row's number, so that even a third
    of all rows with one text, or one doc_id, is spread over places. It has 52 bits and so is exact as a double.
    """
    end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
    width = id_type(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = library(tokenizer_path), 0
        table = _hashes(max(known.tokenizer.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1))
        for batch in batches:
            for part in slices(batch, 64):
                found = [np.concatenate([e, end]) for e in known.encode(part.column(1).to_pylist())]
                n, lengths = len(found), np.array([len(e) for e in found])
                ids, of, ends = np.concatenate(found), np.repeat(np.arange(n), lengths), np.cumsum(lengths)
                hashes = table[ids]
                # a digest of the ids in their order, and of doc_id
                order = (np.arange(len(ids)) - np.repeat(ends - lengths, lengths) + 1).astype(np.uint64)
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * order)])
                doc = _hash(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                digest = (((sums[ends] - sums[ends - lengths]) ^ doc) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIGEST_BITS)
                place = (curve_keys(hashes, of, n) << DIGEST_BITS) | digest.astype(np.int64)
                place = (place << SALT_BITS) | ((row + np.arange(n)) & (2**SALT_BITS - 1))
                data = pa.array([e.astype(width).tobytes() for e in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(place), pa.array(lengths.astype(np.int64)), data], ["doc_id", "place", "n_tokens", "ids"])
                row += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, place long, n_tokens long, ids binary")


@cache
def id_type(tokenizer_path: str, end_id: int | None) -> str:
    return "<u2" if max(library(tokenizer_path).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id or 0) < 1 << 16 else "<u4"


def sequence_starts(total: int, length: int) -> tuple[int, np.ndarray]:
    """The number of full sequences of total tokens, and where the others begin: the rest goes by its binary digits, largest first.

    Lengths that are powers of two need no padding, so none is padded.
    """
    full, rest = divmod(total, length)
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return full, full * length + np.cumsum([0, *sizes])[: len(sizes)].astype(np.int64)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, length: int = LENGTH, per_bucket: int = 2_000) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    docs has doc_id and text; null texts count as empty, null doc_ids stay, repeated rows are packed each, other columns are not
    passed on, and an empty table gives none. A document's ids and end_id form its tokens. Encoded once and written to the
    shared folder, documents are sorted by ranges of their place along the curve and laid end to end; every `length` tokens close a
    sequence, and the last tokens of all go to sequences of powers of two. ids are little-endian unsigned 32-bit numbers.
    Without end_id, texts without tokens have no piece.
    """
    spark, folder = docs.sparkSession, new_folder(shared_dir(docs.sparkSession), "packing")
    encode_places(docs, tokenizer_path, end_id).write.parquet(folder)
    encoded = spark.read.parquet(folder)
    bounds = id_buckets(encoded.select(F.col("place").cast("double").alias("doc_id")), per_bucket)
    placed = in_buckets(encoded, "place", bounds, "bucket")
    # one row a range, of which id_buckets makes 20,000 at most
    sums = sorted(placed.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([r["n"] for r in sums]).tolist()
    begins = {r["bucket"]: e - r["n"] for r, e in zip(sums, ends)}
    full, rest = sequence_starts(ends[-1] if ends else 0, length)
    width = id_type(tokenizer_path, end_id)

    def sequence_at(position: np.ndarray) -> np.ndarray:
        return np.where(position < full * length, position // length, full - 1 + np.searchsorted(rest, position, side="right"))

    def begin_of(sequence: np.ndarray) -> np.ndarray:
        known = np.concatenate([rest, [0]])
        return np.where(sequence < full, sequence * length, known[np.clip(sequence - full, 0, len(rest))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for batch in batches:
            n, first = np.asarray(batch.column(1)), []
            for b, tokens in zip(batch.column(3).to_pylist(), n.tolist()):
                if b != bucket:
                    bucket, at = b, begins[b]
                first.append(at)
                at += tokens
            first, end = np.array(first, dtype=np.int64), np.array(first, dtype=np.int64) + n
            low, some = sequence_at(first), n > 0
            pieces = np.where(some, sequence_at(np.maximum(end - 1, first)) - low + 1, 0)
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(begin_of(sequence), first[doc])
            stop = np.minimum(np.where(sequence + 1 < full + len(rest), begin_of(sequence + 1), 2**62), end[doc])
            start, size = begin - first[doc], stop - begin
            texts = batch.column(2)
            ids = [np.frombuffer(texts[d].as_buffer(), dtype=width)[s : s + m].astype("<u4").tobytes() for d, s, m in zip(doc.tolist(), start.tolist(), size.tolist())]
            columns = [batch.column(0).take(pa.array(doc)), start, size, pa.array(ids, pa.binary()), n[doc], sequence, begin - begin_of(sequence)]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    sorted_ = placed.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "place", "doc_id", "ids")
    return sorted_.select("doc_id", "n_tokens", "ids", "bucket").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    """pieces with the checksum of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
