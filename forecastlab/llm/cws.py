"""Document fingerprints by consistent weighted sampling of word pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import id_buckets, in_buckets

#: Samples in a fingerprint; each is kept as 16 bits.
SAMPLES = 64
_SPACE = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FIRST = -(2**63)


@cache
def _draws(seed: int = 11) -> tuple[np.ndarray, ...]:
    """Tables of r and ln c, both of Gamma(2, 1) draws, and of uniform b; the keys of weight 1; and a multiplier for each sample, which picks a term's draws."""
    rng = np.random.default_rng(seed)
    r, lnc, b = rng.gamma(2.0, 1.0, 65_536).astype(np.float32), np.log(rng.gamma(2.0, 1.0, 65_536)).astype(np.float32), rng.random(65_536).astype(np.float32)
    pick = rng.integers(0, 2**31, (SAMPLES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return r, lnc, b, _ordered(lnc + r * b - r), pick


def _ordered(a: np.ndarray) -> np.ndarray:
    """32-bit floats as unsigned integers in the same order."""
    bits = a.astype(np.float32).view(np.int32)
    return np.where(bits < 0, ~bits, bits ^ np.int32(-(2**31))).view(np.uint32)


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's distinct terms and their weights, which are their counts.

    A term is a pair of adjacent words, A-Z lower-cased; a single word is one by itself. A text without words has none.
    """
    words = [w for w in text.encode().translate(_SPACE).split(b" ") if w]
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    known: dict[bytes, int] = {}
    for w in set(words):
        known[w] = xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) > 1:
        with np.errstate(over="ignore"):
            h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[1:]
    found, n = np.unique(h, return_counts=True)
    return found, n.astype(np.float64)


def sign(hashes: np.ndarray, weights: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The weighted minimum of each sample as 16 bits: for a term of weight w, t = floor(ln w / r + b), and a = ln c - r (t - b) - r is least.

    Two sets agree in a sample with the probability of their generalised Jaccard similarity. No terms give all zeros.
    """
    if not len(hashes):
        return np.zeros(SAMPLES, dtype=np.uint16)
    r, lnc, b, of_one, pick = _draws()
    best = np.full(SAMPLES, 2**64 - 1, dtype=np.uint64)
    once = weights == 1
    for mask, single in ((once, True), (~once, False)):
        h, lnw = hashes[mask], np.log(weights[mask]).astype(np.float32)
        for at in range(0, len(h), chunk):
            part = h[at : at + chunk]
            i = (part >> np.uint64(32)).astype(np.uint32)[None, :] * pick >> np.uint32(16)
            if single:
                key = of_one[i]
            else:
                t = np.floor(lnw[None, at : at + chunk] / r[i] + b[i])
                key = _ordered(lnc[i] - r[i] * (t - b[i]) - r[i])
            np.minimum(best, (key.astype(np.uint64) << np.uint64(32) | (part & np.uint64(0xFFFFFFFF))).min(axis=1), out=best)
    return ((best ^ (best >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str) -> np.ndarray:
    return sign(*terms(text))


def as_text(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples in which two fingerprints agree."""
    return float((a == b).mean())


def with_next(docs: DataFrame, per_bucket: int = 2_000) -> DataFrame:
    """docs (doc_id, text) dealt to ranges of doc_id and sorted, each range followed by the first row of the next one as a guest.

    The ranges' bounds and first ids are bounded numbers of longs; no row needs any other task's rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast("long").alias("k"))
    bounds = id_buckets(docs.select(F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast("double").alias("doc_id")), per_bucket)
    placed = in_buckets(rows, "k", bounds, "bucket")
    firsts = sorted((r["bucket"], r["k"]) for r in in_buckets(docs.select(F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast("long").alias("k")), "k", bounds, "bucket").groupBy("bucket").agg(F.min("k").alias("k")).collect())
    if not firsts:
        return placed.withColumn("guest", F.lit(False))
    before = [(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)]
    guests = docs.sparkSession.createDataFrame(before, "to int, k long")
    as_guest = placed.join(F.broadcast(guests), "k").withColumn("bucket", F.col("to")).drop("to").withColumn("guest", F.lit(True))
    both = placed.withColumn("guest", F.lit(False)).unionByName(as_guest.select(*placed.columns, "guest"))
    return both.repartition(max(1, min(len(firsts), 20_000)), "bucket").sortWithinPartitions("bucket", "guest", "k", "text")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's by ascending doc_id; the last is followed by the first, a single document by itself. Null texts count as
    empty, null doc_ids come first, and rows with one doc_id are in the order of their texts. Texts without words have a
    fingerprint of zeros, which is like itself. An empty table gives an empty result; other columns are not looked at.
    """

    def row(now: tuple, after: tuple) -> tuple:
        doc_id, text, own = now
        n = len(text)
        edited = text[: n - n // 4] + after[1][: n // 4]
        changed = own if edited == text else fingerprint(edited)
        return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, after[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket, out = None, None, []
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, text, b, guest in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if b != bucket:
                        last, bucket = None, b
                    elif last is None:
                        continue  # the guest was paired already
                    now = (doc_id, text, fingerprint(text))
                    if last is not None:
                        out.append(row(last, now))
                    last = None if guest else now
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []

    return with_next(docs).select("doc_id", "text", "bucket", "guest").mapInArrow(run, _SCHEMA)
