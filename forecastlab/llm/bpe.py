"""Byte-level BPE: cached merging of pre-tokens, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .piece_table import PieceTable

@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines of base64 bytes and rank. The file is on every machine, like the library that reads it."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank, the leftmost of equals, merges until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 100:
        return _merge_long(piece, ranks)
    none, get = 1 << 32, ranks.get
    part = [piece[i : i + 1] for i in range(len(piece))]
    pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair and (low := min(pair)) < none:
        i = pair.index(low)
        part[i] += part.pop(i + 1)
        del pair[i]
        if i < len(pair):
            pair[i] = get(part[i] + part[i + 1], none)
        if i:
            pair[i - 1] = get(part[i - 1] + part[i], none)
    return [ranks[p] for p in part]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for very long pre-tokens in n log n steps: a heap of pairs over a linked list."""
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    pairs = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        rank, i, size = heapq.heappop(pairs)
        if not alive[i] or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != rank:
            continue
        part[i] += part[j]
        alive[j], after[i] = False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (rank := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(pairs, (rank, a, len(part[a]) + len(part[b])))
    return [ranks[p] for p, live in zip(part, alive) if live]


@cache
def table_of(path: str) -> PieceTable:
    """The worker's memory for a rank file; it outlives tasks."""
    ranks = load_ranks(path)
    return PieceTable(lambda pieces: [merge(p, ranks) for p in pieces])


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    return table_of(path).encode(texts)


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens after one another, and where each id's begin and how many they are."""
    ranks = load_ranks(path)
    length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), dtype=np.uint8), np.cumsum(length) - length, length


def offsets(ids: np.ndarray, path: str) -> np.ndarray:
    """The byte offset at which each token of a text starts, and the text's length at the end."""
    return np.concatenate([[0], np.cumsum(token_bytes(path)[2][ids])])


def decode(ids: np.ndarray, at: np.ndarray, path: str) -> bytes:
    """The bytes of ids, each put at its offset."""
    data, begin, _ = token_bytes(path)
    return data[np.repeat(begin[ids] - at[:-1], np.diff(at)) + np.arange(at[-1])].tobytes()


def encode_documents(docs: DataFrame, ranks_path: str, group: int = 64) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, ids, offsets, ids_sha256, decoded_sha256.

    ids are little-endian unsigned 32-bit numbers, offsets the byte offsets of the tokens, and the text's length, as such
    64-bit ones. Null texts count as empty and have no ids; whole texts are encoded, however long. decoded_sha256 is of
    the bytes that the ids decode to. Repeated rows have a row each; an empty table gives an empty result; other columns
    are not looked at.
    """
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "offsets": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, group):
                ids = encode([t or "" for t in part.column(1).to_pylist()], ranks_path)
                at = [offsets(x, ranks_path) for x in ids]
                decoded = [hashlib.sha256(decode(x, o, ranks_path)).hexdigest() for x, o in zip(ids, at)]
                raw = [x.astype("<u4").tobytes() for x in ids]
                columns = [part.column(0), [len(x) for x in ids], raw, [o.astype("<i8").tobytes() for o in at], [hashlib.sha256(x).hexdigest() for x in raw], decoded]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, offsets binary, ids_sha256 string, decoded_sha256 string")
