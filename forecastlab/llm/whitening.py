"""Embedding whitening: exact cross-products from bit planes, centred as integers, then principal components of unit variance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c counts as floor(SCALE * c) + SHIFT, held within plus and minus MOST.
SCALE, SHIFT, MOST = 1024, 100_000, 1 << 45
#: Components whose eigenvalue is not over this share of the largest have no direction that doubles can tell.
LEAST_SHARE = 1e-12
#: Rows whose bit planes are held at a time.
ROWS = 8192


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are there and finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True))


def as_integers(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column, all of dim entries, as whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of non-negative columns of x, across rows: words of 64 rows for each (column, bit), then the columns and the bits.

    A column has as many planes as its largest number has bits.
    """
    words, columns, bits = [], [], []
    width, most = -(-len(x) // 64) * 8, x.max(axis=0)
    for b in range(int(most.max()).bit_length()):
        has = np.flatnonzero(most >> b)
        packed = np.packbits(((x[:, has] >> b) & 1).astype(np.uint8).T, axis=1)
        padded = np.zeros((len(has), width), dtype=np.uint8)
        padded[:, : packed.shape[1]] = packed
        words.append(padded.view(np.uint64))
        columns.append(has)
        bits.append(np.full(len(has), b))
    if not words:
        return np.zeros((0, width // 8), dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    columns, bits = np.concatenate(columns), np.concatenate(bits)
    order = np.lexsort((bits, columns))
    return np.concatenate(words)[order], columns[order], bits[order]


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of each column and of each product of two columns of whole numbers, as Python's integers.

    Columns are shifted by their least number, so that few bits are left. The sum of products of two shifted columns is
    the sum over pairs of their planes of 2 ** (bit + bit) times the ones in the AND of the planes; sums weigh the planes'
    own ones. Then the shifts are put back.
    """
    n, dim = x.shape
    low = x.min(axis=0)
    planes, columns, bits = bit_planes(x - low)
    k = len(planes)
    both = np.zeros((k, k), dtype=np.int64)
    for p in range(k):
        both[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    both = np.triu(both) + np.triu(both, 1).T
    kind = np.int64 if k == 0 or 2 * int(bits.max()) + n.bit_length() < 60 else object
    weight = np.array([1 << int(b) for b in bits], dtype=kind)
    sums, products = np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
    if k:
        has, first = np.unique(columns, return_index=True)
        sums[has] = np.add.reduceat(both.diagonal().astype(kind) * weight, first).astype(object)
        by_row = np.add.reduceat(both.astype(kind) * weight[:, None] * weight[None, :], first, axis=0)
        products[np.ix_(has, has)] = np.add.reduceat(by_row, first, axis=1).astype(object)
    low = low.astype(object)
    shifted = np.multiply.outer(low, sums)
    return sums + n * low, products + shifted + shifted.T + n * np.multiply.outer(low, low)


def scatter(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """How many vectors there are, the sums of their entries and of the products of entries: exact, of the whole numbers.

    vectors has one column of arrays of dim entries. Each task gives one row for each pair of dimensions, so what is
    shuffled and what the driver gets depend on the dimensions and not on the vectors.
    """
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = as_integers(batch.column(0).slice(at, ROWS), dim)
                s, p = cross_products(x)
                n, sums, products = n + len(x), sums + s, products + p
        if n:
            i = np.concatenate([[-1], np.arange(dim), upper[0]])
            j = np.concatenate([[-1], np.full(dim, -1), upper[1]])
            v = [n, *sums.tolist(), *products[upper].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.decimal128(38, 0))], ["i", "j", "v"])

    found = vectors.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    n, sums, products = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for r in found.select("i", "j", F.col("v").cast("string")).collect():
        i, j, v = r[0], r[1], int(r[2])
        if i < 0:
            n = v
        elif j < 0:
            sums[i] = v
        else:
            products[i][j] = products[j][i] = v
    return n, sums, products


def principal(n: int, sums: list[int], products: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling, unit eigenvectors (columns), and shares of the trace, of the first components of the covariance.

    n * products - sums * sums is the covariance times n squared, exact; only its quotient is rounded.
    """
    dim = len(sums)
    exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    value, vector = np.linalg.eigh(np.array([[c / (n * n) for c in row] for row in exact]))
    order = np.argsort(-value, kind="stable")[: min(most, dim)]
    value, vector = value[order], vector[:, order]
    vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = sum(exact[i][i] for i in range(dim)) / (n * n)
    return value, vector, value / trace if trace else np.full(len(order), np.nan)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """df's key, and for each component: n, deviation, deviation_exact, whitened, explained, identity_error.

    Rows whose vector is null or has null or not finite entries are left out, and so are vectors whose length is not the
    most frequent one (of equally frequent ones the longest) or is zero. Repeated rows count each, null keys stay. An entry c
    counts as x = floor(1024 c) + 100000 (beyond 2 ** 35 in size it saturates). deviation_exact is the sum over dimensions of
    (n x - S) ** 2 as decimal digits; deviation is the same as a long, null where it has no room. A component whose variance is
    zero, up to rounding, has null in whitened and takes no part in identity_error, which is null without any other. An empty
    table gives an empty result; other columns of df are not passed on.
    """
    kept = df.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(usable("v") & (F.size("v") > 0))
    common = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    kind = df.schema[key].dataType.simpleString()
    if common is None:
        empty = f"{key} {kind}, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], empty)
    dim = common["dim"]
    kept = kept.filter(F.size("v") == dim)
    n, sums, products = scatter(kept.select("v"), dim)
    value, direction, share = principal(n, sums, products, components)
    known = value > LEAST_SHARE * max(value[0], 0.0)
    scale = direction / np.sqrt(np.where(known, value, 1.0))
    total = np.array(sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_integers(batch.column(1), dim)
            bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
            if dim * bound * bound < 2**62:
                y = n * x - total.astype(np.int64)
                deviation = (y * y).sum(axis=1).tolist()
            else:
                y = n * x.astype(object) - total
                deviation = (y * y).sum(axis=1).tolist()
            white = (y.astype(np.float64) / n) @ scale
            cells = pa.array(white[:, known].ravel())
            ends = np.arange(len(x) + 1, dtype=np.int32) * int(known.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(str, deviation)), pa.string()), pa.ListArray.from_arrays(pa.array(ends), cells)], ["key", "d", "w"])

    rows = kept.mapInArrow(run, f"key {kind}, d string, w array<double>")
    error = identity_error(rows, int(known.sum()))
    out = rows.select("key", "d", F.posexplode(F.sequence(F.lit(0), F.lit(len(value) - 1))).alias("k", "_at"), "w")
    shares = F.array(*[F.lit(None if np.isnan(s) else float(s)).cast("double") for s in share])
    return out.select(
        F.col("key").alias(key), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(d AS BIGINT)").alias("deviation"),
        F.col("d").alias("deviation_exact"), F.get("w", F.col("k")).alias("whitened"), F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(rows: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of w, arrays of k numbers, less the identity."""
    if k == 0:
        return None
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = rows.select(*[F.col("w")[a].alias(f"w{a}") for a in range(k)]).agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs))
