"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, join_few, join_hot, slices
from .components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def simhash(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint of a text's word shingles as a signed long; zero without words.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by spaces and repeat; with
    fewer words the whole sequence is one shingle. A bit is 1 if it is set in over half the XXH64 (seed 42) values.
    """
    joined = b" ".join((text or "").encode().translate(_LOWER).split(b" "))
    parts = [w for w in joined.split(b" ") if w]
    if not parts:
        return 0
    joined = b" ".join(parts)
    at = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(joined)]
    n = max(1, len(starts) - words + 1)
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n], ends[min(words, len(ends)) - 1 :])], dtype="<u8")
    set_ = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65_536):
        set_ += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                fps = pa.array([simhash(t, words) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


#: What comparing two fingerprints costs, as a part of what a shuffled row does.
COMPARING = 0.001


class Cover:
    """The anchors of one segment of a fingerprint: the words of a perfect Hamming code of covering radius 1 beside free bits.

    The code has 4 parity bits over 15 (3 over 7 in segments under 15 bits). A value's syndrome alone says which flips
    lead to its nearest anchor, and which to all anchors within radius plus threshold.
    """

    def __init__(self, shift: int, width: int, threshold: int):
        self.parity = 4 if width >= 15 else 3
        coded = (1 << self.parity) - 1
        self.shift, self.mask, self.coded = np.uint64(shift), np.uint64((1 << width) - 1), np.uint64((1 << coded) - 1)
        bits = (np.arange(1 << coded)[:, None] >> np.arange(coded)) & 1
        self.syndrome = np.bitwise_xor.reduce(bits * np.arange(1, coded + 1), axis=1).astype(np.int64)
        flips = [sum(1 << i for i in some) for n in range(2 + threshold) for some in combinations(range(width), n)]
        by = [[m for m in flips if self.syndrome[m & int(self.coded)] == s] for s in range(coded + 1)]
        self.flips = np.array([x + [0] * (max(map(len, by)) - len(x)) for x in by], dtype=np.uint64)
        self.valid = np.array([[True] * len(x) + [False] * (self.flips.shape[1] - len(x)) for x in by])

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, whether it is the fingerprint's own (nearest) one, and row, for each fingerprint and anchor that covers it."""
        value = (fps.view(np.uint64) >> self.shift) & self.mask
        syndrome = self.syndrome[(value & self.coded).astype(np.int64)]
        home = np.where(syndrome > 0, value ^ (np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64)), value)
        row, k = np.nonzero(self.valid[syndrome])
        key = value[row] ^ self.flips[syndrome[row], k]
        return key.astype(np.int64), key == home[row], row


def segments(n: int, bits: int) -> list[tuple[int, int]]:
    """Widths and thresholds of the segments for n fingerprints that at most bits differing bits link.

    Of k segments one differs in at most bits // k. Many narrow ones need few copies of a fingerprint, few wide ones
    have far more anchors; the cheapest k is taken, so rows at an anchor stay few however many fingerprints there are.
    """

    def plan(k: int) -> list[tuple[int, int]]:
        return [(64 // k + (i < 64 % k), bits // k) for i in range(k)]

    def cost(k: int) -> float:
        each = [(sum(comb(w, i) for i in range(t + 2)) / (1 << parity), 1 << (w - parity)) for w, t in plan(k) for parity in (4 if w >= 15 else 3,)]
        return sum(rows * (1 + COMPARING * n / anchors) for rows, anchors in each)

    return plan(min((k for k in range(1, min(8, bits + 2)) if bits // k <= 2), key=cost))


@cache
def covers(plan: tuple[tuple[int, int], ...]) -> list[Cover]:
    ends = np.cumsum([w for w, _ in plan]).tolist()
    return [Cover(end - w, w, t) for end, (w, t) in zip(ends, plan)]


def _covered(fps: np.ndarray, plan: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As Cover.anchors, for all segments; the anchor's number begins with that of its segment."""
    found = [c.anchors(fps) for c in covers(plan)]
    return np.concatenate([key + (s << 48) for s, (key, *_) in enumerate(found)]), np.concatenate([own for _, own, _ in found]), np.concatenate([row for *_, row in found])


def _linked(fps: np.ndarray, home: np.ndarray, bits: int, cells: int = 4_000_000) -> list[tuple[int, int]]:
    """Edges that connect what at most bits differing bits connect between homes and all: a forest, never all pairs."""
    homes = np.flatnonzero(home)
    label = np.arange(len(fps))
    step = max(1, cells // max(1, len(fps)))
    for k in range(0, len(homes), step):
        here = homes[k : k + step]
        i, j = np.nonzero(np.bitwise_count(fps[here][:, None] ^ fps[None, :]) <= bits)
        i = here[i]
        i, j = i[i != j], j[i != j]
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return [(x, label[x]) for x in linked]


def links(distinct: DataFrame, bits: int = 4, crowd: int = 4096, plan: list[tuple[int, int]] | None = None) -> DataFrame:
    """Edges (a, b) between fingerprints of distinct (fp), which connect exactly what at most bits differing bits connect.

    With k segments and at most `bits` differing bits, some segment differs in at most t = bits // k (see segments). The
    anchors of a segment are the words of a covering code of radius 1: a fingerprint's own anchor is within 1 of it, so
    within 1 + t of the other's segment, and every fingerprint goes to all anchors within that distance. Per anchor,
    those at home there are compared with all that came. Anchors with over crowd homes or four times as many visitors
    are cut into a grid of cells of at most so many, so that no task holds a crowd; no pair is left out.
    """
    n = distinct.count()
    how = tuple(plan or segments(n, bits))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1024):
                fps = part.column(0).to_numpy(zero_copy_only=False)
                key, own, row = _covered(fps, how)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(fps[row])], ["anchor", "own", "fp"])

    covered = distinct.select("fp").mapInArrow(cover, "anchor long, own boolean, fp long")
    load = covered.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("homes"))
    crowded = cut(load.filter((F.col("homes") > crowd) | (F.col("n") > 4 * crowd)))  # as many as rows by crowd at most
    grid = F.broadcast(crowded.select("anchor", F.ceil(F.greatest(F.col("homes"), F.lit(1)) / crowd).cast("int").alias("gi"), F.ceil(F.col("n") / (4 * crowd)).cast("int").alias("gj")))
    pages = max(1, min(1 << 20, int(n * sum(c.valid.sum() / len(c.valid) for c in covers(how))) // 16_384))
    dealt = covered.join(grid, "anchor", "left").fillna(1, ["gi", "gj"])
    part = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    as_home = dealt.filter("own").select("anchor", F.lit(True).alias("own"), "fp", part("gi", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("gj") - 1)).alias("j"))
    as_guest = dealt.select("anchor", F.lit(False).alias("own"), "fp", part("gj", 2).alias("j"), F.explode(F.sequence(F.lit(0), F.col("gi") - 1)).alias("i")).select("anchor", "own", "fp", "i", "j")
    page = F.when((F.col("i") > 0) | (F.col("j") > 0), F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(pages)))
    rows = as_home.unionByName(as_guest).withColumn("page", page)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["anchor"].to_numpy(), kind="stable")
        anchor, own, fps = frame["anchor"].to_numpy()[order], frame["own"].to_numpy()[order], frame["fp"].to_numpy()[order]
        ends = [*(np.flatnonzero(np.diff(anchor)) + 1).tolist(), len(anchor)]
        found = set()
        for a, b in zip([0, *ends], ends):
            here, index = np.unique(fps[a:b], return_inverse=True)
            home = np.zeros(len(here), dtype=bool)
            home[index[own[a:b]]] = True
            if len(here) > 1:
                found.update((int(here[x]), int(here[y])) for x, y in _linked(here.view(np.uint64), home, bits))
        return pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")

    return rows.groupBy("page", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fp, component_id (the smallest doc_id that links reach).

    Null and empty texts, and those without words, have fingerprint zero, which links like any other. Whole texts
    count, however long. Null doc_ids are members but no component_id, unless the component has no other. Repeated
    rows have a row each; an empty table gives an empty result; other columns of docs are not looked at.

    Equal fingerprints become one node first, so copies cost nothing more. Crowds of rows with one fingerprint get
    their answer by broadcast (join_hot).
    """
    fps = cut(fingerprints(docs, words))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    edges = cut(links(nodes, bits))
    roots = cut(components(edges))
    member = roots.join(nodes, roots["node"] == nodes["fp"]).select("root", "first_id")
    least = member.groupBy("root").agg(F.min("first_id").alias("root_id"))
    named = roots.join(least, "root").select(F.col("node"), "root_id")
    answer = cut(nodes.join(named, nodes["fp"] == named["node"], "left").select("fp", "n", F.coalesce("root_id", "first_id").alias("component_id")))
    return join_hot(fps, answer, "fp", "n", fps.count()).select("doc_id", "fp", "component_id")


def text_mark() -> Column:
    """A hash by which a text is known; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_firsts(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """docs with one row of each component of roots (mark, root): that with the smallest doc_id, then mark; null doc_ids come last.

    A component is known by its root and a row by doc_id and mark, so texts that share a doc_id do not stand for each other.
    """
    marked = docs.withColumn("_mark", text_mark())
    rows = marked.select("doc_id", "_mark").join(roots, F.col("_mark") == F.col("mark"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("k"))
    keep = least.select(F.col("k.doc_id").alias("_keep"), F.col("k.mark").alias("_keep_mark"))
    others = rows.select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_m")).join(keep, (F.col("_m") == F.col("_keep_mark")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_anti")
    firsts = join_few(marked, cut(others.distinct()), (F.col("_mark") == F.col("_m")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    if not firsts.groupBy("doc_id", "_mark").count().filter("count > 1").isEmpty():
        firsts = firsts.dropDuplicates(["doc_id", "_mark"])
    return firsts.drop("_mark")


def drop_near_copies(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """docs with one row of each component of fingerprints that at most bits differing bits link: that with the smallest doc_id. All columns stay."""
    fps = cut(fingerprints(docs.select(text_mark().alias("doc_id"), "text"), words).distinct())
    roots = cut(components(links(fps.select("fp").distinct(), bits)))
    return keep_firsts(docs, cut(fps.join(roots, fps["fp"] == roots["node"], "left").select(F.col("doc_id").alias("mark"), F.coalesce("root", "fp").alias("root"))))
