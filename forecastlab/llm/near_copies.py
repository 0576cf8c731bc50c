"""Near copies by exact Jaccard similarity of word shingles; candidates by anchor-point covering of wide SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import arrow_batches, cut, join_few, slices
from .components import components, few
from .simhash import _LOWER, keep_firsts, text_mark

#: Words in a shingle; least similarity in fifths (four of five shingles in common).
WORDS, FIFTHS = 5, 4
#: Bits of a fingerprint in segments of 16, and the most that may differ in a candidate. Two segments within 1 of each other always meet at an
#: anchor, so pairs within 15 bits are always candidates; at a similarity of 0.8 the mean is 19 bits and the deviation 4.
SEGMENTS, SEGMENT_BITS, RADIUS = 8, 16, 30
ANCHORS = SEGMENTS * 2 ** (11 + 1)
#: Leading texts of a shingle that others are compared with before all are.
LEADERS = 8
_ROW = np.dtype([("anchor", "<i4"), ("role", "u1"), ("node", "<i8"), ("low", "<u8"), ("high", "<u8"), ("size", "<i4"), ("label", "<i8")])
_HOME, _GUEST = 1, 2


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """The distinct word shingles of a text: words as in simhash; with fewer words the whole sequence is one shingle."""
    parts = [w for w in (text or "").encode().translate(_LOWER).split(b" ") if w]
    if not parts:
        return set()
    joined = b" ".join(parts)
    at = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32).tolist()
    starts, ends = [0, *[a + 1 for a in at]], [*at, len(joined)]
    return {joined[a:b] for a, b in zip(starts[: max(1, len(starts) - words + 1)], ends[min(words, len(ends)) - 1 :])}


def digests(found: set[bytes]) -> np.ndarray:
    """The XXH3 values of shingles: a row of two 64-bit halves for each, ascending."""
    values = np.frombuffer(b"".join(map(xxh3_128_digest, found)), dtype="<u8").reshape(-1, 2)
    return values[np.argsort(values[:, 0])]


def are_near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles, as ascending 64-bit hashes, have a Jaccard similarity of at least FIFTHS / 5; two texts without words are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= FIFTHS * (len(a) + len(b) - both)


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits, each set if it is in over half the shingles' XXH3 values."""
    if not len(hashes):
        return bytes(16)
    bytes_, set_ = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 16), np.zeros(128, dtype=np.int64)
    for k in range(0, len(bytes_), 65_536):
        set_ += np.unpackbits(bytes_[k : k + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(set_ * 2 > len(bytes_)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """node (mark of the text), low, high, size (number of shingles) for each distinct text of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                found = [digests(shingles(t)) for t in part.column(1).to_pylist()]
                halves = np.frombuffer(b"".join(map(fingerprint, found)), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([len(f) for f in found], pa.int32())], ["node", "low", "high", "size"])

    return docs.select(text_mark().alias("node"), F.col("text").cast("string")).mapInArrow(run, "node long, low long, high long, size int").dropDuplicates(["node"])


def shingle_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node, hashes (ascending 64-bit ones of its shingles) for each text of docs that is in needed (needed), a table that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                sets = pa.array([digests(shingles(t))[:, 0].tobytes() for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["node", "hashes"])

    texts = join_few(docs.select(text_mark().alias("node"), F.col("text").cast("string")), needed, F.col("node") == F.col("needed"), "left_semi")
    return cut(texts.mapInArrow(run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")))


@cache
def anchors(threshold: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The words of the perfect [15, 11] Hamming code, of covering radius 1, beside a free bit: for each 16-bit value its nearest anchor, and the anchors within covering radius plus threshold, padded with -1."""
    values = np.arange(1 << SEGMENT_BITS, dtype=np.int64)
    bits = (values[:, None] >> np.arange(15)) & 1
    syndrome = np.bitwise_xor.reduce(bits * np.arange(1, 16), axis=1)
    home = np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values)
    codewords = np.unique(home)
    code_no = np.full(1 << SEGMENT_BITS, -1, dtype=np.int32)
    code_no[codewords] = np.arange(len(codewords))
    flips = np.array([m for m in range(1 << SEGMENT_BITS) if m.bit_count() <= 1 + threshold], dtype=np.int64)
    near = np.sort(code_no[values[:, None] ^ flips[None, :]], axis=1)[:, ::-1]
    near = near[:, : int((near >= 0).sum(axis=1).max())]
    return code_no[home], near


def _covered(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, whether it is the fingerprint's own (nearest) one, and row, for each fingerprint and anchor that covers it."""
    home, near = anchors()
    keys, own, row = [], [], []
    for s in range(SEGMENTS):
        seg = (((low if s < 4 else high) >> np.uint64(SEGMENT_BITS * (s % 4))) & np.uint64(0xFFFF)).astype(np.int64)
        got = near[seg]
        r, c = np.nonzero(got >= 0)
        keys.append(got[r, c] + s * (ANCHORS // SEGMENTS))
        own.append(got[r, c] == home[seg[r]])
        row.append(r)
    return np.concatenate(keys), np.concatenate(own), np.concatenate(row)


def _fields(part: pa.RecordBatch) -> list[np.ndarray]:
    node, low, high, size, label, asks = (part.column(k).to_numpy(zero_copy_only=False) for k in range(6))
    return [node, low.view(np.uint64), high.view(np.uint64), size, label, asks.astype(bool)]


def _mixed(node: np.ndarray) -> np.ndarray:
    """A hash of nodes, the same everywhere: it deals them to cells, and the least of some nodes is their leader."""
    return (node.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _pairs(rows: np.ndarray, most: int | None, cells: int = 500_000) -> np.ndarray:
    """Candidates between guests and homes of one anchor that have other labels, from both sides: node, other, bits apart, lead (see _mixed), and how many others the node has besides.

    Of each node's others those come that are among the `most` nearest or among the `most` leading ones; all, if most is None.
    """
    homes, guests = rows[rows["role"] & _HOME > 0], rows[rows["role"] & _GUEST > 0]
    found, out, step = [], [], max(1, cells // max(1, len(guests)))
    seen = np.zeros(len(guests), dtype=np.int64)
    for k in range(0, len(homes), step):
        here = homes[k : k + step]
        apart = np.bitwise_count(here["low"][:, None] ^ guests["low"][None, :]) + np.bitwise_count(here["high"][:, None] ^ guests["high"][None, :])
        i, j = np.nonzero(apart <= RADIUS)
        a, b = here["size"][i].astype(np.int64), guests["size"][j].astype(np.int64)
        fits = (here["label"][i] != guests["label"][j]) & (5 * np.minimum(a, b) >= FIFTHS * np.maximum(a, b))
        i, j = i[fits], j[fits]
        seen += np.bincount(j, minlength=len(guests))
        found.append(_first(j, here["node"][i], apart[i, j], most))
        at, node, bits = _first(i, guests["node"][j], apart[i, j], most)
        out.append(_rows(here["node"], at, node, bits, np.bincount(i, minlength=len(here))))
    if found:
        j, node, bits = _first(*map(np.concatenate, zip(*found)), most)
        out.append(_rows(guests["node"], j, node, bits, seen))
    return np.concatenate(out) if out else np.zeros((0, 5), dtype=np.int64)


def _rows(names: np.ndarray, at: np.ndarray, node: np.ndarray, bits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    besides = seen - np.bincount(at, minlength=len(names))
    return np.stack([names[at], node, bits.astype(np.int64), _mixed(node).astype(np.int64), besides[at]], axis=1)


def _first(j: np.ndarray, node: np.ndarray, apart: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` nearest and the `most` leading nodes of each j."""
    if most is None or len(j) == 0:
        return j, node, apart
    kept = np.zeros(len(j), dtype=bool)
    for by in (apart, _mixed(node)):
        order = np.lexsort((node, by, j))
        first = np.flatnonzero(np.diff(j[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept[order[rank < most]] = True
    return j[kept], node[kept], apart[kept]


def anchor_load(nodes: DataFrame) -> DataFrame:
    """anchor, n (guests), homes: how many nodes each anchor has. At most ANCHORS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, homes = np.zeros(ANCHORS, dtype=np.int64), np.zeros(ANCHORS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 4096):
                key, own, _ = _covered(*_fields(part)[1:3])
                n += np.bincount(key, minlength=ANCHORS)
                homes += np.bincount(key[own], minlength=ANCHORS)
        some = np.flatnonzero(n + homes)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(homes[some])], ["anchor", "n", "homes"])

    return cut(nodes.select(_NODE).mapInArrow(count, "anchor long, n long, homes long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("homes").alias("homes")))


_NODE = ["node", "low", "high", "size", "label", "asks"]


def candidates(nodes: DataFrame, most: int | None, crowd: int = 4096, load: DataFrame | None = None) -> DataFrame:
    """Candidates of nodes (node, low, high, size, label, asks) that have other labels: guest, home, apart, lead, besides (see _pairs), for each anchor.

    All nodes wait at their own anchors; those that ask visit all anchors that cover them. An anchor with over crowd
    rows is cut into a grid of cells of at most crowd homes and guests each. load may be of the same nodes in an
    earlier round.
    """

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_compared(frame, most), columns=["guest", "home", "apart", "lead", "besides"])

    return _cells(nodes, crowd, load).groupBy("cell").applyInPandas(compare, "guest long, home long, apart long, lead long, besides long")


_FIRSTS = ["guest", "nearest", "apart", "leader", "lead", "low", "high", "besides"]


def firsts(nodes: DataFrame, crowd: int = 4096) -> DataFrame:
    """Of candidates with most = 1 a row for each guest of a cell: its nearest and its leading home there, how far apart
    and with which lead, the least and the greatest home, and the most besides. So a group of many near texts makes no
    more rows than its texts visit cells."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = _compared(frame, 1)
        guest, home, apart, lead, besides = found.T
        nearest, leading = np.lexsort((home, apart, guest)), np.lexsort((home, lead, guest))
        at = np.flatnonzero(np.diff(guest[nearest], prepend=guest[nearest][:1] - 1))
        a, b, (homes, more) = nearest[at], leading[at], found[nearest][:, [1, 4]].T
        ends = [np.minimum.reduceat(homes, at), np.maximum.reduceat(homes, at), np.maximum.reduceat(more, at)] if len(at) else [home, home, besides]
        return pd.DataFrame(dict(zip(_FIRSTS, [guest[a], home[a], apart[a], home[b], lead[b], *ends])))

    return _cells(nodes, crowd).groupBy("cell").applyInPandas(compare, ", ".join(f"{k} long" for k in _FIRSTS))


def _compared(frame: pd.DataFrame, most: int | None) -> np.ndarray:
    """The distinct rows of _pairs over the anchors of a cell."""
    rows = np.frombuffer(b"".join(frame["rows"]), dtype=_ROW)
    rows = rows[np.argsort(rows["anchor"], kind="stable")]
    ends = [*(np.flatnonzero(np.diff(rows["anchor"])) + 1).tolist(), len(rows)]
    return np.unique(np.concatenate([_pairs(rows[a:b], most) for a, b in zip([0, *ends], ends)]), axis=0)


def _cells(nodes: DataFrame, crowd: int, load: DataFrame | None = None) -> DataFrame:
    """cell, rows: the nodes that meet in a cell, by anchor (see candidates)."""
    nodes, load = nodes.select(_NODE), load or anchor_load(nodes)
    pages = max(1, min(ANCHORS, load.agg(F.coalesce(F.sum(F.col("n") + F.col("homes")), F.lit(0))).first()[0] // 16_384))
    crowded = [(r["anchor"], max(1, -(-r["homes"] // crowd)), max(1, -(-r["n"] // crowd))) for r in load.filter(F.col("n") + F.col("homes") > crowd).orderBy("anchor").collect()]  # at most ANCHORS rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid_i, grid_j, first, at = np.ones(ANCHORS, dtype=np.int64), np.ones(ANCHORS, dtype=np.int64), np.arange(ANCHORS, dtype=np.int64) % pages, pages
        for anchor, i, j in crowded:
            grid_i[anchor], grid_j[anchor], first[anchor] = i, j, at
            at += i * j
        for batch in batches:
            for part in slices(batch, 1024):
                node, low, high, size, label, asks = _fields(part)
                key, own, row = _covered(low, high)
                dealt, mixed = [], _mixed(node)
                for role, chosen in ((_HOME, own), (_GUEST, asks[row])):
                    k, r = key[chosen], row[chosen]
                    mine, over = (mixed[r] % grid_i[k].astype(np.uint64), grid_j[k]) if role == _HOME else (mixed[r] // np.uint64(7) % grid_j[k].astype(np.uint64), grid_i[k])
                    mine, again = np.repeat(mine.astype(np.int64), over), np.arange(over.sum()) - np.repeat(np.cumsum(over) - over, over)
                    k, r = np.repeat(k, over), np.repeat(r, over)
                    out = np.empty(len(k), dtype=_ROW)
                    out["anchor"], out["role"], out["node"], out["low"], out["high"], out["size"], out["label"] = k, role, node[r], low[r], high[r], size[r], label[r]
                    dealt.append((first[k] + (mine * grid_j[k] + again if role == _HOME else again * grid_j[k] + mine), out))
                cell, out = np.concatenate([c for c, _ in dealt]), np.concatenate([o for _, o in dealt])
                order = np.argsort(cell, kind="stable")
                cell, out = cell[order], out[order]
                begins = np.flatnonzero(np.diff(cell, prepend=-1))
                ends = np.append(begins[1:], len(cell))
                yield pa.RecordBatch.from_arrays([pa.array(cell[begins]), pa.array([out[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())], ["cell", "rows"])

    return nodes.mapInArrow(deal, "cell long, rows binary")


def confirmed(pairs: DataFrame, sets: DataFrame, hot: int = 20_000) -> DataFrame:
    """Those of pairs (guest, home) that share at least four of five shingles, by joining their sets (node, hashes) to both sides.

    The homes of over hot pairs, whose number is that of all pairs by hot at most, go to their pairs one batch of
    pairs at a time: their pairs are spread by the guest, and a copy of the home's set comes to each spread.
    """
    counts = cut(few(pairs.groupBy("home").agg(F.count("*").alias("n")), pairs.count()).filter(F.col("n") > hot).withColumn("spread", F.ceil(F.col("n") / hot).cast("int")))
    with_guest = pairs.join(sets.select(F.col("node").alias("guest"), F.col("hashes").alias("guest_set")), "guest")
    homes = sets.select(F.col("node").alias("home"), F.col("hashes").alias("home_set"))
    if counts.isEmpty():
        both = with_guest.join(homes, "home")
    else:
        spread = F.broadcast(counts.select("home", "spread"))  # a row for each hot home
        dealt = with_guest.join(spread, "home", "left").withColumn("at", F.pmod(F.xxhash64("guest"), F.coalesce("spread", F.lit(1))).cast("int")).drop("spread")
        copies = homes.join(spread, "home", "left").withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))).drop("spread")
        both = dealt.join(copies, ["home", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                near = [are_near(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield part.select(["guest", "home"]).filter(pa.array(near, pa.bool_()))

    return both.select("guest", "home", "guest_set", "home_set").mapInArrow(run, "guest long, home long")


def _one_each(found: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Of each of n nodes' candidates over all its cells (see firsts) the nearest and the leading one as pairs (guest, home); and all nodes with candidates: needed, more."""
    best = cut(few(found.groupBy("guest").agg(
        F.min_by("nearest", F.struct("apart", "nearest")).alias("nearest"), F.min_by("leader", F.struct("lead", "leader")).alias("leader"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("besides").alias("besides")
    ), n))
    pairs = best.select(F.explode(F.array_distinct(F.array("nearest", "leader"))).alias("home"), "guest").select(F.least("guest", "home").alias("guest"), F.greatest("guest", "home").alias("home")).distinct()
    return pairs, best.select(F.col("guest").alias("needed"), ((F.col("besides") > 0) | (F.col("low") != F.col("high"))).alias("more"))


def prefixes(sets: DataFrame) -> DataFrame:
    """node, size, h, rest: of each set (node, hashes) the rarest fifth of its shingles and one more, without those that no other set has; rest counts from h on.

    Two sets that are four fifths alike have one of these in common, in whatever order all sets rank shingles. Passages
    that many texts share are not among them, unless they are over four fifths of a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                found = [np.frombuffer(b, dtype="<i8") for b in part.column(1).to_pylist()]
                n = np.array([len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(np.concatenate(found))], ["node", "size", "h"])

    rows = sets.select("node", "hashes").mapInArrow(run, "node long, size int, h long")
    known = rows.join(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h", "left")
    ranked = known.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "h"))).alias("ranked"))
    first = F.slice("ranked", F.lit(1), F.col("size") - F.floor((4 * F.col("size") + 4) / 5).cast("int") + 1)
    return cut(ranked.select("node", "size", F.posexplode(first).alias("at", "x")).filter("x.n > 1").select("node", "size", "x.h", (F.col("size") - F.col("at")).alias("rest")))


def _shared(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (guest, home) of nodes with other labels that share a shingle of their prefixes (rows), one of which leads by a hash among those that have it.

    What two sets that are four fifths alike share is four ninths of both sizes; from their first common shingle on, in
    the order that ranks all, each has that many.
    """
    known = rows.join(nodes.select("node", "label"), "node")
    leads = F.array(*[F.min_by(F.struct("node", "label", "size", "rest"), F.struct(F.xxhash64("node", F.lit(k)), "node")) for k in range(LEADERS)])
    lead = known.groupBy("h").agg(leads.alias("leads"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    apart = known.join(lead.select("h", F.explode(F.array_distinct("leads")).alias("lead")), "h").filter(F.col("label") != F.col("lead.label"))
    fits = 9 * F.least("rest", "lead.rest") >= 4 * (F.col("size") + F.col("lead.size"))
    return apart.filter(fits).select(F.least("node", "lead.node").alias("guest"), F.greatest("node", "lead.node").alias("home")).distinct()


def _links_between(rows: DataFrame, nodes: DataFrame, sets: DataFrame, block: int = 24) -> DataFrame:
    """Links (guest, home) between nodes with other labels that share a shingle of their prefixes (rows); all of them.

    Of each shingle's labels the most frequent asks nothing, so a large component is not compared with itself. A node
    asks other labels (a table of nodes and labels, not of pairs); those that ask a label and its members meet in blocks
    of about `block` each, and only links come out.
    """
    known = rows.join(nodes.select("node", "label"), "node").withColumn("spare", 9 * F.col("rest") - 4 * F.col("size"))
    by_label = known.groupBy("h", "label").agg(F.min("size").alias("least"), F.max("spare").alias("most"), F.count("*").alias("n"))
    main = by_label.groupBy("h").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    asking = known.join(main.select("h", "main"), "h").filter("label != main").drop("n")
    of = by_label.select("h", F.col("label").alias("of"), "least", "most")
    asks = cut(asking.join(of, "h").filter("label != of AND spare >= 4 * least AND most >= 4 * size").select("of", "node").distinct())

    def blocks(members: DataFrame, name: str) -> DataFrame:
        n = members.groupBy("of").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        dealt = members.join(n, "of").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")))
        return dealt.join(sets, "node").groupBy("of", "at").agg(F.collect_list(F.struct("node", "hashes")).alias(name)).drop("at")

    members = nodes.select(F.col("label").alias("of"), "node").join(asks.select("of").distinct(), "of", "left_semi").join(rows.select("node").distinct(), "node", "left_semi")
    both = blocks(asks, "askers").join(blocks(members, "members"), "of").select("askers", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ((askers,), (members,)) = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = [np.frombuffer(m["hashes"], dtype="<u8") for m in members]
                size = np.array([len(f) for f in found])
                joined, owner = np.concatenate(found), np.repeat(np.arange(len(found)), size)
                for a in askers:
                    own = np.frombuffer(a["hashes"], dtype="<u8")
                    both = np.bincount(owner[np.isin(joined, own)], minlength=len(found))
                    near = np.flatnonzero((5 * both >= FIFTHS * (len(own) + size - both)) & np.array([m["node"] != a["node"] for m in members]))
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array([a["node"]] * len(near), pa.int64()), pa.array([members[k]["node"] for k in near], pa.int64())], ["guest", "home"])

    return both.mapInArrow(run, "guest long, home long")


def _merged(nodes: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """n nodes with the labels of the components that links (guest, home) make of theirs."""
    good = cut(links)
    if (k := good.count()) == 0:
        return nodes
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    found = few(few(few(good, k).join(of("guest"), "guest"), k).join(of("home"), "home"), k)
    roots = components(found.select(F.col("label_guest").alias("a"), F.col("label_home").alias("b")))
    return cut(few(nodes.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), n))


def near_roots(docs: DataFrame) -> DataFrame:
    """mark, root for each distinct text of docs (text): the components that confirmed candidates make.

    A group of many texts near each other would have all its pairs as candidates. So each text first names two over all
    its anchors: the nearest, and the one that leads by a hash, which is mostly the same for a whole group. Texts that
    have more are then joined exactly, by the rarest of their shingles (see prefixes): first each with leading texts
    that have the shingle, then, in blocks, all that are still in other components. Candidates are named from both sides, so the two
    texts of one that was not tested both have more: none goes untested unless it cannot be near or is in one component.
    """
    nodes = cut(fingerprints(docs).withColumn("label", F.col("node")))
    n = nodes.count()
    pairs, involved = _one_each(firsts(few(nodes, 4 * n).withColumn("asks", F.lit(True))), n)
    nodes = cut(few(nodes.select("node", "label"), n))
    sets = shingle_sets(docs, involved)
    nodes = _merged(nodes, confirmed(cut(few(pairs, 2 * n)), sets), n)
    more = involved.filter("more").select(F.col("needed").alias("node"))
    if not more.isEmpty():
        rows = prefixes(sets.join(more, "node", "left_semi"))
        nodes = _merged(nodes, confirmed(cut(_shared(rows, nodes)), sets), n)
        nodes = _merged(nodes, _links_between(rows, nodes, sets), n)
    return nodes.select(F.col("node").alias("mark"), F.col("label").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near_roots: that with the smallest doc_id. All columns stay."""
    with arrow_batches(docs.sparkSession, 1_000, "16m"):  # rows hold texts and sets of shingles, two at a time
        roots = cut(near_roots(docs))
    return keep_firsts(docs, roots)
