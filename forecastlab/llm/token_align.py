"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a sentencepiece model cover the same bytes of a text.

A text counts with a space before it, which the sentencepiece model adds itself. Tokens get byte ranges from the libraries'
own spans: character offsets of the tokenizers library, byte spans of sentencepiece's proto result. Where these are too
coarse (characters cut into several tokens, byte-fallback tokens) decoded bytes refine them.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, arrow_batches, cut, shared_dir, slices
from .token_files import LETTERS, new_folder

#: Segments that a worker remembers, the longest of them, and links of all of them, before it starts anew: its bound on memory.
REMEMBERED, LONGEST, REMEMBERED_LINKS = 140_000, 64, 1_200_000
#: Characters of new segments that the libraries get as one text.
JOINED = 1 << 11
#: Rows of the table of id pairs up to which it is broadcast; beyond, only pairs with a large share of all links are.
FEW_PAIRS = 1_000_000
#: White space of either tokenizer: Python's, and one mark that older Unicode counted.
OLD_BLANK = "\u180e"
BLANK = r"\s" + OLD_BLANK
#: What is read of a piece of sentencepiece's proto result.
SPAN = attrgetter("id", "begin", "end")
#: An id pair is one number: A's id times this, plus B's.
PAIR = 1 << 32


def refined_ends(start: np.ndarray, end: np.ndarray, size: np.ndarray, first: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes. start and end are coarse; size is that of the token's decoded bytes.

    A token whose coarse range is as long as its bytes is right. Others follow the last right one before them, or the
    beginning of their text, byte by byte. first has the index of the first token of each one's text, base where that begins.
    """
    at, total = np.arange(len(size)), np.cumsum(size)
    right = np.maximum.accumulate(np.where(end - start == size, at, -1)) if len(size) else at
    has = right >= first
    anchor = np.where(has, right, first)
    return np.where(has, end[anchor] + total - total[anchor], base + total - total[anchor] + size[anchor])


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index in A, index in B) of tokens whose ranges overlap; both cover the same bytes without gaps."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    low = np.searchsorted(b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, a_ends, side="left") - low
    a = np.repeat(np.arange(len(a_ends)), n)
    return a, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(a))


class Growing:
    """An array of numbers that is added to at its end."""

    def __init__(self, kind: str):
        self.data, self.n = np.zeros(1 << 12, dtype=kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + len(values), dtype=self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Rows:
    """Lists of numbers end to end: at and n say where each is in flat."""

    def __init__(self, kind: str):
        self.at, self.n, self.flat = Growing("i8"), Growing("i8"), Growing(kind)

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        self.at.add(self.flat.n + np.cumsum(sizes) - sizes)
        self.n.add(sizes)
        self.flat.add(values)

    def of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the entries, end to end, and how many each has."""
        n = self.n.data[entries]
        return self.flat.data[np.repeat(self.at.data[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def texts_by_row(rows: np.ndarray, parts: list[str], n: int) -> list[str]:
    """Of n rows, each one's parts joined; rows ascends."""
    ends = np.searchsorted(rows, np.arange(n), side="right").tolist()
    return ["".join(parts[x:y]) for x, y in zip([0, *ends[:-1]], ends)]


class Aligner:
    """Aligns texts by a tokenizers file (A) and a sentencepiece model (B).

    Where neither has tokens across a space that follows a character that is no white space, texts are cut before such
    spaces, and what a short segment gives is remembered: entries are numbers of remembered segments. New segments are
    joined again to longer texts, which the libraries take faster. Otherwise texts stay whole.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte_of = {letter: b for b, letter in LETTERS.items()}
        vocabulary = {i: t for t, i in self.a.get_vocab().items()}
        names = [vocabulary.get(i, "") for i in range(max(vocabulary) + 1)]
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.words = [[f"{i}{mark}" for i in range(max(len(names), len(pieces)))] for mark in (",", "|", ";", "")]
        before = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cut = usual and not any(re.search("[^▁]▁", p) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ok, self.groups, self.texts, self.uses = Growing("?"), Growing("i8"), [], np.zeros(0, dtype=np.int64)
        self.a_ids, self.a_ends, self.b_ids, self.b_ends, self.pairs = Rows("i4"), Rows("i4"), Rows("i4"), Rows("i4"), Rows("i8")

    @property
    def full(self) -> bool:
        return len(self.texts) > REMEMBERED or self.pairs.flat.n > REMEMBERED_LINKS

    def forget(self) -> None:
        """Keeps only the segments that were used again, of at most half of the room the most used; their entries change."""
        often = np.sort(self.uses)[::-1][REMEMBERED // 2] if len(self.uses) > REMEMBERED // 2 else 0
        old, known, uses, texts = (self.ok, self.groups, self.a_ids, self.a_ends, self.b_ids, self.b_ends, self.pairs), self.known, self.uses, self.texts
        kept = np.fromiter((e for e in known.values() if uses[e] > max(1, often)), dtype=np.int64)
        self.clear()
        if old[-1].of(kept)[1].sum() > REMEMBERED_LINKS // 2:
            return
        place = np.full(len(uses), -1, dtype=np.int64)
        place[kept] = np.arange(len(kept))
        self.known = {s: int(k) for s, e in known.items() if (k := place[e]) >= 0}
        self.texts, self.uses = [texts[e] for e in kept.tolist()], uses[kept] // 2
        for had, new in zip(old, (self.ok, self.groups, self.a_ids, self.a_ends, self.b_ids, self.b_ends, self.pairs)):
            if isinstance(had, Rows):
                values, sizes = had.of(kept)
                new.add(sizes, values)
            else:
                new.add(had.data[kept])

    def segments(self, text: str) -> list[str]:
        """The segments of text, which begins with a space; each begins with one."""
        if not self.cut:
            return [text]
        words = text.split(" ")[1:]
        if "" not in words and not re.search(f"[{BLANK}]", "".join([w[-1] for w in words])):
            return [f" {w}" for w in words]
        return re.split(f"(?<=[^{BLANK}])(?= [\\s\\S])", text)

    def joined(self, segments: list[str]) -> tuple[list[str], list[str]]:
        """The segments in an order in which they, end to end, are the texts that the libraries get; and these texts."""
        # a text's own U+2581 would join the next segment's space
        alone = [s for s in segments if "▁" in s or s[-1].isspace() or s[-1] == OLD_BLANK] if self.cut else segments
        others = set(alone)
        inner = [s for s in segments if s not in others] if others else segments
        ends = np.cumsum([len(s) for s in inner]) // JOINED if inner else np.zeros(0, dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(inner)] if inner else [0]
        return inner + alone, ["".join(inner[x:y]) for x, y in zip(cuts, cuts[1:])] + alone

    def spans(self, texts: list[str], base: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
        """For each tokenizer the ids, and the coarse first byte and end of each token, in texts laid end to end."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        byte_at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
        char_base = np.cumsum([0, *map(len, texts)])
        gc.disable()  # many small objects that are soon gone
        got = self.a.encode_batch(texts, add_special_tokens=False)
        of = np.repeat(np.arange(len(got)), [len(e) for e in got])
        numbers = lambda rows: np.fromiter(chain.from_iterable(rows), dtype=np.int64)
        a = byte_at[numbers(chain.from_iterable(e.offsets for e in got)).reshape(-1, 2) + char_base[of][:, None]]
        a_ids = numbers(e.ids for e in got)
        protos = self.b.encode([t[1:] for t in texts], return_type="proto")
        of = np.repeat(np.arange(len(protos)), [len(p.pieces) for p in protos])
        b = numbers(map(SPAN, chain.from_iterable(p.pieces for p in protos))).reshape(-1, 3)
        gc.enable()
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=bool)
        # the model's own space is before the first span
        return (a_ids, a[:, 0], a[:, 1]), (b[:, 0], base[of] + np.where(first, 0, 1 + b[:, 1]), base[of] + 1 + b[:, 2])

    def learn(self, new: list[str]) -> dict[str, int]:
        """Entries of new segments, aligned in bulk."""
        segments, texts = self.joined(new)
        data = [s.encode() for s in segments]
        ends = np.cumsum([len(d) for d in data])
        begins = ends - [len(d) for d in data]
        base = np.cumsum([0, *[len(t.encode()) for t in texts]])
        sides, ok, whole = [], np.ones(len(segments), dtype=bool), b"".join(data)
        for (ids, start, end), table, sizes in zip(self.spans(texts, base), (self.a_bytes, self.b_bytes), self.sizes):
            parts = [table[i] for i in ids.tolist()]
            segment = np.searchsorted(ends, start, side="right")
            if b"".join(parts) != whole:
                at = np.searchsorted(segment, np.arange(len(segments) + 1)).tolist()
                ok &= [b"".join(parts[x:y]) == d for x, y, d in zip(at, at[1:], data)]
            first = np.searchsorted(segment, segment)
            sides.append((ids, refined_ends(start, end, sizes[ids], first, begins[segment]), segment))
        (a, a_end, a_of), (b, b_end, b_of) = [tuple(x[ok[side[2]]] for x in side) for side in sides]
        i, j = overlaps(a_end, b_end)
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        count = lambda of: np.bincount(of, minlength=len(segments))
        known = len(self.texts)
        self.a_ids.add(count(a_of), a)
        self.a_ends.add(count(a_of), a_end - begins[a_of])
        self.b_ids.add(count(b_of), b)
        self.b_ends.add(count(b_of), b_end - begins[b_of])
        self.pairs.add(count(a_of[i]), a[i] * PAIR + b[j])
        group_of = np.searchsorted(ends, common)
        self.groups.add(count(group_of))
        self.ok.add(ok)
        self.texts += self.group_texts((a, a_end, a_of), (b, b_end, b_of), common, group_of, len(segments))
        return {s: known + k for k, s in enumerate(segments)}

    def group_texts(self, a: tuple, b: tuple, common: np.ndarray, group_of: np.ndarray, n: int) -> list[str]:
        """Of each segment its groups: A's ids, a bar, B's ids; groups apart by semicolons."""
        last_group = np.concatenate([group_of[1:] != group_of[:-1], [True]]) if len(common) else np.zeros(0, dtype=bool)
        keys, ids, marks, segments = [], [], [], []
        for side, (these, end, of) in enumerate((a, b)):
            group = np.searchsorted(common, end)
            closes = np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, dtype=bool)
            keys.append(2 * group + side)
            ids.append(these)
            marks.append(np.where(closes, np.where(last_group[group], 3, 2) if side else 1, 0))
            segments.append(of)
        keys, ids, marks, segments = map(np.concatenate, (keys, ids, marks, segments))
        order = np.argsort(keys, kind="stable")
        words = self.words
        return texts_by_row(segments[order], [words[m][i] for m, i in zip(marks[order].tolist(), ids[order].tolist())], n)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the texts' segments, end to end, and the number of the text of each.

        Texts that are null or empty, or whose bytes the tokens do not give back, have none. Entries hold until forget().
        """
        cut_up = [self.segments(" " + t) if t else [] for t in texts]
        flat = [s for parts in cut_up for s in parts]
        of = np.repeat(np.arange(len(texts)), [len(p) for p in cut_up])
        entries = np.fromiter(map(self.known.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            unknown = [flat[i] for i in missing.tolist()]
            found = self.learn(list(dict.fromkeys(unknown)))
            self.known.update((s, e) for s, e in found.items() if len(s) <= LONGEST)
            entries[missing] = np.fromiter(map(found.__getitem__, unknown), dtype=np.int64, count=len(unknown))
        uses = np.bincount(entries, minlength=len(self.texts))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        good = np.bincount(of, ~self.ok.data[entries], minlength=len(texts))[of] == 0
        return entries[good], of[good]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner of two files, with its memory; it outlives tasks."""
    return Aligner(a_path, b_path)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, a_ends, b_ids, b_ends (where tokens end in space + text, in bytes) and groups (text) of each row of docs.

    Texts that are null, empty or not given back by the tokens of both have empty arrays and ''. Rows that repeat come out each,
    null doc_ids stay, other columns are not passed on, and an empty table gives none.
    """
    names = ["doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "groups"]

    def lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        for batch in batches:
            for part in slices(batch, 64):
                if known.full:
                    known.forget()
                entries, of = known.align(part.column(1).to_pylist())
                columns, n = [], part.num_rows
                for ids, ends in ((known.a_ids, known.a_ends), (known.b_ids, known.b_ends)):
                    (these, size), (at, _) = ids.of(entries), ends.of(entries)
                    # a segment ends where its last token does
                    length = at[np.cumsum(size) - 1] if len(size) else size
                    before = np.cumsum(length) - length
                    before -= before[np.searchsorted(of, of)] if len(of) else 0
                    columns += [lists(these, np.repeat(of, size), n), lists(at + np.repeat(before, size), np.repeat(of, size), n)]
                groups = group_lists(known, entries, of, n)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(groups, pa.string())], names)

    return texts_of(docs).mapInArrow(run, "doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>, groups string")


def group_lists(known: Aligner, entries: np.ndarray, of: np.ndarray, n: int) -> list[str]:
    """The groups of n texts whose segments are entries."""
    parts = [known.texts[e] for e in entries.tolist()]
    at = np.searchsorted(of, np.arange(n + 1)).tolist()
    return [";".join(parts[x:y]) for x, y in zip(at, at[1:])]


def linked_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links (pair, times) of each row of docs.

    A pair is A's id * 2 ** 32 + B's. Rows whose row is null are no texts: their links add up those of all texts of a task.
    """
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    link = pa.struct([("pair", pa.int64()), ("times", pa.int64())])

    def batch_of(columns: list, pairs: np.ndarray, times: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        cells = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], fields=list(link))
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], names)

    def added_up(known: Aligner, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(times)
        pairs, size = known.pairs.of(used)
        if len(pairs):
            pairs, place = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(total, place, np.repeat(times[used], size))
            ends = np.append(np.arange(0, len(pairs), 10_000), len(pairs))
            none = [pa.nulls(len(ends) - 1, pa.int64())] * 6
            yield batch_of([*none, pa.nulls(len(ends) - 1, pa.string())], pairs, total, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row, all_times = aligner(a_path, b_path), TaskContext.get().partitionId() << 33, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 64):
                if known.full:
                    yield from added_up(known, all_times)
                    known.forget()
                    all_times = np.zeros(0, dtype=np.int64)
                entries, of = known.align(part.column(1).to_pylist())
                n, m = part.num_rows, len(known.texts)
                now = np.bincount(entries, minlength=m)
                now[: len(all_times)] += all_times
                all_times = now
                sums = [np.bincount(of, x.data[entries], minlength=n).astype(np.int64) for x in (known.a_ids.n, known.b_ids.n, known.groups, known.pairs.n)]
                groups = [sha256(g.encode()).hexdigest() if g else "" for g in group_lists(known, entries, of, n)]
                each, times = np.unique(of * m + entries, return_counts=True)
                pairs, size = known.pairs.of(each % max(1, m))
                ends = np.concatenate([[0], np.cumsum(np.bincount(each // max(1, m), size, minlength=n).astype(np.int64))])
                columns = [pa.array(np.arange(row, row + n)), part.column(0), *map(pa.array, sums), pa.array(groups, pa.string())]
                yield batch_of(columns, pairs, np.repeat(times, size), ends)
                row += n
        yield from added_up(known, all_times)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: long>>"
    return texts_of(docs).mapInArrow(run, schema)


def alignment_report(docs: DataFrame, a_path: str, b_path: str, few: int = FEW_PAIRS) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is that of its id pair over all texts; n_best counts links whose count is the highest of their B id. Texts
    without tokens (see alignments) have zeros and ''. Texts are encoded once and their links written to the shared folder.
    The table of id pairs is broadcast while it has at most `few` rows. Beyond, pairs with over 0.1% of all links, so at most
    1000, are, and the other links are shuffled to theirs.
    """
    spark, folder = docs.sparkSession, new_folder(shared_dir(docs.sparkSession), "alignment")
    with arrow_batches(spark, 1_000, "16m"):
        linked_texts(docs, a_path, b_path).write.parquet(folder)
    written = spark.read.parquet(folder)
    linked = written.filter("row IS NOT NULL")
    counted = cut(written.filter("row IS NULL").select(F.explode("links").alias("link")).groupBy("link.pair").agg(F.sum("link.times").alias("n")))
    highest = counted.groupBy((F.col("pair") % PAIR).alias("b")).agg(F.max("n").alias("highest"))
    known = counted.withColumn("b", F.col("pair") % PAIR).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    rows, total = counted.agg(F.count("*"), F.sum("n")).first()
    links = linked.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.times")
    if rows <= few:
        found = links.join(F.broadcast(known), "pair")
    else:
        often = F.col("n") > total * HOT_SHARE
        hot = known.filter(often).select("pair", F.col("n").alias("hot_n"), F.col("best").alias("hot_best"))
        some = links.join(F.broadcast(hot), "pair", "left")
        # links of hot pairs ask for nothing more, each at a place of its own
        asking = some.withColumn("ask", F.when(F.col("hot_n").isNull(), F.col("pair")).otherwise(-1 - F.col("row")))
        rest = asking.join(known.filter(~often).withColumnRenamed("pair", "ask").hint("merge"), "ask", "left")
        found = rest.withColumns({"n": F.coalesce("n", "hot_n"), "best": F.coalesce("best", "hot_best")})
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    whole = linked.drop("links").join(sums, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
