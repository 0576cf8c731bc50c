"""Exact deduplication by skew-safe combining: local, then salted, then global groups, each by digest and full content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import root_scale


def exact_groups(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same code points; a null text counts as empty. Of equal texts the largest
    doc_id stays (a null one is the smallest); of repeated rows with that doc_id, one. An empty table gives an
    empty result; other columns of docs are not looked at.

    Rows combine three times: inside each input partition and by (digest, salt, text) in the same aggregation, then
    by (digest, text) over the salted winners. The text is a grouping key each time, so a digest alone never decides.
    The winners' answer goes back by (digest, salt, winner); no text moves a third time, and no task gets more of a
    group than one salt's share. The number of salts grows with the square root of the rows.
    """
    salts = salts or root_scale(docs.count(), 16, 65_536, by=8)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.sha2("text", 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    )
    salted = rows.groupBy("digest", "salt", "text").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    winners = salted.select("digest", "text", "salt", F.array_max("ids")["doc_id"].alias("winner"), F.size("ids").alias("n"))
    groups = winners.groupBy("digest", "text").agg(
        F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list(F.struct("salt", "winner")).alias("salted")
    )
    answer = groups.select("digest", "keep_id", "group_size", F.inline("salted")).withColumnsRenamed({"digest": "a_digest", "salt": "a_salt", "winner": "a_winner"})
    members = salted.select("digest", "salt", F.array_max("ids")["doc_id"].alias("winner"), F.sort_array("ids", asc=False).alias("ids"))
    # null-safe on all keys: plain equality would put a not-null filter below one use of the salted groups, which then are not shared
    same = F.col("digest").eqNullSafe(F.col("a_digest")) & F.col("salt").eqNullSafe(F.col("a_salt")) & F.col("winner").eqNullSafe(F.col("a_winner"))
    return (
        members.join(answer, same)
        .select("keep_id", "group_size", "winner", F.col("digest").alias("text_sha256"), F.posexplode("ids").alias("at", "id"))
        .select(
            F.col("id.doc_id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
            (F.col("winner").eqNullSafe(F.col("keep_id")) & (F.col("at") == 0)).alias("kept"), "text_sha256",
        )
    )


def drop_exact_copies(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """docs without the rows whose text a kept row has; all columns stay. The same three stages as in exact_groups.

    Of equal texts (a null one counts as empty) the row with the largest doc_id stays, of several the one whose other
    columns are largest, in their order, which their types must have. The rest of a row goes along with its text, so
    nothing is joined back. A kept null text stays null.
    """
    salts = salts or root_scale(docs.count(), 16, 65_536, by=8)
    others = ["doc_id", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*others, F.col("text").isNull().alias("_no_text")).alias("row")).select(
        "text", "row", F.sha2("text", 256).alias("digest"), F.pmod(F.xxhash64("row.doc_id"), F.lit(salts)).cast("int").alias("salt")
    )
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("row").alias("row"))
    kept = salted.groupBy("digest", "text").agg(F.max("row").alias("row"))
    return kept.select(*[F.when(~F.col("row._no_text"), F.col("text")).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
