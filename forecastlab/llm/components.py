"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_few_or_hot

#: Edges that one task takes at least: few edges are not dealt out to many tasks.
PER_TASK = 10_000
#: At most so many edges, counted from both ends, go round in one task, where no step has to shuffle them.
ONE_TASK = 100_000


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, root (the smallest node it reaches) for each node of edges (a long, b long); nodes without an edge are not in it.

    Each round points nodes at the smallest neighbour: once from every node to its larger ones, once among its smaller
    ones, until no node that points at a smaller one has other neighbours. Edges and minima are tables in the checkpoint
    folder; nothing is collected. A node with very many neighbours is joined by broadcast (join_few_or_hot). Up to
    one_task edges a round is one task; beyond, each step is dealt out by node.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    n = 2 * now.count()
    now = _rounds_of_few(now, most_rounds) if n <= one_task else _rounds(now, n, most_rounds)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _rounds_of_few(now: DataFrame, most_rounds: int) -> DataFrame:
    """What _rounds gives, in one partition: a job for each round and one that looks whether it was the last."""
    of_a = Window.partitionBy("a")
    least = F.least("a", F.min("b").over(of_a)).alias("m")
    now = now.coalesce(1)
    for _ in range(most_rounds):
        seen = _pairs_of(now, ("a", "b"), ("b", "a")).groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        if seen.filter((F.col("m") < F.col("a")) & (F.col("n") > 1)).isEmpty():
            return now
        down = _pairs_of(now, ("a", "b"), ("b", "a")).select("a", "b", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        now = cut(_pairs_of(down.select("a", "b", least), ("b", "m"), ("a", "m")).filter("a != b").distinct()).coalesce(1)
    raise RuntimeError("components did not settle")


def _rounds(now: DataFrame, n: int, most_rounds: int) -> DataFrame:
    """Edges that point each node at the smallest it reaches; now has n / 2 edges (a, smaller b)."""
    for _ in range(most_rounds):
        both = _pairs_of(now, ("a", "b"), ("b", "a"))
        least, n, top, settled = _least(both, n)
        if settled:
            return now
        large = join_few_or_hot(both, least, "a", "n", n, top).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = cut(few(large.distinct(), n))
        least, n, top, _ = _least(down, n)
        small = join_few_or_hot(down, least, "a", "n", n, top)
        now = cut(few(_pairs_of(small, ("b", "m"), ("a", "m")).filter("a != b").distinct(), n))
    raise RuntimeError("components did not settle")


def _pairs_of(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """a, b: the given pairs of columns of each row."""
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return rows.select(F.inline(F.array(*[pair(*p) for p in pairs])))


def few(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which there are about n, in no more partitions than have PER_TASK each."""
    return rows.coalesce(max(1, -(-n // PER_TASK)))


def _least(edges: DataFrame, about: int) -> tuple[DataFrame, int, int, bool]:
    """a, m (the smallest of a and its neighbours b), n (their number); the number of edges, the largest n, and whether no node has a smaller neighbour and others."""
    least = cut(few(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), about))
    open_: Column = (F.col("m") < F.col("a")) & (F.col("n") > 1)
    n, top, open_nodes = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count_if(open_)).first()
    return least, n, top, open_nodes == 0
