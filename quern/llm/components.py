"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, hot_keys, lookup_join, written


def _with_least(pairs: DataFrame) -> DataFrame:
    """(a, b, m) of every pair, m the least b of its a; an a with very many pairs is dealt to many tasks."""
    least = written(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    return lookup_join(pairs, least, "a", hot=hot_keys(least, "a")).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down)
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one ordered type); root is the least node reachable.

    Each step is written to the shared folder.  Least neighbours are partial minima, and the pairs of a node
    with very many neighbours are dealt to many tasks when they are joined with its least one, so that such a node isn't
    gathered anywhere.  Loops and repeated edges are allowed; nodes must not be null.
    """
    current = written(edges.toDF("a", "b").where("a <> b").distinct(), "edges")
    state = None
    while True:
        row = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        now = (row[0], row[1])
        if now == state or now[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state, before = now, current
        large = written(_large_star(current), "stars")
        current = written(_small_star(large), "edges")
        dropped(before)
        dropped(large)
