"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import BROADCAST_ROWS, materialize, spread_join


def _with_least(edges: DataFrame, least: DataFrame, bound: int) -> DataFrame:
    """edges (a, b) with the least node of a's neighbourhood. The centre of a large star is a hot key: least is broadcast where
    its bound allows, and else hot centres are dealt over tasks."""
    if bound <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least), "a")
    return spread_join(edges, materialize(least, "least"), "a", "_n", F.col("b"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node's larger neighbours to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("_n")).select("a", F.least("a", "_m").alias("_m"), "_n")
    return _with_least(both.filter("b > a"), least, 2 * n).select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these. Edges point to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("_n"))
    moved = _with_least(edges, least, n).filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (a, b: longs, any order): component is the smallest node it can reach.

    Neighbourhoods are never gathered: a star is a minimum, added up before the shuffle, and a join. Each round is written to the
    shared folder; the work ends when a round changes nothing, and raises an error if that takes more than `rounds`."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        # a large star has at most as many edges as before, so one count bounds both tables
        now = materialize(_small_star(_large_star(now, seen[0]), seen[0]), "edges")
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components are not final after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
