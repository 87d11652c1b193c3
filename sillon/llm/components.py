"""Connected components of large link tables by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, packed


def _side(least: DataFrame, edges: int) -> DataFrame:
    """Least neighbours, at most two for each of so many edges: broadcast where they are few."""
    return F.broadcast(least) if edges <= BROADCAST_ROWS // 8 else least


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = packed(both.groupBy("a").agg(F.min("b").alias("m")), 2 * n).select("a", F.least("a", "m").alias("m"))
    return both.join(_side(least, n), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = packed(down.groupBy("a").agg(F.min("b").alias("m")), 2 * n)
    moved = down.join(_side(least, n), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """Columns node, component (the least node reachable) for every node of ``links`` (a, b) that isn't its own component.

    Each step is written to the shared folder. Chains shorten by half in a step, so steps grow with the logarithm of
    the longest path. Loops and repeated links are of no account. ``most`` is a bound on the number of links, if
    one is known.
    """
    distinct = links.filter("a <> b").select("a", "b").distinct()
    edges = materialize(distinct if most is None else packed(distinct, most), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state or not now.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
        edges = materialize(packed(_small_star(_large_star(edges, now.n), now.n), 2 * now.n), "edges")
