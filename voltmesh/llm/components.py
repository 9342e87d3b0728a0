"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_LISTED = 1000


def hot_nodes(both: DataFrame, most_edges: int) -> DataFrame | None:
    """u and salts, over how many tasks its edges are dealt, of the nodes with over ``most_edges`` edges; None without any. A short list is broadcast."""
    found = both.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("u", F.ceil(F.col("n") / most_edges).cast("int").alias("salts"))
    rows = found.limit(MOST_LISTED + 1).collect()
    if not rows:
        return None
    return F.broadcast(both.sparkSession.createDataFrame(rows, "u long, salts int")) if len(rows) <= MOST_LISTED else found


def join_least(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least of u and its neighbours; a hot node's edges are dealt by a hash of v, and its row of m stands once for each task."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if hot is None:
        return edges.join(least, "u")
    salts = F.coalesce("salts", F.lit(1))
    dealt = edges.join(hot, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), salts).cast("int").alias("salt"))
    spread = least.join(hot, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return dealt.join(spread, ["u", "salt"]).select("u", "v", "m")


def are_stars(edges: DataFrame) -> bool:
    """Whether every greater end has one edge only and is no lesser end: then the edges are the components, each below its least node."""
    roles = edges.select(F.col("a").alias("node"), F.lit(0).alias("below")).union(edges.select("b", F.lit(1)))
    return roles.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("least")).where("n > 1 or (n = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 100, most_edges: int = 1000) -> DataFrame:
    """node and component (its least node) of every node in ``edges`` (a, b: long, a <> b).

    Each step needs the least neighbour only, an aggregate that combines before its shuffle, and a join that is salted
    where a node has very many edges. Rounds grow with the logarithm of the longest chain; should ``most_rounds``
    not do, an error is raised.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds = 0
    while not are_stars(now):
        if rounds == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        rounds += 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hot = hot_nodes(both, most_edges)
        large = join_least(both, hot).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # a node has no more edges to smaller ones now than it had edges before, so the same nodes are hot
        joined = join_least(large.select(F.col("b").alias("u"), F.col("a").alias("v")), hot)
        linked = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(joined.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        now = cut(linked)
    centres = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(centres)
