"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A node is a hub from so many edges on, and from one in so many of all edges on, so that hubs are few; the edges of a
#: hub are dealt to so many parts.
HUB_EDGES, HUB_SHARE, SALTS = 100, 1_000, 16


def _with_least(edges: DataFrame, least: DataFrame, hub_edges: int) -> DataFrame:
    """Edges with m, the minimum of their u. least: u, m and n, the number of edges of u.

    A hub's edges are dealt to SALTS parts with a copy of its minimum each; those of other nodes lie where they are.
    """
    hubs = least.where(F.col("n") > hub_edges).select("u", F.lit(True).alias("hub"))
    # Fewer than 2 * HUB_SHARE nodes can have more than one in HUB_SHARE of the edges, so the hubs fit anywhere.
    dealt = edges.join(F.broadcast(hubs), "u", "left").withColumn("part", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hub")
    parts = F.when(F.col("n") > hub_edges, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(least.select("u", "m", F.explode(parts).alias("part")), ["u", "part"]).drop("part")


def _large_star(edges: DataFrame, hub_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    return _with_least(both, least, hub_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hub_edges: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, hub_edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge in edges (u long, v long), root being the smallest node reachable.

    Self-loops and repeated edges are allowed; nodes without edges to others are not returned. Edges are written to the
    shared folder first, so that what made them runs once. Each round is two grouped minima joined to the edges, so a
    hub's edges are never gathered in one task, and is written too. Rounds grow with the logarithm of the longest path.
    Raises if max_rounds isn't enough.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = stored(edges.where("u <> v").select("u", "v"), "edges")
    seen = mark(now)
    for done in range(max_rounds + 1):
        if not seen[0]:
            break
        hub_edges = max(HUB_EDGES, 2 * seen[0] // HUB_SHARE)
        now = stored(_small_star(_large_star(now, hub_edges) if done else now, hub_edges), "edges")
        then, seen = seen, mark(now)
        if done and then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
