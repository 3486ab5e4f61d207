"""Connected components of an edge table by alternating star contraction.

Every round is two grouped minima over the edges, so it needs O(log n) rounds on chains and no state on the
driver beyond one change count per round.  Each round's edges are written to the shared folder; nothing is kept
in executors.  A hub's minimum is combined before the shuffle, and the edges of a hub are dealt over ``SALTS`` tasks to meet
it: hubs have more than ``HUB`` edges (fewer are little work for one task) and more than a thousandth of all, so there are
at most 2,000, whose names are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.state.shared import drop, materialise


SMALL, HUB, SALTS = 1_000_000, 100_000, 64


def _star(edges: DataFrame, larger_only: bool, total: int, hub: int) -> DataFrame:
    """Link the neighbours of every node (only the larger, or only the smaller ones) to its least neighbour."""
    if larger_only:
        pairs = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
    least = pairs.groupBy("n").agg(F.min("m").alias("lo"), F.count("*").alias("degree")).select("n", F.least("n", "lo").alias("lo"), (F.col("degree") > max(hub, total // 1000)).alias("hub"))
    if total > hub:
        hubs = F.broadcast(least.where("hub").select("n", "hub"))
        salted = pairs.join(hubs, "n", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("m"), F.lit(SALTS))).otherwise(0)).drop("hub")
        every = least.withColumn("salt", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))))
        joined = salted.join(every.drop("hub"), ["n", "salt"])
    else:
        joined = pairs.join(least, "n")
    if larger_only:
        out = joined.where("m > n").select(F.col("m").alias("a"), F.col("lo").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("lo").alias("b")).union(least.select(F.col("n").alias("a"), F.col("lo").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its least node.

    Nodes may be integers or strings.  Null ends and loops are dropped; a node met only in loops is absent,
    callers take such a node as its own component.  An empty edge table gives an empty result.
    """
    cur = materialise(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    count = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    seen = cur.agg(F.count("*"), count).first()
    for _ in range(max_rounds):
        if not seen[0]:
            break
        nxt = _star(_star(cur, True, seen[0], hub), False, seen[0], hub).distinct()
        if seen[0] < SMALL:  # few edges: few files
            nxt = nxt.coalesce(8)
        nxt = materialise(nxt, "cc")
        now = nxt.agg(F.count("*"), count).first()
        drop(cur)
        cur = nxt
        if tuple(now) == tuple(seen):
            break
        seen = now
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
