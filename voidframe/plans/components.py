"""Connected components by alternating large and small stars (Kiveris et al., SoCC 2014).

Each half-round hangs the neighbours of a node onto the least node in sight. The edge set ends as one star per component. Every
round is a grouped minimum (combined before the shuffle) and an equi-join; lineage is cut by a checkpoint per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u")
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 64) -> DataFrame:
    """(node, component) of every node with an edge to another node; component is the least node reachable. a and b are
    comparable columns of one type; nulls and self-loops are ignored."""
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    own = checkpointed(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        own = checkpointed(_small_star(_large_star(own).where("u <> v").distinct()).where("u <> v").distinct())
        state = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return own.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
