"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round takes the least neighbour of each node, an aggregation that begins on the map side, and joins it back to the
edges, a join whose large keys Spark may split; so no task has to read all the edges of a hub. A round never makes more
edges than it had (a node's neighbours all move to their least member). Rounds are tables in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.durable import written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("u").agg(F.min("v").alias("least")))  # read from storage, so that both sides of the join may be split
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    Self-loops and repeated edges are harmless; nulls are dropped; an empty table gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, mark = written(now), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least_neighbour(large)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u > v").distinct())
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
