"""Connected components of an edge table, by alternating large-star and small-star rounds.

No node's neighbours are ever collected: each half-round is a minimum per node (combined before the shuffle) and a join
back. The minima are written to the shared folder first, so the join has a plain exchange on both sides and adaptive
execution can split a hub with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import write_table


def _least(edges: DataFrame) -> DataFrame:
    return write_table(edges.groupBy("u").agg(F.min("v").alias("m")), "component-least")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most towards a smaller one, and none of those smaller ones has any: all stars."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return not ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node that has an edge to another node.

    Null ends and self-loops are ignored, repeated and reversed edges count once, an empty table gives an empty table.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    now = write_table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    for _ in range(most_rounds):
        if _settled(now):
            return _stars(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = write_table(large, "component-large")
        least = _least(large)
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = write_table(small, "component-edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _stars(edges: DataFrame) -> DataFrame:
    """Every settled edge points a node at its component's smallest one."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
