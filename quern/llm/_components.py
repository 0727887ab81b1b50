"""Connected components of an undirected graph given as an edge table, by alternating large-star and small-star steps.

No node's neighbours are ever gathered: each step takes a minimum per node, combined before the shuffle, and joins it
back with hot nodes set apart. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import attach
from quern.session import materialise

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then every edge leads to a component's smallest node."""
    counts = edges.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("u").alias("nodes")).first()
    if counts["rows"] != counts["nodes"]:
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (two columns of equal type), component being its smallest node."""
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now = materialise(pairs, name)
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        # large star: the larger neighbours of each node go to the least of all; a node may have very many
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min("v"), F.col("u")).alias("least")
        around = both.groupBy("u").agg(least, F.count(F.lit(1)).alias("degree"))
        large = attach(both, around, "u", "degree", F.col("v"), 2 * now.count())
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        # small star: a node and its smaller neighbours, now few, go to the least of these
        small = large.join(large.groupBy("u").agg(F.min("v").alias("least")), "u")
        linked = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
        now = materialise(linked.where("u != v").distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
