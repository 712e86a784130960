"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round points all neighbours of a node at the smallest node it sees; the minimum is taken before
the shuffle, so a node with very many neighbours costs one row per task. The edges never leave the
executors; only their number and a hash come to the driver, to see that a round changed nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierworks.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two long columns u, v. Returns node, root (smallest node of its component).

    Nodes without an edge to another node do not appear. An empty table gives an empty result.
    """
    state, seen = cut_lineage(edges.select("u", "v").where("u <> v").distinct()), None
    while True:
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or not mark["n"]:
            break
        seen = (mark["n"], mark["h"])
        state = cut_lineage(_small_star(_large_star(state)))
    # every edge now points at its root
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
