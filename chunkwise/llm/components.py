"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the edges (u, v); comp is the component's least node.

    Each round halves the depth of the trees, so rounds grow with the logarithm of the longest path. Every round
    is written to the shared folder. Least neighbours are aggregated before they are shuffled and joined back, so that a node
    with very many neighbours is no task's own. Loops and null ends are left out, repeated edges count once; no edges give no rows.
    """
    current = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct())
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = cut(both.where("v > u").join(low, "u").select("v", F.col("m").alias("u")).where("u <> v").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        following = cut(small)
        drop_cut(large)
        # once all edges are stars around roots, a round changes nothing
        moved = following.join(current, ["u", "v"], "left_anti").limit(1).count()
        same = not moved and following.count() == current.count()
        drop_cut(current)
        current = following
        if same:
            break
    roots = current.select(F.col("u").alias("node"), F.col("u").alias("comp"))
    return current.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(roots).distinct()
