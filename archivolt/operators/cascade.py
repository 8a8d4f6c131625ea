"""What follows from withdrawn inputs: everything derived from them, over any number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.operators.hierarchy import build_hierarchy


def tainted(links: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """(node, origin, distance): every node below a withdrawn one, with the nearest withdrawn ancestor.

    ``links`` is (node, parent), ``withdrawn`` (node). Withdrawn nodes themselves are listed if they lie below another
    one; nodes on circles or below them are not. The nearest one is carried along from ancestor to descendant.
    """
    marked = links.select("node", "parent").join(withdrawn.select("node", F.lit(True).alias("marked")).distinct(), "node", "left")
    tree = build_hierarchy(marked.select("node", "parent", F.coalesce("marked", F.lit(False)).alias("marked")), marks=True)
    return tree.where("near is not null").select("node", F.col("near.node").alias("origin"), F.col("near.distance").alias("distance"))


def fully_tainted(members: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """(group): groups of which every member (group, node) is tainted."""
    marked = members.join(found.select("node", F.lit(True).alias("t")), "node", "left")
    return marked.groupBy(group).agg(F.every(F.coalesce("t", F.lit(False))).alias("all")).where("all").select(group)
