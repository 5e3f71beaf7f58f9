"""Connected components of a link table by alternating star contractions.

Each pass lets every node point its larger neighbours at the smallest node it
knows, until only stars around smallest nodes are left.  Only minima and counts
are aggregated, so a node with very many links is combined before the shuffle
and no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise

#: The smallest nodes that up to so many pairs lead to are sent to all executors (16 bytes each); beyond, the same joins shuffle.
SENT = 500_000


def _star(pairs: DataFrame, both_ways: bool, sent: bool) -> DataFrame:
    """One star operation; ``pairs`` are (a, b) with a > b, repeated ones are harmless."""
    near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        near = near.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = F.broadcast(low) if sent else low
    if both_ways:  # larger neighbours move to the minimum
        moved = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours and the node itself move to it
        moved = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    moved = moved.where("a > b")
    return moved if sent and both_ways else moved.distinct()


def _stars(pairs: DataFrame) -> bool:
    """Whether each larger node has one link, to a node that has none itself; then all are linked to their component's smallest."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or ups = 1 and n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a long, b long); comp is the smallest node reachable.

    Self links and repeated links are harmless; an empty table gives an empty result.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    pairs = materialise(pairs, "links")
    sent = pairs.count() <= SENT  # no step makes the table longer
    while not _stars(pairs):
        pairs = materialise(_star(_star(pairs, True, sent), False, sent), "stars")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
