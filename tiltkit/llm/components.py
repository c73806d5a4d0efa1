"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds, sized_shuffles


#: Links that one task of a round takes.
TASK_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node of each component.

    A large-star step links every larger neighbour of a node to the node's
    smallest neighbour, a small-star step does so for the smaller ones; the
    links become stars around the roots in O(log^2 n) rounds. Minima combine
    before they shuffle, and each step is written, so a hub's rows can be split
    and a lost executor costs one step at most. The shuffles are sized by the
    number of links, which no round increases above twice the first.
    """
    spark = links.sparkSession
    rounds = Rounds(spark)
    edges = rounds.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = _digest(edges)
    with sized_shuffles(spark, now[0], TASK_LINKS):
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = rounds.write(large.distinct())
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            after = rounds.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
            edges, was, now = after, now, _digest(after)
            if now == was:
                return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    """Tells two sets of distinct links apart (but for chance in 128 bits)."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
