"""Connected components of an edge table, by large-star and small-star steps.

Every step is a grouped minimum and a join, so hubs are combined before the
shuffle and no component is gathered anywhere; each round is written to the
shared folder. The number of rounds follows the logarithm of the longest
path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root): the smallest node that each node
    reaches. Nodes without edges (or only with themselves) are not listed;
    repeated edges and both directions are allowed; null ends are dropped."""
    e = staged(edges.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node are joined to its least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: neighbours below a node, and the node, to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = staged(small, "small")
        # done when each node has one root and no root is itself below another
        ends = new.select("a", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(new.select(F.col("b").alias("a"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("a").agg(F.sum("below").alias("n"), F.max("above").alias("up")).where("n > 1 or (n = 1 and up = 1)").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")) \
                .unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        e = new
