"""Connected components by rounds of star contraction, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import drop_written, written


def _mark(pairs: DataFrame) -> tuple:
    """Number and sum of hashes of the pairs: equal for equal pairs, and for others once in 2**64."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each end of the edges (u, v) with the smallest node of its component.

    Large-star and small-star rounds: every node hooks its larger neighbours (then its smaller ones and itself)
    to its smallest neighbour. Stars deepen the contraction, so the rounds grow with the logarithm of the longest
    path. Neighbours of one node are only ever reduced with min, never gathered.
    """
    pairs = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct(), "pairs")
    mark = _mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        small = large.join(large.groupBy("v").agg(F.min("u").alias("m")), "v")
        hooked = small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(small.select(F.col("m").alias("u"), "v")).where("u != v").distinct()
        after = written(hooked, "pairs")
        before, mark = mark, _mark(after)
        drop_written(pairs)
        pairs = after
        if before == mark:
            break
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
