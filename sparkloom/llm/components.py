"""Connected components of links between names of 128 bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import components


def connected(links: DataFrame) -> DataFrame:
    """(h1, h2, g1, g2): each end of the links (a1, a2, b1, b2) with the smallest name in its component."""
    ends = [F.struct(F.col(f"{x}1").alias("h1"), F.col(f"{x}2").alias("h2")).alias(name) for x, name in (("a", "u"), ("b", "v"))]
    return components(links.select(*ends)).select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), F.col("root.h1").alias("g1"), F.col("root.h2").alias("g2"))
