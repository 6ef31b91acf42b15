"""Connected components of links, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spool


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them. ``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node it can reach) for every node that has a link to a smaller one.

    Nothing is gathered on the driver but a row count and a checksum a round; each round is written to
    the shared folder. A centre with many links is pre-aggregated by task, and its join is one that
    Spark can split.
    """
    x, y = F.col(a), F.col(b)
    edges = spool(links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    seen = None
    while True:  # settles after some log(n)**2 rounds
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        nxt = spool(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges = nxt
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
