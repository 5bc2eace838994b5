"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import shared_table

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; links has columns a, b.

    Each round aggregates minima before the shuffle and joins them back, so the links of a hub are
    never one group; rounds are as many as the logarithm of the longest path, and each is written to
    the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = shared_table(edges, "links")
    before = _digest(edges)
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour is linked to the smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = shared_table(edges, "links")
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return shared_table(own.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
