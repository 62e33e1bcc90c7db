"""Connected components of a link table, by alternating stars.

Each round points every node at the smallest node it knows: first all larger neighbours (large star), then all smaller
ones (small star). Both are a minimum per node, combined before the shuffle, and a join whose other side has one
row per node, so a hub never sits in one task. Rounds grow with the logarithm of a component's length. Every
round is written to the shared folder, which cuts the lineage; a lost executor repeats one round at most.

Rows with a NULL end and links of a node to itself say nothing and are left out. No links: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from echoscore.sources.stage import staged


def _star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every linked node; label is the smallest node of its component."""
    a, b = F.col(a), F.col(b)
    edges = staged(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        edges = staged(_star(edges), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
