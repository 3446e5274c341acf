"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstrata.llm.common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each id in links (columns a, b) the smallest id it reaches.

    Each step sends every node's neighbours to its smallest one. Minima are aggregated before the shuffle and joined
    back, so a node with very many neighbours is no group in any task; each step is written to shared storage, so a lost
    executor costs one step. Steps end when the links are stars around their smallest ids.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        last, edges = edges, cut(_small_star(_large_star(edges)), "stars")
        drop(last)
        after = _mark(edges)
        if after == before:
            break
        before = after
    own = edges.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(own).distinct()


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and the sums of two hashes of them: equal before and after a step that changed nothing."""
    hashed = [F.sum((F.xxhash64(F.lit(salt), "v", "u") % (1 << 30)).cast("long")) for salt in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *hashed).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour, or itself if it is smaller."""
    both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v: node, u: neighbour
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    return both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionAll(least.select("v", F.col("m").alias("u"))).distinct()
