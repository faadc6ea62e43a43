"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgrid.llm.common import forget, staged

MAX_STEPS = 60


def _stars(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Pairs (v, m): each v beside u now hangs on m, the least node beside u."""
    return pairs.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _settled(edges: DataFrame) -> bool:
    """Every node hangs on one other, which hangs on none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the least node that it is linked with.

    links may hold repeated rows and either direction; self links and null ends are ignored.
    """
    links = links.where(F.col("a") != F.col("b"))
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(MAX_STEPS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain exchanges and a node with very many links can be split
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = _stars(both.where(F.col("v") > F.col("u")), least).distinct()
        large = staged(large, "large")
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        before, edges = edges, staged(_stars(large, nearest).unionByName(nearest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(before, least, large)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
