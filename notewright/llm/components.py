"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import cut


def apart(totals: DataFrame, key: str) -> DataFrame:
    """totals, aggregated by key (a long), as the small side of a join of all rows with the totals of their key.

    The key is computed anew, so both sides of the join are plain shuffles and the adaptive rule for skewed joins can
    split the rows of a key that many have; it can't where a side comes straight from an aggregation by that key."""
    return totals.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Minima come from a partial aggregation, and a hub's neighbours may be split among tasks.

    A large star has a row for each edge; a small one has each of its rows once."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(apart(least, "u"), "u")
    if large:
        return joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _ended(edges: DataFrame) -> bool:
    """Whether each node has one edge up at most and nodes below others have none: then every edge leads to its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("below")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("below")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("below").alias("below")).where("up > 1 or up = 1 and below = 1").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for each node that has a link to another.

    Nulls and self links are ignored. Each step is written to the shared folder; rounds end when all edges lead to
    the smallest node of their component, so edges that do from the start take none."""
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct(), "edges")
    while not _ended(edges):
        edges = cut(_star(cut(_star(edges, large=True), "large-stars"), large=False), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
