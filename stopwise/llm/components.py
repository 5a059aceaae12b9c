"""Connected components of links, by repeated minimum labels with the graph kept small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u itself."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or up > 0 and down > 0").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, label for every id in links (two long columns): label is the smallest id reachable.

    Each round links every id to the smallest id near it, from both sides (large star and small star); distances shrink
    at least by half in two rounds.  A round's links are written to the shared folder, and the former round's deleted.
    Ends when all components are stars around their smallest id.  Links of an id with itself, repeated links and both
    directions of a link change nothing; links with a null end are left out; no links give no rows.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a, b).filter(f"{a} <> {b}").select("u", "v").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours of u go to the smallest near u.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        discard(edges)
        edges = new
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
