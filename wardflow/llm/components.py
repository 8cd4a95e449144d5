"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardflow.sources.scratch import written


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked with the smallest node around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_smallest_neighbour(both), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the smallest of them (here u > v)."""
    mins = _smallest_neighbour(edges)
    return (
        edges.join(mins, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(mins.select("u", F.col("m").alias("v")))
        .where("u > v")
        .distinct()
    )


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one link to a smaller node and none to a larger one, or the reverse."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """``(u, v)`` links to ``(u, v)``: every node that isn't its component's smallest, and that one.

    ``folder``: the scratch folder for the rounds.  Self links and nulls are passed over.  Groups meet in minima with map-side combine and in
    joins that adaptive execution may split, so that a node may have any number of links.
    """
    ordered = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = written(ordered.distinct(), "links", folder)
    while not _only_stars(now):
        now = written(_small_star(_large_star(now)), "links", folder)
    return now
