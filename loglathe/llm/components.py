"""Connected components by alternating large and small stars; every step is a grouping and a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.sources.staging import stage


def _rows(table: DataFrame, *rows: dict[str, str | Column]) -> DataFrame:
    """Several rows for each of the table's, by one pass over it."""
    made = [F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in row.items()]) for row in rows]
    return table.select(F.inline(F.array(*made)))


def _near(links: DataFrame) -> DataFrame:
    """Every link (u, v) with the smallest neighbour of u, u itself included, as m."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id has one link down at most, and none if links lead to it."""
    ends = _rows(edges, {"id": "u", "down": F.lit(1)}, {"id": "v", "down": F.lit(0)})
    met = ends.groupBy("id").agg(F.sum("down").alias("links"), F.min("down").alias("least"))
    return met.where("links > 1 or (links = 1 and least = 0)").count() == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link.

    Links may repeat, point either way or lead back to their start; null ends are left out. Each
    round is staged, so a lost executor costs one round at most, and the number of rounds grows
    with the logarithm of the longest path. Links always lead down to a smaller id, so they are done
    once they are stars; none is needed to see that nothing changes any more. A round is one small
    plan: each table stands in it once for the least neighbours and once for the links, and links
    that repeat halfway (no more than the round began with) go at its end only.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges = stage(edges.distinct(), "links")
    while not _are_stars(edges):
        both = _rows(edges, {"u": "u", "v": "v"}, {"u": "v", "v": "u"})
        large = _near(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _rows(_near(large), {"u": "v", "v": "m"}, {"u": "u", "v": "m"})
        edges = stage(small.where("u != v").distinct(), "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
