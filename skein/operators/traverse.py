"""Bounded breadth-first search, one join a level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import both_ways
from skein.plans.lineage import cut, small_side

MAX_DEPTH = 5  # fixed value


Lead = Callable[[DataFrame], DataFrame]


def along(edges: DataFrame) -> Lead:
    """What leads on from a frontier (src) along ``edges`` (src, dst, rel_type, direction)."""
    return lambda ends: edges.join(small_side(ends), "src")


def _levels(start: DataFrame, lead: Lead, depth: int) -> DataFrame:
    """(id, depth, direction, rel_type, parent) of everything within ``depth`` of ``start`` (id), the start at depth 0.

    ``lead``: from a frontier (src) to (src, dst, rel_type, direction). A node takes its first way in: outgoing before
    incoming, then by relation and parent.
    """
    none = F.lit(None)
    level = cut(start.select("id", F.lit(0).alias("depth"), none.cast("int").alias("direction"), none.cast("string").alias("rel_type"), none.cast("string").alias("parent")).distinct())
    found = level
    for k in range(1, depth + 1):
        ways = lead(level.select(F.col("id").alias("src")))
        ways = ways.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("direction", "rel_type", F.col("src").alias("parent"))).alias("way"))
        new = ways.join(found.select("id"), "id", "left_anti")
        level = cut(new.select("id", F.lit(k).alias("depth"), "way.direction", "way.rel_type", "way.parent"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def impact(edges: DataFrame | None, start: DataFrame, depth: int | None = None, lead: Lead | None = None) -> DataFrame:
    """(id, depth, relation, parent): what edges in either direction join to ``start`` (id) within ``depth`` hops (3; 5 at most).

    The relation of an edge followed backwards has the prefix ``(in) ``. ``lead`` stands for the edges where a store can
    find those of a frontier by itself.
    """
    found = _levels(start, lead or along(both_ways(edges)), min(3 if depth is None else depth, MAX_DEPTH))
    relation = F.when(F.col("direction") == 1, F.concat(F.lit("(in) "), "rel_type")).otherwise(F.col("rel_type"))
    return found.where("depth > 0").select("id", "depth", relation.alias("relation"), "parent")


def reach(edges: DataFrame | None, start: DataFrame, depth: int = 3, lead: Lead | None = None) -> DataFrame:
    """(id, depth, parent): what outgoing edges reach from ``start`` (id) within ``depth`` hops."""
    lead = lead or along(edges.select("src", "dst", "rel_type", F.lit(0).alias("direction")))
    return _levels(start, lead, depth).where("depth > 0").select("id", "depth", "parent")
