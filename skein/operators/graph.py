"""The property graph as DataFrames: keyed upserts, relation inserts, reading, writing and export."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import visible_properties
from skein.schema import TABLES


@dataclass
class Graph:
    """nodes(id, name, entity_type, properties), edges(src, dst, rel_type, ...) and the tables of the other labels."""

    nodes: DataFrame
    edges: DataFrame
    functions: DataFrame | None = None
    store_items: DataFrame | None = None
    apis: DataFrame | None = None

    def save(self, path: str) -> None:
        """Replace the graph at ``path``; nodes and edges lie in a folder for each type, so a filter on it prunes."""
        parts = {"nodes": "entity_type", "edges": "rel_type"}
        for field in fields(self):
            if (df := getattr(self, field.name)) is not None:
                writer = df.write.mode("overwrite")
                (writer.partitionBy(parts[field.name]) if field.name in parts else writer).parquet(f"{path}/{field.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()})


def upsert_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a ``key``, that of the greatest ``order``: what remains after writing the rows one by one."""
    names = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order, *names)).alias("__row"))
    return last.select(key, *[F.col("__row")[c].alias(c) for c in names])


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for the ``keys``, the first in ``order``; a partial aggregate, so large groups don't move whole."""
    names = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__row"))
    return first.select(*keys, *[F.col("__row")[c].alias(c) for c in names])


def insert_edges(edges: DataFrame, nodes: DataFrame, order: str, dedup: bool = True, targets: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, rel_type, ...) whose ends exist; with ``dedup`` the first of each (src, dst, rel_type)."""
    known = nodes.select(F.col("id").alias("__end"))
    ends = (targets if targets is not None else nodes).select(F.col("id").alias("__end"))
    there = edges.join(known, edges["src"] == known["__end"], "left_semi")
    there = there.join(ends, there["dst"] == ends["__end"], "left_semi")
    return first_of(there, ["src", "dst", "rel_type"], [order]) if dedup else there


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, rel_type, direction): every edge as outgoing (0) of one end and incoming (1) of the other."""
    out = edges.select("src", "dst", "rel_type", F.lit(0).alias("direction"))
    return out.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type", F.lit(1).alias("direction")))


def hop(edges: DataFrame, nodes: DataFrame, rel_type: str | None = None) -> DataFrame:
    """Edges with the nodes of both ends, their columns prefixed ``from_`` and ``to_``."""
    chosen = edges.where(F.col("rel_type") == rel_type) if rel_type else edges
    ends = {p: nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in nodes.columns]) for p in ("from", "to")}
    return chosen.join(ends["from"], F.col("src") == F.col("from_id")).join(ends["to"], F.col("dst") == F.col("to_id"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of every node that has an edge; edges are counted before their ends meet."""
    counted = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    ends = counted.select(F.col("src").alias("id"), "n").unionByName(counted.select(F.col("dst").alias("id"), "n"))
    return ends.groupBy("id").agg(F.sum("n").alias("degree"))


def export_rows(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a viewer gets: one node an id with its visible properties as a map, one edge a (src, rel_type, dst)."""
    shown = graph.nodes.withColumn("properties", visible_properties(F.col("properties")))
    nodes = shown.groupBy("id").agg(*[F.any_value(c).alias(c) for c in ("name", "entity_type", "properties")])
    ids = graph.nodes.select("id")
    edges = graph.edges.select("src", "rel_type", "dst").distinct()
    edges = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
    return nodes, edges


def export_graph(graph: Graph, path: str) -> None:
    """Write the export as JSON lines below ``path``."""
    nodes, edges = export_rows(graph)
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
