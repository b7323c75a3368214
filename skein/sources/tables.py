"""A property graph over relational tables of customers, orders, parts and suppliers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.graph import Graph
from skein.plans.lineage import BROADCAST_ROWS

#: table: (label, key column, name column); fixed values.
LABELS = {
    "region": ("region", "r_regionkey", "r_name"),
    "nation": ("nation", "n_nationkey", "n_name"),
    "customer": ("customer", "c_custkey", "c_name"),
    "supplier": ("supplier", "s_suppkey", "s_name"),
    "part": ("part", "p_partkey", "p_name"),
    "orders": ("order", "o_orderkey", "o_orderstatus"),
}
#: relation: (table, label and column of the source, label and column of the target); fixed values.
RELATIONS = (
    ("in_region", "nation", ("nation", "n_nationkey"), ("region", "n_regionkey")),
    ("in_nation", "customer", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    ("in_nation", "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    ("placed_by", "orders", ("order", "o_orderkey"), ("customer", "o_custkey")),
    ("contains_part", "lineitem", ("order", "l_orderkey"), ("part", "l_partkey")),
    ("supplied_by", "lineitem", ("order", "l_orderkey"), ("supplier", "l_suppkey")),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(label: str, key: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """(id, name, entity_type, properties) with the row as JSON."""
    found = None
    for table, (label, key, name) in LABELS.items():
        if only and label not in only:
            continue
        rows = read(spark, sf_dir, table)
        part = rows.select(ident(label, key).alias("id"), F.col(name).alias("name"), F.lit(label).alias("entity_type"), F.to_json(F.struct(*rows.columns)).alias("properties"))
        found = part if found is None else found.unionByName(part)
    return found


def edges(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """(src, dst, rel_type, src_label, dst_label); relations of the item table repeat as its rows do."""
    found = None
    for relation, table, (a, a_key), (b, b_key) in RELATIONS:
        if only and relation not in only:
            continue
        part = read(spark, sf_dir, table).select(ident(a, a_key).alias("src"), ident(b, b_key).alias("dst"), F.lit(relation).alias("rel_type"), F.lit(a).alias("src_label"), F.lit(b).alias("dst_label"))
        found = part if found is None else found.unionByName(part)
    return found


def lead(spark: SparkSession, sf_dir: str, both: bool) -> Callable[[DataFrame], DataFrame]:
    """From a frontier (src) to the edges that leave it (src, dst, rel_type, direction), with ``both`` those that enter it, too.

    Only relations of the labels in the frontier are read, two key columns of each, and joined by the keys themselves, the
    frontier's side broadcast if it is small; names of nodes are made for what is left.
    """

    def of(ends: DataFrame) -> DataFrame:
        ends = ends.select(F.substring_index("src", ":", 1).alias("label"), F.substring_index("src", ":", -1).cast("long").alias("key"))
        sizes = {r["label"]: r["count"] for r in ends.groupBy("label").count().collect()}  # a row a label
        found = spark.createDataFrame([], "src string, dst string, rel_type string, direction int")
        for relation, table, a, b in RELATIONS:
            for direction, (near, near_key), (far, far_key) in [(0, a, b), (1, b, a)][: 1 + both]:
                if near in sizes:
                    keys = ends.where(F.col("label") == near).select(F.col("key").alias(near_key))
                    met = read(spark, sf_dir, table).select(near_key, far_key).join(F.broadcast(keys) if sizes[near] <= BROADCAST_ROWS else keys, near_key)
                    found = found.unionByName(met.select(ident(near, near_key).alias("src"), ident(far, far_key).alias("dst"), F.lit(relation).alias("rel_type"), F.lit(direction).alias("direction")))
        return found

    return of


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))
