"""Index a project: files to facts, facts to a graph."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import base_name, wildcard_regex
from skein.operators import edges as E
from skein.operators.graph import Graph, insert_edges, upsert_last
from skein.plans.lineage import cut
from skein.plans.plugins import Registry
from skein.schema import EDGES, ENDS
from skein.sources import files as S
from skein.sources.config import Config
from skein.sources.facts import facts as fact_table
from skein.sources.facts import of


def entities_of(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, name, entity_type, ordinal, properties): one row a file, its properties as JSON."""
    props = of(facts, "properties").select("path", F.col("text").alias("properties"))
    rows = files.join(props, "path", "left")
    return rows.select("path", F.coalesce(F.get_json_object("properties", "$.name"), F.lit("")).alias("name"), "entity_type", "ordinal", F.coalesce("properties", F.lit("{}")).alias("properties"))


def with_markers(entities: DataFrame, config: Config) -> DataFrame:
    """``entities`` with what the markers of their types say added to the properties; of several patterns the last counts."""
    for entity_type, markers in config.markers.items():
        found: dict[str, Column] = {}
        component = F.col("path").endswith(".vue")
        for marker in markers:
            if (wanted := marker.get("uses_options_api")) is not None:
                found["usesOptionsAPI"] = F.when(component, F.lit(bool(wanted)))
                if wanted:
                    found["markedAsOptionsAPI"] = F.when(component & (F.get_json_object("properties", "$.apiMode") == "options"), F.lit(True))
            if pattern := marker.get("naming_pattern"):
                found["matchesNamingPattern"] = F.col("name").rlike(wildcard_regex(pattern, escape=False))
        if found:
            more = F.to_json(F.struct(*[c.alias(k) for k, c in found.items()]))  # nulls are left out
            inner = F.regexp_replace("properties", r"\}\s*$", "")
            joined = F.when(more == "{}", F.col("properties")).when(F.trim(inner) == "{", more).otherwise(F.concat(inner, F.lit(", "), F.substring(more, 2, 1_000_000)))
            entities = entities.withColumn("properties", F.when(F.col("entity_type") == entity_type, joined).otherwise(F.col("properties")))
    return entities


def definitions(spark: SparkSession, config: Config) -> DataFrame:
    """(part, name, detail, description): the entity types, relations and APIs that a configuration defines."""
    rows = [("entity", n, ", ".join(p), config.descriptions.get(n, "")) for n, p in config.entities.items()]
    rows += [("relation", n, f"{r.source} -> {r.target}", r.description) for n, r in config.relationships.items()]
    rows += [("apis", n, str(len(names)), "") for n, names in config.apis.items()]
    return spark.createDataFrame(rows, "part string, name string, detail string, description string")


def reclassified(facts: DataFrame, kinds: list[DataFrame]) -> DataFrame:
    """``facts`` whose functions have the kind of the first of ``kinds`` (path, name, line, kind) that knows their file."""
    for k in reversed(kinds):
        own = k.select("path", "name", "line", F.col("kind").alias("__kind")).withColumn("fact", F.lit("function"))
        known = k.select("path").distinct().withColumn("__known", F.lit(True))
        joined = facts.join(own, ["path", "name", "line", "fact"], "left").join(known, "path", "left")
        joined = joined.where((F.col("fact") != "function") | F.col("__known").isNull() | F.col("__kind").isNotNull())
        facts = joined.withColumn("full", F.coalesce("__kind", "full")).select(*facts.columns)
    return facts


def functions_of(facts: DataFrame) -> DataFrame:
    offsets = of(facts, "script").select("path", F.col("line").alias("offset"))
    rows = of(facts, "function").join(offsets, "path")
    ident = F.concat("path", F.lit("#"), "name", F.lit(":"), "line")
    out = rows.select(ident.alias("id"), "name", F.col("path").alias("file_path"), F.col("path").alias("entity_path"), F.col("full").alias("kind"), F.col("line").alias("start_line"), "end_line", (F.col("line") + F.col("offset")).alias("file_start_line"), F.col("text").alias("content"))
    return out.dropDuplicates(["id"])


def items_of(facts: DataFrame) -> DataFrame:
    ident = F.concat("path", F.lit("#"), "full", F.lit(":"), "name")
    return of(facts, "store_item").select(ident.alias("id"), "name", F.col("full").alias("item_type"), F.col("path").alias("store_path"), F.lit("{}").alias("properties")).dropDuplicates(["id"])


def build(spark: SparkSession, config: Config, registry: Registry | None = None, compat: bool = True) -> Graph:
    """The graph of the project at ``config.source_root``. Plugins of the registry that find their framework take part."""
    return assemble(S.read_files(spark, config.source_root.rstrip("/")), config, registry, compat)


def assemble(listing: DataFrame, config: Config, registry: Registry | None = None, compat: bool = True) -> Graph:
    """The graph of files (path, rel_path, content, length), of which ``build`` reads a folder's."""
    spark, root = listing.sparkSession, config.source_root.rstrip("/")
    listing = cut(listing)
    active = registry.active(listing, os.path.dirname(root)) if registry else []
    for plugin in active:
        config = plugin.contribute(config, compat)
    files = cut(S.classify(listing, config))
    facts = cut(fact_table(files))
    for more in registry.each(active, lambda p: p.extract(files)) if registry else []:
        facts = facts.unionByName(more.select(*facts.columns))
    if registry and (kinds := registry.each(active, lambda p: p.classify(facts))):
        facts = cut(reclassified(facts, kinds))
    entities = cut(with_markers(entities_of(files, facts), config))
    apis = spark.createDataFrame([(n, f) for f, names in config.apis.items() for n in names], "name string, framework string").dropDuplicates(["name"])
    functions, items = cut(functions_of(facts)), cut(items_of(facts))
    package = S.package(spark, os.path.dirname(root))
    nodes = entities.select(F.col("path").alias("id"), F.when(F.col("name") == "", base_name(F.col("path"))).otherwise(F.col("name")).alias("name"), "entity_type", "properties").unionByName(package)
    nodes = cut(upsert_last(nodes.withColumn("k", F.monotonically_increasing_id()), "id", "k").drop("k"))

    found = [E.imports(facts, E.folders(listing), entities, root, S.aliases(os.path.dirname(root)))]
    if (related := E.configured(facts, entities, config)) is not None:
        found.append(related)
    for parts in registry.each(active, lambda p: p.after(facts, entities, items)) if registry else []:
        found += parts
    between = found[0].withColumn("k", F.lit(0))
    for k, part in enumerate(found[1:], 1):  # of equal relations that of the earlier part stays: imports, configuration, plugins
        between = between.unionByName(part.withColumn("k", F.lit(k)))
    ends = nodes.select("id")
    between = insert_edges(between, ends, "k").drop("k")
    parts = [between, E.uses_api(facts, apis, 1 + bool(active)), E._edges(items, "store_path", "id", "has_item"), E._edges(functions, "entity_path", "id", "defines")]
    used = E.store_item_uses(facts, items) if active else None
    every = parts[0]
    for part in [*parts[1:], *([used] if used is not None else [])]:
        every = every.unionByName(part)
    every = every.unionByName(E.calls(facts, functions), allowMissingColumns=True)
    label = lambda end: F.coalesce(*[F.when(F.col("rel_type") == r, ends[end]) for r, ends in ENDS.items()], F.lit("Entity"))
    every = every.withColumn("src_label", label(0)).withColumn("dst_label", label(1))
    return Graph(nodes, cut(every.select(*[F.col(f.name).cast(f.dataType) for f in EDGES.fields])), functions, items, apis)
