"""The questions a graph answers, each as DataFrames; ``render`` makes text of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import diff, search, traverse
from skein.operators.graph import Graph
from skein.plans.cypher import Catalog, cypher
from skein.sources.files import diff_lines

#: Rows of a route map by default and at most, names shown of each kind of store item, API uses shown.
ROUTES, MOST_ROUTES, ITEMS, API_USES = 50, 200, 20, 30
ROUTE = "struct<depth:int,path:string,fullPath:string,name:string,component:string,componentPath:string,lazy:boolean,redirect:string,alias:array<string>,meta:map<string,string>,guards:array<string>>"
FIRST_KEYS = ["name", "apiMode", "storeVariant", "isRouter", "routeCount", "hasDefaultExport", "@owner"]


@dataclass
class Tools:
    graph: Graph

    @property
    def spark(self) -> SparkSession:
        return self.graph.nodes.sparkSession

    def between(self) -> DataFrame:
        """Relations of entities with entities."""
        return self.graph.edges.where("src_label = 'Entity' and dst_label = 'Entity'")

    def catalog(self) -> Catalog:
        g = self.graph
        labels = {"Entity": g.nodes, "Function": g.functions, "StoreItem": g.store_items}
        if g.apis is not None:
            labels["FrameworkAPI"] = g.apis.select(F.col("name").alias("id"), "name", "framework")
        return Catalog(labels, g.edges, {"filePath": "id", "entityType": "entity_type", "itemType": "item_type", "storePath": "store_path", "startLine": "start_line", "endLine": "end_line", "entityPath": "entity_path", "callSite": "call_site"})

    def cypher(self, text: str) -> DataFrame:
        return cypher(self.catalog(), text)

    def find(self, path: str) -> DataFrame:
        """The entity of a path, else of its last part's name, else the first whose path holds it."""
        last = path.replace("\\", "/").rpartition("/")[2]
        stem = last.rpartition(".")[0] or last
        n = F.col("id")
        rank = F.when(n == path, 0).when(F.col("name").isin(last, stem), 1).when(n.contains(path), 2)
        return self.graph.nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", "id").limit(1).drop("rank")

    def properties(self, entity: DataFrame) -> DataFrame:
        """(key, value, place): visible properties, the telling ones first."""
        keyed = entity.select(F.explode(F.from_json("properties", "map<string,string>")).alias("key", "value")).where("key not like '\\_%'")
        place = F.array_position(F.array(*[F.lit(k) for k in FIRST_KEYS]), F.col("key"))
        return keyed.select("key", "value", F.when(place > 0, place).otherwise(len(FIRST_KEYS) + 1).alias("place")).orderBy("place", "key")

    def entity_context(self, path: str) -> dict[str, DataFrame]:
        g, entity = self.graph, self.find(path)
        ids = entity.select("id")
        own = lambda df, column: df.join(ids, df[column] == ids["id"], "left_semi")
        edges = g.edges
        out = own(edges, "src").where("dst_label = 'Entity'").select(F.lit("out").alias("direction"), "rel_type", F.col("dst").alias("other"))
        into = own(edges, "dst").where("src_label = 'Entity'").select(F.lit("in").alias("direction"), "rel_type", F.col("src").alias("other"))
        internals = own(g.store_items, "store_path").groupBy("item_type").agg(F.slice(F.array_sort(F.collect_set("name")), 1, ITEMS).alias("names"), F.count("*").alias("n"))
        used = own(edges, "src").where("rel_type = 'uses_store_item'").join(g.store_items.withColumnRenamed("id", "dst"), "dst").select("name", "item_type", "store_path", F.get_json_object(edges["properties"], "$.line").alias("line"))
        apis = own(edges, "src").where("rel_type = 'USES_API'").select(F.col("dst").alias("api"), F.get_json_object("properties", "$.line").cast("long").alias("line")).orderBy("line", "api").limit(API_USES)
        return {
            "entity": entity,
            "properties": self.properties(entity),
            "store_items": internals.orderBy("item_type"),
            "store_usage": used.orderBy("line"),
            "functions": own(g.functions, "file_path").select("name", "kind", "start_line", "end_line").orderBy("start_line"),
            "apis": apis,
            "relations": out.unionByName(into).distinct().orderBy(F.desc("direction"), "rel_type", "other"),
        }

    def impact_analysis(self, path: str, depth: int | None = None) -> DataFrame:
        """(id, depth, relation, parent, entity_type) of what the entity touches or is touched by."""
        start = self.graph.nodes.where(F.col("id") == path).select("id")
        return traverse.impact(self.between(), start, depth).join(self.graph.nodes.select("id", "entity_type"), "id").orderBy("depth", "id")

    def routes(self) -> DataFrame:
        parsed = F.from_json(F.get_json_object("properties", "$.routes"), f"array<{ROUTE}>")
        rows = self.graph.nodes.where("get_json_object(properties, '$.routes') is not null").select(F.col("id").alias("file"), F.posexplode(parsed).alias("place", "r"))
        return rows.select("file", "place", "r.*")

    def route_map(self, text: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self.routes()
        if text:
            shown = F.lower(F.concat_ws(" ", "path", "fullPath", "name", "component", "componentPath", "redirect", F.array_join("alias", " ")))
            rows = rows.where(shown.contains(text.lower()))
        return rows.orderBy("file", "place").limit(min(ROUTES if limit is None else limit, MOST_ROUTES))

    def trace_usage(self, name: str) -> DataFrame:
        """(section, id, detail): store items of that name, who uses them, and entities whose properties name it, with why."""
        g = self.graph
        items = g.store_items.where(F.col("name") == name)
        uses = g.edges.where("rel_type = 'uses_store_item'").join(items.select(F.col("id").alias("item")), F.col("dst") == F.col("item"))
        named = g.nodes.where(F.col("properties").contains(name))
        strings = lambda key: F.coalesce(F.from_json(F.get_json_object("properties", f"$.{key}"), "array<string>"), F.array().cast("array<string>"))
        called = F.exists(strings("storeCalls"), lambda c: c.contains(name))
        composed = F.array_contains(strings("composableCalls"), name)
        why = F.when(called, "store call").when(composed, "composable call").otherwise("property")
        parts = [
            items.select(F.lit("item").alias("section"), "id", F.col("item_type").alias("detail")),
            uses.select(F.lit("usage").alias("section"), F.col("src").alias("id"), F.get_json_object("properties", "$.line").alias("detail")),
            named.select(F.lit("named").alias("section"), "id", why.alias("detail")),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("section", "id", "detail")

    def find_entrypoints(self) -> DataFrame:
        """(section, id, detail): route files and their routes, components that look like pages or mains, the package."""
        nodes = self.graph.nodes
        low = F.lower("id")
        main = F.col("id").contains("/views/") | F.col("id").contains("/pages/") | low.contains("app.vue") | low.contains("main")
        parts = [
            nodes.where("entity_type = 'route'").select(F.lit("route file").alias("section"), "id", F.get_json_object("properties", "$.routeCount").alias("detail")),
            self.routes().select(F.lit("route").alias("section"), F.col("file").alias("id"), F.coalesce("fullPath", "path").alias("detail")),
            nodes.where(F.col("entity_type").isin("component", "page", "layout") & main).select(F.lit("component").alias("section"), "id", F.lit(None).cast("string").alias("detail")),
            nodes.where("entity_type = 'package'").select(F.lit("package").alias("section"), "id", F.get_json_object("properties", "$.version").alias("detail")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.orderBy("section", "id", "detail")

    def project_overview(self) -> DataFrame:
        """(part, label, n): totals, entities by type, store items by type, relations by label, APIs by framework."""
        g = self.graph
        tagged = [g.nodes.select(F.lit("entities").alias("part"), F.col("entity_type").alias("label")), g.edges.select(F.lit("relations").alias("part"), F.col("rel_type").alias("label"))]
        if g.store_items is not None:
            tagged.append(g.store_items.select(F.lit("store items").alias("part"), F.col("item_type").alias("label")))
        if g.functions is not None:
            tagged.append(g.functions.select(F.lit("functions").alias("part"), F.col("kind").alias("label")))
        if g.apis is not None:
            tagged.append(g.apis.select(F.lit("apis").alias("part"), F.col("framework").alias("label")))
        rows = tagged[0]
        for part in tagged[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy("part", "label").agg(F.count("*").alias("n")).orderBy("part", F.desc("n"), "label")

    def function_context(self, name: str, file: str | None = None) -> dict[str, DataFrame]:
        """The functions of a name; if they are one, its callers, callees and siblings as well."""
        g = self.graph
        found = g.functions.where(F.col("name") == name)
        if file:
            found = found.where(F.col("file_path").contains(file))
        if found.limit(2).count() != 1:
            return {"matches": found.orderBy("file_path", "start_line")}
        one = found.select(F.col("id").alias("one"), F.col("entity_path").alias("of"))
        calls = g.edges.where("rel_type = 'CALLS'")
        about = g.functions.select("id", "name", "kind", "file_path", "start_line")
        callers = calls.join(one, F.col("dst") == F.col("one")).select(F.col("src").alias("id"), "confidence").join(about, "id")
        callees = calls.join(one, F.col("src") == F.col("one")).select(F.col("dst").alias("id"), "confidence").join(about, "id")
        siblings = g.functions.join(one, (F.col("entity_path") == F.col("of")) & (F.col("id") != F.col("one"))).select("id", "name", "kind", "start_line")
        return {"function": found, "callers": callers.orderBy("id"), "callees": callees.orderBy("id"), "siblings": siblings.orderBy("start_line")}

    def diff_impact(self, text: str, script_lines: bool = False) -> DataFrame:
        """Functions that a unified diff touches and what they call. ``script_lines`` takes its lines for those of scripts."""
        nodes = self.graph.nodes.select("id")
        ranges = diff.hunks(diff_lines(self.spark, text))
        known = ranges.join(nodes, F.col("id").endswith(F.concat(F.lit("/"), F.col("file_path"))) | (F.col("id") == F.col("file_path")))
        ranges = known.select(F.col("id").alias("file_path"), "low", "high", "ordinal")
        line = "start_line" if script_lines else "file_start_line"
        return diff.diff_impact(ranges, self.graph.functions, self.graph.edges.where("rel_type = 'CALLS'"), line=line).orderBy("impact_depth", "id")

    def documents(self) -> DataFrame:
        """(doc_id, name, kind, text): functions by name and content, entities by name, type and text properties."""
        g = self.graph
        functions = g.functions.select(F.col("id").alias("doc_id"), "name", "kind", F.concat_ws(" ", "name", "content").alias("text"))
        parsed = F.from_json("properties", "map<string,variant>")
        words = F.array_join(F.transform(F.filter(F.map_values(parsed), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")), " ")
        entities = g.nodes.select(F.col("id").alias("doc_id"), "name", F.col("entity_type").alias("kind"), F.concat_ws(" ", "name", "entity_type", words).alias("text"))
        return functions.unionByName(entities)

    def semantic_search(self, query: str, limit: int | None = None, kind: str | None = None) -> DataFrame:
        """The best matches; with a kind but none of them, the functions of that kind."""
        found = search.search(self.documents(), query, limit, kind)
        if kind and found.isEmpty():
            most = min(search.LIMIT if limit is None else limit, search.MOST)
            return self.graph.functions.where(F.col("kind") == kind).select(F.col("id").alias("doc_id"), "name", "kind", F.lit(0.0).alias("score")).orderBy("doc_id").limit(most)
        return found
