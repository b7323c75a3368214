"""Queries over the made project: every step of an index, from files to the tools, against what the tables say must be found."""

from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import build, detectors
from skein.operators import edges as E
from skein.operators.graph import Graph
from skein.operators.tools import Tools
from skein.plans.lineage import cut, shared_dir
from skein.plans.plugins import built_in
from skein.sources import files as S
from skein.sources import made
from skein.sources.config import load, with_plugin
from skein.sources.facts import facts as fact_table
from skein.sources.facts import of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What the files of the project are made from, and their paths.
WITH = """WITH p AS (SELECT p_partkey AS p, p_partkey % 10 AS s, p_partkey % 25 AS n, p_partkey - p_partkey % 2 AS q, p_partkey % 7 AS t FROM part),
    s AS (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier), n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation),
    part_file AS (SELECT *, '/app/src/components/Part' || p || '.vue' AS path FROM p), shop_file AS (SELECT *, '/app/src/store/shop' || s || '.js' AS path FROM s),
    api_file AS (SELECT *, '/app/src/api/fetch' || n || '.js' AS path FROM n), mixin_file AS (SELECT *, '/app/src/mixins/Nation' || n || '.js' AS path FROM n),
    card_file AS (SELECT *, '/app/src/components/Card' || n || '.vue' AS path FROM n), router_file AS (SELECT *, '/app/src/router/region' || r || '.js' AS path FROM n),
    main_file AS (SELECT *, '/app/src/main/region' || r || '.ts' AS path FROM n)"""
CARD, MIXIN, SHOP, API, MAIN = ("'/app/src/components/Card' || {0} || '.vue'", "'/app/src/mixins/Nation' || {0} || '.js'", "'/app/src/store/shop' || {0} || '.js'", "'/app/src/api/fetch' || {0} || '.js'", "'/app/src/main/region' || {0} || '.ts'")
#: Relations between files by what makes them.
IMPORTS = f"SELECT path AS src, {SHOP.format('s')} AS dst FROM part_file UNION ALL SELECT path, {MIXIN.format('n')} FROM part_file UNION ALL SELECT path, {API.format('n')} FROM shop_file"
COMPONENTS = f"SELECT path AS src, {CARD.format('n')} AS dst, 3 AS line FROM part_file UNION ALL SELECT path, '/app/src/components/Part' || q || '.vue', 4 FROM part_file WHERE p <> q"
#: A mixin's name holds another's where its number begins with that one; the first by path is taken.
MIXINS = f"SELECT path AS src, {MIXIN.format('CASE WHEN n >= 10 THEN n // 10 ELSE n END')} AS dst FROM part_file"
ITEMS = " UNION ALL ".join(f"SELECT path || '#{kind}:{name}' || {key} AS id, '{name}' || {key} AS name, '{kind}' AS item_type, path AS store_path FROM shop_file" for kind, name, key in (("state", "stock", "s"), ("state", "total", "''"), ("getter", "sum", "s"), ("action", "add", "s")))
USES = f"SELECT path AS src, {SHOP.format('s')} || '#action:add' || s AS dst, 14 AS line FROM part_file UNION ALL SELECT path, {SHOP.format('s')} || '#state:stock' || s, 15 FROM part_file"
FUNCTIONS = "SELECT path || '#load' || p || ':12' AS id, 'load' || p AS name, path AS file_path, 'method' AS kind, 12 AS start_line, 16 AS end_line, 19 AS file_start_line FROM part_file UNION ALL SELECT path || '#step' || p || ':17', 'step' || p, path, 'method', 17, 20, 24 FROM part_file UNION ALL SELECT path || '#fetch' || n || ':2', 'fetch' || n, path, 'function', 2, 4, 2 FROM api_file"
CALLS = f"SELECT path || '#load' || p || ':12' AS src, path || '#step' || p || ':17' AS dst, CAST(0.95 AS DOUBLE) AS confidence, 'load' || p || '→step' || p AS call_site FROM part_file UNION ALL SELECT path || '#step' || p || ':17', {API.format('n')} || '#fetch' || n || ':2', CAST(0.8 AS DOUBLE), 'step' || p || '→fetch' || n FROM part_file"
IPC = f"SELECT path AS src, {MAIN.format('n.r')} AS dst, 'calls_ipc' AS rel_type FROM part_file JOIN n USING (n) UNION ALL SELECT DISTINCT '/app/src/preload/index.ts', path, 'exposes_ipc' FROM main_file"
APIS = "SELECT path AS src, 'ref' AS dst, 4 AS line, 'vue' AS framework FROM card_file UNION ALL SELECT path, 'defineStore', 4, 'pinia' FROM shop_file UNION ALL SELECT path, 'fetch1', 19, 'shop' FROM part_file WHERE n = 1 UNION ALL SELECT path, 'fetch1', 9, 'shop' FROM shop_file WHERE n = 1"
CONFIGURED = f"SELECT path AS src, {CARD.format('n')} AS dst, 'shows' AS rel_type FROM router_file UNION ALL SELECT f.path, a.path, 'asks' FROM shop_file f JOIN api_file a ON contains('fetch' || f.n, 'fetch' || a.n) OR contains('fetch' || a.n, 'fetch' || f.n)"
ROUTES = "SELECT path, 'n' || n AS name, '/n' || n || '/' AS full_path, 0 AS depth FROM router_file UNION ALL SELECT path, 'list' || n, '/n' || n || '/list', 1 FROM router_file UNION ALL SELECT path, 'abs' || n, '/abs' || n, 1 FROM router_file"
NODES = "SELECT path, 'Part' || p AS name, 'component' AS entity_type, 'options' AS api_mode FROM part_file UNION ALL SELECT path, '', 'store', 'unknown' FROM shop_file UNION ALL SELECT path, '', 'api', 'unknown' FROM api_file UNION ALL SELECT path, '', 'mixin', 'options' FROM mixin_file UNION ALL SELECT path, '', 'component', 'composition' FROM card_file UNION ALL SELECT DISTINCT path, '', 'route', 'options' FROM router_file UNION ALL SELECT DISTINCT path, '', 'electron-main', 'unknown' FROM main_file UNION ALL SELECT '/app/src/preload/index.ts', '', 'preload', 'unknown'"
BETWEEN = f"SELECT src, dst, 'imports' AS rel_type FROM ({IMPORTS}) UNION ALL SELECT src, dst, 'uses_component' FROM ({COMPONENTS}) UNION ALL SELECT src, dst, 'uses_mixin' FROM ({MIXINS}) UNION ALL {IPC} UNION ALL {CONFIGURED}"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"{WITH} {oracle}"
        return f

    return add


def _config():
    return with_plugin(made.config())


def _files(spark, sf_dir) -> DataFrame:
    return S.classify(made.files(spark, sf_dir), _config())


def _facts(spark, sf_dir) -> DataFrame:
    return fact_table(_files(spark, sf_dir))


def _indexed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The facts and the entities."""
    files = _files(spark, sf_dir)
    facts = cut(fact_table(files))
    return facts, cut(build.entities_of(files, facts))


def _tools(spark, sf_dir) -> Tools:
    return Tools(build.assemble(made.files(spark, sf_dir), made.config(), built_in()))


def _line(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.get_json_object("properties", "$.line").cast("int").alias("line"))


def _framework(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.get_json_object("properties", "$.line").cast("int").alias("line"), F.get_json_object("properties", "$.framework").alias("framework"))


# files to facts


@query(NODES)
def project_entities(spark, sf_dir):
    _, entities = _indexed(spark, sf_dir)
    return entities.select("path", "name", "entity_type", F.get_json_object("properties", "$.apiMode").alias("api_mode"))


@query("""SELECT path, 7 AS line, 'js' AS language FROM part_file UNION ALL SELECT path, 3, 'ts' FROM card_file UNION ALL SELECT DISTINCT path, 0, 'ts' FROM main_file UNION ALL SELECT '/app/src/preload/index.ts', 0, 'ts'
    UNION ALL SELECT path, 0, 'js' FROM shop_file UNION ALL SELECT path, 0, 'js' FROM api_file UNION ALL SELECT path, 0, 'js' FROM mixin_file UNION ALL SELECT DISTINCT path, 0, 'js' FROM router_file""")
def project_script_blocks(spark, sf_dir):
    return of(_facts(spark, sf_dir), "script").select("path", F.col("line").cast("int").alias("line"), F.col("name").alias("language"))


@query("""SELECT path, '../store/shop' || s AS source, 'useShop' || s || 'Store' AS names, false AS is_default FROM part_file UNION ALL SELECT path, '@/mixins/Nation' || n, 'Nation' || n, true FROM part_file
    UNION ALL SELECT path, 'pinia', 'defineStore', false FROM shop_file UNION ALL SELECT path, '../api/fetch' || n, 'fetch' || n, false FROM shop_file
    UNION ALL SELECT path, 'vue', 'ref', false FROM card_file UNION ALL SELECT DISTINCT path, 'electron', 'ipcMain', false FROM main_file""")
def project_import_facts(spark, sf_dir):
    found = of(_facts(spark, sf_dir), "import")
    return found.select("path", F.col("name").alias("source"), F.array_join("args", ",").alias("names"), F.col("flag").alias("is_default"))


@query(FUNCTIONS)
def project_functions(spark, sf_dir):
    found = build.functions_of(_facts(spark, sf_dir))
    return found.select("id", "name", "file_path", "kind", *[F.col(c).cast("int").alias(c) for c in ("start_line", "end_line", "file_start_line")])


@query("SELECT path, 'owner' AS tag, 'team' || t AS value FROM part_file UNION ALL SELECT path, 'since', '1.' || t FROM part_file")
def project_annotations(spark, sf_dir):
    return of(_facts(spark, sf_dir), "annotation").select("path", F.col("name").alias("tag"), F.col("full").alias("value"))


@query("SELECT path, 'Card' || n AS tag, 3 AS line FROM part_file UNION ALL SELECT path, 'part-' || q, 4 FROM part_file")
def project_template_tags(spark, sf_dir):
    return of(_facts(spark, sf_dir), "tag").select("path", F.col("name").alias("tag"), F.col("line").cast("int").alias("line"))


@query(ITEMS)
def project_store_items(spark, sf_dir):
    return build.items_of(_facts(spark, sf_dir)).select("id", "name", "item_type", "store_path")


@query("SELECT path, 'pinia' AS variant, 'stock' || s || ',total' AS state, true AS has_action, false AS has_mutation FROM shop_file")
def project_store_properties(spark, sf_dir):
    _, entities = _indexed(spark, sf_dir)
    get = lambda key: F.get_json_object("properties", f"$.{key}")
    rows = entities.where("entity_type = 'store'")
    return rows.select("path", get("storeVariant").alias("variant"), F.array_join(F.from_json(get("stateKeys"), "array<string>"), ",").alias("state"), (get("hasAction") == "true").alias("has_action"), (get("hasMutation") == "true").alias("has_mutation"))


@query(ROUTES)
def project_route_paths(spark, sf_dir):
    return of(_facts(spark, sf_dir), "route").select("path", "name", F.col("full").alias("full_path"), F.col("line").cast("int").alias("depth"))


@query("SELECT path, 'Shop' || s AS store, 'add' || s AS item FROM part_file UNION ALL SELECT path, 'Shop' || s, 'stock' || s FROM part_file")
def project_store_usages(spark, sf_dir):
    return of(_facts(spark, sf_dir), "usage").select("path", F.col("object").alias("store"), F.col("name").alias("item"))


@query("SELECT path, 'Nation' || n AS mixin FROM part_file")
def project_mixin_names(spark, sf_dir):
    return of(_facts(spark, sf_dir), "mixin").select("path", F.col("name").alias("mixin"))


# detectors


def _detected(kind: str, pattern: str, *columns):
    return lambda spark, sf_dir: detectors.detect(_facts(spark, sf_dir), kind, pattern).select("path", *columns)


@query("SELECT path, '@/mixins/Nation' || n AS name FROM part_file WHERE contains('Nation' || n, 'Nation1')")
def detect_import_statement(spark, sf_dir):
    return _detected("import_statement", "Nation1", "name")(spark, sf_dir)


@query("SELECT path, 'useShop' || s || 'Store' AS name, 13 AS line FROM part_file")
def detect_call_expression(spark, sf_dir):
    return _detected("call_expression", "use*Store", "name", F.col("line").cast("int").alias("line"))(spark, sf_dir)


@query("SELECT path, 'Cache' || n AS name FROM api_file WHERE contains('Cache' || n, 'Cache2')")
def detect_new_expression(spark, sf_dir):
    return _detected("new_expression", "Cache2", "name")(spark, sf_dir)


@query("SELECT path, 'window.api' AS \"full\" FROM part_file UNION ALL SELECT path, 'window.api.get' || n FROM part_file")
def detect_member_expression(spark, sf_dir):
    return _detected("member_expression", "window.*", "full")(spark, sf_dir)


@query(f"SELECT path, '../components/Card' || n || '.vue' AS name FROM router_file WHERE contains('Card' || n, 'Card1')")
def detect_import_expression(spark, sf_dir):
    return _detected("import_expression", "Card1", "name")(spark, sf_dir)


@query("SELECT path, k AS name FROM part_file, (VALUES ('name'), ('mixins')) AS x(k)")
def detect_export_default(spark, sf_dir):
    return _detected("export_default", "name, mixins", "name")(spark, sf_dir)


@query("SELECT path, 'since' AS name, '1.' || t AS \"full\" FROM part_file")
def detect_annotation(spark, sf_dir):
    return _detected("annotation", "since", "name", "full")(spark, sf_dir)


@query("SELECT path, '<Card' AS name, '1' AS \"full\" FROM part_file UNION ALL SELECT path, '/>', '3' FROM part_file UNION ALL SELECT path, '</b>', '1' FROM card_file")
def detect_template_element(spark, sf_dir):
    return _detected("template_element", "<Card, />, </b>, <svg", "name", "full")(spark, sf_dir)


@query("SELECT path, 'defineProps' AS name, '[''size'']' AS argument FROM card_file")
def detect_compiler_macro(spark, sf_dir):
    return _detected("compiler_macro", "define*", "name", F.element_at("args", 1).alias("argument"))(spark, sf_dir)


# facts to relations


@query(IMPORTS)
def project_imports(spark, sf_dir):
    facts, entities = _indexed(spark, sf_dir)
    return E.imports(facts, E.folders(made.files(spark, sf_dir)), entities, made.ROOT).select("src", "dst")


@query(COMPONENTS)
def project_uses_component(spark, sf_dir):
    return _line(E.components(*_indexed(spark, sf_dir)))


@query(MIXINS)
def project_uses_mixin(spark, sf_dir):
    return E.mixins(*_indexed(spark, sf_dir)).select("src", "dst")


@query(USES)
def project_uses_store_item(spark, sf_dir):
    facts = cut(_facts(spark, sf_dir))
    return _line(E.store_item_uses(facts, build.items_of(facts)))


@query(CALLS)
def project_calls(spark, sf_dir):
    facts = cut(_facts(spark, sf_dir))
    return E.calls(facts, build.functions_of(facts)).select("src", "dst", "confidence", "call_site")


@query(IPC)
def project_ipc(spark, sf_dir):
    return E.ipc(cut(_facts(spark, sf_dir))).select("src", "dst", "rel_type")


@query(f"SELECT src, dst, line, framework FROM ({APIS}), (VALUES (1), (2)) AS x(pass)")
def project_api_uses(spark, sf_dir):
    config = _config()
    apis = spark.createDataFrame([(n, f) for f, names in config.apis.items() for n in names], "name string, framework string")
    return _framework(E.uses_api(_facts(spark, sf_dir), apis, 2))


@query(CONFIGURED)
def project_configured(spark, sf_dir):
    facts, entities = _indexed(spark, sf_dir)
    return E.configured(facts, entities, _config()).select("src", "dst", "rel_type")


# the whole graph and the tools


@query(f"""SELECT src, dst, rel_type, 1 AS n FROM ({BETWEEN}) UNION ALL SELECT src, dst, 'USES_API', 2 FROM ({APIS}) UNION ALL SELECT src, dst, 'uses_store_item', 1 FROM ({USES})
    UNION ALL SELECT store_path, id, 'has_item', 1 FROM ({ITEMS}) UNION ALL SELECT file_path, id, 'defines', 1 FROM ({FUNCTIONS}) UNION ALL SELECT src, dst, 'CALLS', 1 FROM ({CALLS})""")
def project_graph(spark, sf_dir):
    edges = _tools(spark, sf_dir).graph.edges
    return edges.groupBy("src", "dst", "rel_type").agg(F.count("*").cast("int").alias("n"))


#: The mixin's import goes through the alias of tsconfig.json in the written files.
@query(f"""SELECT replace(src, '/app/', '') AS src, replace(dst, '/app/', '') AS dst, rel_type FROM ({BETWEEN}) UNION ALL SELECT DISTINCT replace(src, '/app/', ''), dst, 'USES_API' FROM ({APIS})
    UNION ALL SELECT replace(src, '/app/', ''), replace(dst, '/app/', ''), 'uses_store_item' FROM ({USES}) UNION ALL SELECT 'package.json', 'made', 'package'""")
def project_from_files(spark, sf_dir):
    """The project written as files, read back with its YAML configuration, indexed, saved and loaded."""
    place = f"{shared_dir(spark)}/project-{uuid4().hex}"
    made.write(made.files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("'@/mixins/"), F.lit("'#mixins/"))), place)
    folder = re.sub("^file:/*", "/", place)
    build.build(spark, load(f"{folder}/skein.yaml"), built_in()).save(f"{place}/graph")
    graph = Graph.load(spark, f"{place}/graph")
    short = lambda c: F.replace(c, F.lit(f"{folder}/"), F.lit("")).alias(c)
    edges = graph.edges.where("rel_type not in ('has_item', 'defines', 'CALLS')").select(short("src"), short("dst"), "rel_type").distinct()
    package = graph.nodes.where("entity_type = 'package'").select(short("id"), "name", "entity_type")
    return edges.unionByName(package.toDF("src", "dst", "rel_type"))


@query(f"""SELECT 'entities' AS part, entity_type AS label, count(*) AS n FROM ({NODES}) GROUP BY 2 UNION ALL SELECT 'relations', rel_type, count(*) FROM ({BETWEEN}) GROUP BY 2
    UNION ALL SELECT 'relations', 'uses_store_item', count(*) FROM ({USES}) UNION ALL SELECT 'relations', 'USES_API', 2 * count(*) FROM ({APIS}) UNION ALL SELECT 'relations', 'has_item', count(*) FROM ({ITEMS})
    UNION ALL SELECT 'relations', 'defines', count(*) FROM ({FUNCTIONS}) UNION ALL SELECT 'relations', 'CALLS', count(*) FROM ({CALLS})
    UNION ALL SELECT 'store items', item_type, count(*) FROM ({ITEMS}) GROUP BY 2 UNION ALL SELECT 'functions', kind, count(*) FROM ({FUNCTIONS}) GROUP BY 2""")
def tool_project_overview(spark, sf_dir):
    return _tools(spark, sf_dir).project_overview().where("part <> 'apis'")


@query(f"""SELECT 'item' AS section, id, item_type AS detail FROM ({ITEMS}) WHERE name = 'add3' UNION ALL SELECT 'usage', src, CAST(line AS VARCHAR) FROM ({USES}) WHERE ends_with(dst, '#action:add3')
    UNION ALL SELECT 'named', path, 'property' FROM part_file WHERE s = 3 UNION ALL SELECT 'named', path, 'property' FROM shop_file WHERE starts_with('' || s, '3')""")
def tool_trace_usage(spark, sf_dir):
    return _tools(spark, sf_dir).trace_usage("add3")


@query("SELECT path AS file, 'list' || n AS name, '/n' || n || '/list' AS \"fullPath\", 1 AS depth FROM router_file WHERE contains('list' || n, 'list2') UNION ALL SELECT path, 'n' || n, '/n' || n || '/', 0 FROM router_file WHERE false")
def tool_route_map(spark, sf_dir):
    return _tools(spark, sf_dir).route_map("LIST2").select("file", "name", "fullPath", "depth")


@query(f"SELECT 'route file' AS section, path AS id, CAST(3 * count(*) AS VARCHAR) AS detail FROM router_file GROUP BY 2 UNION ALL SELECT 'route', path, full_path FROM ({ROUTES})")
def tool_find_entrypoints(spark, sf_dir):
    return _tools(spark, sf_dir).find_entrypoints()


@query(f"SELECT DISTINCT 'out' AS direction, rel_type, dst AS other FROM ({BETWEEN}) WHERE src = '/app/src/components/Part12.vue' UNION ALL SELECT DISTINCT 'in', rel_type, src FROM ({BETWEEN}) WHERE dst = '/app/src/components/Part12.vue'")
def tool_entity_context(spark, sf_dir):
    return _tools(spark, sf_dir).entity_context("Part12.vue")["relations"]


@query(f"SELECT 'caller' AS part, src AS id, confidence FROM ({CALLS}) WHERE dst = '/app/src/components/Part12.vue#step12:17' UNION ALL SELECT 'callee', dst, confidence FROM ({CALLS}) WHERE src = '/app/src/components/Part12.vue#step12:17' UNION ALL SELECT 'sibling', id, NULL FROM ({FUNCTIONS}) WHERE file_path = '/app/src/components/Part12.vue' AND name <> 'step12'")
def tool_function_context(spark, sf_dir):
    found = _tools(spark, sf_dir).function_context("step12", "Part12.vue")
    parts = [found["callers"].select(F.lit("caller").alias("part"), "id", "confidence"), found["callees"].select(F.lit("callee").alias("part"), "id", "confidence")]
    return parts[0].unionByName(parts[1]).unionByName(found["siblings"].select(F.lit("sibling").alias("part"), "id", F.lit(None).cast("double").alias("confidence")))


DIFF = "\n".join(["diff --git a/src/components/Part12.vue b/src/components/Part12.vue", "@@ -20,2 +20,3 @@ x", "diff --git a/src/api/fetch3.js b/src/api/fetch3.js", "@@ -1 +1 @@"])


@query(f"""SELECT id, name, 0 AS impact_depth FROM ({FUNCTIONS}) WHERE name = 'load12' UNION ALL SELECT id, name, 1 FROM ({FUNCTIONS}) WHERE name = 'step12' UNION ALL SELECT id, name, 2 FROM ({FUNCTIONS}) WHERE name = 'fetch12'""")
def tool_diff_impact(spark, sf_dir):
    return _tools(spark, sf_dir).diff_impact(DIFF).select("id", "name", "impact_depth")


@query(f"""SELECT id, depth FROM (SELECT dst AS id, 1 AS depth FROM ({BETWEEN}) WHERE src = '/app/src/store/shop4.js' UNION SELECT src, 1 FROM ({BETWEEN}) WHERE dst = '/app/src/store/shop4.js')""")
def tool_impact_analysis(spark, sf_dir):
    return _tools(spark, sf_dir).impact_analysis("/app/src/store/shop4.js", 1).select("id", "depth")


@query(f"SELECT kind, count(*) AS n, CAST(count(DISTINCT file_path) AS BIGINT) AS files FROM ({FUNCTIONS}) GROUP BY 1")
def tool_cypher(spark, sf_dir):
    return _tools(spark, sf_dir).cypher("MATCH (e:Entity)-[:defines]->(f:Function) RETURN f.kind AS kind, count(*) AS n, count(DISTINCT e.id) AS files")
