"""An own small project, indexed, and every tool asked about it. Expected values were counted by hand."""

import json
import shutil
from pathlib import Path

import pytest
import yaml
from pyspark.sql import functions as F

from skein.cli import main
from skein.operators import detectors
from skein.operators.build import build, definitions
from skein.operators.graph import Graph
from skein.operators.render import markdown, sections
from skein.operators.tools import Tools
from skein.plans.plugins import Base, ComponentFiles, Detection, Registry, built_in
from skein.sources import config as C
from skein.sources import files as S
from skein.sources.facts import facts

PROJECT = Path(__file__).parent / "project"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("work") / "shop"
    shutil.copytree(PROJECT, top)
    return top


@pytest.fixture(scope="module")
def tools(spark, root, tmp_path_factory):
    built = build(spark, C.load(str(root / "skein.yaml")), built_in())
    place = str(tmp_path_factory.mktemp("graph"))
    built.save(place)
    return Tools(Graph.load(spark, place))


def short(df, root, *columns):
    cut = lambda v: v.replace(f"{root}/", "").replace("src/", "", 1) if isinstance(v, str) else v
    return sorted(tuple(cut(r[c]) for c in columns) for r in df.collect())


def pairs(tools, root, relation):
    return short(tools.graph.edges.where(F.col("rel_type") == relation), root, "src", "dst")


def test_entities(tools, root):
    kinds = dict(short(tools.graph.nodes, root, "id", "entity_type"))
    assert kinds["components/Basket.vue"] == "component" and kinds["router/index.ts"] == "route" and kinds["electron/main.ts"] == "electron-main"
    assert sorted(kinds.values()) == sorted(["component"] * 2 + ["store"] * 2 + ["route", "composable", "mixin", "electron-main", "preload", "package"])


def test_functions(tools, root):
    found = short(tools.graph.functions, root, "file_path", "name", "kind", "start_line", "file_start_line")
    assert len(found) == 12
    assert ("components/Basket.vue", "check", "function", 11, 19) in found
    assert ("components/PriceTag.vue", "short", "method", 18, 18) in found
    assert not any(f[1] == "long" for f in found)  # a computed method, not a pair
    assert {f[2] for f in found if f[0].startswith("store/")} == {"store_action"}
    assert ("composables/useRates.ts", "useRates", "composable_function", 5, 5) in found


def test_store_items(tools, root):
    assert short(tools.graph.store_items.where("id like '%basket%'"), root, "name", "item_type") == [("addItem", "action"), ("clear", "action"), ("items", "state"), ("sum", "getter")]
    assert short(tools.graph.store_items.where("id like '%goods%'"), root, "name", "item_type") == [("fetchGoods", "action"), ("list", "state"), ("page", "state"), ("setList", "mutation")]


def test_relations(tools, root):
    assert pairs(tools, root, "imports") == [("components/Basket.vue", "components/PriceTag.vue"), ("components/Basket.vue", "store/basket.ts"), ("components/PriceTag.vue", "mixins/Listing.js")]
    assert pairs(tools, root, "matches_route") == [("router/index.ts", "components/Basket.vue"), ("router/index.ts", "components/PriceTag.vue")]
    assert pairs(tools, root, "uses_component") == [("components/Basket.vue", "components/PriceTag.vue")]
    assert pairs(tools, root, "uses_mixin") == [("components/PriceTag.vue", "mixins/Listing.js")]
    assert pairs(tools, root, "calls_ipc") == [("components/PriceTag.vue", "electron/main.ts"), ("electron/preload.ts", "electron/main.ts")]
    assert pairs(tools, root, "exposes_ipc") == [("electron/preload.ts", "electron/main.ts")]
    assert [d.rpartition("#")[2] for _, d in pairs(tools, root, "uses_store_item")] == ["action:addItem", "getter:sum", "action:fetchGoods", "state:list"]
    assert len(pairs(tools, root, "has_item")) == 8 and len(pairs(tools, root, "defines")) == 12
    calls = tools.graph.edges.where("rel_type = 'CALLS'")
    assert sorted((r["call_site"], r["confidence"]) for r in calls.collect()) == [("check→label", 0.95), ("put→addItem", 0.8), ("put→check", 0.95)]


def test_api_uses_count_twice(tools):
    used = tools.graph.edges.where("rel_type = 'USES_API'")
    assert used.count() == 2 * used.select("src", "dst", "properties").distinct().count() == 20
    assert tools.graph.apis.count() == 34 + 8 + 7 + 4


def test_corrected_relations(spark, root):
    built = build(spark, C.load(str(root / "skein.yaml")), built_in(), compat=False)
    found = short(built.edges.where("rel_type = 'uses_store'"), root, "src", "dst")
    assert ("components/Basket.vue", "store/basket.ts") in found and ("components/PriceTag.vue", "store/goods.js") in found


def test_without_plugins(spark, root):
    built = build(spark, C.load(str(root / "skein.yaml")), None)
    assert built.edges.where("rel_type in ('uses_mixin', 'uses_store_item', 'calls_ipc')").isEmpty()
    assert built.nodes.where("entity_type = 'mixin'").isEmpty()


def test_impact(tools, root):
    found = short(tools.impact_analysis(str(root / "src/store/basket.ts")), root, "id", "depth", "relation")
    assert ("components/Basket.vue", 1, "(in) imports") in found and ("router/index.ts", 2, "(in) matches_route") in found
    assert {d for _, d, _ in found} <= {1, 2, 3}
    assert tools.impact_analysis("nowhere").count() == 0


def test_routes(tools):
    rows = tools.route_map().collect()
    assert [(r["fullPath"], r["depth"]) for r in rows] == [("/", 0), ("/tags", 1), ("/top", 1), ("/old", 0)]
    assert rows[1]["alias"] == ["/labels", "/t"] and rows[0]["meta"] == {"title": "Home", "open": "true"} and rows[3]["guards"] == ["guard"]
    assert [r["name"] for r in tools.route_map("LABELS").collect()] == ["tags"] and tools.route_map(limit=2).count() == 2


def test_tools(tools, root):
    context = tools.entity_context("PriceTag.vue")
    assert context["entity"].first()["name"] == "PriceTag" and "calls_ipc" in {r["rel_type"] for r in context["relations"].collect()}
    assert "# " in sections(context)
    assert {r["section"] for r in tools.trace_usage("addItem").collect()} >= {"item", "usage"}
    assert {r["section"] for r in tools.find_entrypoints().collect()} == {"route file", "route", "package"}
    assert ("entities", "component", 2) in [tuple(r) for r in tools.project_overview().collect()]
    one = tools.function_context("check")
    assert [r["name"] for r in one["callers"].collect()] == ["put"] and [r["name"] for r in one["callees"].collect()] == ["label"]
    assert {r["name"] for r in one["siblings"].collect()} == {"label", "put"}
    assert [r["n"] for r in tools.cypher("MATCH (e:Entity)-[:defines]->(f:Function {kind: 'method'}) RETURN e.entityType AS t, count(*) AS n ORDER BY n DESC").collect()] == [3, 1]


def test_diff_uses_lines_of_the_file(tools):
    text = "diff --git a/src/components/Basket.vue b/src/components/Basket.vue\n@@ -19,1 +20,1 @@"
    assert [(r["name"], r["impact_depth"]) for r in tools.diff_impact(text).collect()] == [("check", 0), ("label", 1)]
    assert [r["name"] for r in tools.diff_impact(text, script_lines=True).where("impact_depth = 0").collect()] == ["put"]


def test_search(tools):
    assert tools.semantic_search("addItem").first()["name"] == "addItem"
    assert {r["kind"] for r in tools.semantic_search("rate", kind="method").collect()} == {"method"}
    assert tools.semantic_search("zzzz").count() == 0
    assert tools.semantic_search("zzzz", kind="store_action").count() == 2


def test_detectors(spark, root):
    files = S.classify(S.read_files(spark, str(root / "src")), C.with_plugin(C.load(str(root / "skein.yaml"))))
    table = facts(files).cache()
    found = lambda kind, pattern="*": {r["name"] for r in detectors.detect(table, kind, pattern).collect()}
    assert found("call_expression", "use*Store") == {"useBasketStore"} and not found("call_expression", "seBasket")
    assert found("import_statement", "pinia") == {"pinia"} and found("new_expression") == set()
    assert found("import_expression", "Price") == {"../components/PriceTag.vue"}
    assert "addItem" in found("member_expression", "basket.*") and "name" in found("export_default", "name, mixins")
    assert {"owner", "since"} <= found("annotation") and found("template_element", "rice, nowhere") == {"rice"} and not found("template_element", "")
    assert found("compiler_macro") == set() and detectors.detect(table, "nothing", "*") is None


def test_config(tmp_path):
    with pytest.raises(C.ConfigError):
        C.load(str(tmp_path / "none.yaml"))
    with pytest.raises(C.ConfigError):
        C.parse({"project": {"name": "x"}})
    assert C.source_root("/a", "/b") == "/a" and C.source_root("C:\\x", "/b") == "C:\\x" and C.source_root("src", "/b") == "/b/src"
    parsed = C.parse({"project": {"name": "x", "source_root": "s"}, "relationships": {"uses_store": {"from": "a", "to": "b", "detect_by": []}}})
    assert C.with_plugin(parsed).relationships["uses_store"].source == "component"
    assert C.with_plugin(parsed, compat=False).relationships["uses_store"].source == "a"
    path = tmp_path / "skein.yaml"
    assert main(["init", str(path)]) == 0 and C.load(str(path)).name == tmp_path.name


def test_package_and_aliases(spark, tmp_path):
    (tmp_path / "src").mkdir()
    assert S.package(spark, str(tmp_path)).count() == 0 and S.aliases(str(tmp_path / "src")) == []
    (tmp_path / "package.json").write_text('{"name": "p", "dependencies": {"pinia": "1"}}')
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions": {"paths": {"#/*": ["src/*"]}}}')
    assert json.loads(S.package(spark, str(tmp_path)).first()["properties"])["hasPinia"]
    assert S.aliases(str(tmp_path / "src")) == [("#/", str(tmp_path / "src"))] or S.aliases(str(tmp_path / "src"))[0][1].rstrip("/") == str(tmp_path / "src")


def test_registry():
    class Broken(ComponentFiles):
        name = "broken"

        def detect(self, listing, folder):
            raise RuntimeError("no")

    found = Registry()
    found.register(Broken())
    assert found.active(None, "/") == [] and "broken" in found.errors
    with pytest.raises(ValueError):
        found.register(Broken())


def test_markers(tools):
    props = {r["name"]: json.loads(r["properties"]) for r in tools.graph.nodes.where("entity_type = 'component'").collect()}
    assert props["Basket"]["usesOptionsAPI"] is False and props["PriceTag"]["matchesNamingPattern"] is False and "markedAsOptionsAPI" not in props["PriceTag"]
    others = tools.graph.nodes.where("entity_type = 'store'").collect()
    assert all("usesOptionsAPI" not in json.loads(r["properties"]) for r in others)


def test_definitions(spark, root):
    rows = {(r["part"], r["name"]): r["detail"] for r in definitions(spark, C.load(str(root / "skein.yaml"))).collect()}
    assert rows["relation", "matches_route"] == "route -> component" and rows["entity", "component"] == "**/*.vue" and rows["apis", "vue"] == "4"


def test_hooks(spark, root):
    class Own(Base):
        name = "own"

        def detect(self, listing, folder):
            return Detection(True, 1.0, [])

        def extract(self, files):
            return facts(files).where("fact = 'script'").withColumn("fact", F.lit("store_item")).withColumn("name", F.lit("extra")).withColumn("full", F.lit("state")).where("path like '%basket.ts'")

        def classify(self, table):
            return table.where("fact = 'function' and path like '%basket.ts' and name = 'addItem'").select("path", "name", "line", F.lit("special").alias("kind"))

        def after(self, table, entities, items):
            raise RuntimeError("later")

    registry = Registry()
    registry.register(Own())
    built = build(spark, C.load(str(root / "skein.yaml")), registry)
    assert "extra" in {r["name"] for r in built.store_items.collect()}
    assert {(r["name"], r["kind"]) for r in built.functions.where("file_path like '%basket.ts'").collect()} == {("addItem", "special")}
    assert built.functions.where("file_path like '%Basket.vue'").count() == 3 and "own" in registry.errors


def test_render(spark):
    df = spark.createDataFrame([("a|b", 1.0), (None, 2.0)], "x string, y double")
    assert "a\\|b" in markdown("T", df) and "Only the first 1" in markdown("T", df, 1) and "Nothing" in markdown("T", df.limit(0))


def test_stream(spark, sf_dir, tmp_path):
    from skein.streaming import edges as stream

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in")
    rows = stream.read_stream(spark, f"{sf_dir}/events.parquet", str(tmp_path / "in"))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    stream.run_once(stream.windowed_counts(rows), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = stream.windowed_counts(events)
    assert got.count() > 0 and got.join(batch, ["start", "event_type", "n"], "left_anti").isEmpty()


def test_probe_and_templates(tmp_path):
    top = tmp_path / "shop"
    for name in ("src/stores/a.ts", "src/views/V.vue", "src/composables/useA.ts", "src/x.js"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("")
    (top / "package.json").write_text('{"name": "shop", "dependencies": {"pinia": "2", "vue-router": "4"}, "devDependencies": {"vuex": "4"}}')
    seen = C.probe(str(top))
    assert (seen.name, seen.source_root, seen.language, seen.stores, seen.store_folder) == ("shop", "src", "ts", "both", "stores") and seen.parts == {"composable", "page", "route"}
    first = C.parse(yaml.safe_load(C.minimal(seen, True)), str(top))
    assert first.entities == {"component": ["**/*.vue"], "store": ["stores/**/*.{js,ts}"], "route": ["router/**/*.{js,ts}"]}
    answers = iter(["", ".", "perl", "js", "vuex", "", "n", "y", "", "", "", "y"])
    said = C.ask(seen, lambda question: next(answers))
    assert (said.name, said.source_root, said.language, said.stores, said.parts) == ("shop", ".", "js", "vuex", {"route", "page", "electron-main"})
    parsed = C.parse(yaml.safe_load(C.full(said)), str(top))
    assert list(parsed.entities) == ["component", "store", "route", "page", "electron-main", "preload"] and "src/router/**/*.js" in parsed.entities["route"]
    assert not any(p.endswith(".ts") for patterns in parsed.entities.values() for p in patterns) and set(parsed.apis) == {"vue", "vue-router"}
    assert ("call_expression", "mapState") in parsed.relationships["uses_store"].detect_by and "uses_mixin" not in parsed.relationships
    (top / "electron").mkdir()
    assert C.probe(str(top)).source_root == "." and "electron-main" in C.probe(str(top)).parts
    assert main(["init", str(top / "skein.yaml")]) == 0 and C.load(str(top / "skein.yaml")).entities["store"] == ["src/stores/**/*.{js,ts}"]


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 3}" / f"f{k}.js").write_text(f"const a = {k}\n")
    found = S.read_files(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = {f"d{k % 3}/f{k}.js": f"const a = {k}\n" for k in range(300)}
    assert {r["rel_path"]: (r["content"], r["length"]) for r in found.collect()} == {p: (t, len(t)) for p, t in texts.items()}
    (tmp_path / "none").mkdir()
    assert S.read_files(spark, str(tmp_path / "none")).count() == 0
