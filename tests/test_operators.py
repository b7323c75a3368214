import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import diff, graph, joins, layout, traverse
from skein.plans.cypher import Catalog, CypherError, cypher
from skein.schema import describe_schema


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_impact_equals_plain_search(spark, seed):
    draw = random.Random(seed)
    pairs = [(f"n{draw.randint(0, 30)}", f"n{draw.randint(0, 30)}", draw.choice("rs")) for _ in range(35)]
    edges = spark.createDataFrame(pairs, "src string, dst string, rel_type string")
    start = spark.createDataFrame([("n0",)], "id string")
    want, level, seen = {}, {"n0"}, {"n0"}
    for depth in range(1, 4):
        level = {b for a, b, _ in pairs if a in level} | {a for a, b, _ in pairs if b in level}
        level -= seen
        seen |= level
        want |= {x: depth for x in level}
    assert dict(rows(traverse.impact(edges, start), "id", "depth")) == want
    want, level, seen = {}, {"n0"}, {"n0"}
    for depth in range(1, 4):
        level = {b for a, b, _ in pairs if a in level} - seen
        seen |= level
        want |= {x: depth for x in level}
    assert dict(rows(traverse.reach(edges, start), "id", "depth")) == want


def test_impact_of_nothing(spark):
    edges = spark.createDataFrame([], "src string, dst string, rel_type string")
    assert traverse.impact(edges, spark.createDataFrame([("x",)], "id string")).count() == 0


def test_insert_edges_is_idempotent(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    raw = spark.createDataFrame([("a", "b", "r", 2), ("a", "b", "r", 1), ("a", "zz", "r", 0)], "src string, dst string, rel_type string, k int")
    once = graph.insert_edges(raw, nodes, "k")
    assert rows(once, "src", "dst", "rel_type", "k") == [("a", "b", "r", 1)]
    assert rows(graph.insert_edges(once.unionByName(once), nodes, "k"), "src", "dst", "k") == [("a", "b", 1)]
    assert graph.insert_edges(raw, nodes, "k", dedup=False).count() == 2


def test_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "id string, seq int, v string")
    assert rows(graph.upsert_last(df, "id", "seq"), "id", "v") == [("a", "y"), ("b", None)]


def test_diff(spark):
    text = "diff --git a/src/a.ts b/src/a.ts\n@@ -1,2 +3,4 @@ f\n x\n@@ -9 +20 @@\ndiff --git a/b.ts b/b.ts\n@@ -5,2 +5,0 @@"
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, line string")
    found = diff.hunks(lines)
    assert rows(found, "file_path", "low", "high") == [("b.ts", 5, 4), ("src/a.ts", 3, 6), ("src/a.ts", 20, 20)]
    functions = spark.createDataFrame([("f", "f", "function", "src/a.ts", 5, 9, 5), ("g", "g", "function", "src/a.ts", 10, 19, 10), ("h", "h", "function", "b.ts", 4, 5, 4), ("i", "i", "function", "b.ts", 5, 5, 5)], "id string, name string, kind string, file_path string, start_line long, end_line long, file_start_line long")
    assert rows(diff.changed_functions(found, functions), "id") == [("f",), ("h",)]
    calls = spark.createDataFrame([("f", "g", "CALLS"), ("g", "i", "CALLS")], "src string, dst string, rel_type string")
    assert rows(diff.diff_impact(found, functions, calls), "id", "impact_depth") == [("f", 0), ("g", 1), ("h", 0), ("i", 2)]


def test_binned_overlap_equals_nested_loop(spark):
    draw = random.Random(5)
    a = [(k, (low := draw.randint(0, 200)), low + draw.randint(-1, 40)) for k in range(60)]
    b = [(k, (low := draw.randint(0, 200)), low + draw.randint(0, 40)) for k in range(60)]
    want = sorted((i, j) for i, low, high in a if low <= high for j, s, e in b if low <= e and high >= s)
    ranges = spark.createDataFrame([x for x in a if x[1] <= x[2]], "r long, low long, high long")
    spans = spark.createDataFrame(b, "s long, start_line long, end_line long")
    assert rows(joins.overlaps(ranges, spans, [], 16), "r", "s") == want
    keyed = joins.overlaps(ranges.withColumn("k", F.col("r") % 3), spans.withColumn("k", F.col("s") % 3), ["k"], 8)
    assert rows(keyed, "r", "s") == [(i, j) for i, j in want if i % 3 == j % 3]


def test_overlaps_of_alike_ranges_take_little_room(spark, tmp_path):
    draw = random.Random(8)
    ranges = spark.createDataFrame([(k, (low := draw.randint(0, 5) * 10), low + 3) for k in range(600)], "r long, low long, high long")
    spans = spark.createDataFrame([(k, (low := draw.randint(0, 60)), low + draw.randint(0, 30)) for k in range(1500)], "s long, start_line long, end_line long")
    joins.overlaps(ranges, spans, []).select("r", "s").write.parquet(f"{tmp_path}/met")
    got = spark.read.parquet(f"{tmp_path}/met")
    left, right = ranges.collect(), spans.collect()
    want = sorted((r, s) for r, low, high in left for s, start, end in right if low <= end and high >= start)
    assert rows(got, "r", "s") == want
    assert sum(p.stat().st_size for p in (tmp_path / "met").glob("*.parquet")) < len(want) / 2


def test_overlaps_of_odd_ranges(spark):
    ranges = spark.createDataFrame([("a", 1, 5, 6), ("a", 1, 5, 6), ("a", None, 5, 6), (None, 2, 5, 6), ("a", 3, None, 6), ("a", 4, 64, 63), ("b", 5, -3, 200)], "k string, r long, low long, high long")
    spans = spark.createDataFrame([("a", 0, 70, 1), ("a", 6, 6, 2), ("b", 199, 300, 3), (None, 0, 99, 4)], "k string, start_line long, end_line long, s long")
    met = joins.overlaps(ranges, spans, ["k"])
    assert met.columns == ["k", "r", "low", "high", "start_line", "end_line", "s"]
    got = sorted(((r["k"], r["r"] or 0, r["s"]) for r in met.collect()))
    assert got == [("a", 0, 1), ("a", 0, 2), ("a", 1, 1), ("a", 1, 1), ("a", 1, 2), ("a", 1, 2), ("a", 4, 1), ("b", 5, 3)]
    assert joins.overlaps(ranges.drop("r"), spans, ["k"]).count() == len(got) and joins.overlaps(ranges.limit(0), spans, ["k"]).count() == 0


def test_many_alike_ranges_come_in_lists_of_bounded_size(spark):
    table = spark.range(10_000).select((F.col("id") % 10_000 < 9_000).cast("long").alias("k"), F.col("id").alias("r"))
    lists = [[x["r"] for x in row["__rows"]] for row in joins.listed(table, ["k"], 100).collect()]
    assert sorted(x for found in lists for x in found) == list(range(10_000)) and max(map(len, lists)) < 200


def test_overlaps_of_many_pairs_are_dealt_to_tasks_and_come_one_by_one(spark):
    draw = random.Random(9)
    ranges = spark.createDataFrame([(k, k % 5 == 4, (low := draw.randint(0, 9) * 10), low + 3) for k in range(900)], "r long, k boolean, low long, high long")
    spans = spark.createDataFrame([(k, k % 5 == 4, (low := draw.randint(0, 90)), low + draw.randint(0, 30)) for k in range(900)], "s long, k boolean, start_line long, end_line long")
    left, right = ranges.collect(), spans.collect()
    for by in (["k"], []):
        own = (lambda side: side) if by else (lambda side: side.drop("k"))
        met = joins.overlaps(own(ranges), own(spans), by, share=20_000).select("r", "s")
        want = sorted((x["r"], y["s"]) for x in left for y in right if (not by or x["k"] == y["k"]) and x["low"] <= y["end_line"] and x["high"] >= y["start_line"])
        parts = met.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert rows(met, "r", "s") == want
        assert len(parts) > 4 and max(p["count"] for p in parts) < len(want) / 2
        met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        merge = next(line for line in plan.splitlines() if "SortMergeJoin" in line and "low" in line and "end_line" in line)
        assert "*(" not in merge, "the merge is in generated code, which makes all rows of a list at once"


def test_resolve_prefers_the_first_suffix(spark):
    wanted = spark.createDataFrame([("x", "/s/store"), ("x", "/s/a"), ("x", "/s/none")], "src string, base string")
    listing = spark.createDataFrame([("/s/store",), ("/s/store/index.ts",), ("/s/a.ts",), ("/s/a.js",)], "path string")
    assert rows(joins.resolve_candidates(wanted, listing), "base", "path") == [("/s/a", "/s/a.ts"), ("/s/store", "/s/store")]


@pytest.fixture(scope="module")
def small(spark):
    people = spark.createDataFrame([("p1", "Ann", 30), ("p2", "Bo", 40), ("p3", "Cy", None)], "id string, name string, age int")
    places = spark.createDataFrame([("c1", "Rome"), ("c2", "Oslo")], "id string, name string")
    edges = spark.createDataFrame([("p1", "c1", "LIVES"), ("p2", "c1", "LIVES"), ("p1", "p2", "KNOWS"), ("p2", "p3", "KNOWS")], "src string, dst string, rel_type string")
    return Catalog({"Person": people, "City": places}, edges, {"years": "age"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (p:Person) WHERE p.age >= 40 OR p.name = 'Ann' RETURN p.name AS n", [("Ann",), ("Bo",)]),
        ("MATCH (p:Person {name: 'Bo'})-[:LIVES]->(c:City) RETURN c.name AS n", [("Rome",)]),
        ("MATCH (c:City)<-[r]-(p) RETURN p.id AS i, type(r) AS t", [("p1", "LIVES"), ("p2", "LIVES")]),
        ("MATCH (a:Person)-[:KNOWS*1..2]->(b:Person) RETURN a.id AS a, b.id AS b", [("p1", "p2"), ("p1", "p3"), ("p2", "p3")]),
        ("MATCH (p:Person)-[:LIVES]->(c:City) RETURN c.name AS c, count(*) AS n, collect(p.name) AS who", [("Rome", 2, ["Ann", "Bo"])]),
        ("MATCH (a:Person)-[:LIVES]->(c) MATCH (b:Person)-[:LIVES]->(c) WHERE a.id <> b.id RETURN a.name AS a, b.name AS b", [("Ann", "Bo"), ("Bo", "Ann")]),
        ("MATCH (p:Person) WHERE p.years IS NULL RETURN p.name AS n", [("Cy",)]),
        ("MATCH (p:Person) WHERE NOT (p.name IN ['Ann', 'Bo'] AND p.name ENDS WITH 'n') RETURN p.name AS n", [("Bo",), ("Cy",)]),
        ("MATCH (p:Person) RETURN p.name AS n ORDER BY n DESC SKIP 1 LIMIT 1", [("Bo",)]),
        ("MATCH (p:Person) RETURN p.name AS n ORDER BY p.age DESC LIMIT 1", [("Bo",)]),
        ("MATCH (p:Person), (c:City {name: 'Oslo'}) RETURN DISTINCT c.name AS c", [("Oslo",)]),
        ("MATCH (c:City) OPTIONAL MATCH (p:Person)-[:LIVES]->(c) WHERE p.name <> 'Ann' RETURN c.name AS c, count(p.id) AS n", [("Oslo", 0), ("Rome", 1)]),
        ("MATCH (p:Person)-[:LIVES]->(c:City) WITH c, count(*) AS n WHERE n > 1 RETURN c.name AS c, n AS n", [("Rome", 2)]),
        ("MATCH (p:Person)-[:LIVES]->(c:City) WITH c, count(*) AS n MATCH (q:Person)-[:LIVES]->(c) WHERE n = 2 RETURN q.name AS q", [("Ann",), ("Bo",)]),
        ("MATCH (p:Person) RETURN p.name AS n UNION MATCH (p:Person)-[:LIVES]->(c:City) RETURN p.name AS n", [("Ann",), ("Bo",), ("Cy",)]),
        ("MATCH (c:City) RETURN c.name AS n UNION ALL MATCH (c:City {name: 'Rome'}) RETURN c.name AS n", [("Oslo",), ("Rome",), ("Rome",)]),
    ],
)
def test_cypher(small, text, want):
    got = [tuple(r) for r in cypher(small, text).collect()]
    assert sorted(got) == want


@pytest.mark.parametrize("text", ["RETURN 1", "MATCH (p:Nobody) RETURN p.id", "MATCH (p:Person) RETURN p.shoe", "MATCH (p:Person", "MATCH (p:Person) WHERE p.name ~ 'x' RETURN p.id", "MATCH (a:Person)-[*1..9]->(b) RETURN a.id", "OPTIONAL MATCH (a:Person) RETURN a.id", "MATCH (a:Person) RETURN a.id AS x UNION MATCH (a:Person) RETURN a.id AS y"])
def test_cypher_errors(small, text):
    with pytest.raises((CypherError, IndexError)):
        cypher(small, text)


def test_as_of(spark):
    left = spark.createDataFrame([("u", 5), ("u", 1), ("v", 9)], "k string, t int")
    right = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b"), ("v", 10, "c")], "k string, t int, v string")
    assert rows(joins.as_of(left, right, "k", "t", "v").fillna("-"), "k", "t", "v") == [("u", 1, "-"), ("u", 5, "b"), ("v", 9, "-")]


def test_spread_apart(spark):
    """Pairs in order, all of them, against the rule written out."""
    draw = random.Random(4)
    rows_ = [(f"n{k:02}", draw.uniform(0, 60), draw.uniform(0, 60), draw.uniform(2, 9)) for k in range(40)]
    p, r = [list(x[1:3]) for x in rows_], [x[3] * 1.05 + 3 for x in rows_]
    for _ in range(15):
        moved = False
        for i in range(40):
            for j in range(i + 1, 40):
                dx, dy = p[i][0] - p[j][0], p[i][1] - p[j][1]
                far = math.hypot(dx, dy)
                if 0.01 < far < r[i] + r[j]:
                    push = (r[i] + r[j] - far) / 2 / far
                    p[i] = [p[i][0] + dx * push, p[i][1] + dy * push]
                    p[j] = [p[j][0] - dx * push, p[j][1] - dy * push]
                    moved = True
        if not moved:
            break
    got = {x["id"]: (x["x"], x["y"]) for x in layout.spread_apart(spark.createDataFrame(rows_, "id string, x double, y double, size double")).collect()}
    assert all(math.isclose(a, b, abs_tol=1e-6) for k, x in enumerate(rows_) for a, b in zip(got[x[0]], p[k]))


def naive_forces(p, edges, s):
    """The rule of a round, pair by pair."""
    n = len(p)
    weight, degree = {}, [0] * n
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            weight[x, y] = weight.get((x, y), 0) + 1
            degree[x] += 1
    for _ in range(s.rounds):
        cells = [(math.floor(x / 100), math.floor(y / 100)) for x, y in p]
        move = [[0.0, 0.0] for _ in p]
        for i in range(n):
            for j in range(i + 1, n):
                if n <= 200 or max(abs(cells[i][0] - cells[j][0]), abs(cells[i][1] - cells[j][1])) <= 1:
                    dx, dy = p[i][0] - p[j][0], p[i][1] - p[j][1]
                    d2 = max(dx * dx + dy * dy, 1.0)
                    f = s.repulsion / d2 / math.sqrt(d2)
                    for k, d in ((0, dx), (1, dy)):
                        move[i][k] += f * d
                        move[j][k] -= f * d
        for i in range(n):
            out = math.hypot(*p[i]) or 1.0
            for k in (0, 1):
                move[i][k] -= s.gravity * p[i][k] / out
        for (a, b), w in weight.items():
            for k in (0, 1):
                move[a][k] += w / degree[a] * (p[b][k] - p[a][k])
        longest = 0.0
        for i in range(n):
            m = math.hypot(*move[i])
            longest = max(longest, m)
            if m > 0:
                p[i] = [p[i][k] + move[i][k] * min(m / s.slow, 10) / m for k in (0, 1)]
        if longest < 0.1:
            break
    return p


@pytest.mark.parametrize(("n", "rounds"), [(12, 25), (230, 6)])
def test_layout_by_brute_force(spark, n, rounds):
    draw = random.Random(n)
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(2 * n)]
    nodes = spark.createDataFrame([(f"n{k:03}",) for k in range(n)], "id string")
    links = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges] + [("n000", "nowhere")], "src string, dst string")
    at = {r["id"]: [r["x"], r["y"]] for r in layout.beginning(nodes, n).collect()}
    s = layout.settings_for(n)
    want = naive_forces([at[f"n{k:03}"] for k in range(n)], edges, s._replace(rounds=rounds))
    got = {r["id"]: (r["x"], r["y"]) for r in layout.force_layout(nodes, links, rounds).collect()}
    assert all(math.isclose(a, b, abs_tol=1e-4) for k in range(n) for a, b in zip(got[f"n{k:03}"], want[k]))


def test_layout_in_rounds_of_joins(spark, monkeypatch):
    """Nodes far from each other move alike, whichever way does it; only one task looks at pairs that far apart."""
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(8)], "id string")
    links = spark.createDataFrame([("n0", "n1"), ("n1", "n2"), ("n5", "n6")], "src string, dst string")
    monkeypatch.setattr(layout, "beginning", lambda nodes, n: nodes.withColumns({"x": (F.substring("id", 2, 1).cast("double") - 4.3) * 400, "y": F.lit(50.0)}))
    one = {r["id"]: (r["x"], r["y"]) for r in layout.force_layout(nodes, links, 3).collect()}
    monkeypatch.setattr(layout, "ONE_TASK", 0)
    many = {r["id"]: (r["x"], r["y"]) for r in layout.force_layout(nodes, links, 3).collect()}
    assert one.keys() == many.keys() and all(math.isclose(a, b, abs_tol=1e-3) for k in one for a, b in zip(one[k], many[k]))


def test_earlier_relations_win(spark):
    """Of one pair of files and relation, the first detector's first match, then the configuration before the plugin."""
    from skein.operators import edges as E
    from skein.operators.build import assemble
    from skein.plans.plugins import Base, Detection, Registry
    from skein.sources.config import Config, Relationship

    class Late(Base):
        name = "late"

        def detect(self, listing, folder):
            return Detection(True, 1.0, [])

        def after(self, facts, entities, items):
            return [spark.createDataFrame([("/a/src/use.js", "/a/src/goods.js", "asks", '{"line":99}')], "src string, dst string, rel_type string, properties string")]

    text = "const a = one()\nconst goods = 1\ngoods()\ngoodsAll()\ngoods()\n"
    listing = spark.createDataFrame([("/a/src/use.js", "use.js", text, len(text)), ("/a/src/goods.js", "goods.js", "x()", 3)], "path string, rel_path string, content string, length long")
    relations = {"asks": Relationship("use", "goods", [("call_expression", "goodsAll"), ("call_expression", "goods")])}
    config = Config("a", "/a/src", {"use": ["use.js"], "goods": ["goods.js"]}, {}, relations)
    registry = Registry()
    registry.register(Late())
    for found in (assemble(listing, config, registry).edges, assemble(listing, config).edges):
        assert [r["properties"] for r in found.where("rel_type = 'asks'").collect()] == ['{"line":4,"evidence":"goodsAll"}']
    entities = spark.createDataFrame([("/m/goods.js", "", "mixin", 0), ("/c/Card.vue", "Tag", "component", 1)], "path string, name string, entity_type string, ordinal int")
    facts = spark.createDataFrame([("/p.vue", 7, "mixin", "Goods", 1), ("/p.vue", 3, "mixin", "goods", 1), ("/p.vue", 9, "tag", "card", 5), ("/p.vue", 8, "tag", "tag", 6)], "path string, ordinal int, fact string, name string, line int")
    assert [r["properties"] for r in E.mixins(facts, entities).collect()] == ['{"mixin":"goods"}']
    assert [r["properties"] for r in E.components(facts, entities).collect()] == ['{"tag":"tag","line":6}']


def test_schema(spark):
    assert {r["table_name"] for r in describe_schema(spark).collect()} == {"nodes", "edges", "functions", "store_items", "apis"}


def test_degrees(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a")], "src string, dst string")
    assert rows(graph.degrees(edges), "id", "degree") == [("a", 4), ("b", 2)]


def test_scratch(spark):
    """Checkpoints go with the innermost scope, but for those that are to outlive it."""
    from pathlib import Path

    from skein.plans.lineage import cut, scratch, shared_dir

    place = Path(shared_dir(spark).removeprefix("file:"))
    before = set(place.glob("rdd-*"))
    with scratch(spark):
        with scratch(spark):
            cut(spark.range(3))
            kept = cut(spark.range(5), keep=True)
        assert kept.count() == 5 and len(set(place.glob("rdd-*")) - before) == 1
    assert not set(place.glob("rdd-*")) - before
