"""The engine's queries over the driver's tables, each with an oracle for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import detectors, diff, graph, joins, layout, search, traverse
from skein.plans.cypher import Catalog, cypher
from skein.sources import files, tables
from skein.sources.config import Config
from skein.sources.facts import facts as fact_table
from skein.sources.tables import ident, read
from skein.streaming.edges import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


NODES = " UNION ALL ".join(f"SELECT '{label}:' || {key} AS id, CAST({name} AS VARCHAR) AS name, '{label}' AS entity_type FROM {table}" for table, (label, key, name) in tables.LABELS.items())
EDGES = " UNION ALL ".join(f"SELECT '{a}:' || {ak} AS src, '{b}:' || {bk} AS dst, '{rel}' AS rel_type, '{a}' AS src_label, '{b}' AS dst_label FROM {table}" for rel, table, (a, ak), (b, bk) in tables.RELATIONS)
GRAPH = f"nodes AS ({NODES}), edges AS ({EDGES})"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    labels = {label: tables.nodes(spark, sf_dir, (label,)) for label, _, _ in tables.LABELS.values()}
    return Catalog(labels, tables.edges(spark, sf_dir), {"filePath": "id", "entityType": "entity_type"})


# scans, filters and hops


@query("SELECT 'part:' || p_partkey AS id, p_name AS name FROM part")
def node_scan(spark, sf_dir):
    return tables.nodes(spark, sf_dir, ("part",)).select("id", "name")


@query("SELECT 'customer:' || c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def node_filter_eq(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 7))
    return rows.select(ident("customer", "c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))


@query("SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%widget%'")
def node_contains(spark, sf_dir):
    return tables.nodes(spark, sf_dir, ("part",)).where(F.col("name").contains("widget")).select("id", "name")


@query("SELECT n_name AS from_name, r_name AS to_name, 'in_region' AS rel_type FROM nation JOIN region ON n_regionkey = r_regionkey")
def hop_out(spark, sf_dir):
    return graph.hop(tables.edges(spark, sf_dir, ("in_region",)), tables.nodes(spark, sf_dir, ("nation", "region")), "in_region").select("from_name", "to_name", "rel_type")


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def hop_in(spark, sf_dir):
    met = graph.hop(tables.edges(spark, sf_dir, ("in_nation",)), tables.nodes(spark, sf_dir, ("customer", "nation")), "in_nation")
    return met.groupBy("to_id", F.col("to_name").alias("nation")).agg(F.count("*").alias("n")).select("nation", "n")


@query(f"WITH {GRAPH} SELECT rel_type, dst AS other, 'out' AS direction FROM edges WHERE src = 'nation:7' UNION ALL SELECT rel_type, src, 'in' FROM edges WHERE dst = 'nation:7'")
def hop_untyped(spark, sf_dir):
    return layout.ego(tables.edges(spark, sf_dir), "nation:7").select("rel_type", "other", "direction")


@query("SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem")
def hop_ordered(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(ident("order", "l_orderkey").alias("src"), ident("part", "l_partkey").alias("dst"), "l_linenumber", "l_partkey")
    return graph.ranked(rows, ["src"], ["l_linenumber", "l_partkey"], "place").select("src", "dst", F.col("place").cast("long").alias("place"))


@query(f"WITH {GRAPH} SELECT entity_type, count(*) AS n FROM nodes GROUP BY 1")
def count_nodes_by_type(spark, sf_dir):
    return tables.nodes(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT rel_type, count(*) AS n FROM edges GROUP BY 1")
def count_edges_by_label(spark, sf_dir):
    return tables.edges(spark, sf_dir).groupBy("rel_type").agg(F.count("*").alias("n"))


@query("SELECT a.o_orderkey AS order_id, b.o_orderkey AS sibling FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey")
def sibling_join(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    other = orders.withColumnRenamed("o_orderkey", "sibling")
    return orders.join(other, "o_custkey").where("o_orderkey <> sibling").select(F.col("o_orderkey").alias("order_id"), "sibling")


# upserts, dedup, first match


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_last_wins(spark, sf_dir):
    return graph.upsert_last(read(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), "user_id", "event_id")


@query("SELECT src, dst, rel_type, line FROM (SELECT 'order:' || l_orderkey AS src, 'supplier:' || l_suppkey AS dst, 'supplied_by' AS rel_type, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_suppkey IN (SELECT s_suppkey FROM supplier)) WHERE k = 1")
def edge_dedup_first(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(ident("order", "l_orderkey").alias("src"), ident("supplier", "l_suppkey").alias("dst"), F.lit("supplied_by").alias("rel_type"), F.col("l_linenumber").alias("line"))
    return graph.insert_edges(rows, tables.nodes(spark, sf_dir, ("order",)), "line", targets=tables.nodes(spark, sf_dir, ("supplier",)))


@query(f"WITH {GRAPH} SELECT rel_type, count(*) AS stored, count(DISTINCT src || '|' || dst) AS distinct_pairs FROM edges GROUP BY 1")
def edge_multiplicity(spark, sf_dir):
    pairs = tables.edges(spark, sf_dir).groupBy("rel_type", "src", "dst").agg(F.count("*").alias("n"))
    return pairs.groupBy("rel_type").agg(F.sum("n").alias("stored"), F.count("*").alias("distinct_pairs"))


#: Entity types of pages by the globs of their paths, in order.
PAGE_TYPES = {"german": ["de/**"], "html": ["**/*.html"], "short": ["*/?"], "rest": ["**"]}


@query(r"""WITH f AS (SELECT page_id, '/site/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/?', '') AS path FROM pages WHERE length(url) > 0)
    SELECT page_id, CASE WHEN regexp_matches(path, '(?:^|/)de/.*$') THEN 'german' WHEN regexp_matches(path, '(?:^|/)(?:.*/)?[^/]*\.html$') THEN 'html' WHEN regexp_matches(path, '(?:^|/)[^/]*/[^/]$') THEN 'short' ELSE 'rest' END AS entity_type FROM f""")
def classify_first_match(spark, sf_dir):
    rel = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*/?", "")
    rows = read(spark, sf_dir, "pages").select("page_id", rel.alias("rel_path"), F.concat(F.lit("/site/"), rel).alias("path"), F.length("url").alias("length"))
    return files.classify(rows, Config("pages", "/site", PAGE_TYPES, {}, {})).select("page_id", "entity_type")


@query("""WITH listing AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM pages),
    wanted AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '(/|\\.html)$', '') AS base FROM pages),
    tries AS (SELECT page_id, base, base || s AS path, k FROM wanted, (VALUES ('', 0), ('.html', 1), ('/', 2)) AS x(s, k)),
    r AS (SELECT t.*, row_number() OVER (PARTITION BY page_id, base ORDER BY k) AS n FROM tries t JOIN listing l ON t.path = l.path)
    SELECT page_id, base, path FROM r WHERE n = 1""")
def path_candidates_resolve(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    pages = read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    wanted = pages.select(F.col("page_id").alias("src"), F.regexp_replace("path", r"(/|\.html)$", "").alias("base")).distinct()
    return joins.resolve_candidates(wanted, pages, ("", ".html", "/")).select(F.col("src").alias("page_id"), "base", "path")


# traversal

BOTH = "SELECT src, dst, rel_type, 0 AS direction FROM edges UNION ALL SELECT dst, src, rel_type, 1 FROM edges"


@query(f"""WITH RECURSIVE {GRAPH}, ways AS (SELECT DISTINCT * FROM ({BOTH})),
    walk(id, depth) AS (SELECT 'order:0', 0 UNION SELECT w.dst, walk.depth + 1 FROM walk JOIN ways w ON w.src = walk.id WHERE walk.depth < 3),
    best AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
    ins AS (SELECT b.id, b.depth, w.direction, w.rel_type, w.src AS parent, row_number() OVER (PARTITION BY b.id ORDER BY w.direction, w.rel_type, w.src) AS k
            FROM best b JOIN ways w ON w.dst = b.id JOIN best p ON p.id = w.src AND p.depth = b.depth - 1)
    SELECT id, CAST(depth AS INTEGER) AS depth, CASE WHEN direction = 1 THEN '(in) ' || rel_type ELSE rel_type END AS relation, parent FROM ins WHERE k = 1 AND depth > 0""")
def impact_bfs(spark, sf_dir):
    start = spark.createDataFrame([("order:0",)], "id string")
    return traverse.impact(None, start, 3, tables.lead(spark, sf_dir, both=True))


@query(f"""WITH RECURSIVE {GRAPH}, walk(id, depth) AS (SELECT 'order:0', 0 UNION SELECT e.dst, walk.depth + 1 FROM walk JOIN edges e ON e.src = walk.id WHERE walk.depth < 3)
    SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id HAVING min(depth) > 0""")
def reach_calls(spark, sf_dir):
    start = spark.createDataFrame([("order:0",)], "id string")
    return traverse.reach(None, start, 3, tables.lead(spark, sf_dir, both=False)).select("id", "depth")


# diffs, intervals, carrying forward


@query("""WITH l AS (SELECT o_custkey AS diff_id, o_orderkey * 2 + k AS line_no, CASE WHEN k = 0 THEN 'diff --git a/f' || (o_orderkey % 7) || '.ts b/f' || (o_orderkey % 7) || '.ts' ELSE '@@ -1,2 +' || (o_orderkey % 90 + 1) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',' || (o_orderkey % 5) END || ' @@ x' END AS line FROM orders, (VALUES (0), (1)) AS v(k)),
    f AS (SELECT *, last_value(nullif(regexp_extract(line, '^diff --git a/.* b/(.*)$', 1), '') IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS file_path, nullif(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 1), '') AS lo, nullif(regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 2), '') AS n FROM l)
    SELECT diff_id, file_path, CAST(lo AS BIGINT) AS low, CAST(lo AS BIGINT) + coalesce(CAST(n AS BIGINT), 1) - 1 AS high FROM f WHERE lo IS NOT NULL""")
def diff_hunks_parse(spark, sf_dir):
    key = F.col("o_orderkey")
    name = F.concat(F.lit("f"), (key % 7).cast("string"), F.lit(".ts"))
    count = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit(","), (key % 5).cast("string")))
    lines = F.array(F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name), F.concat(F.lit("@@ -1,2 +"), (key % 90 + 1).cast("string"), count, F.lit(" @@ x")))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("diff_id"), key, F.posexplode(lines).alias("k", "line"))
    return diff.hunks(rows.select("diff_id", (F.col("o_orderkey") * 2 + F.col("k")).alias("line_no"), "line"), ["diff_id"]).select("diff_id", "file_path", "low", "high")


@query("""WITH r AS (SELECT o_custkey % 50 AS k, o_orderkey AS r_id, o_orderkey % 400 AS low, o_orderkey % 400 + 5 AS high FROM orders),
    s AS (SELECT p_partkey % 50 AS k, p_partkey AS s_id, p_partkey % 390 AS start_line, p_partkey % 390 + p_size AS end_line FROM part)
    SELECT r_id, s_id FROM r JOIN s USING (k) WHERE low <= end_line AND high >= start_line""")
def overlap_join(spark, sf_dir):
    at = F.col("o_orderkey") % 400
    ranges = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("r_id"), at.alias("low"), (at + 5).alias("high"))
    line = F.col("p_partkey") % 390
    spans = read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("k"), F.col("p_partkey").alias("s_id"), line.alias("start_line"), (line + F.col("p_size")).alias("end_line"))
    return joins.overlaps(ranges, spans, ["k"]).select("r_id", "s_id")


@query("""WITH r AS (SELECT event_id, epoch_us(ts) // 60000000 AS low, epoch_us(ts) // 60000000 + CAST(floor(value) AS BIGINT) % 9 AS high FROM events WHERE event_type = 'error'),
    s AS (SELECT event_id AS other, epoch_us(ts) // 60000000 AS start_line, epoch_us(ts) // 60000000 + 3 AS end_line FROM events WHERE event_type = 'purchase')
    SELECT event_id, other FROM r JOIN s ON low <= end_line AND high >= start_line""")
def overlap_join_binned(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("minute", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000))
    ranges = events.where("event_type = 'error'").select("event_id", F.col("minute").alias("low"), (F.col("minute") + F.floor("value") % 9).alias("high"))
    spans = events.where("event_type = 'purchase'").select(F.col("event_id").alias("other"), F.col("minute").alias("start_line"), (F.col("minute") + 3).alias("end_line"))
    return joins.overlaps(ranges, spans, [], 32).select("event_id", "other")


@query("""WITH f AS (SELECT doc_id, 'g' || (doc_id % 200) AS source, 'f' || (doc_id % 50) AS name, doc_id * 20 AS start_line, doc_id * 20 + n_chars // 100 AS end_line FROM documents),
    r AS (SELECT 'g' || (o_orderkey % 200) AS source, o_orderkey * 7 AS low, o_orderkey * 7 + 2 AS high, o_orderkey AS ordinal FROM orders),
    m AS (SELECT f.source, f.name, f.doc_id, row_number() OVER (PARTITION BY f.source, f.name ORDER BY r.ordinal, f.start_line, length('f:' || f.doc_id), 'f:' || f.doc_id) AS k FROM f JOIN r ON f.source = r.source AND low <= end_line AND high >= start_line)
    SELECT source, name, 'f:' || doc_id AS id FROM m WHERE k = 1""")
def changed_functions(spark, sf_dir):
    start = F.col("doc_id") * 20
    file = lambda key: F.concat(F.lit("g"), (F.col(key) % 200).cast("string")).alias("file_path")
    functions = read(spark, sf_dir, "documents").select(ident("f", "doc_id").alias("id"), F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.col("lang").alias("kind"), file("doc_id"), start.alias("start_line"), (start + F.floor(F.col("n_chars") / 100)).alias("end_line"), start.alias("file_start_line"))
    key = F.col("o_orderkey")
    ranges = read(spark, sf_dir, "orders").select(file("o_orderkey"), (key * 7).alias("low"), (key * 7 + 2).alias("high"), key.alias("ordinal"))
    return diff.changed_functions(ranges, functions).select(F.col("file_path").alias("source"), "name", "id")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations")
def carry_forward_file(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("own", F.when(F.col("role") == "user", F.col("turn")))
    return rows.select("conv_id", "turn", joins.carry_forward(rows, "own", "turn", ["conv_id"]).alias("user_turn"))


# search

SQL_TOKENS = "list_filter(flatten(list_transform(list_filter(regexp_split_to_array({0}, '[^a-zA-Z0-9_$]+'), lambda w: length(w) >= 2), lambda w: regexp_split_to_array(lower(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' '))), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9_$]+$'))"


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({SQL_TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def tokenize_df(spark, sf_dir):
    return search.frequencies(read(spark, sf_dir, "documents"))


def _tfidf_sql(corpus: str, terms: list[str]) -> str:
    wanted = ", ".join(f"('{t}')" for t in terms)
    return f"""c AS ({corpus}), n AS (SELECT count(*) AS n FROM c), t AS (SELECT doc_id, unnest({SQL_TOKENS.format('text')}) AS token FROM c),
    q(token) AS (VALUES {wanted}), p AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token IN (SELECT token FROM q) GROUP BY 1, 2),
    w AS (SELECT q.token, ln((any_value(n.n) + 1) / (coalesce(nullif(count(p.doc_id), 0), 1) + 1)) + 1 AS idf FROM q CROSS JOIN n LEFT JOIN p USING (token) GROUP BY 1),
    scores AS (SELECT doc_id, sum(idf * idf * tf) / (sqrt((SELECT sum(idf * idf) FROM w)) * sqrt(sum(idf * tf * idf * tf))) AS score FROM p JOIN w USING (token) GROUP BY 1)"""


PARTS = "SELECT 'part:' || p_partkey AS doc_id, p_name AS name, p_type AS kind, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part"


def _part_docs(spark, sf_dir):
    return read(spark, sf_dir, "part").select(ident("part", "p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))


@query(f"WITH {_tfidf_sql('SELECT doc_id, text FROM documents', ['with', 'the', 'idiot'])} SELECT doc_id, round(score, 6) AS score FROM scores")
def tfidf_search(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    terms = ["with", "the", "idiot"]
    return search.tfidf(search.postings(docs, terms=terms), docs.count(), terms).select("doc_id", F.round("score", 6).alias("score"))


BOOST = "CASE WHEN lower(name) = '{0}' THEN 0.5 WHEN contains(lower(name), '{0}') THEN 0.3 ELSE 0 END + CASE WHEN starts_with(lower(name), '{0}') THEN 0.2 ELSE 0 END"


@query(f"WITH {_tfidf_sql(PARTS, ['red', 'plate'])} SELECT doc_id, name, kind, round(coalesce(score, 0) + {BOOST.format('red plate')}, 6) AS score FROM c LEFT JOIN scores USING (doc_id) WHERE coalesce(score, 0) + {BOOST.format('red plate')} > 0 ORDER BY coalesce(score, 0) + {BOOST.format('red plate')} DESC, doc_id LIMIT 30")
def search_boost(spark, sf_dir):
    return search.search(_part_docs(spark, sf_dir), "Red plate", 50).withColumn("score", F.round("score", 6))


@query(f"WITH {_tfidf_sql(PARTS + chr(32) + 'WHERE p_type = ' + chr(39) + 'PROMO' + chr(39), ['widget'])} SELECT doc_id, name, kind, round(coalesce(score, 0) + {BOOST.format('widget')}, 6) AS score FROM c LEFT JOIN scores USING (doc_id) WHERE coalesce(score, 0) + {BOOST.format('widget')} > 0 ORDER BY coalesce(score, 0) + {BOOST.format('widget')} DESC, doc_id LIMIT 15")
def search_by_kind(spark, sf_dir):
    return search.search(_part_docs(spark, sf_dir), "widget", kind="PROMO").withColumn("score", F.round("score", 6))


# names


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^red .*t$')")
def glob_match(spark, sf_dir):
    return read(spark, sf_dir, "part").where(T.matches_exact_or_glob(F.col("p_name"), "red *t")).select("p_partkey", "p_name")


# JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_get(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT 'nation:' || n_nationkey AS id, 'n_name' AS property, n_name AS value FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation")
def json_hide_private(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(ident("nation", "n_nationkey").alias("id"), F.to_json(F.struct("n_name", "n_nationkey", F.col("n_regionkey").alias("_n_regionkey"))).alias("properties"))
    return rows.select("id", F.explode(T.visible_properties(F.col("properties"))).alias("property", "value"))


# drawing


@query(f"""WITH {GRAPH}, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT id, count(*) AS degree FROM ends GROUP BY id),
    a AS (SELECT nodes.id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d USING (id)), m AS (SELECT min(degree) AS lo, max(degree) AS hi FROM a)
    SELECT id, CAST(degree AS BIGINT) AS degree, round(greatest(2.8, 4.0 * (1 + 1.2 * coalesce((degree - lo) / nullif(hi - lo, 0), 0))), 6) AS size FROM a, m""")
def degree_size(spark, sf_dir):
    return layout.sizes(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir)).withColumn("size", F.round("size", 6))


@query(f"WITH {GRAPH} SELECT 'node' AS part, entity_type AS label, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 2")
def legend_counts(spark, sf_dir):
    return layout.legend(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT src, dst, rel_type FROM edges WHERE rel_type <> 'contains_part' AND src_label <> 'customer' AND dst_label <> 'customer' AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def visible_edges(spark, sf_dir):
    return layout.visible(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), ["customer"], ["contains_part"])[1].select("src", "dst", "rel_type")


@query(f"WITH {GRAPH} SELECT 'out' AS direction, rel_type, dst AS other FROM edges WHERE src = 'customer:5' UNION ALL SELECT 'in', rel_type, src FROM edges WHERE dst = 'customer:5'")
def ego_graph(spark, sf_dir):
    return layout.ego(tables.edges(spark, sf_dir), "customer:5")


@query(f"WITH {GRAPH} SELECT id, name FROM nodes WHERE contains(lower(name), 'plate') OR contains(lower(id), 'plate') OR contains(lower(entity_type), 'plate')")
def text_filter(spark, sf_dir):
    return layout.text_filter(tables.nodes(spark, sf_dir), "Plate").select("id", "name")


@query(f"WITH {GRAPH} SELECT DISTINCT src, rel_type, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def export_graph(spark, sf_dir):
    return graph.export_rows(tables.graph(spark, sf_dir))[1]


@query("SELECT event_id, array_to_string(list_slice(list_filter([event_type, CASE WHEN value > 50 THEN 'big' END, CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)], lambda x: x IS NOT NULL), 1, 3), ', ') AS summary FROM events")
def edge_summary(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.edge_summary(F.col("event_type"), F.when(F.col("value") > 50, "big"), F.col("user_id"), F.col("event_id")).alias("summary"))


@query("SELECT page_id, CASE WHEN len(p) <= 3 THEN url ELSE '.../' || array_to_string(list_slice(p, len(p) - 2, len(p)), '/') END AS short FROM (SELECT page_id, url, regexp_split_to_array(url, '[\\\\/]+') AS p FROM pages)")
def short_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.short_path(F.col("url")).alias("short"))


@query()
def layout_force(spark, sf_dir):
    """The whole graph, all rounds."""
    return layout.force_layout(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir))


@query()
def layout_apart(spark, sf_dir):
    """Suppliers and nations, each as large as its degree says, laid out and pushed apart."""
    nodes, edges = tables.nodes(spark, sf_dir, ("nation", "supplier")), tables.edges(spark, sf_dir, ("in_nation",)).where("src_label = 'supplier'")
    placed = layout.force_layout(nodes, edges).join(layout.sizes(nodes, edges).select("id", "size"), "id")
    return layout.spread_apart(placed)


# Cypher


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_name LIKE 'Customer#00000001%'")
def cypher_two_hops(spark, sf_dir):
    return cypher(catalog(spark, sf_dir), "MATCH (c:customer)-[:in_nation]->(n:nation)-[:in_region]->(r:region {name: 'ASIA'}) WHERE c.name STARTS WITH 'Customer#00000001' RETURN c.name AS customer, n.name AS nation")


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def cypher_group_count(spark, sf_dir):
    return cypher(catalog(spark, sf_dir), "MATCH (c:customer)-[r:in_nation]->(n:nation) RETURN n.name AS nation, count(*) AS n ORDER BY n DESC, nation LIMIT 10")


@query("SELECT a.s_name AS a, b.s_name AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey <> b.s_suppkey AND b.s_name <> 'Supplier#000000003'")
def cypher_siblings(spark, sf_dir):
    return cypher(catalog(spark, sf_dir), "MATCH (a:supplier)-[:in_nation]->(n:nation) MATCH (b:supplier)-[:in_nation]->(n) WHERE a.id <> b.id AND NOT b.name = 'Supplier#000000003' RETURN a.name AS a, b.name AS b")


@query(f"WITH {GRAPH} SELECT rel_type AS rel, dst AS target FROM edges WHERE src = 'order:3'")
def cypher_untyped_out(spark, sf_dir):
    return cypher(catalog(spark, sf_dir), "MATCH (o:order {filePath: 'order:3'})-[r]->(m) RETURN r._label AS rel, m.id AS target")


@query("""WITH n AS (SELECT 'supplier:' || s_suppkey AS s, 'nation:' || s_nationkey AS d FROM supplier), r AS (SELECT 'nation:' || n_nationkey AS s, 'region:' || n_regionkey AS d FROM nation)
    SELECT s_name AS supplier, t AS target FROM (SELECT n.s, n.d AS t FROM n UNION ALL SELECT DISTINCT n.s, r.d FROM n JOIN r ON n.d = r.s) JOIN supplier ON s = 'supplier:' || s_suppkey""")
def cypher_var_length(spark, sf_dir):
    return cypher(catalog(spark, sf_dir), "MATCH (s:supplier)-[:in_nation|in_region*1..2]->(t) RETURN s.name AS supplier, t.id AS target")


# what the engine adds to the reference's operators, on the table of events


@query("SELECT coalesce(event_type, 'all') AS event_type, CAST(grouping(event_type) + 2 * grouping(user_id % 4) AS BIGINT) AS level, user_id % 4 AS shard, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 4)")
def cube_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("shard"))
    cubed = rows.cube("event_type", "shard").agg(F.count("*").alias("n"), (F.grouping("event_type") + 2 * F.grouping("shard")).cast("long").alias("level"))
    return cubed.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "level", "shard", "n")


@query("SELECT e.event_id, max(p.event_id) AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.event_id <= e.event_id GROUP BY 1")
def asof_events(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("at"), "event_id")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("purchase_id"))
    return joins.as_of(errors, bought, "user_id", "at", "purchase_id").select("event_id", "purchase_id")


@query("""SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM
    (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY 1, 2""".replace("session, count(*)", "CAST(session AS BIGINT) AS session, count(*)", 1))
def sessionize(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(order)
    rows = read(spark, sf_dir, "events").withColumn("brk", F.when(gap <= F.expr("INTERVAL 30 MINUTE"), 0).otherwise(1))
    session = F.sum("brk").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("session", session).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stream_edge_counts(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


# the source scanner on the scripts of pages


def _scripts(spark, sf_dir) -> DataFrame:
    """Every script block of every page as a file."""
    scripts = F.regexp_extract_all("html", F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(scripts).alias("k", "content"))
    path = F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("k").cast("string"), F.lit(".js"))
    return rows.select(path.alias("path"), path.alias("rel_path"), "content", F.lit("page").alias("entity_type"))


SCRIPTS = "SELECT page_id || '-' || k || '.js' AS path, s[k + 1] AS script FROM (SELECT page_id, s, unnest(range(0, len(s))) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS s FROM pages))"


@query(rf"SELECT path, 'track' AS callee, regexp_extract(script, 'track\(([0-9]+)\)', 1) AS argument FROM ({SCRIPTS}) WHERE regexp_matches(script, 'track\([0-9]+\)')")
def scan_calls(spark, sf_dir):
    calls = detectors.detect(fact_table(_scripts(spark, sf_dir)), "call_expression", "tr*k")
    return calls.select("path", F.col("name").alias("callee"), F.element_at("args", 1).alias("argument"))
