import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.extract import blocks, extract, full_path, inner, main_script
from skein.functions.scanner import Source, tokenise
from skein.operators import search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def tokens_plain(text):
    out = []
    for word in re.split(r"[^a-zA-Z0-9_$]+", text):
        if len(word) < 2:
            continue
        for t in re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", word)).split(" "):
            t = t.lower()
            if len(t) >= 2 and not re.fullmatch(r"[0-9_$]+", t):
                out.append(t)
    return out


def test_code_tokens(spark):
    texts = ["loadUserProfile", "HTTPServer", "snake_case", "a-b", "x1 22 __ $a", "", "getHTTPResponseCode42 andMore"]
    draw = random.Random(3)
    texts += ["".join(draw.choice("aBcD_$ 9-.") for _ in range(draw.randint(0, 30))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.code_tokens(F.col("t")).alias("x")).collect()
    assert all(r["x"] == tokens_plain(r["t"]) for r in rows)
    assert tokens_plain("loadUserProfile HTTPServer") == ["load", "user", "profile", "http", "server"]


def test_names_and_paths(spark):
    lit = F.lit
    assert one(spark, T.normal_name(lit("My-Cart_Store.ts"))) == "mycartstorets"
    assert one(spark, T.normal_channel(lit("Get-App_Info"))) == "getappinfo"
    assert one(spark, T.base_name(lit("/a/b.c/d.test.ts"))) == "d.test"
    assert one(spark, T.short_path(lit("/a/b/c/d"))) == ".../b/c/d" and one(spark, T.short_path(lit("a/b"))) == "a/b"
    for parent, path, want in (("", "x", "/x"), ("/", "x", "/x"), ("/a/", "x", "/a/x"), ("/a", "/b", "/b")):
        assert full_path(parent, path) == want
    assert one(spark, T.visible_properties(lit('{"a":1,"_b":2}'))) == {"a": "1"} and one(spark, T.visible_properties(lit("oops"))) == {}


def test_globs():
    fits = lambda p, x: bool(re.search(T.glob_regex(p), x))
    assert fits("**/*.vue", "a/b/C.vue") and fits("**/*.vue", "C.vue") and not fits("*.vue", "a/C.vue")
    assert fits("store/**/*.{ts,js}", "store/a/b.js") and fits("store/**/*.ts", "store/b.ts") and not fits("store/**/*.ts", "xstore/b.ts")


def test_wildcards(spark):
    rows = spark.createDataFrame([(x,) for x in ("useCartStore", "useStore", "mapState", "xmapState")], "n string")
    match = lambda c: {r["n"] for r in rows.where(c).collect()}
    assert match(T.matches_exact_or_glob(F.col("n"), "use*Store")) == {"useCartStore", "useStore"}
    assert match(T.matches_exact_or_glob(F.col("n"), "mapState")) == {"mapState"}
    assert match(T.matches_loosely(F.col("n"), "mapState")) == {"mapState", "xmapState"}
    assert len(match(T.matches_loosely(F.col("n"), "*"))) == 4


CODE = """import { defineStore } from 'pinia'
import Vue, { ref as r } from "vue";
const total = computed<number>(() => items.reduce((s, i) => s + i, 0))
export default wrap({ name: 'A', methods: { foo() { this.$store.dispatch('a/b') }, bar: function () {} } })
const text = `x ${fn(`y ${1}`)} z`, re = /a"b'c/g.test(s) / 2
class K { run(a: number): void { go(a) } }
if (a) { b() } for (const x of y) { z?.w(x) }
"""


def test_scanner():
    f = Source(CODE).facts()
    assert [(x.source, x.names, x.is_default) for x in f.imports] == [("pinia", ["defineStore"], False), ("vue", ["Vue", "ref", "r"], True)]
    called = [c.full for c in f.calls]
    assert {"computed", "items.reduce", "wrap", "this.$store.dispatch", "go", "b"} <= set(called)
    assert not {"run", "foo", "if", "for"} & set(called)
    assert {(x.name, x.form) for x in f.functions} >= {("foo", "method"), ("bar", "method")}
    assert [c.callee for c in Source("new Map<string, X>(a)").facts().news] == ["Map"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab(){}[]<>'\"`/\\,;:=.$ \n*?-constfunctioimpr", max_size=80))
def test_scanner_survives_anything(text):
    assert all(t.start < t.end <= len(text) for t in tokenise(text))
    Source(text).facts()
    list(extract("x.vue", f"<script>{text}</script>", "store"))
    list(extract("x.ts", text, "route"))


def test_blocks():
    text = "<template><div><template #a>x</template></div></template>\n<script>a()</script>\n<script setup lang='ts'>b()\n</script>"
    found = blocks(text)
    assert [b.kind for b in found] == ["template", "script", "script"] and inner(main_script(found)) == "b()\n"
    assert blocks("<script>never closed") == [] and main_script([]) is None


def test_tfidf_against_plain(spark):
    import math

    docs = [("a", "red plate red"), ("b", "blue plate"), ("c", "green"), ("d", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r["doc_id"]: r["score"] for r in search.tfidf(search.postings(df), 4, ["red", "plate", "none"]).collect()}
    idf = {t: math.log(5 / (n + 1)) + 1 for t, n in (("red", 1), ("plate", 2), ("none", 1))}
    norm = math.sqrt(sum(w * w for w in idf.values()))
    for doc, tf in (("a", {"red": 2, "plate": 1}), ("b", {"plate": 1})):
        dot = sum(idf[t] * idf[t] * n for t, n in tf.items())
        assert math.isclose(got.pop(doc), dot / (norm * math.sqrt(sum((idf[t] * n) ** 2 for t, n in tf.items()))))
    assert not got
