"""Relations of a configuration against the rule written out over all pairs."""

import re

from skein.operators.edges import configured
from skein.plans.lineage import cut
from skein.sources.config import Config, Relationship
from skein.sources.facts import FACTS

NAMES = ["useCartStore", "useShop", "cart", "Cart", "mapState", "mapGetters", "ca", "x", "", "use", "fetch-User", "ORDERS", "store"]
PATHS = ["/app/src/store/cart.ts", "/app/src/store/modules/Shop.js", "/cart/x.ts", "/app/CART.store.ts", "orders/user.js", "/a//b.js", "/app/src/store/cart/index.ts"]
IMPORTS = ["../store/cart.ts", "@/store/modules", "./Shop.js", "cart", "x", "ab", "src", "./index", "../store/b.js"]


def base(path):
    return re.sub(r"\.[^.]+$", "", re.split(r"[\\/]", path)[-1])


def normal(name):
    return re.sub("[^a-z0-9]", "", name.lower())


def means(kind, name, args, path, own, target):
    stem, low = base(path).lower(), path.lower()
    if kind == "call_expression":
        callee, own, core = normal(name), normal(own or ""), re.sub("(?i)Store$", "", re.sub("^use", "", name)).lower()
        modules = [a.strip("'\"").split("/")[0].lower() for a in args or [] if a[:1] in "'\""]
        return (len(own) > 1 and own in callee) or (len(callee) > 1 and callee in own) or (len(core) > 2 and (core in stem or stem in core)) or (name.startswith("map") and any(m == stem or f"/{m}/" in low for m in modules))
    if kind == "member_expression":
        return "store" in target
    name, whole = base(name).lower(), name
    return len(whole) > 2 and ((len(name) > 1 and name == stem) or (kind == "import_expression" and len(name) > 2 and f"/{name}/" in low))


def setting(spark):
    facts, blank = [], (None,) * 14
    for k, path in enumerate(["/p/A.vue", "/p/B.vue", *PATHS]):
        kind = "component" if k < 2 else "store"
        for n, name in enumerate(NAMES[k % 3 :]):
            facts.append((path, path, kind, n, "call", name, name, None, [["'cart'", "x"], ["'Modules/a'"], ["''"], None][(n + k) % 4], None, n, *blank[11:], None))
        for n, name in enumerate(IMPORTS[k % 2 :], 50):
            facts += [(path, path, kind, n + 20 * i, fact, name, None, None, [], i > 0, n, *blank[11:], None) for i, fact in enumerate(("import", "dynamic_import"))]
        facts += [(path, path, kind, 99 - n, "member", "y", f"this.{n}", "this", None, None, 99 - n, *blank[11:], None) for n in range(2)]
    entities = [(p, n, t, k) for t in ("store", "page") for k, (p, n) in enumerate(zip(PATHS if t == "store" else [f"/pages{p}" for p in PATHS], ["", "Cart", "shop", "Orders", "User", None, "x"]))]
    return facts, entities, cut(spark.createDataFrame(facts, FACTS)), cut(spark.createDataFrame(entities, "path string, name string, entity_type string, ordinal long"))


KINDS = {"call": "call_expression", "import": "import_statement", "dynamic_import": "import_expression", "member": "member_expression"}


def test_configured_equals_all_pairs(spark):
    facts, entities, f, e = setting(spark)
    for kinds in [[k] for k in KINDS] + [list(KINDS)]:
        relations = {t + s: Relationship(s, t, [(KINDS[k], "*") for k in kinds]) for s in ("component", "store") for t in ("store", "page")}
        want = {}
        for r in relations.values():
            for place, k in enumerate(kinds):
                for x in sorted((x for x in facts if x[2] == r.source and x[4] == k), key=lambda x: x[3]):
                    for path, name, t, _ in entities:
                        if t == r.target and x[0] != path and means(KINDS[k], x[5], x[8], path, name, t):
                            want.setdefault((x[0], path, t + r.source), x[10])
        got = configured(f, e, Config("c", "/", {}, {}, relations)).selectExpr("src", "dst", "rel_type", "cast(get_json_object(properties, '$.line') as long) as line").collect()
        assert len(got) == len(want) and {(r["src"], r["dst"], r["rel_type"]): r["line"] for r in got} == want


def test_imports_meet_entities_by_keys(spark):
    _, _, f, e = setting(spark)
    found = configured(f, e, Config("c", "/", {}, {}, {"shows": Relationship("component", "page", [("import_expression", "*"), ("import_statement", "*")])}))
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())
