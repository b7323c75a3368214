"""Relations between files, functions, store items and APIs, as joins over the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.extract import MAP_HELPERS
from skein.functions.text import base_name, directory, normal_channel, normal_name
from skein.operators.detectors import detect
from skein.operators.graph import first_of
from skein.operators.joins import SUFFIXES, resolve_candidates
from skein.plans.lineage import small_side
from skein.sources.config import Config
from skein.sources.facts import of

#: Callee names that never resolve to a function of the project (fixed values).
BUILTINS = [
    "if", "switch", "for", "while", "return", "throw", "typeof", "instanceof", "new", "import", "export",
    "require", "console", "JSON", "Math", "Object", "Array", "String", "Number", "Boolean", "Promise", "Map",
    "Set", "Ref", "ComputedRef", "parseInt", "parseFloat", "isNaN", "setTimeout", "setInterval", "clearTimeout",
    "clearInterval", "alert", "confirm", "prompt", "fetch", "isFinite", "encodeURIComponent", "decodeURIComponent",
]
#: How sure a call is inside a file and across files (fixed values).
SAME_FILE, OTHER_FILE = 0.95, 0.8
COLUMNS = ["src", "dst", "rel_type", "properties"]


def _edges(rows: DataFrame, src: str, dst: str, relation: str, k: str | None = None, **properties: Column) -> DataFrame:
    """(src, dst, rel_type, properties) and, with ``k``, that column as the order of the rows."""
    props = F.to_json(F.struct(*[v.alias(name) for name, v in properties.items()])) if properties else F.lit("{}")
    order = [F.col(k).alias("k")] if k else []
    return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(relation).alias("rel_type"), props.alias("properties"), *order)


def _first(edges: DataFrame) -> DataFrame:
    return first_of(edges, ["src", "dst", "rel_type"], ["k"]).select(*COLUMNS)


def collapse(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts."""
    step = lambda done, part: F.when((part == ".") | ((part == "") & (F.size(done) > 0)), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def imports(facts: DataFrame, listing: DataFrame, entities: DataFrame, root: str, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Imports of one entity by another; ``listing`` (path) has every file and folder that exists.

    A path is relative, or begins with ``@/`` (the source root), ``~/`` (its parent) or an alias. A folder of the very
    name wins over the file index inside it and is no entity, so such an import gives no relation.
    """
    source = F.col("name")
    base = F.when(source.startswith("."), F.concat(directory(F.col("path")), F.lit("/"), source))
    base = base.when(source.startswith("@/"), F.concat(F.lit(root + "/"), F.substring(source, 3, 10_000)))
    base = base.when(source.startswith("~/"), F.concat(F.lit(root.rpartition("/")[0] + "/"), F.substring(source, 3, 10_000)))
    for prefix, folder in aliases:
        base = base.when(source.startswith(prefix), F.concat(F.lit(folder + "/"), F.substring(source, len(prefix) + 1, 10_000)))
    wanted = of(facts, "import").withColumn("base", collapse(base)).where("base is not null")
    found = resolve_candidates(wanted.select(F.col("path").alias("src"), "base").distinct(), listing, SUFFIXES)
    known = found.join(entities.select("path"), "path", "left_semi")
    rows = wanted.select(F.col("path").alias("src"), "base", "ordinal", "args").join(known, ["src", "base"])
    return _first(_edges(rows, "src", "path", "imports", "ordinal", importedNames=F.col("args")))


def folders(files: DataFrame) -> DataFrame:
    """(path) of the files and of every folder above them."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select("path").unionByName(files.select(F.explode(above).alias("path"))).distinct()


def _inner_parts(path: Column) -> Column:
    """The lower-case names of the folders that stand between two slashes of a path."""
    parts = F.split(F.lower(path), "/")
    return F.array_distinct(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))


def _by_key(matches: DataFrame, keys: DataFrame) -> DataFrame:
    return matches.join(keys, "__key").drop("__key")


def _meant(kind: str, matches: DataFrame, targets: DataFrame) -> DataFrame | None:
    """``matches`` with the ``e_path`` of each of ``targets`` (e_path, e_name) that a match of the detector means, perhaps repeated.

    Equal names and folders are met by their keys. Containment of names has no key, so each name that is called meets each
    name of an entity once, whatever the number of calls and entities that have it.
    """
    base = F.lower(base_name(F.col("e_path")))
    if kind == "call_expression":
        heard = matches.withColumns({"__callee": normal_name(F.col("name")), "__core": F.lower(F.regexp_replace(F.regexp_replace("name", "^use", ""), "(?i)Store$", ""))})
        known = targets.select("e_path", normal_name(F.coalesce("e_name", F.lit(""))).alias("__own"), base.alias("__base"))
        callee, core, own, stem = (F.col(f"__{c}") for c in ("callee", "core", "own", "base"))
        by_name = ((F.length(own) > 1) & callee.contains(own)) | ((F.length(callee) > 1) & own.contains(callee))
        by_core = (F.length(core) > 2) & (stem.contains(core) | core.contains(stem))
        pairs = heard.select("__callee", "__core").distinct().join(small_side(known.select("__own", "__base").distinct()), by_name | by_core)
        met = heard.join(pairs, ["__callee", "__core"]).join(known, ["__own", "__base"]).select(*matches.columns, "e_path")
        helpers = matches.where(F.col("name").isin(list(MAP_HELPERS))).withColumn("__key", F.explode(vuex_modules(F.col("args"))))
        return met.unionByName(_by_key(helpers, targets.select("e_path", F.explode(F.array_distinct(F.concat(F.array(base), _inner_parts(F.col("e_path"))))).alias("__key"))))
    if kind in ("import_expression", "import_statement"):
        named = matches.withColumn("__key", F.lower(base_name(F.col("name")))).where((F.length("name") > 2) & (F.length("__key") > 1))
        met = _by_key(named, targets.select("e_path", base.alias("__key")))
        if kind == "import_expression":
            met = met.unionByName(_by_key(named.where(F.length("__key") > 2), targets.select("e_path", F.explode(_inner_parts(F.col("e_path"))).alias("__key"))))
        return met
    if kind == "member_expression":  # any use means every store, so that of a file's first match says it all
        return first_of(matches, ["path"], ["ordinal"]).join(targets.select("e_path"))
    return None


def vuex_modules(args: Column) -> Column:
    """Module names in the arguments of a map helper: ``'a/b'`` and ``'a'`` give a, ``{k: 'm/x'}`` gives m."""
    text = F.array_join(F.coalesce(args, F.array().cast("array<string>")), ",")
    plain = F.transform(F.filter(F.coalesce(args, F.array().cast("array<string>")), lambda a: a.rlike("^['\"]")), lambda a: F.split(F.regexp_replace(a, "['\"]", ""), "/")[0])
    return F.transform(F.concat(plain, F.regexp_extract_all(text, F.lit(r":\s*['\"]([^'\"/]+)/"), F.lit(1))), lambda x: F.lower(x))


def configured(facts: DataFrame, entities: DataFrame, config: Config) -> DataFrame | None:
    """Relations that the configuration defines: matches of its detectors against the entities of the target type.

    Of several matches of one pair, the first detector's first match counts. Both tables are read a few times a relation, so
    they should be cut off or cheap.
    """
    found = None
    for name, r in config.relationships.items():
        if name == "imports":
            continue
        targets = entities.where(F.col("entity_type") == r.target).select(F.col("path").alias("e_path"), F.col("name").alias("e_name"))
        own = facts.where(F.col("entity_type") == r.source)
        for place, (kind, pattern) in enumerate(r.detect_by):
            matches = detect(own, kind, pattern)
            if matches is None or (kind == "member_expression" and "store" not in r.target.lower()):
                continue
            met = _meant(kind, matches, targets)
            if met is None:
                continue
            met = met.where("path <> e_path").withColumn("place", F.struct(F.lit(place).alias("detector"), "ordinal"))
            part = _edges(met, "path", "e_path", name, "place", line=F.col("line"), evidence=F.col("full"))
            found = part if found is None else found.unionByName(part)
    return None if found is None else _first(found)


def uses_api(facts: DataFrame, apis: DataFrame, passes: int) -> DataFrame:
    """One relation a call of an API and pass, not deduplicated."""
    calls = of(facts, "call").where("full = name").select("path", "name", "line").join(small_side(apis), "name")
    every = calls.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    return _edges(every, "path", "name", "USES_API", line=F.col("line"), framework=F.col("framework"))


def calls(facts: DataFrame, functions: DataFrame) -> DataFrame:
    """CALLS between functions: each call inside the first function of its name in the file, resolved by the bare name.

    (src, dst, rel_type, confidence, call_site); a name may mean several functions.
    """
    made = of(facts, "call").where(~F.col("name").isin(BUILTINS)).select("path", F.col("name").alias("callee"), "start", "end")
    own = of(facts, "function").select("path", F.col("name").alias("caller"), F.col("start").alias("low"), F.col("end").alias("high"), F.col("line"))
    first = first_of(own, ["path", "caller"], ["low"])
    inside = made.join(first, "path").where("start >= low and end <= high and caller <> callee").select("path", "caller", "callee", "line").distinct()
    target = functions.select(F.col("id").alias("dst"), F.col("name").alias("callee"), F.col("file_path").alias("dst_path"))
    source = functions.select(F.col("id").alias("src"), F.col("name").alias("caller"), F.col("file_path").alias("path"), F.col("start_line").alias("line"))
    met = inside.join(source, ["path", "caller", "line"]).join(target, "callee").where("src <> dst")
    sure = F.when(F.col("path") == F.col("dst_path"), SAME_FILE).otherwise(OTHER_FILE)
    return met.select("src", "dst", F.lit("CALLS").alias("rel_type"), sure.alias("confidence"), F.concat("caller", F.lit("→"), "callee").alias("call_site")).distinct()


def mixins(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """The first mixin entity whose name equals, holds or is held by the name that a component lists."""
    named = of(facts, "mixin").select("path", "ordinal", normal_name(F.col("name")).alias("m"), "name").where("m <> ''")
    targets = small_side(entities.where("entity_type = 'mixin'").select(F.col("path").alias("e_path"), F.col("ordinal").alias("e_ordinal"), normal_name(base_name(F.col("path"))).alias("e")))
    met = named.join(targets, F.col("m").contains(F.col("e")) | F.col("e").contains(F.col("m")))
    chosen = first_of(met.select("path", "ordinal", "name", "e_path", "e_ordinal"), ["path", "ordinal"], ["e_ordinal"])
    return _first(_edges(chosen, "path", "e_path", "uses_mixin", "ordinal", mixin=F.col("name")))


def components(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """The first other component, page or layout whose own name or file name a template tag stands for."""
    tags = of(facts, "tag").select("path", F.col("name").alias("tag"), "line", "ordinal", normal_name(F.col("name")).alias("key")).where("key <> ''")
    shown = entities.where(F.col("entity_type").isin("component", "page", "layout"))
    names = shown.select(F.col("path").alias("e_path"), F.col("ordinal").alias("e_ordinal"), F.explode(F.array_distinct(F.array(normal_name(F.coalesce("name", F.lit(""))), normal_name(base_name(F.col("path")))))).alias("key"))
    met = tags.join(names.where("key <> ''"), "key").where("path <> e_path")
    chosen = first_of(met, ["path", "tag"], ["e_ordinal"])
    return _first(_edges(chosen, "path", "e_path", "uses_component", "ordinal", tag=F.col("tag"), line=F.col("line")))


def store_item_uses(facts: DataFrame, items: DataFrame) -> DataFrame:
    """The store item of each use: by name and type, an exact store before a similar one before the only candidate."""
    used = of(facts, "usage").select("path", "ordinal", normal_name(F.col("name")).alias("k"), F.col("full").alias("type"), normal_name(F.coalesce("object", F.lit(""))).alias("store"), "line", F.col("name").alias("item"))
    known = items.select(F.col("id").alias("dst"), normal_name(F.col("name")).alias("k"), "item_type", normal_name(base_name(F.col("store_path"))).alias("of"))
    met = used.join(known, "k").where("type is null or type = item_type")
    alone = met.groupBy("path", "ordinal").agg(F.count("*").alias("n"))
    met = met.join(alone, ["path", "ordinal"])
    similar = (F.col("store") != "") & (F.col("store").contains(F.col("of")) | F.col("of").contains(F.col("store")))
    met = met.withColumn("kind", F.when(F.col("store") == F.col("of"), 0).when(similar, 1).when(F.col("n") == 1, 2)).where("kind is not null")
    chosen = first_of(met.select("path", "ordinal", "dst", "kind", "item", "line"), ["path", "ordinal"], ["kind", "dst"])
    return _first(_edges(chosen, "path", "dst", "uses_store_item", "ordinal", itemName=F.col("item"), line=F.col("line")))


def ipc(facts: DataFrame) -> DataFrame:
    """calls_ipc from callers to the files that handle a channel, exposes_ipc from preload scripts; one a pair of files."""
    found = of(facts, "ipc").withColumn("key", normal_channel(F.col("name"))).where("key <> ''")
    handled = found.where(F.col("full").isin("handle", "on")).select(F.col("path").alias("h_path"), "key").distinct()
    parts = []
    for relation, kinds in (("calls_ipc", ("invoke", "send", "bridge")), ("exposes_ipc", ("exposed",))):
        met = found.where(F.col("full").isin(*kinds)).join(handled, "key").where("path <> h_path")
        parts.append(_first(_edges(met, "path", "h_path", relation, "ordinal", channel=F.col("name"), line=F.col("line"))))
    return parts[0].unionByName(parts[1])
