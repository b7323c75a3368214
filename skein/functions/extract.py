"""The facts of one source file, as rows of one layout. Pure Python, run inside executors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from skein.functions.scanner import Call, Facts, Function, Source, unquote

#: Template tags of the framework itself, and the calls that mark each API style (fixed values).
FRAMEWORK_TAGS = frozenset(
    [
        "component", "keep-alive", "router-link", "router-view", "slot", "suspense", "teleport", "transition",
        "transition-group",
    ]
)
COMPOSITION_CALLS = frozenset(["ref", "computed", "watch", "onMounted", "reactive"])
MACROS = frozenset(["defineProps", "defineEmits", "defineExpose", "defineOptions", "defineSlots", "defineModel", "withDefaults"])
MAP_HELPERS = {"mapState": "state", "mapGetters": "getter", "mapActions": "action", "mapMutations": "mutation"}
STORE_PARTS = {"state": "state", "getters": "getter", "mutations": "mutation", "actions": "action"}
#: Characters of a function's text that are kept, and the patterns of tags and annotations (fixed values).
CONTENT = 300
TAG = re.compile(r"<(/?)\s*(template|script|style)\b([^>]*)>", re.I)
TEMPLATE_TAG = re.compile(r"<\s*([A-Za-z][A-Za-z0-9_.:-]*)\b")
ANNOTATION = re.compile(r"@(\w+(?:-\w+)*)\s*:?\s*(\S[^\n]*?(?=\s*@|\s*\*/|\s*\n\s*\*/|\n\s*$|$))", re.M | re.A)
LANG = re.compile(r"\blang\s*=\s*[\"']?(\w+)")
LAZY = re.compile(r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")


class Fact(NamedTuple):
    """Columns of the fact table; what each means for a kind of fact is said where it is made."""

    fact: str
    name: str = ""
    full: str | None = None
    object: str | None = None
    args: list[str] | None = None
    flag: bool | None = None
    line: int | None = None
    end_line: int | None = None
    start: int | None = None
    end: int | None = None
    text: str | None = None


class Block(NamedTuple):
    kind: str  # template, script or style
    attributes: str
    text: str
    start: int
    inner: int  # offset of the content behind the opening tag


def blocks(content: str) -> list[Block]:
    """The blocks of a single-file component in the order in which they close; a closing tag ends the nearest of its kind."""
    out, open_ = [], []
    for m in TAG.finditer(content):
        kind = m[2].lower()
        if not m[1]:
            if not m[3].rstrip().endswith("/"):
                open_.append((kind, m))
            continue
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == kind:
                opening = open_[k][1]
                del open_[k:]
                if not open_ or kind != "template":
                    out.append(Block(kind, opening[3], content[opening.start() : m.end()], opening.start(), opening.end()))
                break
    return out


def main_script(found: list[Block]) -> Block | None:
    """The first script with ``setup``, else the first script."""
    scripts = [b for b in found if b.kind == "script"]
    return next((b for b in scripts if "setup" in b.attributes), scripts[0] if scripts else None)


def language(path: str, attributes: str) -> str:
    """``ts`` by the script's own attribute or the file's ending, else ``js``."""
    own = LANG.search(attributes)
    return "ts" if own and own[1] in ("ts", "tsx") or path.lower().endswith((".ts", ".tsx")) else "js"


def inner(block: Block) -> str:
    """A block's text between its tags."""
    first, last = block.text.find(">"), block.text.rfind("</")
    return block.text[first + 1 : last] if last > first >= 0 else ""


def extract(path: str, content: str, entity_type: str) -> Iterator[Fact]:
    """Every fact of a file, and at the end the entity's properties. Lines are those of the script; ``script`` says where that begins and its language."""
    found = list(_extract(path, content, entity_type))
    yield from found
    yield Fact("properties", text=json.dumps(properties(found, entity_type), ensure_ascii=False))


def properties(found: list[Fact], entity_type: str) -> dict:
    """What an entity tells about itself; keys with an underscore are not shown."""
    of: dict[str, list[Fact]] = {}
    for f in found:
        of.setdefault(f.fact, []).append(f)
    get = lambda kind: of.get(kind, [])
    out = {f.name: json.loads(f.full) for f in get("property")}
    out |= {f"@{f.name}": f.full for f in get("annotation")}
    out["_imports"] = [{"source": f.name, "imports": f.args, "isDefault": f.flag} for f in get("import")]
    lists = {
        "mixinNames": [f.name for f in get("mixin")],
        "composableCalls": [f.name for f in get("call") if re.match("use[A-Z]", f.name)],
        "storeCalls": [f.full for f in get("call") if f.full.startswith("use")],
        "templateComponents": [{"tag": f.name, "line": f.line} for f in get("tag")],
        "storeItemUsages": [{"itemName": f.name, "itemType": f.full, "storeName": f.object, "line": f.line, "evidence": f.text, "confidence": "high" if f.flag else "medium"} for f in get("usage")],
        "mapHelperCalls": [{"helper": f.name, "args": f.args} for f in get("map_helper")],
        "ipcHandlers": [{"channel": f.name, "type": f.full, "line": f.line} for f in get("ipc") if f.full in ("handle", "on")],
        "ipcCalls": [{"channel": f.name, "callee": f.object, "type": f.full, "line": f.line} for f in get("ipc") if f.full in ("invoke", "send", "bridge")],
        "routes": [json.loads(f.text) for f in get("route")],
    }
    out |= {k: v for k, v in lists.items() if v}
    if exposed := [f for f in get("ipc") if f.full == "exposed"]:
        out["preloadBridge"] = {"namespace": exposed[0].object, "methods": [f.name for f in exposed], "line": exposed[0].line}
    if entity_type == "store":
        for kind, names in (("state", "stateKeys"), ("getter", "getterNames"), ("mutation", "mutationNames"), ("action", "actionNames")):
            out[names] = [f.name for f in get("store_item") if f.full == kind]
            out[f"has{names.removesuffix('Keys').removesuffix('Names').capitalize()}"] = bool(out[names])
    if routes := lists["routes"]:
        out |= {"routeCount": len(routes), "hasNestedRoutes": any(r["depth"] for r in routes), "hasRouteMeta": any(r.get("meta") for r in routes), "hasRouteGuards": any(r.get("guards") for r in routes), "hasRedirects": any(r.get("redirect") for r in routes), "hasAliases": any(r.get("alias") for r in routes)}
    if any(f.name == "createRouter" for f in get("call")) or any(f.name == "VueRouter" for f in get("new")):
        out["isRouter"] = True
    return out


def _extract(path: str, content: str, entity_type: str) -> Iterator[Fact]:
    component = path.endswith(".vue")
    found = blocks(content) if component else []
    script = main_script(found) if component else None
    code = inner(script) if script else "" if component else content
    offset = content.count("\n", 0, script.inner) if script else 0
    source = Source(code)
    facts = source.facts()
    yield Fact("script", language(path, script.attributes if script else ""), line=offset)
    if template := next((b for b in found if b.kind == "template"), None):
        yield Fact("template", text=template.text)
    for x in facts.imports:
        yield Fact("import", x.source, args=x.names, flag=x.is_default, line=x.line)
    for kind, calls in (("call", facts.calls), ("new", facts.news)):
        for c in calls:
            yield Fact(kind, c.callee, c.full, args=c.args, line=c.line, start=c.start, end=c.end)
    for owner, name, full, line in facts.members:
        yield Fact("member", name, full, owner, line=line)
    for name, template, line in facts.dynamic:
        yield Fact("dynamic_import", name, flag=template, line=line)
    yield from functions(facts, entity_type, offset)
    yield from annotations(content)
    yield from prose(source, facts, content, component)
    yield from template_tags(content, found)
    yield from usages(source, facts)
    if entity_type == "store":
        yield from store_items(source, facts)
    if entity_type == "route" or any(c.callee == "createRouter" for c in facts.calls):
        yield from routes(source)
    yield from channels(source, facts)


def functions(facts: Facts, entity_type: str, offset: int) -> Iterator[Fact]:
    seen = set()
    for f in sorted(facts.functions, key=lambda f: f.start):
        if f.name.startswith("_") or (f.name, f.line) in seen:
            continue
        seen.add((f.name, f.line))
        text = f.text if len(f.text) <= CONTENT else f.text[:CONTENT] + "..."
        yield Fact("function", f.name, function_kind(f, entity_type), line=f.line, end_line=f.end_line, start=f.start, end=f.end, text=text)


def function_kind(f: Function, entity_type: str) -> str:
    if f.form in ("method", "computed"):
        return "method"
    if re.match("use[A-Z]", f.name):
        return "composable_function"
    return "store_action" if entity_type == "store" else "function"


def annotations(content: str) -> Iterator[Fact]:
    """name: tag, full: its first value."""
    seen: dict[str, str] = {}
    for m in ANNOTATION.finditer(content):
        seen.setdefault(m[1], m[2].strip())
    for tag, value in seen.items():
        yield Fact("annotation", tag, value)


def prose(source: Source, facts: Facts, content: str, component: bool) -> Iterator[Fact]:
    """Properties of an entity. name: property, full: its value as JSON."""
    names = [c.callee for c in facts.calls]
    composition, options = bool(COMPOSITION_CALLS & set(names)), "export default" in content or source.default_export() >= 0
    yield Fact("property", "apiMode", json.dumps("mixed" if composition and options else "composition" if composition else "options" if options else "unknown"))
    exported = source.default_export()
    yield Fact("property", "hasDefaultExport", json.dumps(exported >= 0))
    if exported >= 0:
        for e in source.entries(exported):
            if e.key == "name" and e.form == "pair" and source.kind(e.first) == "string":
                yield Fact("property", "name", json.dumps(unquote(source.tokens[e.first].text)))
                break
        for e in source.entries(exported):
            if e.form != "spread":
                yield Fact("export_key", e.key, e.form, line=source.line(source.tokens[e.first].start), text=source.between(e.first, e.last)[:CONTENT])
    for k, t in enumerate(source.tokens):
        if t.text == "mixins" and source.is_(k + 1, ":") and source.is_(k + 2, "["):
            for a, b in source.parts(k + 2):
                if a == b and source.kind(a) == "name":
                    yield Fact("mixin", source.tokens[a].text)
    variant = "pinia" if "defineStore" in names else "vuex" if any("Store" in c.callee for c in facts.news) else None
    if variant:
        yield Fact("property", "storeVariant", json.dumps(variant))
    for macro in facts.calls:
        if macro.callee in MACROS and macro.full == macro.callee:
            yield Fact("macro", macro.callee, args=macro.args, line=macro.line)


def template_tags(content: str, found: list[Block]) -> Iterator[Fact]:
    """name: tag of a component in the template; line: of the file, where it stands first."""
    seen: dict[str, int] = {}
    for b in found:
        if b.kind == "template":
            for m in TEMPLATE_TAG.finditer(b.text):
                tag = m[1].rpartition(":")[2]
                if tag.lower() not in FRAMEWORK_TAGS and (tag[:1].isupper() or "-" in tag):
                    seen.setdefault(tag, content.count("\n", 0, b.start + m.start()) + 1)
    for tag, line in seen.items():
        yield Fact("tag", tag, line=line)


def usages(source: Source, facts: Facts) -> Iterator[Fact]:
    """Uses of store items. name: item, full: its type if known, object: the store's name if known, text: the evidence."""
    aliases = {}
    for name, first, last in facts.variables:
        if m := re.fullmatch(r"use(.+)Store", source.tokens[first].text):
            if source.is_(source.after_generics(first + 1), "("):
                aliases[name] = m[1]
    seen = set()

    def once(fact: Fact) -> Iterator[Fact]:
        key = (fact.object, fact.name, fact.line, fact.text)
        if key not in seen:
            seen.add(key)
            yield fact

    for owner, name, full, line in facts.members:
        if owner in aliases:
            yield from once(Fact("usage", name, None, aliases[owner], [owner], True, line, text=full))
    for c in facts.calls:
        if c.callee in MAP_HELPERS and c.full == c.callee:
            yield Fact("map_helper", c.callee, args=c.args, line=c.line)
            module = next((unquote(a) for a in c.args if a[:1] in "'\""), None)
            inside = Source(", ".join(c.args))
            evidence = f"{c.callee}({', '.join(c.args)})"
            for k, t in enumerate(inside.tokens):
                if inside.inside[k] >= 0 or t.text not in ("[", "{"):
                    continue
                if t.text == "[":
                    found = [(unquote(inside.tokens[a].text), module) for a, b in inside.parts(k) if a == b and inside.kind(a) == "string"]
                else:
                    raw = [unquote(inside.between(e.first, e.last)) for e in inside.entries(k) if e.form == "pair"]
                    found = [(r.rpartition("/")[2], r.split("/")[0] if "/" in r else module) for r in raw]
                for item, store in found:
                    yield from once(Fact("usage", item, MAP_HELPERS[c.callee], store, [], store is not None, c.line, text=evidence))


def store_items(source: Source, facts: Facts) -> Iterator[Fact]:
    """name: item, full: state, getter, mutation or action."""
    parts: dict[str, list[str]] = {kind: [] for kind in STORE_PARTS.values()}

    def keys(opening: int) -> None:
        """The keys of the objects that stand for the parts of a store."""
        for e in source.entries(opening):
            if e.key in STORE_PARTS and e.form == "pair" and source.is_(e.first, "{"):
                parts[STORE_PARTS[e.key]] += [x.key for x in source.entries(e.first) if x.form != "spread"]

    for k, t in enumerate(source.tokens):
        if t.text != "defineStore" or t.kind != "name" or not source.is_(opening := source.after_generics(k + 1), "("):
            continue
        for first, last in source.parts(opening):
            if source.is_(first, "{"):
                keys(first)
            elif (end := source.function_at(first)) > 0:
                body = next((b for b in range(first, end) if source.is_(b, "{") and source.close(b) == end), -1)
                for r in range(body + 1, end) if body >= 0 else ():
                    if source.is_(r, "return") and source.is_(r + 1, "{"):
                        _returned(source, facts, r + 1, source.tokens[body].start, source.tokens[end].end, parts)
    for name, first, _ in facts.variables:
        if name in STORE_PARTS and source.is_(first, "{"):
            parts[STORE_PARTS[name]] += [e.key for e in source.entries(first) if e.form != "spread"]
    if not parts["state"] and not parts["getter"]:
        for opening in source.objects():
            keys(opening)
    for kind, names in parts.items():
        for name in dict.fromkeys(names):
            yield Fact("store_item", name, kind)


def _returned(source: Source, facts: Facts, opening: int, low: int, high: int, parts: dict[str, list[str]]) -> None:
    """Sort what a setup store returns: by the declarations around it, else by the value."""
    declared = [source.between(a - 2 if source.is_(a - 1, "=") else a, b) for _, a, b in facts.variables if low <= source.tokens[a].start < high]
    named = {f.name for f in facts.functions if f.form == "declaration" and low <= f.start < high}
    for e in source.entries(opening):
        if e.form not in ("pair", "shorthand"):
            continue
        value = source.between(e.first, e.last) if e.form == "pair" else ""
        about = [d for d in declared if e.key in d]
        if any("ref(" in d or "reactive(" in d for d in about):
            kind = "state"
        elif any("computed(" in d for d in about):
            kind = "getter"
        elif e.key in named:
            kind = "action"
        elif value.startswith(("ref(", "reactive(")):
            kind = "state"
        elif value.startswith("computed("):
            kind = "getter"
        elif value and (source.kind(e.first) == "name" or source.function_at(e.first) > 0):
            kind = "action"
        else:
            continue
        parts[kind].append(e.key)


def routes(source: Source) -> Iterator[Fact]:
    """name: the route's name, full: its full path, line: its depth, text: the entry as JSON, in pre-order."""
    best: list[dict] = []
    for k, t in enumerate(source.tokens):
        if t.text == "[" and t.kind == "punctuation" and k in source.pair:
            entries = [x for a, _ in source.parts(k) if source.is_(a, "{") and (x := _route(source, a, "", 0))]
            if len(entries) > len(best):
                best = entries

    def flat(entries: list[dict]) -> Iterator[dict]:
        for e in entries:
            yield {k: v for k, v in e.items() if k != "children"}
            yield from flat(e.get("children", []))

    for e in flat(best):
        yield Fact("route", e.get("name") or "", e.get("fullPath"), line=e["depth"], text=json.dumps(e, ensure_ascii=False))


def full_path(parent: str, path: str) -> str:
    return path if path.startswith("/") else f"{parent.removesuffix('/')}/{path}"


def _strings(source: Source, k: int) -> list[str]:
    if source.kind(k) == "string":
        return [unquote(source.tokens[k].text)] if len(source.tokens[k].text) > 2 else []
    return [unquote(source.tokens[a].text) for a, _ in source.parts(k) if source.kind(a) == "string"] if source.is_(k, "[") else []


def _route(source: Source, opening: int, parent: str, depth: int) -> dict | None:
    entry: dict = {"depth": depth}
    pairs = {e.key: e for e in source.entries(opening) if e.form == "pair"}
    text = {k: source.between(e.first, e.last) for k, e in pairs.items()}
    string = lambda k: unquote(text[k]) if k in pairs and source.kind(pairs[k].first) == "string" and pairs[k].first == pairs[k].last else None
    if "path" in pairs:
        entry["path"] = string("path")
        if entry["path"] is not None:
            entry["fullPath"] = full_path(parent, entry["path"])
    if "name" in pairs:
        entry["name"] = string("name")
    if "component" in pairs:
        lazy = LAZY.search(text["component"])
        entry |= {"component": text["component"], "componentPath": lazy[1] if lazy else None, "lazy": bool(lazy)}
    if "redirect" in pairs:
        entry["redirect"] = string("redirect") or text["redirect"]
    if "alias" in pairs:
        entry["alias"] = _strings(source, pairs["alias"].first)
    if "meta" in pairs and source.is_(pairs["meta"].first, "{"):
        entry["meta"] = {e.key: unquote(source.between(e.first, e.last)) for e in source.entries(pairs["meta"].first) if e.form == "pair"}
    if "beforeEnter" in pairs:
        entry["guards"] = [text["beforeEnter"]]
    if "children" in pairs and source.is_(pairs["children"].first, "["):
        below = entry.get("fullPath") or entry.get("path") or parent
        found = [x for a, _ in source.parts(pairs["children"].first) if source.is_(a, "{") and (x := _route(source, a, below, depth + 1))]
        if found:
            entry["children"] = found
    return entry if len(entry) > 1 else None


def channels(source: Source, facts: Facts) -> Iterator[Fact]:
    """name: channel or method, full: handle, on, invoke, send, bridge or exposed, object: the caller's text or namespace."""

    def channel(c: Call) -> str | None:
        return unquote(c.args[0]) if c.args and c.args[0][:1] in "'\"" else None

    exposed = False
    for c in facts.calls:
        parts = c.full.split(".")
        if c.full in ("ipcMain.handle", "ipcMain.on", "ipcRenderer.invoke", "ipcRenderer.send"):
            if name := channel(c):
                yield Fact("ipc", name, parts[1], c.full, line=c.line)
        elif len(parts) == 3 and parts[0] == "window" and parts[1] in ("api", "electronAPI"):
            yield Fact("ipc", parts[2], "bridge", c.full, line=c.line)
        elif c.callee == "exposeInMainWorld" and not exposed and len(c.args) > 1:
            exposed = True
            inside = Source(c.args[1])
            for e in inside.entries(0) if inside.is_(0, "{") else ():
                if e.form in ("pair", "method", "shorthand"):
                    yield Fact("ipc", e.key, "exposed", unquote(c.args[0]), line=c.line)
