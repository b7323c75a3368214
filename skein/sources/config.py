"""A project's configuration: YAML to plain objects, and what the built-in plugin adds to it."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

import yaml

#: What the built-in plugin for single-file components contributes (fixed values).
PLUGIN_ENTITIES = {
    "component": ["**/*.vue"],
    "composable": ["composables/**/*.ts", "composables/**/*.js"],
    "store": ["stores/**/*.ts", "stores/**/*.js", "store/**/*.ts", "store/**/*.js", "vuex/**/*.ts", "vuex/**/*.js"],
    "route": ["router/**/*.ts", "router/**/*.js", "routes/**/*.ts", "routes/**/*.js"],
    "plugin": ["plugins/**/*.ts", "plugins/**/*.js"],
    "layout": ["layouts/**/*.vue"],
    "page": ["pages/**/*.vue", "views/**/*.vue"],
    "mixin": ["mixins/**/*.ts", "mixins/**/*.js", "mixins/**/*.vue"],
    "electron-main": ["electron/main.ts", "electron/main.js", "electron/index.ts", "electron/index.js", "src/main/**/*.ts", "src/main/**/*.js"],
    "preload": ["electron/preload/**/*.ts", "electron/preload/**/*.js", "electron/preload.ts", "electron/preload.js", "src/preload/**/*.ts", "src/preload/**/*.js"],
}
PLUGIN_MARKERS = {"component": [{"uses_options_api": False}, {"naming_pattern": "*.vue"}]}
PLUGIN_APIS = {
    "vue": [
        "ref", "reactive", "computed", "watch", "watchEffect", "onMounted", "onUnmounted", "onBeforeMount",
        "onBeforeUnmount", "onUpdated", "onBeforeUpdate", "onActivated", "onDeactivated", "provide", "inject",
        "defineComponent", "defineAsyncComponent", "nextTick", "shallowRef", "shallowReactive", "toRef", "toRefs",
        "isRef", "unref", "triggerRef", "customRef", "markRaw", "toRaw", "readonly", "shallowReadonly",
        "useCssModule", "useCssVars", "useSlots", "useAttrs",
    ],
    "vue-router": [
        "createRouter", "createWebHistory", "createWebHashHistory", "createMemoryHistory", "useRouter", "useRoute",
        "onBeforeRouteUpdate", "onBeforeRouteLeave",
    ],
    "pinia": [
        "defineStore", "createPinia", "useStore", "storeToRefs", "setActivePinia", "getActivePinia",
        "setMapStoreSuffix",
    ],
}
#: Relations of the plugin: from, to, and what detects them. The second list is what its patterns mean, the first is the text
#: as it stands, whose patterns mostly never match.
PLUGIN_RELATIONS = {
    "uses_store": ("component", "store", [("member_expression", r"\$store"), ("call_expression", r"/^use[A-Z]\w+Store$/")], [("member_expression", "$store"), ("call_expression", "use*Store")]),
    "route_to_component": ("route", "component", [("import_statement", r"\.vue$")], [("import_statement", "*.vue")]),
    "uses_component": ("component", "component", [], []),
    "defines_composable": ("composable", "composable", [("export_default", ""), ("export_statement", r"use[A-Z]\w+")], []),
    "uses_mixin": ("component", "mixin", [], []),
    "ipc_channel": ("electron-main", "electron-main", [("call_expression", "ipcMain.handle"), ("call_expression", "ipcMain.on")], []),
    "exposes_ipc": ("preload", "preload", [("call_expression", "contextBridge.exposeInMainWorld")], []),
    "calls_ipc": ("component", "electron-main", [("call_expression", "ipcRenderer.invoke"), ("call_expression", "ipcRenderer.send"), ("member_expression", "window.*")], []),
}


class ConfigError(ValueError):
    """The configuration is missing or incomplete."""


@dataclass
class Relationship:
    source: str
    target: str
    detect_by: list[tuple[str, str]] = field(default_factory=list)
    description: str = ""


@dataclass
class Config:
    name: str
    source_root: str
    entities: dict[str, list[str]]
    apis: dict[str, list[str]]
    relationships: dict[str, Relationship]
    markers: dict[str, list[dict]] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)


def source_root(root: str, base: str) -> str:
    """An absolute path, of either system, as it is; another below the configuration's folder."""
    absolute = root.startswith("/") or (len(root) > 2 and root[1] == ":" and root[2] in "\\/") or "://" in root
    return root if absolute else os.path.normpath(os.path.join(base, root))


def load(path: str) -> Config:
    """Read a configuration file; custom entities follow and replace the entities of the same name."""
    if not os.path.exists(path):
        raise ConfigError(f"no configuration at {path}")
    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f) or {}, os.path.dirname(os.path.abspath(path)))


def parse(raw: dict, base: str = ".") -> Config:
    project = raw.get("project") or {}
    if not project.get("name") or not project.get("source_root"):
        raise ConfigError("project.name and project.source_root are needed")
    defined = {**(raw.get("entities") or {}), **(raw.get("custom_entities") or {})}
    relations = {
        name: Relationship(r.get("from", ""), r.get("to", ""), [(d["type"], d.get("pattern") or "") for d in r.get("detect_by") or []], r.get("description") or "")
        for name, r in (raw.get("relationships") or {}).items()
    }
    return Config(
        project["name"],
        source_root(project["source_root"], base),
        {name: list(e.get("patterns") or []) for name, e in defined.items()},
        {a["name"]: list(a.get("api_list") or []) for a in raw.get("framework_apis") or []},
        relations,
        {name: list(e.get("markers") or []) for name, e in defined.items()},
        {name: e.get("description") or "" for name, e in defined.items()},
    )


def with_plugin(config: Config, compat: bool = True) -> Config:
    """``config`` with the plugin's entities and APIs united and its relations merged in.

    With ``compat`` the plugin's relations replace those of the same name, patterns and all; otherwise the configuration's
    stay, and the plugin's are added with patterns that can match.
    """
    entities = {name: list(dict.fromkeys([*config.entities.get(name, []), *PLUGIN_ENTITIES.get(name, [])])) for name in {**config.entities, **PLUGIN_ENTITIES}}
    apis = {name: list(dict.fromkeys([*config.apis.get(name, []), *PLUGIN_APIS.get(name, [])])) for name in {**config.apis, **PLUGIN_APIS}}
    added = {name: Relationship(a, b, literal if compat else meant) for name, (a, b, literal, meant) in PLUGIN_RELATIONS.items()}
    relations = {**config.relationships, **added} if compat else {**added, **config.relationships}
    markers = {name: [*config.markers.get(name, []), *PLUGIN_MARKERS.get(name, [])] for name in entities}
    return Config(config.name, config.source_root, entities, apis, relations, markers, config.descriptions)


#: Folders and packages that tell of a part of a project (fixed values).
FOLDERS = {
    "composable": ["composables"],
    "layout": ["layouts"],
    "mixin": ["mixins"],
    "page": ["pages", "views"],
    "plugin": ["plugins"],
    "route": ["router"],
    "store": ["store", "stores"],
    "electron-main": ["electron"],
}
PACKAGES = {"route": ["vue-router"], "store": ["pinia", "vuex"], "electron-main": ["electron", "electron-builder", "electron-vite"]}
#: Questions of an interactive start by the entity type they are about.
QUESTIONS = {
    "route": "Track routes and the components they lead to",
    "composable": "Track composables",
    "page": "Track pages and views",
    "layout": "Track layouts",
    "plugin": "Track application plugins",
    "mixin": "Track mixins",
    "electron-main": "Track main process, preload scripts and channels",
}


@dataclass
class Probe:
    """What a folder looks like, and the answers of an interactive start."""

    name: str
    source_root: str
    language: str
    stores: str  # pinia, vuex, both or none
    parts: set[str]
    store_folder: str = "store"


def probe(folder: str, depth: int = 4) -> Probe:
    """A project's name, source root, commonest script language, kinds of stores and parts, by its folders and packages."""
    top = Path(folder).resolve()
    package = top / "package.json"
    try:
        read = json.loads(package.read_text(encoding="utf-8")) if package.exists() else {}
    except ValueError:
        read = {}
    needs = {**(read.get("dependencies") or {}), **(read.get("devDependencies") or {})}
    root = "src" if (top / "src").is_dir() and not (top / "electron").is_dir() else "."
    votes = {"ts": 0, "js": 0}
    for path in (top / root).rglob("*"):
        parts = path.relative_to(top / root).parts
        if len(parts) <= depth and "node_modules" not in parts and path.is_file():
            votes["ts"] += path.suffix in (".ts", ".vue")
            votes["js"] += path.suffix == ".js"
    places = [top / root, top / "src", top]
    there = lambda name: any((p / name).is_dir() for p in places[: 3 if name == "electron" else 2])
    found = {kind for kind, names in FOLDERS.items() if any(map(there, names)) or any(n in needs for n in PACKAGES.get(kind, []))}
    known = [n for n in ("pinia", "vuex") if n in needs]
    stores = "both" if len(known) == 2 else known[0] if known else "pinia" if "store" in found else "none"
    return Probe(read.get("name") or top.name or "my-project", root, "js" if votes["js"] > votes["ts"] else "ts", stores, found - {"store"}, "stores" if there("stores") else "store")


def ask(seen: Probe, answer=input) -> Probe:
    """``seen`` with a user's answers; an empty one accepts what is suggested."""

    def text(question: str, suggested: str) -> str:
        return answer(f"{question} [{suggested}] ").strip() or suggested

    def choice(question: str, values: list[str], suggested: str) -> str:
        while (got := text(f"{question} ({'/'.join(values)})", suggested)) not in values:
            pass
        return got

    name, root = text("Project name", seen.name), text("Source root", seen.source_root)
    language, stores = choice("Script language", ["ts", "js"], seen.language), choice("Stores", ["pinia", "vuex", "both", "none"], seen.stores)
    parts = {kind for kind, question in QUESTIONS.items() if choice(question, ["y", "n"], "y" if kind in seen.parts else "n") == "y"}
    return Probe(name, root, language, stores, parts, seen.store_folder)


def minimal(seen: Probe, has_src: bool = False) -> str:
    """A configuration to begin with: components, stores and routes."""
    below = "src/" if seen.source_root == "." and has_src else ""
    entities = {"component": ["**/*.vue"], "store": [f"{below}{seen.store_folder}/**/*.{{js,ts}}"], "route": [f"{below}router/**/*.{{js,ts}}"]}
    return yaml.safe_dump({"project": {"name": seen.name, "source_root": seen.source_root}, "entities": {n: {"patterns": p} for n, p in entities.items()}}, sort_keys=False)


def full(said: Probe) -> str:
    """The parts of the built-in plugin that the answers name, as a configuration of their own."""
    kinds = {"component", *said.parts} | ({"store"} if said.stores != "none" else set()) | ({"preload"} if "electron-main" in said.parts else set())
    below = ["", "src/"] if said.source_root == "." else [""]
    entities = {}
    for kind, patterns in PLUGIN_ENTITIES.items():
        if kind in kinds:
            own = [p for p in patterns if said.language == "ts" or not p.endswith(".ts")]
            entities[kind] = {"patterns": list(dict.fromkeys(b + p if not p.startswith(("**", "src/")) else p for b in below for p in own))}
    used = {"vue": True, "vue-router": "route" in kinds, "pinia": said.stores in ("pinia", "both")}
    relations = {}
    for name, (source, target, _, meant) in PLUGIN_RELATIONS.items():
        if {source, target} <= kinds:
            if name == "uses_store" and said.stores in ("vuex", "both"):
                meant = [*meant, *(("call_expression", helper) for helper in ("mapState", "mapGetters", "mapActions", "mapMutations"))]
            relations[name] = {"from": source, "to": target, "detect_by": [{"type": kind, "pattern": pattern} for kind, pattern in meant]}
    body = {
        "project": {"name": said.name, "source_root": said.source_root},
        "entities": entities,
        "framework_apis": [{"name": name, "api_list": names} for name, names in PLUGIN_APIS.items() if used.get(name)],
        "relationships": relations,
        "custom_entities": {},
    }
    return yaml.safe_dump(body, sort_keys=False)
