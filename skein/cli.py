"""Command line: index a project, ask a question, export the graph, or write a configuration to begin with."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from skein.operators.build import build
from skein.operators.graph import Graph, export_graph
from skein.operators.render import markdown, sections
from skein.operators.tools import Tools
from skein.plans.plugins import built_in
from skein.sources import config as C

QUESTIONS = {
    "entity": "entity_context", "impact": "impact_analysis", "routes": "route_map", "trace": "trace_usage", "entrypoints": "find_entrypoints",
    "cypher": "cypher", "overview": "project_overview", "function": "function_context", "diff": "diff_impact", "search": "semantic_search",
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skein")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="build a project's graph")
    index.add_argument("config")
    index.add_argument("graph")
    index.add_argument("--corrected", action="store_true", help="read the plugin's patterns by their meaning")
    ask = commands.add_parser("ask", help="answer a question")
    ask.add_argument("graph")
    ask.add_argument("question", choices=QUESTIONS)
    ask.add_argument("argument", nargs="*")
    view = commands.add_parser("export", help="write nodes and edges as JSON lines")
    view.add_argument("graph")
    view.add_argument("out")
    init = commands.add_parser("init", help="write a configuration")
    init.add_argument("path")
    init.add_argument("--interactive", action="store_true", help="ask which parts of the project to track")
    args = parser.parse_args(argv)
    if args.command == "init":
        folder = os.path.dirname(os.path.abspath(args.path))
        seen = C.probe(folder)
        text = C.full(C.ask(seen)) if args.interactive else C.minimal(seen, os.path.isdir(os.path.join(folder, "src")))
        with open(args.path, "x", encoding="utf-8") as f:
            f.write(text)
        return 0
    spark = SparkSession.builder.appName("skein").getOrCreate()
    if args.command == "index":
        build(spark, C.load(args.config), built_in(), compat=not args.corrected).save(args.graph)
    elif args.command == "export":
        export_graph(Graph.load(spark, args.graph), args.out)
    else:
        found = getattr(Tools(Graph.load(spark, args.graph)), QUESTIONS[args.question])(*args.argument)
        print(sections(found) if isinstance(found, dict) else markdown(args.question, found))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
