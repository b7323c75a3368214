"""Detectors: named predicates over the fact table, each giving the matches of a pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import matches_exact_or_glob, matches_loosely
from skein.sources.facts import of

MATCH = ["path", "rel_path", "entity_type", "ordinal", "fact", "name", "full", "object", "args", "line", "text"]


def _by_name(kind: str, exact: bool, column: str = "name", escape: bool = False) -> Callable[[DataFrame, str], DataFrame]:
    test = matches_exact_or_glob if exact else matches_loosely
    return lambda facts, pattern: of(facts, kind).where(test(F.col(column), pattern, escape)).select(*MATCH)


def dynamic_import(facts: DataFrame, pattern: str) -> DataFrame:
    """Literal paths that hold the pattern; template strings whatever they hold."""
    hit = F.lit(True) if not pattern or pattern == "*" else F.col("name").contains(pattern) | F.col("flag")
    return of(facts, "dynamic_import").where(hit).select(*MATCH)


def export_default(facts: DataFrame, pattern: str = "") -> DataFrame:
    """The keys of default exports, those of a comma-separated list if one is given."""
    keys = [k.strip() for k in pattern.split(",") if k.strip()]
    found = of(facts, "export_key")
    return (found.where(F.col("name").isin(keys)) if keys else found).select(*MATCH)


def annotation(facts: DataFrame, pattern: str = "*") -> DataFrame:
    tags = [t.strip() for t in pattern.split(",") if t.strip()]
    found = of(facts, "annotation").where(~F.col("name").contains("-"))
    return (found if not tags or "*" in tags else found.where(F.col("name").isin(tags))).select(*MATCH)


def template_element(facts: DataFrame, pattern: str) -> DataFrame:
    """Of the texts of a comma-separated list, those that stand in a file's template; ``full`` says how often."""
    texts = [x.strip() for x in (pattern or "").split(",") if x.strip()]
    found = of(facts, "template")
    if not texts:
        return found.select(*MATCH).limit(0)
    each = found.drop("name", "full").withColumn("name", F.explode(F.array(*[F.lit(x) for x in texts])))
    times = ((F.length("text") - F.length(F.replace("text", F.col("name"), F.lit("")))) / F.length("name")).cast("long")
    return each.withColumn("full", times.cast("string")).where("full <> '0'").select(*MATCH)


DETECTORS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "import_statement": _by_name("import", exact=False),
    "call_expression": _by_name("call", exact=True),
    "new_expression": _by_name("new", exact=False),
    "member_expression": _by_name("member", exact=False, column="full", escape=True),
    "import_expression": dynamic_import,
    "export_default": export_default,
    "annotation": annotation,
    "template_element": template_element,
    "compiler_macro": _by_name("macro", exact=True),
}


def detect(facts: DataFrame, kind: str, pattern: str) -> DataFrame | None:
    """The matches of a detector, or None for a kind that doesn't exist."""
    return DETECTORS[kind](facts, pattern) if kind in DETECTORS else None
