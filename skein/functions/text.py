"""Column functions over names, paths and code text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def normal_channel(name: Column) -> Column:
    """Lower case without dashes and underscores."""
    return F.translate(F.lower(name), "-_", "")


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "[\\\\/]"), -1)


def base_name(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(last_part(path), r"\.[^.]+$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def short_path(path: Column) -> Column:
    """The last three parts of a path, after ``.../`` if there are more."""
    parts = F.split(path, r"[\\/]+")
    return F.when(F.size(parts) <= 3, path).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -3, 3), "/")))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"`]|['\"`]$", "")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a path glob with ``*``, ``**``, ``?`` and ``{a,b}``."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif pattern.startswith("**", at):
            out.append(".*")
            at += 2
        else:
            closing = pattern.find("}", at) if c == "{" else -1
            if closing > 0:
                out.append("(?:" + "|".join(re.escape(x) for x in pattern[at + 1 : closing].split(",")) + ")")
                at = closing + 1
                continue
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
            at += 1
    return "^" + "".join(out) + "$"


def wildcard_regex(pattern: str, escape: bool = True) -> str:
    """An anchored regular expression in which ``*`` is anything; without ``escape``, the rest is an expression already."""
    return "^" + (".*".join(re.escape(x) for x in pattern.split("*")) if escape else pattern.replace("*", ".*")) + "$"


def matches_exact_or_glob(text: Column, pattern: str | None, escape: bool = False) -> Column:
    """Equal, anything, or a wildcard match; no part of a word."""
    if not pattern or pattern == "*":
        return F.lit(True)
    return text.rlike(wildcard_regex(pattern, escape)) if "*" in pattern else text == pattern


def matches_loosely(text: Column, pattern: str | None, escape: bool = False) -> Column:
    """As above, but a pattern without a wildcard may stand anywhere in the text."""
    if not pattern or pattern == "*":
        return F.lit(True)
    return text.rlike(wildcard_regex(pattern, escape)) if "*" in pattern else text.contains(pattern)


def code_tokens(text: Column) -> Column:
    """The terms of code: identifiers split at changes of case, lower-cased, two letters or more and not only digits.

    The expressions are fixed values.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9_$]+"), lambda w: F.length(w) >= 2)
    spaced = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2"))
    parts = F.flatten(F.transform(spaced, lambda w: F.split(F.lower(w), " ")))
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9_$]+$"))


def visible_properties(properties: Column) -> Column:
    """A JSON object's top-level values as a map of strings, without keys that begin with an underscore; bad JSON is empty."""
    parsed = F.from_json(properties, "map<string,string>")
    return F.map_filter(F.coalesce(parsed, F.create_map().cast("map<string,string>")), lambda k, _: ~k.startswith("_"))


def edge_summary(*values: Column) -> Column:
    """The first three of the values that are there, joined by commas."""
    return F.array_join(F.slice(F.array_compact(F.array(*[v.cast("string") for v in values])), 1, 3), ", ")
