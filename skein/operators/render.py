"""Markdown from the rows of a tool."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST = 1000


def cell(value) -> str:
    if value is None:
        return ""
    text = f"{value:.3f}" if isinstance(value, float) else ", ".join(map(str, value)) if isinstance(value, list) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def markdown(title: str, rows: DataFrame, most: int = MOST) -> str:
    """A heading and a table of at most ``most`` rows; says so if there are more."""
    found = rows.take(most + 1)
    if not found:
        return f"## {title}\n\nNothing found.\n"
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(v) for v in row) + " |" for row in found[:most]]
    return "\n".join(lines) + "\n" + (f"\nOnly the first {most} rows are shown.\n" if len(found) > most else "")


def sections(parts: dict[str, DataFrame]) -> str:
    return "\n".join(markdown(name.replace("_", " ").capitalize(), rows) for name, rows in parts.items())
