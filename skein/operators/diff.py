"""Changed ranges of a unified diff and the functions they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import first_of
from skein.operators.joins import carry_forward, overlaps
from skein.operators.traverse import reach

FILE = r"^diff --git a/.* b/(.*)$"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def hunks(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(file_path, low, high, ordinal): the new side of every hunk of diff lines (line_no, line).

    ``by`` names columns that tell several diffs apart; a diff is read in order by one task, being one text. A count of 0
    gives the empty range [n, n - 1].
    """
    by = by or []
    named = lines.where(F.col("line").rlike("^(diff --git |@@ )"))
    path = F.nullif(F.regexp_extract("line", FILE, 1), F.lit(""))
    named = named.withColumn("file_path", path)
    read = named.withColumn("file_path", carry_forward(named, "file_path", "line_no", by))
    read = read.withColumn("low", F.nullif(F.regexp_extract("line", HUNK, 1), F.lit("")).cast("long")).where("low is not null and file_path is not null")
    count = F.coalesce(F.nullif(F.regexp_extract("line", HUNK, 2), F.lit("")).cast("long"), F.lit(1))
    return read.select(*by, "file_path", "low", (F.col("low") + count - 1).alias("high"), F.col("line_no").alias("ordinal"))


def changed_functions(ranges: DataFrame, functions: DataFrame, line: str = "file_start_line") -> DataFrame:
    """Functions that a range touches, one a (file, name), with the first range as the reason.

    ``line``: ``file_start_line`` for lines of the file, ``start_line`` for lines of the script block as stored.
    """
    spans = functions.select("id", "name", "kind", "file_path", F.col(line).alias("start_line"), (F.col("end_line") + F.col(line) - F.col("start_line")).alias("end_line"))
    met = overlaps(ranges, spans, ["file_path"])
    return first_of(met, ["file_path", "name"], ["ordinal", "start_line", F.length("id"), "id"]).select("id", "name", "kind", "file_path", "start_line", "low", "high")


def diff_impact(ranges: DataFrame, functions: DataFrame, calls: DataFrame, depth: int = 3, line: str = "file_start_line") -> DataFrame:
    """(id, name, kind, file_path, start_line, impact_depth): touched functions at depth 0, what they call behind them."""
    direct = changed_functions(ranges, functions, line)
    later = reach(calls, direct.select("id"), depth).join(functions, "id")
    columns = ["id", "name", "kind", "file_path", F.col(line).alias("start_line"), F.col("depth").alias("impact_depth")]
    return direct.select("id", "name", "kind", "file_path", "start_line", F.lit(0).alias("impact_depth")).unionByName(later.select(*columns))
