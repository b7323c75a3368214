"""The fact table: one pass of Python over the files, everything after it is joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.extract import extract

FACTS = (
    "path string, rel_path string, entity_type string, ordinal long, fact string, name string, `full` string, object string, args array<string>, flag boolean, line long, end_line long, start long, `end` long, text string"
)
COLUMNS = [c.split()[0].strip("`") for c in FACTS.split(", ")]


def facts(files: DataFrame) -> DataFrame:
    """The facts of classified files (path, rel_path, content, entity_type), each file read once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f.path, f.rel_path, f.entity_type, k, *fact) for f in frame.itertuples() for k, fact in enumerate(extract(f.path, f.content or "", f.entity_type))]
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("line", "end_line", "start", "end"):
                out[c] = out[c].astype("Int64")
            yield out

    return files.select("path", "rel_path", "content", "entity_type").mapInPandas(run, FACTS)


def of(table: DataFrame, kind: str) -> DataFrame:
    return table.where(F.col("fact") == kind)
