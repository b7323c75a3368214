"""Blocks of vectors as rows, for exact searches that look at pairs of blocks.

A block is one row with its vectors as one binary value, so shuffles and joins move blocks, not pairs of vectors.
With n vectors and blocks of b, each block goes to n / b pairs: the shuffle is n / b times the table, the work n * n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(v: Column) -> Column:
    """Whether a vector holds something and neither null nor non-finite components; null for a null vector."""
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def per_length(counts: dict[int, int]) -> Column:
    """The number of blocks of a row's ``dim``."""
    return F.create_map(*[F.lit(int(x)) for kv in counts.items() for x in kv])[F.col("dim")] if counts else F.lit(1)


def numbered(rows: DataFrame, per_block: int, by: Column) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` (with a column dim) with a ``block`` of about ``per_block`` rows by hash of ``by``, which should hardly repeat.

    Vectors of different lengths never share a block. Returns the number of blocks by vector length as well; there are
    as few of those as there are lengths.
    """
    counts = {r["dim"]: max(1, -(-r["count"] // per_block)) for r in rows.groupBy("dim").count().collect()}
    return rows.withColumn("block", F.pmod(F.xxhash64(by), per_length(counts)).cast("int")), counts
