"""Joins of the graph builder: candidates in order, intervals, values carried forward, as-of."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import first_of
from skein.plans.lineage import small_side

#: Endings that an import path may lack, in the order in which they are tried; fixed values.
SUFFIXES = ("", ".vue", ".ts", ".js", ".jsx", ".tsx", "/index.ts", "/index.js", "/index.vue")


def resolve_candidates(wanted: DataFrame, listing: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(src, base, path): for each (src, base) the first of base + suffix that ``listing`` (path) has."""
    tries = wanted.select("src", "base", F.posexplode(F.transform(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.concat(F.col("base"), s))).alias("ordinal", "path"))
    found = tries.join(listing.select("path").distinct(), "path")
    return first_of(found, ["src", "base"], ["ordinal"]).select("src", "base", "path")


def listed(rows: DataFrame, by: list[str], most: int = 4096) -> DataFrame:
    """(by, __part, __rows): the rows alike in the columns ``by`` as lists of what else they hold, several of about ``most`` rows for many.

    Which list has a row follows from its content, so only copies in every column are sure to share one. Null keys go.
    """
    rest = [F.col(c) for c in rows.columns if c not in by] or [F.lit(0).alias("__none")]
    rows = rows.where(F.forall(F.array(*[F.col(c).isNotNull() for c in by]), lambda known: known))
    many = small_side(rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > most))
    part = F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64(*rest), F.ceil(F.col("__n") / most))).otherwise(0)
    dealt = rows.join(many, by, "left").withColumn("__part", part)
    return dealt.groupBy(*by, "__part").agg(F.collect_list(F.struct(*rest)).alias("__rows"))


def overlaps(ranges: DataFrame, spans: DataFrame, by: list[str], width: int = 64, share: int = 1 << 25) -> DataFrame:
    """Rows of ``ranges`` (low, high) and ``spans`` (start_line, end_line), with the columns ``by`` alike, that share a point.

    Both sides go to bins of ``width`` and meet in the bin of the later start, so once. A key with many rows is spread over
    its bins. A range with ``high`` = ``low`` - 1 is empty and meets the spans around the place.

    Ranges of the same place meet a span as one list, which is dealt out last: a result that is far larger than its tables
    is compared once a list, and comes as runs of one span and repeats of one list, which files hold in little space. The
    merge keeps the lists outside and the spans inside, whatever their sizes.

    A merge in generated code makes all rows of a list before it hands on the first, so they would lie in memory together:
    the condition holds a lambda, which Spark interprets, and the merge with it, one pair at a time. Tasks follow the pairs to
    compare, about ``share`` each, not the bytes shuffled; the lists of a bin with more pairs are dealt to several.
    """
    kept = [c for c in ranges.columns if c not in by]
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    met_at = [*by, "__bin"]
    places = listed(ranges, [*by, "low", "high"]).withColumn("__bin", bins("low", "high"))
    binned = spans.withColumn("__bin", bins("start_line", "end_line"))
    count = lambda rows, name: rows.groupBy(*met_at).agg(F.count("*").cast("double").alias(name))
    pairs = count(ranges.withColumn("__bin", bins("low", "high")), "__a").join(count(binned, "__b"), met_at).select(*met_at, (F.col("__a") * F.col("__b")).alias("__pairs"))
    tasks = math.ceil((pairs.agg(F.sum("__pairs")).first()[0] or 0) / share)
    if tasks > 1:
        heavy = small_side(pairs.where(F.col("__pairs") > share).select(*met_at, F.ceil(F.col("__pairs") / share).alias("__shares")))
        shares = F.coalesce("__shares", F.lit(1))
        places = places.join(heavy, met_at, "left").withColumn("__share", F.pmod(F.xxhash64("low", "high", "__part"), shares)).drop("__shares")
        binned = binned.join(heavy, met_at, "left").withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("__shares")
        met_at.append("__share")
        places, binned = places.repartition(tasks, *met_at), binned.repartition(tasks, *met_at)
    met = places.join(binned.hint("merge"), met_at)
    later = F.floor(F.greatest("low", "start_line") / width)
    one_by_one = F.forall(F.array(F.col("__bin") == later), lambda holds: holds)
    met = met.where((F.col("low") <= F.col("end_line")) & (F.col("high") >= F.col("start_line")) & one_by_one)
    others = [c for c in spans.columns if c not in by]
    return met.select(*by, "low", "high", *others, F.inline("__rows")).select(*by, *kept, *others)


def carry_forward(rows: DataFrame, value: str, order: str, by: list[str]) -> Column:
    """The last value that isn't null, up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` at or before it, by one sort of both sides together."""
    both = left.withColumn("__value", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(True))
    other = right.select(by, at, F.col(value).alias("__value")).withColumn("__left", F.lit(False))
    every = both.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(value, F.last("__value", ignorenulls=True).over(order)).where("__left").drop("__left", "__value")
