"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.lineage import cut, scratch, shared_dir

__all__ = ["connected_components", "cut", "released", "remove", "scratch", "shared_dir", "slices", "spanning_links", "table", "unused", "without_ids"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Return freed memory to the system; Python workers live on between tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A body for mapInArrow or mapInPandas that gives memory back at times and when it ends."""

    @functools.wraps(run)
    def body(batches: Iterator) -> Iterator:
        try:
            out = None
            for k, out in enumerate(run(batches)):
                yield out
                if k % 32 == 31:
                    give_back()
        finally:
            del out
            give_back()

    return body


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, chars: int = 1_000_000, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice stay below ``chars`` bytes, however long single texts are."""
    for batch in batches:
        at, n = 0, batch.num_rows
        ends = None
        if text is not None and n:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
        while at < n:
            stop = min(n, at + rows)
            if ends is not None:
                base = ends[at - 1] if at else 0
                stop = min(stop, max(at + 1, int(np.searchsorted(ends, base + chars, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def spanning_links(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) with the same connectivity as the links (a, b) on 0..n-1."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


#: So many links (16 bytes each) are joined by one task.
LAST_LINKS = 50_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (src, dst), few and all of them, (node, to): the smallest node that each can reach."""
    sides = [np.zeros((0, 2), np.int64), *(np.stack([b.column(k).to_numpy() for k in (0, 1)], axis=1) for b in batches)]
    nodes, of = np.unique(np.concatenate(sides), return_inverse=True)
    of, label = of.reshape(-1, 2), np.arange(len(nodes))
    moved, to = spanning_links(len(nodes), of[:, 0], of[:, 1])
    label[moved] = to
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "to"])


def connected_components(edges: DataFrame, last: int = LAST_LINKS) -> DataFrame:
    """(node, component): the smallest id that each node of ``edges`` (src, dst: long) can reach.

    Randomised contraction: in each round every node joins the neighbour (or itself) of the lowest random rank,
    groups become the next round's nodes, and links inside a group vanish. The number of links falls by a constant
    factor a round whatever the graph looks like (chains included), and hubs only meet partial aggregates. When at most
    ``last`` links are left, one task joins them. Null ends and self links are ignored; no links give no rows.
    """
    with scratch(edges.sparkSession):
        return _contracted(edges, last)


def _contracted(edges: DataFrame, last: int) -> DataFrame:
    edges = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    steps: list[DataFrame] = []
    while left := edges.limit(last + 1).count():
        if left <= last:
            steps.append(cut(edges.coalesce(1).mapInArrow(_joined, "node long, to long")))
            break
        seed = F.lit(len(steps))
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.groupBy("src").agg(F.min(F.struct(F.xxhash64("dst", seed).alias("rank"), F.col("dst").alias("id"))).alias("low"))
        own = F.struct(F.xxhash64("src", seed).alias("rank"), F.col("src").alias("id"))
        step = cut(near.select(F.col("src").alias("node"), F.least("low", own)["id"].alias("to")))
        steps.append(step)
        half = edges.join(step, edges["src"] == step["node"]).select(F.col("to").alias("a"), "dst")
        edges = half.join(step, half["dst"] == step["node"]).select("a", F.col("to").alias("b")).where("a <> b")
        edges = cut(edges.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    if not steps:
        return cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("component")), keep=True)
    found = steps[0]
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return cut(found.join(least, "to").select("node", "component"), keep=True)


#: So many ids (16 MB as a hash table) may be broadcast; beyond, the join shuffles.
BROADCAST_IDS = 200_000


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, however it spells its own."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone`` (one long column); rows of null id stay."""
    name = unused(docs, "gone")
    gone = cut(gone.toDF(name).distinct())
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
