"""SimHash near-duplicates: pigeonhole blocks, a join on block combinations, then the Hamming distance.

A fingerprint is cut into ``blocks`` parts. Two fingerprints that differ in at most ``distance`` bits agree in at
least ``blocks - distance`` parts, so they share one of the keys made of so many parts. Fingerprints that share a key
are compared in tiles of bounded size; a tile returns links that span its groups, never all its pairs.

64 bits tell texts of similarity 0.8 and 0.6 hardly apart, so for a bound on the similarity ``near_groups`` checks links of
fingerprints by the sets of shingles themselves, and ``similar_groups`` finds the pairs that are farther apart by the same
pigeonhole over the whole sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import connected_components, cut, released, slices, spanning_links, without_ids
from skein.llm.shingles import majority, shingle_hashes, similar_groups

__all__ = ["fingerprint", "fingerprints", "hamming_links", "keep_one", "near_groups", "op5_simhash", "similar_groups", "simhash_groups"]


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text, unsigned; null and wordless texts have 0."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``, over whole texts; other columns aren't read."""

    def run(batches):
        for batch in slices(batches, text=1):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), "doc_id long, fp long")


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """An array with a key (which parts, their bits) for each choice of ``blocks - distance`` parts."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << edges[p + 1]) - (1 << edges[p])) for p in chosen)
        keys.append(F.struct(F.lit(k).alias("part"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys leave about 8 of ``n`` evenly spread fingerprints, or fewer, to a key.

    Any number above ``distance`` finds every pair; more blocks mean longer keys, and more of them.
    """
    blocks = distance + 2
    while blocks < 2 * distance and 2 ** (64 * (blocks - distance) / blocks) * 8 < n:
        blocks += 1
    return blocks


def _compare(distance: int):
    def links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        starts, stops = np.r_[0, cuts], np.r_[cuts, len(group)]
        sizes = stops - starts
        small = np.repeat(sizes <= 64, sizes)
        left, shift, stop_of = np.flatnonzero(small), 1, np.repeat(stops, sizes)
        while len(left := left[left + shift < stop_of[left]]):  # every pair at this distance inside small groups
            hit = left[np.bitwise_count(fp[left] ^ fp[left + shift]) <= distance]
            a.append(hit)
            b.append(hit + shift)
            shift += 1
        for s, e in zip(starts[sizes > 64], stops[sizes > 64]):
            for at in range(s, e, 128):
                near = np.bitwise_count(fp[at : min(e, at + 128), None] ^ fp[None, at:e]) <= distance
                i, j = np.nonzero(near)
                a.append(i[j > i] + at)
                b.append(j[j > i] + at)
        none = np.zeros(0, np.int64)
        return spanning_links(len(fp), np.concatenate([none, *a]), np.concatenate([none, *b]))

    def scan(frames):
        group, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for frame in frames:
            if not len(frame):
                continue
            group = np.r_[group, frame["tile"].to_numpy()]
            fps = np.r_[fps, frame["fp"].to_numpy().view(np.uint64)]
            last = len(group) - int(np.argmax(group[::-1] != group[-1])) if group[0] != group[-1] else 0
            if last:
                x, y = links(group[:last], fps[:last])
                yield pd.DataFrame({"src": fps[:last][x].view(np.int64), "dst": fps[:last][y].view(np.int64)})
                group, fps = group[last:], fps[last:]
        if len(group):
            x, y = links(group, fps)
            yield pd.DataFrame({"src": fps[x].view(np.int64), "dst": fps[y].view(np.int64)})

    return scan


def hamming_links(fps: DataFrame, distance: int = 4, blocks: int | None = None, tile: int = 2048) -> DataFrame:
    """Links (src, dst) between the distinct values ``fp`` of ``fps`` that span every group at ``distance`` bits or fewer.

    A key with n > ``tile`` fingerprints is split into ceil(n / tile) parts by hash; each pair of parts is a tile.
    """
    blocks = blocks or blocks_for(fps.count(), distance)
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.repartition(tasks, "fp")  # many rows come of each, so not in the few tasks that the table itself needs
    keys = spread.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("key")).select("fp", "key.part", "key.bits")
    shared = keys.groupBy("part", "bits").count().where("count > 1")
    rows = keys.join(shared, ["part", "bits"]).withColumn("parts", F.ceil(F.col("count") / tile).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("part", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "fp")
    rows = rows.repartition("tile").sortWithinPartitions("tile")
    return rows.mapInPandas(released(_compare(distance)), "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, words: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the near-duplicate group of every row.

    Equal fingerprints are one node, whatever the number of copies; component_id is the smallest doc_id reachable over
    fingerprints at ``distance`` bits or fewer. Null, empty and wordless texts have fingerprint 0 and link like any
    other. Repeated rows come back repeated. An empty table gives no rows. Columns other than the two named are ignored.
    """
    found = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected_components(hamming_links(nodes.select("fp"), distance, blocks))
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = cut(named)
    lowest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of = named.join(lowest, "group").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", "fp", "component_id")


def near_pairs(sets: DataFrame, distance: int = 4) -> DataFrame:
    """(leader, node): pairs of the sets (node, fp) that span every group of fingerprints at ``distance`` bits or fewer.

    The least node of a fingerprint leads the others of it, and stands for it in the links between fingerprints.
    """
    lead = cut(sets.groupBy("fp").agg(F.min("node").alias("leader")))
    alike = sets.join(lead, "fp").where("node <> leader").select("leader", "node")
    links = hamming_links(lead.select("fp"), distance)
    ends = links.join(lead.select(F.col("fp").alias("src"), "leader"), "src").join(lead.select(F.col("fp").alias("dst"), F.col("leader").alias("node")), "dst")
    return alike.unionByName(ends.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 4) -> DataFrame:
    """(doc_id, component_id): groups of texts of similarity ``similarity`` or more by SimHash, then by their whole sets.

    Sets of shingles whose fingerprints are linked at ``distance`` bits are compared by their exact similarity, and so are
    those that share a block of the whole sets, which finds the pairs that 64 bits leave farther apart. Nulls, empty texts,
    repeated rows, empty tables and further columns are as in ``similar_groups``.
    """
    return similar_groups(docs, id_col, text_col, words, similarity, near=lambda sets: near_pairs(sets, distance))


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose group (doc_id, component_id) has a smaller doc_id; rows of null doc_id stay.

    All rows that carry a kept doc_id stay, so exact repetitions of a row are not told apart here.
    """
    return without_ids(docs, groups.where("doc_id <> component_id").select("doc_id"), id_col)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
