"""Embedding near-duplicates by int8 quantised tile products with error bounds.

Each unit vector a is s * q + r with q in -127..127. For two of them the exact cosine differs from s_a s_b (q_a . q_b)
by at most e_a + e_b + e_a e_b with e = |r|. Tiles of two blocks hold only q, s and e: what is linked or apart by these
bounds is settled there, and only vectors with a pair in between come to the tile a second time, in double precision. The
integer products run as float32 matrix products: all partial sums are integers below 2^24 for up to 1024 dimensions,
longer vectors are summed by slices.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import tiles
from skein.llm.common import connected_components, cut, spanning_links

EXACT_DIMS = 1024
SLACK = 1e-9  # beyond all rounding of the bounds themselves
LINKS = "node long, peer long, links long"


class Quantised(NamedTuple):
    q: np.ndarray  # int8
    scale: np.ndarray
    error: np.ndarray  # bounds the norm of what quantising left out of the unit vector


def unit(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # exact; squares stay in range
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantise(x: np.ndarray) -> Quantised:
    """Of unit rows."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    left = x - q * scale[:, None]
    return Quantised(q, scale, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9) + 1e-12)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parts = [a[:, k : k + EXACT_DIMS].astype(np.float32) @ b[:, k : k + EXACT_DIMS].astype(np.float32).T for k in range(0, a.shape[1], EXACT_DIMS)]
    return parts[0] if len(parts) == 1 else sum(p.astype(np.float64) for p in parts)


def judged(x: Quantised, y: Quantised, threshold: float, same: bool):
    """(i, j, sure) of index pairs that the bounds don't tell apart (i < j if ``same``), by strips of rows; sure: linked."""
    for at in range(0, len(x.q), 256):
        stop = min(at + 256, len(x.q))
        lo = at if same else 0
        cosine = _product(x.q[at:stop], y.q[lo:]) * (x.scale[at:stop, None] * y.scale[None, lo:])
        off = x.error[at:stop, None] + y.error[None, lo:] * (1 + x.error[at:stop, None]) + SLACK
        i, j = np.nonzero(cosine >= threshold - off)
        sure = cosine[i, j] >= threshold + off[i, j]
        i, j = i + at, j + lo
        if same:
            i, j, sure = i[j > i], j[j > i], sure[j > i]
        yield i, j, sure


def linked(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the pairs (x[i], y[j]) reach the threshold in double precision."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        a, b = i[k : k + 100_000], j[k : k + 100_000]
        out[k : k + 100_000] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return out


class Found:
    """Counts of links and links that span the groups of a tile; pairs themselves aren't kept."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray):
        self.nodes, self.weights, self.links = nodes, weights, np.zeros(len(nodes))
        self.a = self.b = np.zeros(0, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.links += np.bincount(i, self.weights[j], len(self.nodes)) + np.bincount(j, self.weights[i], len(self.nodes))
        if len(i):
            self.a, self.b = spanning_links(len(self.nodes), np.r_[self.a, i], np.r_[self.b, j])

    def rows(self) -> pd.DataFrame:
        has = np.flatnonzero(self.links)
        return pd.DataFrame({"node": np.r_[self.nodes[has], self.nodes[self.a]], "peer": np.r_[self.nodes[has], self.nodes[self.b]], "links": np.r_[self.links[has].astype(np.int64), np.zeros(len(self.a), np.int64)]})


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """A block: its vectors quantised."""
    frame = frame.sort_values("node", kind="stable")
    q = quantise(unit(np.stack(frame["v"].to_numpy()).astype(np.float64)))
    raw = lambda x, kind: [np.ascontiguousarray(x).astype(kind).tobytes()]
    return pd.DataFrame({"dim": frame["dim"].iloc[:1].to_numpy(), "block": frame["block"].iloc[:1].to_numpy(), "nodes": raw(frame["node"], "<i8"), "copies": raw(frame["copies"], "<i8"), "q": raw(q.q, "i1"), "scale": raw(q.scale, "<f8"), "error": raw(q.error, "<f8")})


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, Quantised]:
    nodes = np.frombuffer(row["nodes"], "<i8")
    return nodes, np.frombuffer(row["copies"], "<i8"), Quantised(np.frombuffer(row["q"], "i1").reshape(len(nodes), -1), np.frombuffer(row["scale"], "<f8"), np.frombuffer(row["error"], "<f8"))


def _settle(threshold: float):
    """A tile's sure links, and as rows of links -1 (own side) or -2 (other side) the vectors with a pair in between."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [_unpack(r) for r in frame.sort_values("block").to_dict("records")]
        (nodes_x, w_x, x), (nodes_y, w_y, y), same = sides[0], sides[-1], len(sides) == 1
        shift = 0 if same else len(nodes_x)
        found = Found(*((nodes_x, w_x) if same else (np.r_[nodes_x, nodes_y], np.r_[w_x, w_y])))
        open_ = np.zeros(len(found.nodes), bool)
        for i, j, sure in judged(x, y, threshold, same):
            found.add(i[sure], j[sure] + shift)
            open_[i[~sure]] = open_[j[~sure] + shift] = True
        again = np.flatnonzero(open_)
        rows = found.rows()
        more = pd.DataFrame({"node": found.nodes[again], "peer": found.nodes[again], "links": np.where(same | (again < len(nodes_x)), -1, -2)})
        out = pd.concat([rows, more], ignore_index=True)
        return out.assign(dim=frame["dim"].iloc[0], low=frame["low"].iloc[0], high=frame["high"].iloc[0])[["dim", "low", "high", "node", "peer", "links"]]

    return run


def _recompute(threshold: float):
    """The pairs of a tile that the bounds left open, in double precision; those that they settled are counted already."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["links", "node"], ascending=[False, True], kind="stable")
        v, n = np.stack(frame["v"].to_numpy()).astype(np.float64), int((frame["links"] == -1).sum())
        same = bool((frame["low"] == frame["high"]).iloc[0])
        q, found = quantise(unit(v)), Found(frame["node"].to_numpy(), frame["copies"].to_numpy())
        shift = 0 if same else n
        x, y = (q, q) if same else (Quantised(*(p[:n] for p in q)), Quantised(*(p[n:] for p in q)))
        for i, j, sure in judged(x, y, threshold, same):
            i, j = i[~sure], j[~sure] + shift
            hit = linked(v, v, i, j, threshold)
            found.add(i[hit], j[hit])
        return found.rows()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, per_block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row, by cosine >= ``threshold`` between all vectors.

    Equal vectors are one node, named by a 64-bit hash, with a weight, so many copies of a vector cost no more than one.
    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, vectors of different
    lengths not with each other. Rows that repeat an id count as vectors of their own that share the id; rows of null id
    link with nothing. Columns other than the two named are ignored. An empty table gives no rows.
    """
    v = F.col(vec_col).cast("array<double>")
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fit = F.col("vec_id").isNotNull() & tiles.is_usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    every = every.select("vec_id", "v", F.when(F.coalesce(fit, F.lit(False)), F.xxhash64(F.transform("v", lambda x: x + 0.0))).alias("node"))
    of = every.select("vec_id", "node")
    classes = every.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("dim", F.size("v")))
    numbered, counts = tiles.numbered(classes, per_block, F.col("node"))
    packed = cut(numbered.select("dim", "block", "node", "copies", "v").groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, nodes binary, copies binary, q binary, scale binary, error binary"))
    sent = packed.withColumn("other", F.explode(F.sequence(F.lit(0), tiles.per_length(counts) - 1)))
    sent = sent.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    settled = cut(sent.groupBy("dim", "low", "high").applyInPandas(_settle(threshold), f"dim int, low int, high int, {LINKS}"))
    again = settled.where("links < 0").select("dim", "low", "high", "node", "links").join(classes.select("node", "copies", "v"), "node")
    found = cut(settled.where("links >= 0").select("node", "peer", "links").unionByName(again.groupBy("dim", "low", "high").applyInPandas(_recompute(threshold), LINKS)))
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("links = 0").select(F.col("node").alias("src"), F.col("peer").alias("dst")))
    named = classes.select("node", "least", "copies").join(links, "node", "left").join(groups, "node", "left")
    named = cut(named.select("node", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("group")))
    lowest = named.groupBy("group").agg(F.min("least").alias("component"))
    named = named.join(lowest, "group").select("node", "n", "component")
    out = of.join(named, "node", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
