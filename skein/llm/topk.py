"""Exact top-k by integer inner product: columnar branch and bound.

Candidates of a block lie dimension by dimension. For a query the product is accumulated over blocks of dimensions; after
each, the mass left bounds what a candidate can still gain (Cauchy-Schwarz), and candidates that cannot reach the k-th
best score any more are compacted away, so the dimensions left are multiplied with the survivors only. A first block
gives every query a score that its k-th best reaches at least; the other blocks prune by it from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import tiles
from skein.llm.common import cut, released


def best_of_block(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int, step: int = 16, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, candidate ids, scores, places of the queries, multiplications): of each query its k best candidates.

    Candidates are sorted by id on entry. ``floors`` holds a score for each query that its k-th best of all has at least;
    candidates below it are left out.
    """
    dims = c.shape[1]
    order = np.argsort(-np.abs(c).sum(axis=0, dtype=np.float64), kind="stable")  # heavy dimensions first
    small = float(np.abs(c).max(initial=0)) * max(1.0, float(np.abs(q).max(initial=0))) * dims < 2**52  # then doubles add integers exactly
    kind = np.float64 if small else np.int64
    columns, q = np.ascontiguousarray(c[:, order].T).astype(kind), np.ascontiguousarray(q[:, order]).astype(kind)
    cuts = [*range(0, dims, step), dims]
    left = {e: np.sqrt((columns[e:].astype(np.float64) ** 2).sum(axis=0)) for e in cuts[1:-1]}
    ask = {e: np.sqrt((q[:, e:].astype(np.float64) ** 2).sum(axis=1)) for e in cuts[1:-1]}
    floors = np.full(len(q), -np.inf) if floors is None else floors
    out, done = [], 0
    for at in range(0, len(q), 64):
        first = q[at : at + 64, : cuts[1]] @ columns[: cuts[1]]  # all candidates are alive for all queries
        done += first.size * cuts[1]
        for place in range(at, min(at + 64, len(q))):
            alive, score, floor = np.arange(len(c_ids)), first[place - at], floors[place]
            mine, rest, base = c_ids == q_ids[place], columns, 0
            for s, e in zip(cuts, cuts[1:]):
                if s:
                    score = score + q[place, s:e] @ rest[s - base : e - base]
                    done += (e - s) * len(alive)
                if e < dims:
                    reach = ask[e][place] * left[e][alive] * (1 + 1e-9) + 1
                    if len(alive) - mine.sum() > k:
                        sure = np.where(mine, -np.inf, score - reach)
                        floor = max(floor, np.partition(sure, len(sure) - k)[len(sure) - k])  # k candidates score at least this much
                    stay = np.flatnonzero((score + reach >= floor) & ~mine)
                    if len(stay) < 0.75 * len(alive):  # else copying would cost more than it spares
                        alive, score, mine, rest, base = alive[stay], score[stay], mine[stay], rest[e - base :, stay], e
            keep = (score >= floor) & ~mine
            alive, score = alive[keep], score[keep]
            if len(alive) > k:
                last = np.partition(score, len(score) - k)[len(score) - k]
                stay = np.flatnonzero(score > last)
                stay = np.r_[stay, np.flatnonzero(score == last)[: k - len(stay)]]  # ids rise, so the first ties have the smallest
                alive, score = alive[stay], score[stay]
            out.append((np.full(len(alive), q_ids[place]), c_ids[alive], score.astype(np.int64), np.full(len(alive), place)))
    none = np.zeros(0, np.int64)
    return *(np.concatenate([none, *x]) for x in (zip(*out) if out else [()] * 4)), done


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """A block: its ids and its integers, in 4 bytes each if they fit."""
    frame = frame.sort_values("id", kind="stable")
    v = np.stack(frame["v"].to_numpy())
    wide = len(v) > 0 and np.abs(v.astype(np.float64)).max(initial=0) >= 2**31
    return pd.DataFrame({"dim": frame["dim"].iloc[:1].to_numpy(), "block": frame["block"].iloc[:1].to_numpy(), "ids": [frame["id"].to_numpy().astype("<i8").tobytes()], "data": [v.astype("<i8" if wide else "<i4").tobytes()]})


def _unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(data, "<i8" if len(data) == 8 * dim * len(ids) else "<i4").reshape(len(ids), dim).astype(np.int64)


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, k: int = 10, per_block: int = 8192, per_query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows by the inner product of floor(scale * x).

    ``is_query``: a condition on the column ``id``. Ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components take no part; vectors are compared with those of their own length; an empty vector has no
    inner product. Scores must fit a long. Rows that repeat an id are candidates of their own, but not of a query with
    that id; a query row that repeats id and vector asks once for each. An empty table gives no rows. Columns other than
    the two named are ignored. Blocks of queries meet blocks of candidates; the k best of each such pair are merged per
    query row.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(tiles.is_usable(F.col("v")), F.lit(False)))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.size("v").alias("dim"))
    kind = "dim int, block int, ids binary, data binary"
    spread = F.struct("id", F.spark_partition_id(), F.monotonically_increasing_id())  # rows that repeat an id go to many blocks
    rows = cut(rows.withColumn("spread", F.xxhash64(spread)))
    each, counts = tiles.numbered(rows, per_block, F.col("spread"))
    packed = cut(each.drop("spread").groupBy("dim", "block").applyInPandas(_pack, kind))
    asking, asked_counts = tiles.numbered(rows.where(is_query), per_query_block, F.col("spread"))
    if not asked_counts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = cut(asking.drop("spread").groupBy("dim", "block").applyInPandas(_pack, kind)).select("dim", F.col("block").alias("ask"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def run(frames):
        for frame in frames:
            for r in frame.to_dict("records"):
                c_ids, c = _unpack(r["ids"], r["data"], r["dim"])
                q_ids, q = _unpack(r["q_ids"], r["q_data"], r["dim"])
                floors = np.full(len(q), -np.inf)
                for known in r["floors"] if r["floors"] is not None else ():
                    floors[known["place"]] = known["floor"]
                a, b, s, place, _ = best_of_block(q, c, q_ids, c_ids, k, floors=floors)
                yield pd.DataFrame({"dim": r["dim"], "ask": r["ask"], "place": place, "query_id": a, "vec_id": b, "score": s})

    def searched(asked: DataFrame) -> DataFrame:
        pairs = asked.join(packed.hint("shuffle_hash"), ["dim", "block"]).select("dim", "ask", "ids", "data", "q_ids", "q_data", "floors")
        return pairs.mapInPandas(released(run), "dim int, ask int, place int, query_id long, vec_id long, score long")

    first = cut(searched(asked.withColumns({"block": F.lit(0), "floors": F.lit(None).cast("array<struct<place:int,floor:long>>")})))
    tenth = first.groupBy("dim", "ask", "place").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    floors = tenth.groupBy("dim", "ask").agg(F.collect_list(F.struct("place", "floor")).alias("floors"))  # one a query of a block
    others = asked.join(floors, ["dim", "ask"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), tiles.per_length(counts) - 1))).where("block > 0")
    by = Window.partitionBy("dim", "ask", "place").orderBy(F.desc("score"), "vec_id")
    part = first.unionByName(searched(others))
    return part.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)
