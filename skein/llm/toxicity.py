"""Toxicity: a linear classifier on the presence of character n-grams, scaled by naive Bayes log-count ratios.

Counting and featurising run on the executors; the driver only sees the chosen n-grams and their places in a bounded
sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skein.llm.common import cut, released, slices, table, unused

ORDERS = (4, 5, 6)
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 20


class Model(NamedTuple):
    codes: np.ndarray  # of the chosen n-grams, sorted
    weights: np.ndarray
    bias: float


def ngram_codes(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every ``n``-gram of the lower-cased texts, repeats included; n-grams don't cross rows."""
    parts = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    chars = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = np.full(m, n, np.uint64)
    for k in range(n):
        code *= BASE
        code += chars[k : k + m]
    code ^= code >> np.uint64(32)
    code *= BASE
    rows = np.repeat(np.arange(len(parts)), size)
    whole = rows[:m] == rows[n - 1 :]
    return rows[:m][whole], code[whole]


def _presence(texts: list[str | None], wanted: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, code), or (row, place in the sorted ``wanted`` codes)."""
    rows, codes = [], []
    for n in ORDERS:
        r, c = ngram_codes(texts, n)
        if wanted is not None:
            known, mask = wanted
            near = mask[(c >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            r, c = r[near], c[near]
            at = np.minimum(np.searchsorted(known, c), len(known) - 1)
            hit = known[at] == c
            r, c = r[hit], at[hit].astype(np.uint64)
        rows.append(r)
        codes.append(c)
    r, c = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((c, r))
    r, c = r[order], c[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    return r[first], c[first]


def _lookup(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.zeros(1 << TABLE_BITS, bool)
    mask[(codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    return codes, mask


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(rows: DataFrame, max_features: int = 2048, smoothing: float = 1.0, l2: float = 1e-3, rounds: int = 250) -> Model:
    """A model of ``rows`` (text, label 0/1), which must be a bounded sample: about 100 n-gram places a row reach the driver."""

    def count(batches):
        for batch in slices(batches, chars=300_000, text=0):
            texts, label = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            r, c = _presence(texts, None)
            codes, place = np.unique(c, return_inverse=True)
            ones = np.bincount(place, label[r], len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(ones), pa.array(np.bincount(place, minlength=len(codes)) - ones)], ["code", "ones", "zeros"])

    rows = cut(rows.select("text", F.col("label").cast("int").alias("label")))
    sizes = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not sizes["p"] or not sizes["n"]:
        return none._replace(bias=float("inf") if sizes["p"] else float("-inf"))
    p, n = float(sizes["p"]), float(sizes["n"])
    seen = rows.mapInArrow(released(count), "code long, ones long, zeros long").groupBy("code").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (a * (n - b) - b * (p - a)) ** 2 / ((a + b) * (p + n - a - b) + 1)
    chosen = seen.where("a + b >= 3").orderBy(chi.desc(), "code").limit(max_features).toPandas()
    if chosen.empty:
        return none._replace(bias=float(np.log(p / n)))
    codes = chosen["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    codes, a, b = codes[order], chosen["a"].to_numpy(float)[order], chosen["b"].to_numpy(float)[order]
    ratio = np.log((a + smoothing) / (p + 2 * smoothing)) - np.log((b + smoothing) / (n + 2 * smoothing))

    def places(batches):
        wanted = _lookup(codes)
        for batch in slices(batches, chars=300_000, text=0):
            r, c = _presence(batch.column(0).to_pylist(), wanted)
            ends = np.cumsum(np.bincount(r, minlength=batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(c.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], ["label", "places"])

    sample = rows.mapInArrow(released(places), "label int, places array<int>").toPandas()
    y = sample["label"].to_numpy(float)
    size = sample["places"].map(len).to_numpy()
    col = np.concatenate([np.zeros(0, np.int32), *sample["places"]]).astype(np.int64)
    order = np.argsort(np.repeat(np.arange(len(y)), size), kind="stable")  # rows stay as they came; sums run in that order
    row, value = np.repeat(np.arange(len(y)), size)[order], ratio[col]
    w, bias, m, v = np.zeros(len(codes)), float(np.log(p / n)), np.zeros(len(codes) + 1), np.zeros(len(codes) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, w[col] * value, len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        grad = np.r_[np.bincount(col, g[row] * value, len(codes)) + l2 * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(codes, w * ratio, float(bias))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    z = np.full(len(texts), model.bias)
    if len(model.codes):
        r, c = _presence(texts, _lookup(model.codes))
        z += np.bincount(r, model.weights[c.astype(np.int64)], len(texts))
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def with_score(rows: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``rows`` with the score of a text column; other columns pass through."""
    at, schema = rows.columns.index(text_col), StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=300_000, text=at):
            found = pa.array(scores(model, batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return rows.mapInArrow(released(run), schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000) -> Model:
    """A model of at most ``max_rows`` labelled rows outside the held-out fifth, those of the smallest hash of the id.

    A document with several labels counts as toxic if one says so; null labels and ids are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col(label_col).cast("int").alias("label")).where("labelled is not null and label in (0, 1)")
    known = known.groupBy("labelled").agg(F.max("label").alias("label")).where(~held_out(F.col("labelled")))
    known = cut(known.orderBy(F.xxhash64("labelled"), "labelled").limit(max_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("labelled"), F.col(text_col).cast("string").alias("text"))
    return fit(texts.join(F.broadcast(known), "labelled").select("text", "label"))  # max_rows rows of two numbers


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts score the model's bias.

    Without rows of both labels to learn from, every score is 1 or 0, whichever was seen, and 0 if none was.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return with_score(rows, model).drop("text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more.

    Null and empty texts score the model's bias, texts count whole, repeated rows stay or go together. Without rows of both
    labels to learn from, all stay, unless all labels are toxic. An empty table gives no rows. Extra columns pass through.
    """
    model, name = train(docs, labels), unused(docs, "score")
    return with_score(docs, model, name=name).where(F.col(name) < threshold).drop(name)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
