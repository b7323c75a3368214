"""Language ID by Bayesian evidence fusion.

A document's posterior over languages multiplies
- the likelihood of its character trigrams under a model of each language, tempered, since trigrams aren't independent;
- P(declared language | language) and P(address suffix | language), from grouped counts over all documents;
- a prior of its host, smoothed towards its domain, which is smoothed towards the whole table.
The counts take a document for what its text alone says. Against the languages stands "und", text of no known language.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, released, slices, table, without_ids
from skein.plans.lineage import small_side

UND = "und"
BUCKETS = 1 << 16
NOT_LETTERS = re.compile(r"[\W\d_]+")


class TextModel(NamedTuple):
    langs: list[str]  # the last is UND
    logs: np.ndarray  # (languages, BUCKETS)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the trigrams of the lower-cased letters of each text, words set apart by one space."""
    parts = [NOT_LETTERS.sub(" ", f" {t.lower()} ") if t else "" for t in texts]
    parts = [p if len(p) > 2 else "" for p in parts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(chars) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(parts)), size)
    code = (chars[:-2] * np.uint32(0x9E3779B1) + chars[1:-1]) * np.uint32(0x85EBCA6B) + chars[2:]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    whole = rows[:-2] == rows[2:]
    return rows[:-2][whole], (code >> np.uint32(16)).astype(np.int64)[whole]


def fit(rows: DataFrame, smoothing: float = 0.1, enough: int = 10_000) -> TextModel:
    """A model of each ``lang`` of ``rows`` (text, lang); what reaches the driver is bounded by languages x buckets.

    A language of fewer trigrams than ``enough`` is smoothed by less, else the smoothing would hide its few texts.
    """

    def count(batches):
        for batch in slices(batches, text=0):
            langs = np.array(batch.column(1).to_pylist(), object)
            r, b = trigrams(batch.column(0).to_pylist())
            for lang in sorted(set(langs)):
                n = np.bincount(b[langs[r] == lang], minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    seen = rows.select("text", "lang").mapInArrow(released(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(seen["lang"].unique())
    if not langs:
        return TextModel([UND], np.zeros((1, BUCKETS), np.float32))
    logs = np.empty((len(langs) + 1, BUCKETS), np.float32)
    for k, lang in enumerate(langs):
        own, counts = seen[seen["lang"] == lang], np.zeros(BUCKETS)
        counts[own["bucket"].to_numpy(int)] = own["n"]
        add = smoothing * min(1.0, counts.sum() / enough) ** 2 or smoothing
        logs[k] = np.log((counts + add) / (counts.sum() + add * BUCKETS))
    logs[-1] = -np.log(max(1, seen["bucket"].nunique()))
    return TextModel([*langs, UND], logs)


def primary(tag: Column) -> Column:
    """``en`` of ``en-GB``; null for empty."""
    found = F.lower(F.regexp_extract(F.coalesce(tag.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,8})", 1))
    return F.when(found != "", found)


def train(docs: DataFrame, text_col: str, declared_col: str, id_col: str, per_lang: int = 1000) -> TextModel:
    """A model from a sample by hash of about ``per_lang`` documents of each declared language, however few declare it."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), primary(F.col(declared_col)).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")).where("text <> '' and lang is not null")
    sizes = rows.groupBy("lang").count().where(F.col("count") > per_lang).collect()
    if not sizes:
        return fit(rows)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], per_lang / r["count"])])[F.col("lang")]
    return fit(rows.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < F.coalesce(share, F.lit(1.0))))


def text_evidence(model: TextModel, temper: float = 0.5, enough: int = 80):
    """mapInArrow body: rows (key..., text) to rows (key..., logs array<double>); logs is null without letters.

    The mean log-likelihood of a trigram counts min(trigrams, ``enough``) times ``temper``.
    """

    def run(batches):
        for batch in slices(batches, text=batch_text):
            r, b = trigrams(batch.column(batch_text).to_pylist())
            n = np.bincount(r, minlength=batch.num_rows)
            weight = temper * np.minimum(n, enough) / np.maximum(n, 1)
            logs = np.stack([np.bincount(r, model.logs[k][b], batch.num_rows) * weight for k in range(len(model.langs))], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(logs.ravel()), len(model.langs)).cast(pa.list_(pa.float64()))
            lists = pc.if_else(pa.array(n > 0), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch_text)), lists], [*batch.schema.names[:batch_text], "logs"])

    batch_text = 4
    return run


def _index_of_max(logs: Column) -> Column:
    return F.array_position(logs, F.array_max(logs)).cast("int") - 1


def _sum(numbers: Column | str) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x)


def _constants(numbers: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in numbers])


def _smoothed(n: Column, wider: Column, pull: float) -> Column:
    """Shares of the counts ``n`` after ``pull`` more documents with the shares of the wider level."""
    return F.zip_with(n, wider, lambda a, p: (a + pull * p) / (_sum(n) + pull))


def host_priors(said: DataFrame, per_lang: Column, general: Column, pull: float) -> DataFrame:
    """(host, prior): shares of languages, smoothed towards the host's domain and that towards the table."""
    domains = said.where("domain <> ''").groupBy("domain").agg(per_lang.alias("n")).select("domain", _smoothed(F.col("n"), general, pull).alias("wider"))
    hosts = said.where("host <> ''").groupBy("host", "domain").agg(per_lang.alias("n")).join(domains, "domain", "left")
    return hosts.select("host", _smoothed(F.col("n"), F.coalesce("wider", general), pull).alias("prior"))


def evidence(said: DataFrame, per_lang: Column, by: str, top: list[float], add: float = 0.5) -> DataFrame:
    """(value, given_, any_): P(value of ``by`` | language) and P(value), by smoothed counts of every value there is."""
    counts = said.where(F.col(by) != "").groupBy(by).agg(per_lang.alias("n"))
    given = F.zip_with("n", _constants(top), lambda a, t: (a + add) / (t + 10 * add))
    return counts.select(F.col(by), given.alias(f"given_{by}"), ((_sum("n") + add) / (sum(top) + 10 * add)).alias(f"any_{by}"))


def fuse(seen: DataFrame, langs: list[str], pull: float, und_prior: float) -> DataFrame:
    """``seen`` with the log of the joint of each language in ``fused``; null without letters."""
    known = len(langs) - 1
    if not known:
        return seen.withColumn("fused", F.col("logs"))
    said = seen.where(F.col("best") < known)  # what the texts alone say; und has no part in the counts
    per_lang = F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(known)])
    top = said.agg(per_lang.alias("n")).first()["n"]
    general, ones = _constants([(x + 1) / (sum(top) + known) for x in top]), _constants([1.0] * known)
    rows = seen.join(host_priors(said, per_lang, general, pull), "host", "left")
    for by in ("declared", "suffix"):
        rows = rows.join(small_side(cut(evidence(said, per_lang, by, top))), by, "left")
    part = lambda name, default, i: F.log(F.get(F.coalesce(name, default), i))
    each = F.transform(F.sequence(F.lit(0), F.lit(known - 1)), lambda i: F.get("logs", i) + float(np.log(1 - und_prior)) + part("prior", general, i) + part("given_declared", ones, i) + part("given_suffix", ones, i))
    # und is as likely as any text to come with a declaration or a suffix
    und = F.get("logs", F.lit(known)) + float(np.log(und_prior)) + F.log(F.coalesce("any_declared", F.lit(1.0))) + F.log(F.coalesce("any_suffix", F.lit(1.0)))
    return rows.withColumn("fused", F.when(F.col("logs").isNotNull(), F.concat(each, F.array(und))))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", model: TextModel | None = None, pull: float = 10.0, und_prior: float = 0.01, least: float = 0.5) -> DataFrame:
    """(doc_id, lang, posterior, text_lang, accepted) for every row.

    ``pull``: how many documents the wider level counts as in a prior. A row is accepted if its language isn't "und" and
    the posterior reaches ``least``. Null, empty and letterless texts are "und" with posterior 1; null or unknown
    declarations and hosts bring no evidence; ties go to the first language by name; repeated rows come back repeated;
    an empty table gives no rows. Where no text declares a language there is no model to speak against any text, so all
    with letters are accepted. Whole texts count. Rows join the priors of their hosts by a shuffle, which Spark splits
    at a host with many rows.
    """
    none = F.lit(None).cast("string")
    model = model or train(docs, text_col, declared_col, id_col)
    declared = primary(F.col(declared_col)) if declared_col else none
    host = F.lower(F.col(host_col).cast("string")) if host_col else none
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), declared.alias("declared"), host.alias("host"), F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([a-z]{2,})$", 1).alias("suffix"), F.col(text_col).cast("string").alias("text"))
    seen = keyed.mapInArrow(released(text_evidence(model)), "doc_id long, declared string, host string, suffix string, logs array<double>")
    seen = cut(seen.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+|[^.]+)$", 1)).withColumn("best", _index_of_max(F.col("logs"))))
    names, top = F.array(*[F.lit(x) for x in model.langs]), F.array_max("fused")
    rows = fuse(seen, model.langs, pull, und_prior).withColumns(
        {
            "posterior": F.coalesce(1 / F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - top)), F.lit(1.0)),
            "lang": F.coalesce(F.get(names, _index_of_max(F.col("fused"))), F.lit(UND)),
            "text_lang": F.coalesce(F.get(names, F.col("best")), F.lit(UND)),
        }
    )
    accepted = (F.col("lang") != UND) & (F.col("posterior") >= least) if len(model.langs) > 1 else F.col("logs").isNotNull()
    return rows.select("doc_id", "lang", "posterior", "text_lang", accepted.alias("accepted"))


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) of web pages: the text without markup, the declared language, the host."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), bare.alias("text"), F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("lang"), F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://([^/?#:]*)", 1).alias("source"))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language isn't accepted.

    Null, empty and letterless texts go, rows of null id stay, repeated rows stay or go together. Texts count whole. An
    empty table gives no rows. Extra columns pass through.
    """
    return without_ids(docs, identify(docs).where("not accepted").select("doc_id"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def language_id_of_pages(spark, sf_dir: str) -> DataFrame:
    """The operator on web pages: declared markup language, suffixes, and hosts smoothed to their domains."""
    return identify(pages_as_documents(table(spark, sf_dir, "pages"))).withColumnRenamed("doc_id", "page_id")
