"""Ranking of documents by TF-IDF over code-aware terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import code_tokens
from skein.plans.lineage import cut

LIMIT, MOST = 15, 30  # fixed values


def postings(docs: DataFrame, text: Column | str = "text", key: str = "doc_id", terms: list[str] | None = None) -> DataFrame:
    """(token, doc_id, tf): the index of a corpus, worth writing once, laid out by token.

    With ``terms`` only their entries are made: texts that hold none of them are left out before they are split.
    """
    text = F.col(text) if isinstance(text, str) else text
    tokens = code_tokens(text)
    if terms is not None:
        low, found = F.lower(text), F.lit(False)
        for t in terms:
            found = found | low.contains(t)
        docs, tokens = docs.where(found), F.filter(tokens, lambda t: t.isin(terms))
    return docs.select(F.col(key).alias("doc_id"), F.explode(tokens).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("tf"))


def frequencies(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """(token, df, tf) over a corpus of one row a document: counted inside the rows' tasks, so only sums by token are shuffled."""
    docs = docs.select(code_tokens(F.col(text) if isinstance(text, str) else text).alias("tokens"))  # made once, read twice
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("df"), F.lit(0).alias("tf")))
    each = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit(0).alias("df"), F.lit(1).alias("tf")))
    rows = docs.select(F.explode(F.concat(once, each)).alias("r"))
    return rows.groupBy("r.token").agg(F.sum("r.df").alias("df"), F.sum("r.tf").alias("tf"))


def query_terms(text: str) -> list[str]:
    """The distinct terms of a query, in order; it is lower-cased before it is split."""
    import re

    words = re.split(r"[^a-zA-Z0-9_$]+", text.lower())
    return list(dict.fromkeys(w for w in words if len(w) >= 2 and not re.fullmatch(r"[0-9_$]+", w)))


def tfidf(index: DataFrame, total: int, terms: list[str]) -> DataFrame:
    """(doc_id, score) of the documents that hold a term: the cosine over the query's terms alone."""
    wanted = cut(index.where(F.col("token").isin(terms)))  # read twice
    df = {r["token"]: r["n"] for r in wanted.groupBy("token").agg(F.count("*").alias("n")).collect()}  # as many rows as terms
    idf = {t: math.log((total + 1) / (df.get(t, 1) + 1)) + 1 for t in terms}
    norm = math.sqrt(sum(w * w for w in idf.values()))
    if not norm:
        return wanted.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])[F.col("token")]
    parts = wanted.groupBy("doc_id").agg(F.sum(weight * weight * F.col("tf")).alias("dot"), F.sqrt(F.sum((weight * F.col("tf")) ** 2)).alias("length"))
    return parts.select("doc_id", (F.col("dot") / (norm * F.col("length"))).alias("score"))


def name_boost(name: Column, query: str) -> Column:
    """0.5 for the query itself, else 0.3 for holding it; 0.2 more for beginning with it."""
    low, q = F.lower(name), query.lower()
    return F.when(low == q, 0.5).when(low.contains(q), 0.3).otherwise(0.0) + F.when(low.startswith(q), 0.2).otherwise(0.0)


def search(docs: DataFrame, query: str, limit: int | None = None, kind: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, name, kind, score) of the best of ``docs`` (doc_id, name, kind, text), best first, ties by doc_id.

    ``kind`` restricts the corpus itself, so it changes the weights. A prebuilt ``index`` must be of the same corpus.
    """
    corpus = docs.where(F.col("kind") == kind) if kind else docs
    terms = query_terms(query)
    if index is None:
        index = postings(corpus, "text", terms=terms)
    scored = corpus.join(tfidf(index, corpus.count(), terms), "doc_id", "left")
    total = F.coalesce("score", F.lit(0.0)) + name_boost(F.col("name"), query)
    found = scored.select("doc_id", "name", "kind", total.alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), "doc_id").limit(min(LIMIT if limit is None else limit, MOST))
