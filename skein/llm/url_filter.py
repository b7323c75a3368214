"""URL filter: ordered rules first, then trust and distrust propagated over the links between hosts.

Trust runs along the links from trusted hosts, distrust against them from blocked hosts; both are personalised PageRank
by power iteration on DataFrames. Only DataFrame functions are used.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut

EQUAL = 1e-9  # masses that differ by less, in proportion, are equal
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Where a page names another host: the address of a link, up to what ends the host or the attribute.
REFERENCE = r"""(?i:href|src)\s*=\s*["']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, AUTHORITY, 1), UPPER, LOWER), F.regexp_extract(text, AUTHORITY, 2)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(action, rule) of the longest fitting rule or null; of equally long ones the longer host, then the first listed."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for rule in sorted(reversed(rules), key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.action).alias("action"), F.lit(rule.text).alias("rule"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts: how many pages of ``src`` name ``dst``. Needs a column ``host``."""
    named = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(REFERENCE), F.lit(1)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(named).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 200) -> DataFrame:
    """(host, kind, mass): personalised PageRank of each ``kind`` from ``seeds`` (host, kind, weight) over ``edges`` (src, dst, kind, weight).

    The weights of a kind's seeds are scaled to sum to one. Mass on hosts without links of that kind returns to the
    seeds, so each kind keeps a total of one. Both kinds move in the same rounds until no host is reached for the first
    time and each kind's masses change by less than ``tolerance`` in all, at the latest after ``rounds``; this is looked at
    every fourth round, when the masses are written out.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = cut(seeds.join(F.broadcast(total), "kind").select("host", "kind", (F.col("weight") / F.col("all")).alias("start")))  # one row a kind
    out = edges.groupBy(F.col("src").alias("host"), "kind").agg(F.sum("weight").alias("out"))
    moves = cut(edges.withColumnRenamed("src", "host").join(out, ["host", "kind"]).select("host", "dst", "kind", (F.col("weight") / F.col("out")).alias("share")))
    now = start.withColumnRenamed("start", "mass")
    if moves.isEmpty():
        return now  # nothing moves: all mass returns to the seeds
    before = now
    for k in range(1, rounds + 1):
        moved = now.join(moves, ["host", "kind"]).groupBy(F.col("dst").alias("host"), "kind").agg(F.sum(damping * F.col("mass") * F.col("share")).alias("mass"))
        stays = moved.groupBy("kind").agg(F.sum("mass").alias("moved"))
        # what did not move along a link, damped or on hosts without links, returns to the seeds
        back = start.join(F.broadcast(stays), "kind", "left").select("host", "kind", (F.col("start") * (1 - F.coalesce("moved", F.lit(0.0)))).alias("mass"))
        now = moved.unionByName(back).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))
        if k % 4 == 0 or k == rounds:
            now = cut(now)
            change = now.join(before.withColumnRenamed("mass", "old"), ["host", "kind"], "full").groupBy("kind")
            change = change.agg(F.sum(F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("moved"), F.count_if(F.col("old").isNull()).alias("new"))
            if change.where((F.col("moved") >= tolerance) | (F.col("new") > 0)).isEmpty():
                break
            before = now
    return now


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row.

    A host most of whose pages a rule blocks is a seed of distrust with that share as weight; one with more pages
    allowed than blocked by rules is a seed of trust. A page without a rule is blocked if its host's distrust exceeds
    ``ratio`` times its trust. Null addresses and those without ``://`` have empty host and path and are allowed; null
    html has no links; repeated rows come back repeated; an empty table gives no rows. Columns other than the three named
    are ignored. Masses are compared in proportion, so it doesn't matter how many hosts share them.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    page = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    page = page.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    hosts = page.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("found.action") == "block").alias("blocked"), F.count_if(F.col("found.action") == "allow").alias("allowed")
    )
    bad = F.col("blocked") / F.col("pages")
    seeds = hosts.select("host", F.when(bad >= 0.5, "distrust").when(F.col("allowed") > F.col("blocked"), "trust").alias("kind"), F.when(bad >= 0.5, bad).otherwise(1 - bad).alias("weight")).where("kind is not null")
    links = cut(host_edges(page))
    edges = links.withColumn("kind", F.lit("trust")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind")))
    mass = propagate(edges, seeds)
    scores = mass.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    judged = page.drop("html").join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > ratio * F.col("trust") * (1 + EQUAL), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", by_host).alias("verdict"), "trust", "distrust")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
