"""The pipeline's stages against the operators' definitions, and the entry without this subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skein.llm import queries
from test_components import groups
from test_line_dedup import expected
from test_shingles import brute

TOP = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    place, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{place}/{name}")
        docs = out[name] = spark.read.parquet(f"{place}/{name}")
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_filters_keep_the_clean(spark, stages):
    """Every document of this table is in one of its languages; labelled clean ones pass the toxicity stage."""
    assert len(ids(stages["language_id"])) >= 0.99 * len(ids(stages["documents"]))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen, kept = set(ids(stages["language_id"])), set(ids(stages["toxicity"]))
    clean = [k for k in seen if labels.get(k) == 0]
    assert sum(k in kept for k in clean) >= 0.98 * len(clean)


def test_line_dedup_stage(stages):
    before, after = texts(stages["toxicity"]), texts(stages["line_dedup"])
    order = sorted(before)
    want = expected([before[k] for k in order])
    assert after == dict(zip(order, want))
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"].collect())


def test_near_dedup_stage(stages):
    """Against all pairs by brute force: similarity 0.8 or more of the sets of five words."""
    before = texts(stages["line_dedup"])
    order = sorted(before)
    own = brute([before[k] for k in order])
    assert ids(stages["near_dedup"]) == sorted({order[k] for k in own}) and len(set(own)) < len(own)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, docs, empty, tmp_path):
    """Nulls in any column, repeated rows, empty and very long texts, columns named as the stages name their own, no rows."""
    none = docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]).limit(1)
    no_id, no_text = none.withColumn("text", F.lit("words without an id " * 30)), none.withColumn("doc_id", F.lit(900).cast("long"))
    rows = docs.unionByName(docs.limit(20)).unionByName(none).unionByName(no_id).unionByName(no_text).unionByName(docs.limit(3).withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1000))
    rows = rows.limit(0) if empty else rows
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    for name, stage in P.STAGES:
        stage(spark, rows, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == rows.columns, name
            assert after.count() <= rows.count() and (empty or after.where("doc_id is null").count() == 2), name
        rows = after
    assert (rows.count() == 0) == empty


def test_packing_stage(stages):
    rows = stages["packing"].toPandas()
    assert set(rows["doc_id"]) == set(ids(stages["near_dedup"])) and (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].first()).all()


def test_run_equals_the_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["doc_tokens"])
    assert sorted(map(key, P.run(spark, SF).dropDuplicates(["doc_id"]).collect())) == sorted(map(key, stages["packing"].dropDuplicates(["doc_id"]).collect()))


def test_queries(spark):
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")) == list(range(1, 11))
    for name, query in queries.QUERIES.items():
        assert query(spark, SF).count() > 0, name


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[k]) for k in at) for r in rel.fetchall())


def test_the_rest_works_without_the_subpackage(tmp_path):
    top = tmp_path / "repo"
    shutil.copytree(TOP, top, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=120)
