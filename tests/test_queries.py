"""Every query against its oracle in DuckDB, as the driver does."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from skein import project_queries, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", [*queries.ORACLES, *project_queries.ORACLES])
def test_oracle(spark, oracle, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = oracle.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"id", "depth", "relation", "parent"} and df.count() > 0


def test_layout_is_the_same_every_time(spark, sf_dir):
    a, b = (sorted(map(tuple, entry.queries()["layout_force"](spark, sf_dir).collect())) for _ in range(2))
    assert [i for i, *_ in a] == [i for i, *_ in b]
    assert all(math.isclose(x, y, abs_tol=1e-6) for p, q in zip(a, b) for x, y in zip(p[1:], q[1:]))  # sums in any order
