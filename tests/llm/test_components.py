import random

import numpy as np
import pytest

from skein.llm.common import connected_components, slices, spanning_links, without_ids


def groups(pairs):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in label}


@pytest.mark.parametrize("last", [0, 40, 50_000])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "clique"])
def test_components(spark, kind, last):
    """By rounds alone, by rounds and one task, by one task."""
    draw = random.Random(kind)
    pairs = {
        "chain": [(k, k + 1) for k in range(200)],
        "star": [(500, k) for k in range(300)],
        "random": [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)],
        "clique": [(a, b) for a in range(25) for b in range(25)],
    }[kind]
    df = spark.createDataFrame([*pairs, *pairs[:5]], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df, last).collect()}
    assert got == groups([p for p in pairs if p[0] != p[1]])


def test_no_links(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")
    assert connected_components(df).count() == 0


def test_spanning_links_keep_groups():
    draw = np.random.default_rng(2)
    for n in (1, 5, 60):
        a, b = draw.integers(0, n, n), draw.integers(0, n, n)
        x, y = spanning_links(n, a, b)
        want = groups([*zip(a.tolist(), b.tolist())])
        assert len(x) < n and all(want[i] == want[j] for i, j in zip(x.tolist(), y.tolist()))
        assert {i: groups([*zip(x.tolist(), y.tolist())]).get(i, i) for i in want} == want


def test_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c", ""])], ["t"])
    cut = [b.column(0).to_pylist() for b in slices([batch], rows=2, chars=50, text=0)]
    assert sum(cut, []) == batch.column(0).to_pylist() and all(len(c) <= 2 for c in cut)


def test_without_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id long, __x string")
    gone = spark.createDataFrame([(1,), (1,), (9,)], "doc_id long")
    assert sorted(r["__x"] for r in without_ids(docs, gone).collect()) == ["c", "d"]
