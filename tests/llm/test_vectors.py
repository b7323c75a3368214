import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import embed_dedup, topk
from test_components import groups

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, block int"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [0.5] * 5]


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(40, 8))
    rows = [x.tolist() for x in base] + [(x + draw.normal(size=8) * 0.15).tolist() for x in base[:30]] + [(3.5 * x).tolist() for x in base[:5]] + [base[0].tolist()] * 30 + ODD
    rows = [None if x is None else [None if y is None else float(np.float32(y)) for y in x] for x in rows]
    order = draw.permutation(len(rows)).tolist()
    ids = [100 * k if k % 7 == 0 else 100 * k + 1 for k in order]
    data = [(i, x, 0, 1, "x", 2) for i, x in zip(ids, rows)]
    return spark.createDataFrame(data, SCHEMA), dict(zip(ids, rows))


def usable(x, zero=False):
    return bool(x) and all(y is not None and np.isfinite(y) for y in x) and (zero or any(x))


@pytest.mark.parametrize("per_block", [7, 4096])
def test_near_vectors(vectors, per_block):
    df, by_id = vectors
    good = {i: np.array(x, np.float64) for i, x in by_id.items() if usable(x)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9]
    own = groups(links)
    n = {i: sum(i in p for p in links) for i in by_id}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(df, per_block=per_block).collect()}
    assert got == {i: (n[i], own.get(i, i), own.get(i, i) == i) for i in by_id}


def test_quantisation_bound():
    draw = np.random.default_rng(1)
    for dims in (3, 64, 1500):
        x = draw.normal(size=(50, dims)) * draw.exponential(size=(50, dims)) ** 3
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q, s, e = embed_dedup.quantise(x)
        off = np.abs(x @ x.T - s[:, None] * s[None] * (q.astype(float) @ q.astype(float).T))
        assert np.abs(q).max() <= 127 and (off <= e[:, None] + e[None] + e[:, None] * e[None] + 1e-12).all()


def settled(x, threshold=0.9):
    """Pairs that are sure, and pairs that are linked in double precision among those left open; how many those were."""
    q = embed_dedup.quantise(embed_dedup.unit(x))
    sure, open_ = set(), []
    for i, j, s in embed_dedup.judged(q, q, threshold, True):
        sure |= set(zip(i[s].tolist(), j[s].tolist()))
        open_ += zip(i[~s].tolist(), j[~s].tolist())
    i, j = np.array(open_, np.int64).reshape(-1, 2).T
    hit = embed_dedup.linked(x, x, i, j, threshold)
    return sure | set(zip(i[hit].tolist(), j[hit].tolist())), len(open_)


def test_tiny_and_huge_vectors():
    links, _ = settled(np.array([[1e-300, 2e-300], [3e300, 6e300], [1.0, -1.0]]))
    assert links == {(0, 1)}


def test_few_pairs_are_recomputed():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 64))
    links, again = settled(x)
    assert len(links) == 0 and again < 600 * 599 / 2 / 100
    near = x[:1] + 0.02 * draw.normal(size=(300, 64))
    links, again = settled(near)
    assert len(links) == 300 * 299 / 2 and again < 300  # far above the threshold, too, nothing is


def test_rows_that_repeat_an_id(spark):
    """One row comes back for each, unusable vectors beside usable ones included."""
    a, b, c = [1.0, 0.0, 0.1], [0.9, 0.1, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, None), (2, b), (2, [0.0] * 3), (3, c), (3, c), (3, [float("nan")] * 3), (1, c), (4, [-0.0, 2.0, 0.0]), (None, a), (None, None)]
    got = sorted((tuple(r) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_block=2).collect()), key=str)
    want = [(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (2, 0, 2, True), (3, 3, 1, False), (3, 3, 1, False), (3, 0, 3, True), (1, 3, 1, True), (4, 3, 1, False), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_open_pairs_cross_tiles(spark):
    """Cosines all around the threshold, in blocks of a few vectors, against all pairs in double precision."""
    draw = np.random.default_rng(8)
    x = np.array([1.0] + [0.0] * 15) + draw.normal(size=(150, 16)) * 0.09
    cosine = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    links = [(a, b) for b in range(150) for a in range(b) if cosine[a, b] >= 0.9]
    assert 1000 < len(links) < 10000
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df, per_block=40).collect()}
    own = groups(links)
    assert got == {k: (sum(k in p for p in links), own.get(k, k)) for k in range(150)}


@pytest.mark.parametrize(("per_block", "per_query_block"), [(9, 2), (8192, 1024)])
def test_top_k(vectors, per_block, per_query_block):
    df, by_id = vectors
    good = {i: np.floor(np.array(x, np.float64) * 1024).astype(np.int64) for i, x in by_id.items() if usable(x, zero=True)}
    want = set()
    for q in (i for i in good if i % 100 == 0):
        scored = sorted((-int(good[q] @ good[c]), c) for c in good if c != q and len(good[c]) == len(good[q]))
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:10])}
    got = topk.top_k(df, F.col("id") % 100 == 0, per_block=per_block, per_query_block=per_query_block)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_top_k_repeated_rows(spark):
    """Every row is a candidate of its own; a query has no part in its own answer, nor have rows of its id."""
    rows = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [3.0, 3.0]), (7, [3.0, 3.0]), (8, [3.0, 3.0]), (9, [2.0**40, 1.0]), (9, [1.0]), (5, None)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0, k=3, per_block=2)
    big, same = 1024 * 1024 * 2**40 + 2 * 1024 * 1024, 9 * 1024 * 1024
    want = [(100, 1, 9, big), (100, 2, 7, same), (100, 3, 7, same)] * 2
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pruning_is_exact():
    draw = np.random.default_rng(9)
    c = np.floor(draw.normal(size=(3000, 48)) * draw.exponential(size=48) ** 2 * 1024).astype(np.int64)
    ids = np.arange(3000)
    q_ids, c_ids, scores, places, done = topk.best_of_block(c[:5], c, ids[:5], ids, 10, step=8)
    assert done < 5 * 3000 * 48 * 0.7 and places.tolist() == q_ids.tolist()  # fewer multiplications than of all dimensions
    best = {q: scores[q_ids == q].min() for q in range(5)}
    again = topk.best_of_block(c[:5], c, ids[:5], ids, 10, step=8, floors=np.array([best[q] for q in range(5)], float))
    assert again[4] < done and again[1].tolist() == c_ids.tolist()  # a known score prunes from the start
    for q in range(5):
        s = c @ c[q]
        want = [k for k in np.lexsort((ids, -s)) if k != q][:10]
        assert sorted(c_ids[q_ids == q].tolist()) == sorted(want) and sorted(scores[q_ids == q].tolist()) == sorted(s[want].tolist())


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embed_dedup.near_vectors(none).count() == 0 and topk.top_k(none, F.col("id") % 100 == 0).count() == 0
    odd = spark.createDataFrame([(k, x, 0, 0, "", 0) for k, x in enumerate(ODD[:2])], SCHEMA)
    assert [tuple(r) for r in embed_dedup.near_vectors(odd).orderBy("vec_id").collect()] == [(0, 0, 0, True), (1, 0, 1, True)]
    assert topk.top_k(odd, F.col("id") % 100 == 0).count() == 0
