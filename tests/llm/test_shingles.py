"""Groups by similar sets of shingles, against all pairs."""

import random

import numpy as np
import pytest

from skein.llm import shingles as S
from test_components import groups


def jaccard(a, b):
    cut = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def brute(texts, similarity=0.8):
    links = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(texts[a] or "", texts[b] or "") >= similarity]
    own = groups(links)
    return [own.get(k, k) for k in range(len(texts))]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(df, **options):
    return {r["doc_id"]: r["component_id"] for r in S.similar_groups(df, **options).collect()}


def edited(draw, words, n):
    out = list(words)
    for _ in range(n):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        out[at : at + 1] = [f"n{draw.randrange(10**6)}"] if kind == 0 else [] if kind == 1 and len(out) > 1 else [out[at], "more"]
    return out


@pytest.mark.parametrize("tile", [4, 1024])
def test_all_sizes(spark, texts, tile):
    """Texts of 1 to 60 words with few edits, texts with a shared passage, and the odd ones."""
    draw, rows = random.Random(tile), list(texts)
    passage = [f"p{k}" for k in range(40)]
    for _ in range(160):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(1, 60))]
        rows += [" ".join(words), " ".join(edited(draw, words, draw.randint(1, 3)))]
        rows += [" ".join(passage + words[: draw.randrange(12)])]
    assert found(frame(spark, rows), tile=tile) == dict(enumerate(brute(rows)))


def test_sets_with_many_empty_blocks_meet(monkeypatch):
    """Where no empty block is allowed for, nearly all sets fall back on single shingles, and each pair still shares a key."""
    draw = np.random.default_rng(6)
    for spare in (None, 0):
        if spare is not None:
            low, blocks, _ = S.size_classes(0.8)
            monkeypatch.setattr(S, "size_classes", lambda s: (low, blocks * 3, np.zeros(len(low), int)))
        for n in (1, 4, 5, 9, 10, 30, 200, 1000):
            for _ in range(40):
                a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
                gone, new = divmod(int(draw.integers(0, max(1, n // 5) + 1)), 2)
                b = np.unique(np.r_[a[gone:], draw.integers(0, 2**63, new).astype(np.uint64)])
                if S.similar(a, b, 0.8):
                    rows, keys = S.block_keys([a, b], 0.8)
                    assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()), (n, gone, new)


def test_sketches_bound_the_distance():
    draw = np.random.default_rng(7)
    for n in (3, 500, 600, 5000):
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.r_[a[n // 7 :], draw.integers(0, 2**63, n // 5).astype(np.uint64)]
        apart = len(np.setxor1d(a, b))
        assert S.sketch_distance(S.sketch(a), S.sketch(b)) <= apart and S.sketch_distance(S.sketch(b), S.sketch(a)) >= apart // 3


def test_very_common_blocks_go_to_many_tasks(spark, monkeypatch):
    """The same groups, whether or not common keys are known beforehand."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = [" ".join(edited(draw, base, draw.randint(1, 4))) for _ in range(300)] + [" ".join(f"x{draw.randrange(10**6)}" for _ in range(50)) for _ in range(50)]
    want = dict(enumerate(brute(rows)))
    assert found(frame(spark, rows)) == want
    monkeypatch.setattr(S, "HOT", 9 * 16)
    assert S._common_keys(frame(spark, rows), 5, 0.8, len(rows)) is not None and found(frame(spark, rows), tile=32) == want


def test_edges(spark, no_docs, docs):
    assert S.similar_groups(no_docs).count() == 0
    got = [tuple(r) for r in S.similar_groups(spark.createDataFrame([(None, "x"), (None, None), (3, ""), (2, None), (4, "x"), (4, "x")], "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (None, None), (3, 2), (2, 2), (4, 4), (4, 4)], key=str)


def test_similar_texts_are_found_and_others_left_alone(spark):
    """Copies with some words changed, down to similarities well below the threshold."""
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("aeioubcdfgklmnprst") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], []
    for k in range(250):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(60, 400))]
        copy = list(words)
        for _ in range(round(len(words) * draw.choice([0, 0.005, 0.01, 0.015, 0.02, 0.08, 0.15]))):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    group = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [group[2 * k + 1] == 2 * k for k in range(250)]
    assert all(group[2 * k] == 2 * k for k in range(250))
    assert linked == [j >= 0.8 for j in pairs] and sum(j < 0.7 for j in pairs) > 40 and sum(linked) > 60


def test_large_similar_group(spark):
    """Many near copies of one text are one group, through tiles."""
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for k in range(150):
        own = list(base)
        own[draw.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(own)))
    got = {r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=16).collect()}
    assert got == {0}


def test_every_pair_of_the_threshold_is_found(spark):
    """Isolated pairs of similarity 0.80 to 0.88 and of less."""
    draw, rows, pairs = random.Random(21), [], []
    for k in range(400):
        words = [f"{draw.randrange(10**6)}" for _ in range(draw.randint(40, 300))]
        copy = list(words)
        for at in draw.sample(range(len(copy)), max(1, round(len(copy) * draw.choice([0.014, 0.018, 0.022, 0.03])))):
            copy[at] = "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    group = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [group[2 * k + 1] == 2 * k for k in range(400)] == [j >= 0.8 for j in pairs]
    assert sum(0.8 <= j < 0.83 for j in pairs) > 20 and sum(0.8 <= j < 0.88 for j in pairs) > 100 and sum(0.7 < j < 0.8 for j in pairs) > 40
