"""The pipeline's near-dedup stage goes through SimHash, and an exact check follows."""

import random

import corpus_pipeline as P
from skein.llm import simhash
from test_shingles import brute


def corpus():
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(500)}" for _ in range(200)) for _ in range(6)]
    for base in texts[:4]:
        for changes in (1, 2, 5, 60):
            words = base.split()
            for at in draw.sample(range(len(words)), changes):
                words[at] = f"x{draw.randrange(999)}"
            texts.append(" ".join(words))
    return texts + ["", "one two", "one two", "one three", texts[0]]


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    texts, seen = corpus(), []
    real = simhash.hamming_links
    monkeypatch.setattr(simhash, "hamming_links", lambda fps, *a: seen.append(fps.count()) or real(fps, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in P.near_dedup(spark, docs, "").collect())
    assert seen and seen[0] > 10  # fingerprints met by their blocks
    assert kept == sorted(set(brute(texts)))


def test_near_pairs_span_the_groups(spark):
    fps = [0, 1, 3, 0xF0F0 << 40, (0xF0F0 << 40) | 15, 0xFFFF, 0]
    sets = spark.createDataFrame([(k, fp) for k, fp in enumerate(fps)], "node long, fp long")
    root = list(range(len(fps)))
    for r in simhash.near_pairs(sets).collect():
        assert r["leader"] < r["node"]
        low, high = sorted((root[r["leader"]], root[r["node"]]))
        root = [low if x == high else x for x in root]
    assert root == [0, 0, 0, 3, 3, 5, 0]
