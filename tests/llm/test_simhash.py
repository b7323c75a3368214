import re
from collections import Counter

import pytest
import xxhash

from skein.llm import simhash as S
from test_components import groups


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    assert all(S.fingerprint(t) == fingerprint(t) for t in texts)
    assert S.fingerprint("A b C d E") == S.fingerprint("a B c D e") != S.fingerprint("a b c d e f")


def expected(texts):
    fps = [fingerprint(t) for t in texts]
    links = [(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 4]
    own = groups(links)
    return fps, [own.get(k, k) for k in range(len(fps))]


def test_groups(docs, texts):
    fps, want = expected(texts)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in S.simhash_groups(docs).collect()}
    assert got == {k: (fps[k], want[k]) for k in range(len(texts))}


def test_every_pair_within_the_distance_shares_a_key(spark):
    import random

    from pyspark.sql import functions as F

    draw = random.Random(4)
    rows = []
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 4):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    for blocks in (5, 6, 8):
        shared = F.arrays_overlap(S.block_keys(F.col("a"), blocks, 4), S.block_keys(F.col("b"), blocks, 4))
        assert df.where(shared).count() == len(rows)


def test_number_of_blocks():
    assert [S.blocks_for(n, 4) for n in (0, 10**7, 10**8, 10**10, 10**12)] == [6, 6, 7, 8, 8] and S.blocks_for(10, 0) == 2


@pytest.mark.parametrize("blocks", [5, 7, 8])
def test_any_number_of_blocks_finds_the_same_groups(docs, texts, blocks):
    _, want = expected(texts)
    assert {r["doc_id"]: r["component_id"] for r in S.simhash_groups(docs, blocks=blocks).collect()} == dict(enumerate(want))


def test_large_groups_go_through_tiles(spark):
    """A key that many fingerprints share is split, and no link is lost."""
    import random

    draw = random.Random(8)
    center = draw.getrandbits(60)
    fps = {center}
    while len(fps) < 400:
        x = draw.choice(sorted(fps)[:40])
        for bit in draw.sample(range(60), draw.randint(1, 3)):
            x ^= 1 << bit
        fps.add(x)
    order = sorted(fps)
    links = [(a, b) for k, b in enumerate(order) for a in order[:k] if (a ^ b).bit_count() <= 4]
    df = spark.createDataFrame([(x,) for x in order], "fp long")
    got = [(r["src"], r["dst"]) for r in S.hamming_links(df, tile=32).collect()]
    assert all((a ^ b).bit_count() > 0 for a, b in got) and groups(got) == groups(links)
    assert len(got) < 15 * 13 * 13 * 64


def test_keep_one(docs, texts):
    _, want = expected(texts)
    kept = S.keep_one(docs, S.simhash_groups(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_edges(spark, no_docs, docs):
    assert S.simhash_groups(no_docs).count() == 0 and S.keep_one(no_docs, S.simhash_groups(no_docs)).count() == 0
    twice = docs.unionByName(docs)
    assert Counter(r["doc_id"] for r in S.simhash_groups(twice).collect()) == Counter({k: 2 for k in range(docs.count())})
    assert S.simhash_groups(spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string")).count() == 2
