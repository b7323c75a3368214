import random

import numpy as np

from skein.llm import blocks
from skein.llm import line_dedup as L
from test_line_dedup import edited, expected


def test_blocks_keep_every_value():
    draw = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a, b = draw.integers(-(1 << 63), (1 << 63) - 1, (2, n))
        found = list(blocks.read([blocks.blocks([a, b], blocks.bucket_of(a, 24), 1)], 0, 2))
        assert all((blocks.bucket_of(rows[0], 24) == bucket).all() and kind == 1 for bucket, kind, rows in found)
        assert len({bucket for bucket, *_ in found}) == len(found) <= 24
        assert sorted(tuple(x) for *_, rows in found for x in rows.T.tolist()) == sorted(zip(a.tolist(), b.tolist()))


def shuffled(spark) -> int:
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_lines_that_meet_nothing_are_no_rows_of_a_shuffle(spark):
    """Distinct lines have 12 keys each and one place; the documents themselves and a sample of keys are shuffled."""
    draw = random.Random(9)
    texts = ["\n".join("".join(draw.choice("abcdefghijklmnop ") for _ in range(40)).strip().ljust(30, "z") for _ in range(50)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = shuffled(spark)
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()} == dict(enumerate(texts))
    assert 40 <= shuffled(spark) - before < 5 * 40 * 50


def test_large_buckets_and_common_names_give_the_same(spark, monkeypatch):
    """Blocks of few values, buckets looked at in parts and lines that share the first half of their name."""
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(24, 60))).strip().ljust(24, "z") for _ in range(30)]
    texts = ["\n".join(edited(draw, draw.choice(base), draw.randint(0, 3)) for _ in range(5)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(L, "HELD", 40)
    monkeypatch.setattr(L, "WHOLE", 10)
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()} == dict(enumerate(expected(texts)))


def test_occurrences_of_lines_that_share_a_name():
    """Lines are told apart by both halves of their name; the place that stays is not among the others."""
    known = np.array([(2, 7, 1, 0), (2, 5, 3, 1), (4, 5, 3, 2)]).T
    rows = np.array([(2, 5, 3, 1), (2, 5, 4, 0), (2, 6, 9, 9), (2, 7, 1, 0), (2, 7, 1, 4), (3, 5, 1, 1), (4, 5, 3, 3)]).T
    got = L._elsewhere(known, rows).to_pydict()
    assert list(zip(*got.values())) == [(4, 0, 2), (1, 4, 2), (3, 3, 4)]
    assert L._elsewhere(known[:, :0], rows).num_rows == 0
