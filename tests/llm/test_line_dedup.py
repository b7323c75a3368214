import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import line_dedup as L
from test_components import groups


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def chars(text):
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=18), st.text("ab", max_size=18)), min_size=1, max_size=12), st.integers(1, 4))
def test_banded_distance(pairs, edits):
    got = L.edit_distances([(chars(a), chars(b)) for a, b in pairs], edits)
    assert got.tolist() == [min(distance(a, b), edits + 1) for a, b in pairs]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=12, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.sampled_from("xab-")), max_size=3))
def test_near_lines_share_a_key(line, changes):
    other = list(line)
    for at, c in changes:
        at = min(at, len(other) - 1)
        if c == "-":
            del other[at]
        elif c == "x":
            other.insert(at, "x")
        else:
            other[at] = c
    other = "".join(other)
    edits = max(1, distance(line, other))
    if line != other and edits <= 3 and min(len(line), len(other)) > edits:
        sides = [L.signatures([x], np.array([n]), edits, L.Powers()) for x, n in ((line, 2), (other, 4))]
        index = [set(k[o & 1 == 1].tolist()) for k, o in sides]
        every = [set(k.tolist()) for k, _ in sides]
        assert index[0] & every[1] or index[1] & every[0]


def edited(draw, text, n):
    out = list(text)
    for _ in range(n):
        at = draw.randrange(len(out))
        out[at : at + 1] = draw.choice([[], [draw.choice("xyz")], [out[at], "q"]])
    return "".join(out)


@pytest.fixture(scope="module")
def lines():
    """Documents of lines with copies, near copies, short lines, white space around them and a hot line."""
    draw = random.Random(6)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(24, 90))).strip().ljust(24, "z") for _ in range(80)]
    docs = []
    for k in range(40):
        own = [edited(draw, draw.choice(base), draw.randint(0, 3)) for _ in range(draw.randint(0, 6))]
        own += ["short", "  " + base[0] + "\t", "the very common line of them all"]
        draw.shuffle(own)
        docs.append("\n".join(own))
    return [*docs, None, "", "\n\n", "one line without an end of forty characters " * 300]


def expected(texts, edits=2, least=20):
    every = [(k, n, x.strip()) for k, t in enumerate(texts) if t for n, x in enumerate(t.split("\n")) if len(x.strip()) >= least]
    distinct = sorted({x for *_, x in every})
    links = [(a, b) for j, b in enumerate(distinct) for a in distinct[:j] if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits]
    own = groups(links)
    seen, gone = set(), set()
    for k, n, x in every:
        name = own.get(x, x)
        if name in seen:
            gone.add((k, n))
        seen.add(name)
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone) for k, t in enumerate(texts)]


def test_dedup_equals_brute_force(spark, lines):
    rows = [(k, t, None if t is None else len(t), 1, "c") for k, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, a long, line_no string")
    out = L.dedup_lines(df, count_col="n_chars")
    assert out.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    want = expected(lines)
    assert got == {k: (t, None if t is None else len(t)) for k, t in enumerate(want)}
    assert sum(a != b for a, b in zip(lines, want)) > 20


def test_a_key_that_many_lines_share_goes_through_tiles(spark):
    """Lines with one half in common: all share a key, few are near."""
    draw = random.Random(3)
    head = "".join(draw.choice("abcdefgh") for _ in range(60))
    texts = [head + "".join(draw.choice("stuvw") for _ in range(20)) for _ in range(60)]
    texts += [edited(draw, t, 1) for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = {L.node_of(t)[0]: t for t in texts}
    want = [(a, b) for a in nodes for b in nodes if a < b and distance(nodes[a], nodes[b]) <= 2]
    got = [(r["src"], r["dst"]) for r in L.near_lines(df, tile=8).collect()]
    assert groups(got) == groups(want) and all(distance(nodes[a], nodes[b]) > 0 for a, b in got)


def test_very_common_keys_go_to_many_tasks(spark, lines, monkeypatch):
    """The same links, whether or not common keys are known beforehand."""
    draw = random.Random(5)
    head = "".join(draw.choice("abcdefgh") for _ in range(60))
    texts = [edited(draw, head + "".join(draw.choice("stuvw") for _ in range(20)), draw.randint(0, 1)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate([*texts, *lines])), "doc_id long, text string")
    plain = groups([(r["src"], r["dst"]) for r in L.near_lines(df).collect()])
    monkeypatch.setattr(L, "HOT", 9 * 16)
    assert L.common_keys(df, 2, 20) is not None
    assert groups([(r["src"], r["dst"]) for r in L.near_lines(df).collect()]) == plain


def test_edges(spark, no_docs):
    assert L.dedup_lines(no_docs).count() == 0
    long = "a line of more than twenty characters"
    odd = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in L.dedup_lines(odd).collect())
    assert got == [(False, 1, long), (False, 1, long), (False, 2, ""), (True, 0, long)]


def test_digest_by_brute_force(spark, lines):
    """The query's columns, null and empty texts included."""
    count = lambda t: len(t.split("\n")) if t else 0
    got = {r["doc_id"]: tuple(r)[1:] for r in L.line_digest(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    want = {k: (count(a), count(b), None if b is None else hashlib.sha256(b.encode()).hexdigest()) for k, (a, b) in enumerate(zip(lines, expected(lines)))}
    assert got == want and want[40] == (0, 0, None) and want[41][:2] == (0, 0) and want[42][:2] == (3, 3)


def test_clashing_columns(spark, lines):
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(lines)], "doc_id long, text string, gone_of int, Gone_Lines int, gone int")
    out = L.dedup_lines(df)
    assert out.columns == df.columns and {r["doc_id"]: r["text"] for r in out.collect()} == dict(enumerate(expected(lines)))
