import hashlib
import json
import zlib
from pathlib import Path
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, packing, tokenbin
from skein.llm.tokens import SPLIT, tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
SLOW = Tokenizer.from_file(JSON)
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


def ids_of(text):
    return SLOW.encode(text or "", add_special_tokens=False).ids


def test_pattern():
    assert SPLIT == P.PATTERN


def test_fast_and_slow_agree(texts):
    t = tokens(JSON)
    assert t.fast is not None
    for text in [*texts, "x<|endoftext|>y", "\u0085a b​  c", "don't 12 ²½ \t\n  x"]:
        assert t.ids(text).tolist() == ids_of(text)
    pieces = [k for k, v in sorted(SLOW.get_vocab().items(), key=lambda x: x[1])][::7]
    assert all(t.ids(p).tolist() == ids_of(p) for p in pieces)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=40))
def test_fast_and_slow_agree_on_anything_plain(text):
    assert tokens(JSON).ids(text).tolist() == ids_of(text)


@pytest.fixture(scope="module")
def packed(docs):
    return packing.pack(docs, per_bucket=20).toPandas()


def test_packing_covers_every_id_once(packed, texts):
    ids = {k: np.array([*ids_of(t), 0], "<u4") for k, t in enumerate(texts)}
    for k, own in packed.groupby("doc_id"):
        own = own.sort_values("start")
        assert (own["start"].to_numpy() == np.cumsum(own["length"]) - own["length"]).all()
        assert own["length"].sum() == len(ids[k]) == own["doc_tokens"].iloc[0]
        for p in own.itertuples():
            assert zlib.crc32(ids[k][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert set(packed["doc_id"]) == set(ids)


def test_packing_sequences(packed):
    padded = 0
    for _, own in packed.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.cumsum(own["length"]) - own["length"]).all()
        n = own["length"].sum()
        assert n <= 1024 and own["tier"].nunique() == own["step_group"].nunique() == 1
        padded += 0 if n & (n - 1) == 0 else 1024 - n
        assert n == own["tier"].iloc[0] or n < 128 or n & (n - 1)
    buckets = packed["sequence_id"].floordiv(1 << packing.NUMBERS).nunique()
    assert padded <= 1024 * buckets
    groups = packed.groupby(["step_group", "tier"])["length"].sum()
    assert (groups <= 16384).all()


@given(st.lists(st.integers(1, 1023), max_size=120))
@settings(max_examples=150, deadline=None)
def test_rests_are_packed_whole(lengths):
    found = packing.pack_rests(lengths)
    used = defaultdict(list)
    for tier, sequence in found:
        assert 0 < sum(n for *_, n in sequence) <= tier
        for item, start, n in sequence:
            used[item].append((start, n))
    for item, length in enumerate(lengths):
        at = 0
        for start, n in sorted(used[item]):
            assert start == at and n > 0
            at += n
        assert at == length
    short = [t for t, s in found if sum(n for *_, n in s) != t]
    assert len(short) <= 1


def test_long_documents_are_packed_in_runs(spark, monkeypatch):
    """Windows of one long document go to several groups; sequences stay apart."""
    monkeypatch.setattr(packing, "RUN", 7)
    rows = packing.pack(spark.createDataFrame([(1, "river stone " * 30_000), (2, "a")], "doc_id long, text string")).toPandas()
    whole = rows[rows["length"] == 1024]
    assert len(whole) > 50 and whole["sequence_id"].is_unique and whole["sequence_id"].floordiv(1 << packing.NUMBERS).value_counts().max() <= 7
    assert rows[rows["doc_id"] == 1]["length"].sum() == rows[rows["doc_id"] == 1]["doc_tokens"].iloc[0]


def test_packing_edges(spark, no_docs):
    assert packing.pack(no_docs).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (7, "x"), (7, "x")], "doc_id long, text string")
    rows = packing.pack(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == {None: 1, 7: 2} and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_bpe_digests(docs, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode_digest(docs, dictionary=300).collect()}
    for k, t in enumerate(texts):
        ids = WANT.encode_ordinary(t or "")
        assert got[k] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_by_higher_order_functions(spark, texts):
    short = [(k, t) for k, t in enumerate(texts) if t is None or len(t) < 400]
    df = spark.createDataFrame(short, "doc_id long, text string")
    rows = bpe.encode(df).withColumn("back", bpe.decode(F.col("ids"))).collect()
    want = dict(short)
    assert all(r["ids"] == WANT.encode_ordinary(want[r["doc_id"]] or "") and bytes(r["back"]).decode() == (want[r["doc_id"]] or "") for r in rows) and len(rows) == len(short)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30), min_size=1, max_size=20))
def test_folds_agree(words):
    ranks = bpe.ranks_of(RANKS)
    table = tuple(np.array(x, np.int32) for x in bpe.pair_table(RANKS))
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    flat, counts = bpe.fold_batch(words, single, table)
    want = [bpe.merge_long(w, ranks) for w in words]
    assert counts.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])
    assert want == [WANT._encode_single_piece(w) for w in words]


def test_bpe_edges(spark, no_docs):
    assert bpe.encode_digest(no_docs).count() == 0
    twice = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in bpe.encode_digest(twice).collect()) == {None: 1, 1: 2}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_permutes(n):
    a, b = (tokenbin.feistel(np.arange(n), n, key) for key in "ab")
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 64 or (a != b).any())


def test_order_round_trip(docs, texts, tmp_path):
    out = f"file://{tmp_path}/order"
    about = tokenbin.write_order(docs, out, length=64, per_shard=10)
    rows = tokenbin.written_records(docs.sparkSession, out).collect()
    shards = sum(-(-n // 10) for n in about["ranges"])
    assert len(list((tmp_path / "order").glob("shard-*.bin"))) == len(list((tmp_path / "order").glob("shard-*.idx"))) == shards > len(about["ranges"])
    assert sorted(r["slot"] for r in rows) == list(range(about["sequences"])) and len(rows) == about["sequences"]
    got = np.concatenate(list(tokenbin.read_order(out)))
    ids = {k: [*ids_of(t), tokenbin.END] for k, t in enumerate(texts)}
    for r in rows:
        record = got[r["slot"]]
        assert record[: r["length"]].tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(record.astype("<u2").tobytes()) == r["record_crc32"]
        with open(tmp_path / "order" / f"{r['shard']}.bin", "rb") as f:
            f.seek(r["byte_offset"])
            assert f.read(128) == record.astype("<u2").tobytes()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for slot in (0, 1, 117, about["ranges"][0], about["sequences"] - 1):
        assert (np.concatenate(list(tokenbin.read_order(out, slot=slot, rows=9))) == got[slot:]).all()
    assert not list(tokenbin.read_order(out, slot=about["sequences"]))
    assert json.loads((tmp_path / "order/order.json").read_text()) == about and not list((tmp_path / "order").glob("_partial*"))


def test_slots_are_ranks_of_feistel_images(spark, docs, texts, tmp_path):
    """The order is that of the images of the sequences' places in the input."""
    tokenbin.write_order(docs.coalesce(1), f"{tmp_path}/order", key="k", length=64)
    every = [(k, s) for k, t in enumerate(texts) for s in range(0, len(ids_of(t)) + 1, 64)]
    images = tokenbin.feistel(np.arange(len(every)), tokenbin.PARTS * tokenbin.PLACES, "k")
    want = [every[k] for k in np.argsort(images)]
    got = tokenbin.written_records(spark, f"{tmp_path}/order").orderBy("slot").collect()
    assert [(r["doc_id"], r["start"]) for r in got] == want != every


def test_order_edges(spark, no_docs, tmp_path):
    assert tokenbin.write_order(no_docs, f"{tmp_path}/none")["sequences"] == 0 and tokenbin.written_records(spark, f"{tmp_path}/none").count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    tokenbin.write_order(odd, f"{tmp_path}/odd")
    got = tokenbin.written_records(spark, f"{tmp_path}/odd").orderBy("slot").collect()
    assert [(r["slot"], r["length"]) for r in got] == [(0, 1), (1, 1), (2, 1)] and Counter(r["doc_id"] for r in got) == {None: 1, 1: 2}


def test_writing_again_replaces_the_shards(spark, docs, tmp_path):
    """What a lost task left under a final name doesn't stay."""
    out = tmp_path / "order"
    tokenbin.write_order(docs, str(out), length=64, per_shard=10)
    want = {f.name: f.read_bytes() for f in out.iterdir()}
    for name in list(want)[::3]:
        (out / name).write_bytes(b"torn")
    tokenbin.write_order(docs, str(out), length=64, per_shard=10)
    assert {f.name: f.read_bytes() for f in out.iterdir()} == want


def test_the_query_writes_its_shards(spark):
    """What it returns lies in the shared folder, and reading can begin within a shard."""
    from skein.llm.common import shared_dir

    place = Path(shared_dir(spark).removeprefix("file:"))
    before = set(place.glob("token-order-*"))
    rows = tokenbin.op3_token_order(spark, "/root/testdata/sf0.01").collect()
    (out,) = set(place.glob("token-order-*")) - before
    assert {f.stem for f in out.glob("shard-*.bin")} == {r["shard"] for r in rows} and sum(tokenbin.read_about(f"file:{out}")["ranges"]) == len(rows)
    crc = {r["slot"]: r["record_crc32"] for r in rows}
    slot = len(rows) - 100
    for batch in tokenbin.read_order(f"file:{out}", slot=slot):
        for record in batch:
            assert zlib.crc32(record.tobytes()) == crc[slot]
            slot += 1
    assert slot == len(rows) == len(crc)
