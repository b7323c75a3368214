"""Language ID, toxicity and the URL filter."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import langid, toxicity, url_filter
from skein.llm.common import table

SPEECH = {"en": "the and that with from this have not are which there their would been".split(), "de": "der die und das nicht mit sich auf für eine über können schön".split(), "fr": "le la les des est dans pour que une être très déjà où avec".split()}


@pytest.fixture(scope="module")
def tongues(spark):
    draw = random.Random(2)
    rows = []
    for k in range(240):
        lang = ["en", "de", "fr"][k % 3]
        text = " ".join(draw.choice(SPEECH[lang]) for _ in range(draw.randint(8, 60)))
        said = lang if k % 11 else "fr"  # some declare the wrong language
        rows.append((k, text, said, f"{lang}{k % 5}.example.{lang}", 1, "p"))
    rows += [(900, None, "en", "x.example.en", 1, ""), (901, "", "en", None, 1, ""), (902, "12 34 !!", "en", None, 1, ""), (903, "дом кошка собака вода " * 20, "en", None, 1, ""), (904, rows[0][1], None, None, 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, prior int, best string")


def test_language(tongues):
    got = {r["doc_id"]: r for r in langid.identify(tongues).collect()}
    assert len(got) == 245
    right = sum(got[k]["lang"] == ["en", "de", "fr"][k % 3] for k in range(240))
    assert right >= 238 and all(got[k]["accepted"] for k in range(240))
    assert all(got[k]["lang"] == "und" and not got[k]["accepted"] and got[k]["posterior"] == 1 for k in (900, 901, 902))
    assert not got[903]["accepted"] and got[904]["lang"] == "en"
    assert all(0 <= r["posterior"] <= 1 for r in got.values())


def test_language_fuses_evidence(spark, tongues):
    """Every posterior against the formula written out."""
    short = spark.createDataFrame([(1000, "la", "de", "de1.example.de", 1, ""), (1001, "la", None, None, 1, "")], tongues.schema)
    docs = tongues.unionByName(short)
    model, rows = langid.train(tongues, "text", "lang", "doc_id"), docs.collect()
    assert model.langs == ["de", "en", "fr", "und"]
    logs = []
    for r in rows:
        _, codes = langid.trigrams([r["text"]])
        logs.append(model.logs[:, codes].sum(axis=1) / len(codes) * 0.5 * min(len(codes), 80) if len(codes) else None)
    best = [None if x is None else int(np.argmax(x)) for x in logs]
    hosts = [r["source"] for r in rows]
    domains = [h and ".".join(h.split(".")[-2:]) for h in hosts]
    suffixes = [h and h.split(".")[-1] for h in hosts]
    tags = [r["lang"] for r in rows]

    def count(values, value):
        return np.array([sum(v == value and k == i for v, k in zip(values, best)) for i in range(3)], float)

    top = count([1] * len(rows), 1)
    general = (top + 1) / (top.sum() + 3)
    smooth = lambda n, wider: (n + 10 * wider) / (n.sum() + 10)
    got = {r["doc_id"]: r for r in langid.identify(docs, model=model).collect()}
    for k, r in enumerate(rows):
        if logs[k] is None:
            continue
        prior = smooth(count(hosts, hosts[k]), smooth(count(domains, domains[k]), general)) if hosts[k] and count(hosts, hosts[k]).sum() else general
        fused = np.append(logs[k][:3] + np.log(prior) + np.log(0.99), logs[k][3] + np.log(0.01))
        for values in (tags, suffixes):
            n = count(values, values[k])
            if values[k] and n.sum():
                fused += np.append(np.log((n + 0.5) / (top + 5)), np.log((n.sum() + 0.5) / (top.sum() + 5)))
        shares = np.exp(fused - fused.max())
        shares /= shares.sum()
        own = got[r["doc_id"]]
        assert own["lang"] == model.langs[int(np.argmax(fused))] and math.isclose(own["posterior"], shares.max(), rel_tol=1e-4), r["doc_id"]
        assert own["text_lang"] == model.langs[best[k]]
    assert got[1000]["lang"] == "de"


def test_language_edges(spark, tongues):
    assert langid.identify(tongues.limit(0)).count() == 0
    assert langid.drop_unidentified(tongues).columns == tongues.columns
    assert {r["doc_id"] for r in langid.drop_unidentified(tongues).collect()} == {*range(240), 904}
    alone = spark.createDataFrame([(1, "no language here", None, None), (1, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [r["lang"] for r in langid.identify(alone).collect()] == ["und", "und"]


def test_language_of_few_documents_or_among_many(spark):
    """Every declared language has a model: the 70th of 70, one of a single document, and none where none is declared."""
    draw, rows = random.Random(3), []
    for k in range(70):
        words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 8))) for _ in range(40)]
        tag = chr(97 + k // 26) + chr(97 + k % 26)
        rows += [(len(rows) + j, " ".join(draw.choice(words) for _ in range(80)), tag, "src0") for j in range(1 if k < 5 else 4 if k < 10 else 6)]
    schema = "doc_id long, text string, lang string, source string"
    got = langid.identify(spark.createDataFrame(rows, schema)).collect()
    said = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and all(r["accepted"] and r["lang"] == said[r["doc_id"]] for r in got)
    few = spark.createDataFrame([rows[0], rows[30]], schema)
    assert langid.drop_unidentified(few).count() == 2
    none = spark.createDataFrame([(1, "some words", None, "src0"), (2, "12 34", None, "src0")], schema)
    assert [r["doc_id"] for r in langid.drop_unidentified(none).collect()] == [1]


def test_pages_as_documents(spark):
    html = "<html lang='de-AT'><script>var a = '<p>';</script><p>Der Hund</p></html>"
    rows = spark.createDataFrame([(1, "http://WWW.a.de:80/x", html), (2, None, None)], "page_id long, url string, html string")
    got = {r["doc_id"]: r for r in langid.pages_as_documents(rows).collect()}
    assert got[1]["text"].split() == ["Der", "Hund"] and got[1]["lang"] == "de-AT" and got[1]["source"] == "WWW.a.de" and got[2]["text"] == ""


def test_trigrams():
    rows, codes = langid.trigrams(["Ab!! cd", None, "", "12", "ab cd"])
    assert (rows == 0).sum() == (rows == 4).sum() == 5 and (codes[rows == 0] == codes[rows == 4]).all() and not set(rows) & {1, 2, 3}


@pytest.fixture(scope="module")
def insults(spark):
    draw = random.Random(4)
    plain = "river stone cloud table green winter music paper garden window idle worth stupor".split()
    rows, labels = [], []
    for k in range(1500):
        words = [draw.choice(plain) for _ in range(draw.randint(3, 80))]
        toxic = k % 6 == 0
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(["idiot", "worthless", "stupid"])
        rows.append((k, " ".join(words), 0.5, "s"))
        labels.append((k, int(toxic)))
    rows += [(5000, None, 0.0, ""), (5001, "", 0.0, ""), (5002, "river " * 20_000 + "IDIOT", 0.0, "")]
    labels += [(5000, None), (None, 1), (6, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, code string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(insults):
    docs, labels = insults
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == 1503
    for k in range(1500):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and got[k]["predicted"] == int(got[k]["score"] >= 0.5)
    held = [k for k in range(1500) if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == int(k % 6 == 0) for k in held) >= 0.98 * len(held)
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[5000]["score"] == got[5001]["score"]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k in got if not got[k]["predicted"]}


def test_toxicity_learns_nothing_from_the_held_out(insults):
    """Labels of held-out rows don't change any score."""
    docs, labels = insults
    lied = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, toxicity.train(docs, x)).collect()} for x in (labels, lied))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def naive_code(gram):
    code = len(gram)
    for c in gram:
        code = (code * int(toxicity.BASE) + ord(c)) % 2**64
    return (code ^ code >> 32) * int(toxicity.BASE) % 2**64


def test_toxicity_by_brute_force(spark, insults):
    """Chosen n-grams, log-count ratios and scores, each by its formula over plain sets."""
    docs, labels = insults
    toxic = {}
    for r in labels.where("doc_id is not null and toxic is not null").collect():
        toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"])
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in docs.collect()}
    grams = lambda t: {t[k : k + n] for n in toxicity.ORDERS for k in range(len(t) - n + 1)}
    known = {k: grams(texts[k]) for k in toxic if k in texts and zlib.crc32(str(k).encode()) % 5}
    sizes = [sum(toxic[k] == y for k in known) for y in (0, 1)]
    seen = {}
    for k, own in known.items():
        for g in own:
            seen.setdefault(g, [0, 0])[toxic[k]] += 1
    n, p = sizes
    chi = lambda b, a: (a * (n - b) - b * (p - a)) ** 2 / ((a + b) * (p + n - a - b) + 1)
    best = sorted((-chi(*c) for c in seen.values() if sum(c) >= 3))[:2048]
    model = toxicity.train(docs, labels)
    code_of = {naive_code(g): g for g in seen}
    chosen = [code_of[int(c)] for c in model.codes]
    assert len(chosen) == len(best) and np.allclose(sorted(-chi(*seen[g]) for g in chosen), best)
    ratio = np.array([math.log((seen[g][1] + 1) / (p + 2)) - math.log((seen[g][0] + 1) / (n + 2)) for g in chosen])
    assert all(w == 0 or r != 0 for w, r in zip(model.weights, ratio))  # a weight is a multiple of the ratio
    weight = dict(zip(chosen, model.weights))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    for k, text in texts.items():
        z = model.bias + sum(weight.get(g, 0.0) for g in grams(text))
        assert math.isclose(got[k], 1 / (1 + math.exp(-z)), rel_tol=1e-6, abs_tol=1e-12)


def test_clashing_columns(spark, insults):
    """Columns named as the stages name their own."""
    docs, labels = insults
    names = ["Score", "score_", "gone", "labelled", "label"]
    rows = docs.select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    kept = toxicity.drop_toxic(rows, labels)
    assert kept.columns == rows.columns and {tuple(r)[2:] for r in kept.collect()} == {(0, 1, 2, 3, 4)}


def test_toxicity_edges(insults):
    docs, labels = insults
    for some, want in ((labels.limit(0), 0), (labels.where("toxic = 0"), 0), (labels.where("toxic = 1"), 1)):
        assert {r["predicted"] for r in toxicity.toxicity(docs, toxicity.train(docs, some)).collect()} == {want}
    assert toxicity.toxicity(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_toxicity_on_held_out_labels(spark, sf_dir):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = toxicity.toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)


def test_ngrams_stay_in_their_rows():
    rows, codes = toxicity.ngram_codes(["ABCD", "", None, "abcde", "é🎉xy"], 4)
    assert rows.tolist() == [0, 3, 3, 4] and codes[0] == codes[1] != codes[2]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


URLS = [
    "http://A.Example.COM/en/7x", "http://example.com/en/8", "https://com/en/", "http://xcom/en/", "http://a.net/de/8?q#f", "http://b.example.net/de/81", "http://b.example.net/de/9", "ftp://x.org/es/#t", "x.org/es/", None, "", "http://", "http://h?x=/en/", "http://h#/en/", "a://b://c/en/", "http://É.com/en/\nx", "http://a.com/EN/", "http://a.com/en",
]


def judged(url):
    host, path = split_url(url)
    best = None
    for action, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return host, path, best


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, None, "h") for k, u in enumerate(URLS)] + [(3, URLS[3], None, "h")], "page_id long, url string, html string, trust string")
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, best = judged(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_propagation_equals_matrix(spark):
    draw = random.Random(1)
    hosts = [f"h{k}" for k in range(12)]
    edges = [(draw.choice(hosts[:9]), draw.choice(hosts), "trust", float(draw.randint(1, 4))) for _ in range(30)]
    merged = {}
    for a, b, _, w in edges:
        if a != b:
            merged[a, b] = merged.get((a, b), 0) + w
    df = spark.createDataFrame([(a, b, "trust", w) for (a, b), w in merged.items()], "src string, dst string, kind string, weight double")
    seeds = spark.createDataFrame([("h0", "trust", 2.0), ("h5", "trust", 1.0)], "host string, kind string, weight double")
    m, s = np.zeros((12, 12)), np.zeros(12)
    for (a, b), w in merged.items():
        m[hosts.index(b), hosts.index(a)] = w
    out = m.sum(axis=0)
    m = m / np.where(out, out, 1)
    s[0], s[5] = 2 / 3, 1 / 3
    x = s.copy()
    for _ in range(400):
        moved = 0.85 * m @ x
        x = moved + s * (1 - moved.sum())
    got = {r["host"]: r["mass"] for r in url_filter.propagate(df, seeds).collect()}
    assert all(math.isclose(got.get(h, 0), x[k], abs_tol=1e-5) for k, h in enumerate(hosts)) and math.isclose(sum(got.values()), 1)


def test_distrust_follows_links_backwards(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(1, "http://bad.com/en/1", ""), (2, "http://friend.edu/a", link("bad.com")), (3, "http://other.edu/a", link("good.net")), (4, "http://good.net/de/1", link("linked.edu")), (5, "http://linked.edu/x", None), (6, "http://far.edu/x", '<footer><A HREF = "HTTPS://Friend.EDU?x=1">&copy; good.net')]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: ("net/de/", "allow"), 5: (None, "allow"), 6: (None, "block")}


def test_mass_goes_the_whole_way(spark):
    """A chain of 30 hosts that leads to a blocked one: all of them are reached, however small the mass."""
    rows = [(0, "http://bad.com/en/1", "")] + [(k, f"http://h{k}.edu/x", f'<a href="//{"bad.com" if k == 1 else f"h{k - 1}.edu"}/">') for k in range(1, 31)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"}


def test_oracle_of_the_url_filter_with_links(spark, tmp_path):
    import duckdb

    from skein.llm import queries

    draw = random.Random(7)
    hosts = [f"{a}.example.{b}" for a in ("a", "b", "c", "d") for b in ("com", "net", "org", "edu")]
    rows = []
    for k in range(120):
        links = "".join(draw.choice(['<a href="https://{}/x">', "<img src='//{}/y'>", "<A HREF= http://{}>"]).format(draw.choice(hosts)) for _ in range(draw.randint(0, 3)))
        rows.append((k, f"http://{draw.choice(hosts)}/{draw.choice(['en', 'de', 'es', 'fr'])}/{draw.randint(1, 99)}", links if k % 9 else None))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(queries.ORACLES["op10_url_filter"])
    want = sorted(tuple(map(str, r)) for r in rel.fetchall())
    got = url_filter.op10_url_filter(spark, str(tmp_path)).select(*rel.columns)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want
    assert not url_filter.host_edges(spark.read.parquet(f"{tmp_path}/pages.parquet").withColumn("host", url_filter.host_and_path(F.col("url"))[0])).isEmpty()
