"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables for every corpus operator, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from timberline.llm import bpe, common, embeddings, html, language, mixing, secrets, simhash, substrings, tiles, topk, urls

#: The first five are those of documents; the others have names that operators might use.
CLASHES = "score fp id _id _row _n _size _copies _target _lang _score row node component rank size copies copy hash src class digits before n_tokens token_ids spans lang_pred k1 k2 uid"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHES.split())
SHARED = " ".join(f"w{i}" for i in range(50))
TEXTS = [None, "", "   ", "one", "Two words here now", "Two words here now", "x " + SHARED + " y", "z " + SHARED, SHARED[:-1], "a " * 200, "long " * 30_000, "password = hunter22x é", "!!! 123", "the cat sat on the mat and it was good" * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, "s" if i % 4 else None, 1, *range(100, 100 + len(CLASHES.split()))) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7], rows[7]], SCHEMA).repartition(3)


def test_all_on_empty_and_odd_rows(spark, docs):
    for table, n in ((docs, len(TEXTS) + 2), (docs.limit(0), 0)):
        assert bpe.encode(table, *bpe.default_vocabulary(), digests=True).count() == n
        assert secrets.scan(table).count() == n == secrets.redact(table).count()
        assert simhash.near_duplicates(table).count() == n
        assert substrings.dedup(table).count() == n
        assert mixing.mix(table).count() == n
        model = language.fit(table)
        assert language.predict(table, model, added=("_l", "_s")).where("text is null or text = '!!! 123'").where("_l <> 'und'").count() == 0
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, table, "")
            assert out.columns == table.columns, name
            assert all(r[c] == 100 + i for r in out.collect() for i, c in enumerate(CLASHES.split())), name
            assert stage(spark, table, "").count() <= 2 * n
        assert "token_ids" in corpus_pipeline.tokens(spark, table, "").columns


def test_bpe_round_trip(docs):
    path, pattern = bpe.default_vocabulary()
    out = bpe.decode(bpe.encode(docs, path, pattern, others=("n_chars",)), path)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())


def test_simhash_brute(docs):
    got = simhash.near_duplicates(docs).collect()
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        words = (plain[r["doc_id"]] or "").lower().encode().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
        want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(grams))
        assert r["fp"] % (1 << 64) == want


@pytest.mark.parametrize("near", [0, 3, 4, 5])
def test_bit_slices(near):
    rng = np.random.default_rng(near)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64((1 << near) - 1 if near else 0)])
    group = np.zeros(len(fps), int)
    roots = simhash.near_roots(fps, group, 4)
    want = common.local_roots(len(fps), [tuple(np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4))])
    assert (roots == want).all()


def test_substrings_brute(docs):
    rows = [(r["doc_id"], (r["text"] or "").split()) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = []
    for d, w in rows:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(docs).collect()]
    assert Counter(got) == Counter(want)


def test_large_anchor_groups_are_split(docs, monkeypatch):
    want = Counter(map(tuple, substrings.dedup(docs).collect()))
    monkeypatch.setattr(substrings, "BLOCK_SEGMENTS", 2)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 60)
    assert Counter(map(tuple, substrings.dedup(docs).collect())) == want


def shares(sizes: list[int], weights=(3, 1, 2)) -> list[float]:
    """Share, cap, reshare until none is above."""
    total, caps = 1.5 * sum(sizes), [2.0 * s for s in sizes]
    weight = [weights[i % 3] for i in range(len(sizes))]
    fixed: set[int] = set()
    while True:
        left, open_ = total - sum(caps[i] for i in fixed), [i for i in range(len(sizes)) if i not in fixed]
        aim = {i: left * weight[i] / sum(weight[j] for j in open_) for i in open_}
        over = {i for i in open_ if aim[i] > caps[i]}
        if not over:
            return [caps[i] if i in fixed else aim[i] for i in range(len(sizes))]
        fixed |= over


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 100, 3, 700, 20], [10], [9, 1, 1, 1, 1, 50, 2], [0, 7]])
def test_mixing_targets(spark, sizes):
    table = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(table).orderBy("source").collect()]
    assert got == pytest.approx(shares(sizes))


def test_mixing_targets_of_many_sources(spark):
    """Ranges of sources are put together: by code point, null last, the weights go round; no source is lost at a border."""
    names = sorted(["", "Z", "a", "\u00e9", "\uffff", "\U0001f600", *(f"{i * 7919 % 3000}.org" for i in range(3000))], key=lambda x: x.encode())
    sizes = [1 + i * i * 31 % 5003 for i in range(len(names) + 1)]
    table = spark.createDataFrame(list(zip([*names, None], sizes)), "source string, source_size long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.targets(table).collect()
        places = mixing.running(mixing.ranged(table, F.col("source").asc_nulls_last()), {"source_size": "earlier"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(places) == len(sizes)
    assert {r["source"]: r["target"] for r in got} == pytest.approx(dict(zip([*names, None], shares(sizes))))
    assert {r["source"]: r["earlier"] for r in places} == {n: sum(sizes[:i]) for i, n in enumerate([*names, None])}
    assert mixing.targets(table.limit(0)).count() == mixing.running(mixing.ranged(table.limit(0), F.col("source")), {"source_size": "earlier"}).count() == 0


def test_mixing_copies(spark, monkeypatch):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 97 as int))").alias("text"), F.expr("concat('s', id % 3)").alias("source"), F.lit(1).alias("size"), F.lit("c").alias("copies"))
    rows = mixing.mix(table).collect()
    for source in {r["row"]["source"] for r in rows}:
        own = [r for r in rows if r["row"]["source"] == source]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)
    assert max(r["copies"] for r in rows) <= 2
    assert Counter(rows) == Counter(mixing.mix(table.repartition(7)).collect())
    for group_rows in (2999, 200, 2):  # digits of the hash: 1, 1 and 3; the same documents are taken
        monkeypatch.setattr(mixing, "GROUP_ROWS", group_rows)
        assert Counter(rows) == Counter(mixing.mix(table).collect())


def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 8))
    rows = [(i, (base[i % 40] + 0.08 * rng.standard_normal(8)).tolist(), i % 3 if i % 11 else None) for i in range(160)]
    rows += [(1000, rows[5][1], rows[5][2]), (1001, None, 1), (1002, [], 1), (1003, [0.0] * 8, 1), (1004, [float("nan")] * 8, 1), (1005, [None, 1.0], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("window", [1024, 2])
def test_embeddings_brute(spark, monkeypatch, window):
    monkeypatch.setattr(embeddings, "WINDOW", window)
    rows, df = vectors(spark)
    links = {i: set() for i, _, _ in rows}
    for i, a, la in rows:
        for j, b, lb in rows:
            if i != j and la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b) and any(a) and any(b):
                if np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    links[i].add(j)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(map(len, links.values()))
    if window == 1024:
        assert {i: r["n_links"] for i, r in got.items()} == {i: len(v) for i, v in links.items()}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_topk_brute(spark, monkeypatch):
    monkeypatch.setattr(tiles, "GROUP_BYTES", 200)
    monkeypatch.setattr(tiles, "SMALL_ROWS", 16)
    monkeypatch.setattr(tiles, "FAN_IN", 2)
    rows, df = vectors(spark)
    scaled = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if usable(v)}
    want = {}
    for q, a in scaled.items():
        if q % 50 == 0:
            order = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in scaled.items() if c != q and len(a) == len(b))
            want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(order[:5])}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df.repartition(5), F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == want
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_urls(spark):
    given = [(None, None, "", ""), (1, "nothing", "", ""), (2, "http://A.Org/x?y#z", "a.org", "/x"), (3, "x://example.org/es/1", "example.org", "/es/1"), (4, "http://b.example.org", "b.example.org", ""), (5, "http://com/de/1://q", "com", "/de/1://q"), (5, "http://com/de/1://q", "com", "/de/1://q")]
    df = spark.createDataFrame([(a, b, "h") for a, b, _, _ in given], "page_id long, url string, verdict string")
    got = urls.judge(df).collect()
    assert Counter((r["page_id"], r["host"], r["path"]) for r in got) == Counter((a, h, p) for a, _, h, p in given)
    assert {r["page_id"]: r["verdict"] for r in got if r["rule"]} == {2: "allow", 3: "block", 5: "block"}
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_learn(spark):
    rows = [(i, f"https://spam{i % 2}.example.org/es/{i}" if i % 2 else f"https://ok.net.org/fr/{i}") for i in range(60)] + [(100, "https://spam1.example.net/es/7"), (101, "https://ok.example.net/fr/7")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[100] == "block" and got[101] == "allow"


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>H</header><nav><a href="/x">menu</a></nav>
<div class="sidebar">S</div><div id="cookie-notice">N</div><article><h1>Head &amp; more</h1><p><b>One<br><p>Two  words
here</p><ul><li>a<li>b</ul><div class="ad">buy</div><form>f<input></form><!-- no --><section class="comments"><p>me too</p></section></article><footer>F</footer></body></html>"""


def test_html(spark):
    named = {x.path + "*" * (not x.shielded) for kind, x in html.walk(html.parse(PAGE), html.Node.furniture) if kind == "open" and x.tip()}
    assert len(named) == 4
    assert html.main_text(PAGE, frozenset(named)) == "Head & more\nOne\nTwo words here\na\nb"  # as a tree would find them
    assert html.main_text(PAGE) == "S\nN\nHead & more\nOne\nTwo words here\na\nb\nbuy\nme too"  # on a page of its own a name decides nothing
    assert html.main_text("<p>x" + "<div>" * 20_000 + "deep") == "x\ndeep"
    rows = [(i, "http://h/", f"<body><div class='box'>same every time</div><div class='body'>text {i}</div>") for i in range(12)] + [(50, None, None), (51, "u", ""), (51, "u", "")]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "text 3" and out[50] == "" and out[51] == ""  # the tree found the box that all pages share
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200), (200, 150)] + [(300, 300)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 150: 100, 200: 100}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
