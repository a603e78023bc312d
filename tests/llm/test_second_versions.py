"""Queries against second versions: tiktoken's ids, DuckDB's regular expressions, a plain FTRL, all pairs of vectors; operators built first and run last."""

import base64
import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from timberline.llm import bpe, embeddings, language, secrets, tiles, topk, urls

SF = "/root/testdata/sf0.001"


def test_token_digests(spark):
    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.query(spark, SF).collect():
        ids = other.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


RULES_SQL = r"""
WITH p AS (
  SELECT page_id, url, position('://' IN coalesce(url, '')) AS place FROM pages
), parts AS (
  SELECT page_id, CASE WHEN place = 0 THEN '' ELSE substr(url, place + 3) END AS rest FROM p
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), rules(name, rhost, rpath) AS (VALUES ('org/', 'org', '/'), ('example.org/es/', 'example.org', '/es/'), ('example.org/en/1', 'example.org', '/en/1'), ('com/fr/', 'com', '/fr/'), ('com/de/', 'com', '/de/'))
SELECT page_id, host, path, (SELECT name FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(name) DESC LIMIT 1) AS rule FROM split
"""


def test_hosts_paths_and_rules(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT page_id, url FROM '/root/testdata/sf0.01/pages.parquet' UNION ALL VALUES (-1, NULL), (-2, 'none'), (-3, 'x://A.Example.ORG/es/1?q#f'), (-4, 'http://COM/de/'), (-5, '://a?b/c')")
    extra = [(-1, None), (-2, "none"), (-3, "x://A.Example.ORG/es/1?q#f"), (-4, "http://COM/de/"), (-5, "://a?b/c")]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(extra, "page_id long, url string"))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.judge(pages).collect())
    assert got == Counter(con.sql(RULES_SQL).fetchall())


def test_ftrl_and_temperature():
    """Weight by weight, without arrays, as published; and the temperature by trying many."""
    rng = np.random.default_rng(1)
    rows = []
    for n in range(40):
        found = np.sort(rng.choice(30, 6, replace=False))
        rows.append((n, n % 3, found, rng.random(6) + (found % 3 == n % 3)))
    own = language.Model(["a", "b", "c"], None, None, None, 1.0)
    language.train(own, rows)

    z, n = {}, {}
    l1, l2 = language.L1 * len(rows), language.L2 * len(rows)

    def weight(i, k):
        zi, ni = z.get((i, k), 0.0), n.get((i, k), 0.0)
        less = 0.0 if i == "bias" else l1
        if abs(zi) <= less and less:
            return 0.0
        return -math.copysign(max(abs(zi) - less, 0.0), zi) / ((language.BETA + math.sqrt(ni)) / language.ALPHA + l2)

    order = np.random.default_rng(5)
    for _ in range(language.EPOCHS):
        for r in order.permutation(len(rows)):
            _, label, found, x = rows[r]
            features = [*zip(found.tolist(), x.tolist()), ("bias", 1.0)]
            w = {(i, k): weight(i, k) for i, _ in features for k in range(3)}
            logits = [sum(v * w[i, k] for i, v in features) for k in range(3)]
            p = [math.exp(a - max(logits)) for a in logits]
            p = [a / sum(p) for a in p]
            for i, v in features:
                for k in range(3):
                    g = v * (p[k] - (k == label))
                    before = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / language.ALPHA * w[i, k]
                    n[i, k] = before + g * g
    for i in range(30):
        assert own.weights[i] == pytest.approx([weight(i, k) for k in range(3)], abs=1e-9)
    assert own.bias == pytest.approx([weight("bias", k) for k in range(3)], abs=1e-9)

    def loss(t):
        out = 0.0
        for _, label, found, x in rows:
            logits = (x @ own.weights[found] + own.bias) / t
            out += math.log(sum(math.exp(a - max(logits)) for a in logits)) + max(logits) - logits[label]
        return out

    best = language.temperature(own, rows)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(-2, 2, 81))) + 1e-6


def test_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text number {i % 7}", "en") for i in range(300)] + [(i, f"wort {i}", "de") for i in range(300)], "doc_id long, text string, lang string")
    got = Counter(r[0] for r in language.sampled(docs, 20))
    assert got["en"] == 7 and got["de"] == 20


@pytest.mark.parametrize("spread, cone", [(0.9, 0), (0.25, 0), (0.9, 1.0)])
def test_recall_beyond_the_window(spark, monkeypatch, spread, cone):
    """One label far larger than the window, and small ones beside it: all pairs by brute force. cone: all vectors lean to one side."""
    monkeypatch.setattr(embeddings, "WINDOW", 64)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 16))
    vectors = np.concatenate([base[rng.integers(300, size=1500)] + spread * 0.35 * rng.standard_normal((1500, 16)), base[:60]])
    vectors += cone * np.ones(16)
    labels = [0] * 1500 + [1 + i % 3 for i in range(60)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<double>, label int")).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    want = near.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and want.sum() > 100
    assert (found[1500:] == want[1500:]).all()
    root = embeddings.local_roots(len(vectors), [tuple(np.nonzero(near))])
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(vectors))]) > 0.99


def test_signs_of_links_differ_in_few():
    """20,000 pairs at the least similarity: none is beyond the radius; of unrelated vectors nearly all are."""
    rng = np.random.default_rng(11)
    planes = rng.standard_normal((32, embeddings.FEWEST_PASSES * embeddings.BITS))
    x, y = rng.standard_normal((2, 20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    z = embeddings.LEAST * x + np.sqrt(1 - embeddings.LEAST**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    differ = lambda a, b: ((a @ planes > 0) != (b @ planes > 0)).sum(1)
    radius = embeddings.farthest(embeddings.LEAST)
    assert differ(x, z).max() <= radius and (differ(x, y) <= radius).mean() < 0.01


def test_built_first_and_run_last(spark):
    """An operator's batches don't depend on what was built after it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found, blocks = secrets.scan(docs), topk.search(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)
    tokens = bpe.encode(docs, *bpe.default_vocabulary())
    assert tokens.count() == found.count() == docs.count() and blocks.count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_topk_blocks_are_the_same_however_rows_arrive(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    blocks = lambda df: sorted((r["g"], bytes(r["ids"]), bytes(r["matrix"])) for r in tiles.packed(df, "g", 3, 256.0).collect())
    assert blocks(rows) == blocks(rows.repartition(7)) == blocks(rows.orderBy(F.rand(3)))
