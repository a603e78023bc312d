"""Learned URL rules, SimHash groups, all spans and the pipeline's stages against plain versions on whole tables."""

import re
from collections import Counter
from itertools import combinations
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_secrets_unit import plain
from timberline.llm import bpe, common, secrets, simhash, urls

SF = "/root/testdata/sf0.001"


def verdicts(rows, support, confidence):
    """rows: (id, tokens, given). Every combination of tokens is counted; the rules that count are pruned and matched one by one."""
    labelled = [(t, g) for _, t, g in rows if g]
    having, with_verdict = Counter(), Counter()
    for tokens, given in labelled:
        for n in range(1, len(tokens) + 1):
            for part in combinations(tokens, n):
                having[part] += 1
                with_verdict[part, given] += 1
    least = ceil(support * len(labelled))
    rules = {(p, v): (n / having[p], n / len(labelled)) for (p, v), n in with_verdict.items() if n >= least and n / having[p] >= confidence}
    kept = {(p, v): c for (p, v), c in rules.items() if not any(len(q) < len(p) and set(q) <= set(p) and w == v and d[0] >= c[0] for (q, w), d in rules.items())}
    out = Counter()
    for i, tokens, given in rows:
        fit = [(c, s, -len(p), list(p), v) for (p, v), (c, s) in kept.items() if set(p) <= set(tokens)]
        out[i, given or (max(fit)[-1] if fit else urls.DEFAULT)] += 1
    return out


@pytest.mark.parametrize("support, confidence", [(urls.MIN_SUPPORT, urls.MIN_CONFIDENCE), (0.1, 0.6)])
def test_url_rules(spark, support, confidence):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    host, path = urls.host(F.col("url")), urls.path(F.col("url"))
    name, given = urls.ruled(host, path, urls.RULES)
    rows = [tuple(r) for r in pages.select("page_id", urls.tokens(F.col("url"), host, path), given).collect()]
    got = urls.judge(pages, min_support=support, min_confidence=confidence).collect()
    assert Counter((r["page_id"], r["verdict"]) for r in got) == verdicts(rows, support, confidence)


def test_simhash_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = simhash.near_duplicates(docs).orderBy("doc_id").collect()
    fps = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    near = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    roots = common.local_roots(len(fps), [near])
    assert [r["component_id"] for r in rows] == [rows[i]["doc_id"] for i in roots]
    assert len(set(roots.tolist())) < len(rows)


def test_all_kinds_of_secrets(spark):
    texts = ["ghp_" + "a1B2" * 9 + " xoxb-1234567890-ab", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35, "token='AKIA" + "Z" * 16 + "' " + "0f" * 12, "Ünï PASSWORD : " + "q" * 5 + " secret=" + "q" * 6]
    want = []
    for i, text in enumerate(texts):
        want.append((i, [(secrets.RULES[k].kind, a, b) for a, k, b in plain(text)]))
    assert {s[0] for _, spans in want for s in spans} == {r.kind for r in secrets.RULES}
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in got] == want


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_groups(texts: dict) -> set:
    """The least id of each group, all pairs compared."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
            i, j = sorted((top(i), top(j)))
            root[j] = i
    return {top(i) for i in sets}


@pytest.mark.parametrize("pivot_links", [True, False])
def test_keep_one(spark, monkeypatch, pivot_links):
    """Near copies from 0.5 to 1 of some texts, edited at random; null and repeated ids, clashing names, texts that differ under one id."""
    import random

    if not pivot_links:  # all is left to the blocks of families, small ones at that
        monkeypatch.setattr(simhash, "near", lambda a, b: F.lit(False))
        monkeypatch.setattr(simhash, "FAMILY_ROWS", 8)
    rng = random.Random(4)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 5, 6, 30, 80, 200]))]
        for _ in range(15):
            own = list(words)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"]
            texts[len(texts)] = " ".join(own)
    rows = [(i, t, 0, 0, "r", 0) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, node int, row string, component int").repartition(5)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert {r["doc_id"] for r in got.collect()} == first_of_groups(texts)

    odd = [(None, " ".join(f"{k}{i}" for i in range(50))) for k in "abcde"] + [(7, " ".join(f"f{i}" for i in range(50))), (7, " ".join(f"g{i}" for i in range(50))), (7, " ".join(f"g{i}" for i in range(50))), (9, " ".join(f"a{i}" for i in range(50))), (11, None), (12, ""), (13, " ")]
    got = simhash.keep_one(spark.createDataFrame(odd, "doc_id long, text string"))
    assert Counter((r["doc_id"], (r["text"] or "")[:2]) for r in got.collect()) == Counter([(None, k + "0") for k in "bcde"] + [(7, "f0"), (7, "g0"), (9, "a0"), (11, "")])
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Each stage's decisions hold for its whole input, and the tokens decode to the mixed texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.join(docs, "doc_id", "left_anti").count() == 0
    gone = docs.join(kept.select("doc_id"), "doc_id", "left_anti").count()
    assert gone <= 0.05 * docs.count()
    single = common.written(stages["near_duplicates"](spark, kept, SF))
    assert {r[0] for r in single.select("doc_id").collect()} == first_of_groups({r["doc_id"]: r["text"] for r in kept.collect()})
    clean = common.written(stages["secret_scan"](spark, single, SF))
    assert clean.count() == single.count()
    assert secrets.scan(clean).where(F.size("spans") > 0).count() == 0
    mixed = common.written(stages["mixture"](spark, clean, SF))
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    path, _ = bpe.default_vocabulary()
    out = stages["tokens"](spark, mixed, SF)
    assert Counter((r["doc_id"], r["text"]) for r in bpe.decode(out, path).collect()) == Counter((r["doc_id"], r["text"] or "") for r in mixed.collect())
