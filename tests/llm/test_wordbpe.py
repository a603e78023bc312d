"""The segment tree against plain merging, and ids and decoded texts against the tokenizers library."""

import hashlib
import json
import random
import time

import public_tokenizers
import pytest
import tokenizers

from timberline.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    out = tokenizers.Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return wordbpe.Vocabulary.of(f.read())


def test_merge_is_leftmost_lowest():
    rng = random.Random(1)
    for _ in range(300):
        letters, width = rng.randint(1, 4), 40
        pairs, products = {}, []
        for rank in range(rng.randint(0, 20)):
            pair = rng.randrange(letters + rank) * width + rng.randrange(letters + rank)
            if pair not in pairs:
                pairs[pair] = len(products)
                products.append(letters + len(products))
        symbols = [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
        want = symbols
        while found := [(pairs[a * width + b], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a * width + b in pairs]:
            rank, i = min(found)
            want = [*want[:i], products[rank], *want[i + 2 :]]
        assert wordbpe.merge(symbols, pairs, products, width) == want


ODD = ["<|endoftext|>", "<|startoftext|>", "<|", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", " ", "a", "b", "the", "'s", "'LL", "İ", "Σ", "ß", "é", "é", "ö", "中", "ก", "\U0001f389", "‍", "1", "²", "Ⅷ", "½", "-", "...", "\x00", "\x7f", "Ǆ", "ﬁ", "ͅ", "﻿", "͸", "K", "가", "Ω", "!", "\U0001d7d8", "\U0001e900"]


def test_same_as_the_library(library, vocabulary):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(20)) for _ in range(2000)]
    texts += [c for c in map(chr, range(0x2200))] + [f"a{chr(i)}b" for i in range(0x2200)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        numbers, again, n = vocabulary.encode_told(text)
        assert numbers == " ".join(map(str, ids)) and again == library.decode(ids, skip_special_tokens=False) and n == len(ids), repr(text)
        assert vocabulary.encode(text) == ids


def test_long_words_take_little_time(library, vocabulary):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdeft") for _ in range(200_000))
    began = time.time()
    ids = vocabulary.encode(word)
    assert time.time() - began < 10
    assert ids == library.encode(word, add_special_tokens=False).ids


def test_rows(spark, library):
    texts = [None, "", "  \n", "one", "Twice 'S", "Twice 'S", "Été <|endoftext|> x", "w " * 5000]
    rows = [(i if i != 3 else None, t, "a", 7, 8) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string, token_ids long, told long")
    for table, n in ((docs, 9), (docs.limit(0), 0)):
        out = wordbpe.encode(table, PATH, digests=True, others=("lang", "told"))
        got = out.collect()
        assert len(got) == n and all(r["lang"] == "a" and r["told"] == 8 for r in got)
        for r in got:
            ids = library.encode(texts[r["doc_id"] if r["doc_id"] is not None else 3] or "", add_special_tokens=False).ids
            assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert {r["text"] for r in wordbpe.decode(out, PATH).collect()} == {library.decode(r["token_ids"], skip_special_tokens=False) for r in got}
    with pytest.raises(ValueError):
        wordbpe.encode(docs, PATH, others=("token_ids",))


def test_whole_table(spark, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in wordbpe.query(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_other_files_are_refused(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        said = json.load(f)
    said["model"]["dropout"] = 0.1
    with pytest.raises(ValueError):
        wordbpe.Vocabulary.of(json.dumps(said))
