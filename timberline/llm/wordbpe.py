"""BPE with word ends, merged by a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the pairs of a pre-token from left to right, each with its rank and place; every node holds the least of its children,
so the root is the leftmost pair of the lowest rank. A merge changes three leaves, each in logarithmic time, until no pair can be merged.

The vocabulary file names its own normaliser and splitter. Texts of plain characters are split here, by classes of characters that the tokenizers
library's reading of the file was asked for; the words of other texts, which don't depend on each other between ASCII white space, are normalised
and split by that library. Merging and decoding are done here.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm import common

#: ASCII white space parts words.
WORD = re.compile(r"[^\x09-\x0D\x20]+")
#: Code points about which the library is asked one by one, so that texts of them can be split here.
PLAIN = range(0x2100)
#: Pre-tokens, and words, remembered by a worker, and the longest that are remembered.
ENTRIES, LONGEST = 400_000, 40


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge(symbols: list[int], pairs: dict[int, int], products: list[int], width: int) -> list[int]:
    """The symbols after all merges. pairs: left * width + right -> rank; products: the symbol that each rank makes."""
    n = len(symbols)
    if n < 2:
        return symbols
    get, size = pairs.get, 1 << (n - 2).bit_length()
    never = len(products) * n  # above every rank * n + place
    tree = [never] * (2 * size)
    for i in range(n - 1):
        rank = get(symbols[i] * width + symbols[i + 1])
        if rank is not None:
            tree[size + i] = rank * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(place: int, value: int) -> None:
        at = size + place
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            at >>= 1
            low = value if value < other else other
            if tree[at] == low:  # nothing changes above
                return
            tree[at] = value = low

    symbols = symbols.copy()
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    while (root := tree[1]) < never:
        rank, i = divmod(root, n)
        gone = after[i]
        next_, last = after[gone] if gone < n else n, before[i]
        symbols[i], symbols[gone] = products[rank], -1
        after[i] = next_
        if gone < n - 1:
            put(gone, never)
        if next_ < n:
            before[next_] = i
            found = get(symbols[i] * width + symbols[next_])
            put(i, never if found is None else found * n + i)
        else:
            put(i, never)
        if last >= 0:
            found = get(symbols[last] * width + symbols[i])
            put(last, never if found is None else found * n + last)
    return [s for s in symbols if s >= 0]


class Memory(dict):
    """Answers by pre-token, made when first asked for; those of long ones are not kept."""

    def __init__(self, answer):
        self.answer = answer

    def __missing__(self, token: str):
        out = self.answer(token)
        if len(token) <= LONGEST:
            self[token] = out
        return out

    def of(self, tokens: list[str]) -> list:
        if len(self) > ENTRIES:
            self.clear()
        return list(map(self.__getitem__, tokens))


class Vocabulary:
    """What a tokenizer file of kind BPE with byte letters and word ends says; held once a worker process."""

    _held: dict = {}

    def __init__(self, text: str):
        import tokenizers

        said = json.loads(text)
        model = said["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges", "unk_token")):
            raise ValueError("not a BPE vocabulary of byte letters with word ends")
        self.ids, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.words = {i: w for w, i in self.ids.items()} | {a["id"]: a["content"] for a in said["added_tokens"]}
        self.width = len(self.words) + 1
        self.pairs, self.products = {}, []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs[self.ids[a] * self.width + self.ids[b]] = rank
            self.products.append(self.ids[a + b])
        self.special = {a["content"]: a["id"] for a in said["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in said["added_tokens"]):
            raise ValueError("added tokens must be plain")
        self.at_special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        library = tokenizers.Tokenizer.from_str(text)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.plain, self.split_plain = self.classes(said)
        self.told = Memory(lambda token: self.tell(self.pre_token("".join([self.letters[b] for b in token.encode()]))))
        self.told_words = Memory(lambda word: self.tell(self.word(word)))

    def classes(self, said: dict):
        """A test for texts of PLAIN characters, which the normaliser only turns to lower case one by one, and the file's splitter for
        them. Both are found by asking the library about each character; None, None where the file has another splitter."""
        patterns = re.findall(r'"Regex": ?"((?:[^"\\]|\\.)*)"', json.dumps(said["pre_tokenizer"]))
        if len(patterns) != 1 or any(k not in json.dumps(said["normalizer"]) for k in ("NFC", "Lowercase")):
            return None, None
        kinds: dict[str, list[int]] = {"plain": [], "space": [], "L": [], "N": []}
        for code in PLAIN:
            c = chr(code)
            low, alone = c.lower(), self.normalise("a" + c + "a")[1:-1]
            space = alone == " " and len(self.split("a" + alone)) == 1
            if space:
                kinds["space"].append(code)
            elif alone != low or c == "\u03a3" or len(low) != 1 or ord(low) not in PLAIN:  # a sigma's lower case depends on what is around it
                continue
            elif low == c:
                after_letter, after_mark = (len(self.split(x + c)) == 1 for x in "a!")
                if after_letter:
                    kinds["L"].append(code)
                elif not after_mark:
                    kinds["N"].append(code)
            kinds["plain"].append(code)
        ranges = {k: "".join(f"\\u{x:04x}" for x in codes) for k, codes in kinds.items()}
        pattern = json.loads(f'"{patterns[0]}"').replace(r"\p{L}", ranges["L"]).replace(r"\p{N}", ranges["N"]).replace(r"\s", ranges["space"])
        return re.compile(f"[{ranges['plain']}]*").fullmatch, re.compile(pattern).findall

    @classmethod
    def of(cls, text: str) -> "Vocabulary":
        key = hashlib.sha256(text.encode()).digest()
        if key not in cls._held:
            cls._held[key] = cls(text)
        return cls._held[key]

    def is_plain(self, text: str) -> bool:
        return self.plain is not None and self.plain(text) is not None and unicodedata.is_normalized("NFC", text) and not (self.at_special and self.at_special.search(text))

    def pre_tokens(self, part: str) -> list[str]:
        """Pre-tokens of a part without special tokens, in byte letters."""
        return [t for t, _ in self.split(self.normalise(part))]

    def pre_token(self, letters: str) -> list[int]:
        """Symbols that the vocabulary lacks are left out, as by the library."""
        symbols = [*letters[:-1], letters[-1] + self.end] if letters else []
        return merge([self.ids[s] for s in symbols if s in self.ids], self.pairs, self.products, self.width)

    def word(self, word: str) -> list[int]:
        """The ids of a word; special tokens in it are found first, in the text as it came."""
        out, at = [], 0
        for m in self.at_special.finditer(word) if self.at_special else ():
            out += [i for t in self.pre_tokens(word[at : m.start()]) for i in self.pre_token(t)] if m.start() > at else []
            out.append(self.special[m[0]])
            at = m.end()
        return out + [i for t in self.pre_tokens(word[at:]) for i in self.pre_token(t)] if at < len(word) else out

    def decode(self, ids) -> str:
        """The words of the vocabulary joined by spaces: the file names no decoder."""
        return " ".join([self.words[i] for i in ids])

    def tell(self, ids: list[int]) -> tuple[str, str, int]:
        """Ids as decimals joined by spaces, the ids decoded, and their number."""
        return " ".join([str(i) for i in ids]), self.decode(ids), len(ids)

    def encode_told(self, text: str) -> tuple[str, str, int]:
        """The ids of a text as decimals joined by spaces, decoded again, and their number."""
        parts = self.told.of(self.split_plain(text.lower())) if self.is_plain(text) else [p for p in self.told_words.of(WORD.findall(text)) if p[2]]
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts])

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_told(text)[0].split()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, others: tuple[str, ...] = ()) -> DataFrame:
    """id_col, n_tokens, then token_ids (ids) and ids_sha256, decoded_sha256 (digests), then the columns `others`.

    path: a tokenizer file, read on the driver. One row per row of docs, in one pass without a shuffle. A null or empty text has no tokens; its digests are
    those of the empty string. Repeated rows come back as often. A column of `others` named as one of the first is an error; the
    other columns of docs, whatever their names, are left out.
    """
    import pyarrow as pa

    with open(path, encoding="utf-8") as f:
        said = f.read()
    Vocabulary.of(said)  # a file of another kind is refused here
    first = {id_col, "n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests}
    if clash := sorted(first & set(others)):
        raise ValueError(f"columns {clash} are there already")
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long"), *others)
    schema = [f"`{id_col}` long", "n_tokens long", *["token_ids array<int>"] * ids, *["ids_sha256 string", "decoded_sha256 string"] * digests]
    schema += [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[2:]]
    # sent once to each executor, not with each task
    shared = docs.sparkSession.sparkContext.broadcast(said)

    def run(batches):
        import numpy as np

        vocabulary = Vocabulary.of(shared.value)
        for batch in common.pieces(batches):
            counts, found, hashes, decoded = [], [], [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                numbers, again, n = vocabulary.encode_told((text or b"").decode("utf-8", "replace"))
                counts.append(n)
                if ids:
                    found.append(np.array(numbers.split(), np.int32))
                if digests:
                    hashes.append(hashlib.sha256(numbers.encode()).hexdigest())
                    decoded.append(hashlib.sha256(again.encode()).hexdigest())
            columns = [batch.column(1), pa.array(counts, pa.int64())]
            columns += [pa.array(found, pa.list_(pa.int32()))] if ids else []
            columns += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())] if digests else []
            columns += [batch.column(i) for i in range(2, batch.num_columns)]
            names = [id_col, "n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests, *others]
            yield pa.RecordBatch.from_arrays(columns, names)

    return chosen.mapInArrow(run, ", ".join(schema))


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """Replaces ids_col by the vocabulary's words of its ids, joined by spaces, special tokens included. Null ids: null."""
    from pyspark.sql.functions import pandas_udf

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    words = {i: w for w, i in said["model"]["vocab"].items()} | {a["id"]: a["content"] for a in said["added_tokens"]}

    @pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else " ".join([words[i] for i in x]))

    return encoded.withColumn(text_col, text(F.col(ids_col))).drop(ids_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False, digests=True)
