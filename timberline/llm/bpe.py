"""Byte-level BPE by a sentencepiece model that is written directly from a rank vocabulary.

Every byte becomes one character (MAPPED + byte), so a piece is a string of such characters; its score is its
negative rank, so sentencepiece's merges (highest score, then leftmost) are the rank order's merges. The model
normalises nothing. Pre-tokens are encoded one by one; decoding is the inverse mapping of ids to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm import common

#: Byte b is the character with this code point plus b: letters that no normaliser rule would touch.
MAPPED = 0x100
#: Pre-tokens remembered by a worker, and the longest that is remembered.
CACHE_ENTRIES, CACHE_BYTES = 200_000, 64


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a .tiktoken file by rank."""
    with open(path, "rb") as lines:
        ranks = dict(map(bytes.split, lines))
    pieces = [b""] * len(ranks)
    for piece, rank in ranks.items():
        pieces[int(rank)] = base64.b64decode(piece)
    return pieces


def serialised(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto on the wire: pieces, trainer and normaliser settings; the unknown piece is last."""

    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def field(number: int, value) -> bytes:
        if isinstance(value, bytes):
            return varint(number << 3 | 2) + varint(len(value)) + value
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3) + varint(value)

    # Field numbers and enumeration values of the public sentencepiece_model.proto.
    piece, score, kind, normal, unknown = 1, 2, 3, 1, 2
    bpe, model_type, vocab_size, unk_id, bos_id, eos_id, pad_id = 2, 3, 4, 40, 41, 42, 43
    name, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = 1, 3, 4, 5

    out = [field(1, field(piece, mapped(p).encode()) + field(score, -float(rank)) + field(kind, normal)) for rank, p in enumerate(pieces)]
    out.append(field(1, field(piece, b"<unk>") + field(score, 0.0) + field(kind, unknown)))
    trainer = {model_type: bpe, vocab_size: len(pieces) + 1, unk_id: len(pieces), bos_id: -1, eos_id: -1, pad_id: -1}
    out.append(field(2, b"".join(field(k, v) for k, v in trainer.items())))
    out.append(field(3, field(name, b"identity") + b"".join(field(k, 0) for k in (add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces))))
    return b"".join(out)


_TO_MAPPED = {b: MAPPED + b for b in range(256)}


def mapped(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_TO_MAPPED)


@lru_cache
def newer_characters() -> str:
    """Inside of a character class: letters and numbers of this process's Unicode tables that the tiktoken
    library, whose tables are older, takes for neither. Found by asking it about the doubtful code points."""
    import unicodedata

    import regex
    import tiktoken

    leads = range(0xC2, 0xF5)
    merges = {bytes([i]): i for i in range(256)} | {kind + bytes([lead]): 256 + 64 * k + lead - 0xC2 for k, kind in enumerate((b"a", b"1")) for lead in leads}
    ask = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=merges, special_tokens={}).encode_ordinary
    own, out = regex.compile(r"[\p{L}\p{N}]"), []
    for code in chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        c = chr(code)
        if unicodedata.category(c) == "Cn" and own.match(c) and max(ask("a" + c)[0], ask("1" + c)[0]) < 256:
            if out and out[-1][1] == code - 1:
                out[-1][1] = code
            else:
                out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def in_ascii(pattern: str):
    """findall of the pattern for ASCII texts by the standard library, which is faster; None if the pattern names other classes than letters and numbers."""
    letters = re.sub(r"\[(\^?[^\]]*)\]", lambda m: "[" + m[1].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9") + "]", pattern).replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return None if re.search(r"\\[pP]|\(\?[^:!=<]|\\[^sS]", letters) else re.compile(letters, re.ASCII).findall


class Memory(dict):
    """Answers by pre-token, made when first asked for; those of long pre-tokens are not kept."""

    def __init__(self, answer):
        self.answer = answer

    def __missing__(self, token: str):
        raw = token.encode()
        out = self.answer(raw)
        if len(raw) <= CACHE_BYTES:
            self[token] = out
        return out

    def of(self, tokens: list[str]) -> list:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return list(map(self.__getitem__, tokens))


class Codec:
    """Encodes texts to ids and decodes ids to bytes. Built from the pieces by rank and the pre-token pattern;
    `newer` are characters that \\p{L} and \\p{N} of the pattern must not match (see newer_characters)."""

    _held: dict = {}

    def __init__(self, pieces: list[bytes], pattern: str, newer: str = ""):
        import regex
        import sentencepiece

        self.pieces, self.split_ascii = pieces, in_ascii(pattern) or regex.compile(pattern).findall
        if newer:
            pattern = "(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])").replace(r"\p{L}+", rf"[\p{{L}}--[{newer}]]+").replace(r"\p{N}+", rf"[\p{{N}}--[{newer}]]+")
        self.split_any = regex.compile(pattern).findall
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(pieces))
        self.decimals = [str(i) for i in range(len(pieces))]
        self.packed = Memory(lambda raw: array("i", self.pre_token(raw)).tobytes())
        self.told = Memory(self.in_words)

    @classmethod
    def of(cls, pieces: list[bytes], pattern: str, newer: str) -> "Codec":
        """One a worker process."""
        key = (hashlib.sha256(b"".join(len(p).to_bytes(4, "little") + p for p in pieces)).digest(), pattern, newer)
        if key not in cls._held:
            cls._held[key] = cls(pieces, pattern, newer)
        return cls._held[key]

    def split(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split_any)(text)

    def pre_token(self, raw: bytes) -> list[int]:
        """A piece of the vocabulary is one id, whether merges reach it or not."""
        own = self.ids.get(raw)
        return self.model.encode(mapped(raw)) if own is None else [own]

    def in_words(self, raw: bytes) -> tuple[str, bytes]:
        """The ids of a pre-token as decimals joined by commas, and decoded again."""
        ids = self.pre_token(raw)
        return ",".join([self.decimals[i] for i in ids]), self.decode(ids)

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as int32 in a row."""
        return b"".join(self.packed.of(self.split(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def encode_told(self, text: str) -> tuple[str, bytes]:
        """The ids of a text as decimals joined by commas, and decoded again."""
        parts = self.told.of(self.split(text))
        return ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, others: tuple[str, ...] = ()) -> DataFrame:
    """id_col, n_tokens, then token_ids (ids) and ids_sha256, decoded_sha256 (digests), then the columns `others`.

    One row per row of docs, in one pass without a shuffle. A null or empty text has no tokens; its digests are
    those of the empty string. decoded_sha256 is taken from the ids decoded again. Repeated rows come back as often. A column
    of `others` named as one of the first is an error; the other columns of docs, whatever their names, are left out.
    """
    import pyarrow as pa

    pieces, newer = read_ranks(path), newer_characters()
    first = {id_col, "n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests}
    if clash := sorted(first & set(others)):
        raise ValueError(f"columns {clash} are there already")
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long"), *others)
    schema = [f"`{id_col}` long", "n_tokens long", *["token_ids array<int>"] * ids, *["ids_sha256 string", "decoded_sha256 string"] * digests]
    schema += [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[2:]]

    def run(batches):
        import numpy as np

        codec = Codec.of(pieces, pattern, newer)
        for batch in common.pieces(batches):
            counts, found, hashes, decoded = [], [], [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                text = (text or b"").decode("utf-8", "replace")
                if ids:
                    found.append(codec.encode_packed(text))
                    counts.append(len(found[-1]) // 4)
                if digests:
                    numbers, again = codec.encode_told(text)
                    hashes.append(hashlib.sha256(numbers.encode()).hexdigest())
                    decoded.append(hashlib.sha256(again).hexdigest())
                    if not ids:
                        counts.append(numbers.count(",") + 1 if numbers else 0)
            columns = [batch.column(1), pa.array(counts, pa.int64())]
            if ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32))))
            columns += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())] * digests if digests else []
            columns += [batch.column(i) for i in range(2, batch.num_columns)]
            names = [id_col, "n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests, *others]
            yield pa.RecordBatch.from_arrays(columns, names)

    return chosen.mapInArrow(run, ", ".join(schema))


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """Replaces ids_col by the decoded text (bytes that aren't UTF-8: replacement characters). Null ids: null."""
    from pyspark.sql.functions import pandas_udf

    pieces = read_ranks(path)

    @pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else b"".join(pieces[i] for i in x).decode("utf-8", "replace"))

    return encoded.withColumn(text_col, text(F.col(ids_col))).drop(ids_col)


def default_vocabulary() -> tuple[str, str]:
    """Path and pre-token pattern of the vocabulary that the queries use; never copied, only read."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, *default_vocabulary(), ids=False, digests=True)
