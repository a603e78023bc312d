"""The sentencepiece model against the tiktoken library."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from timberline.llm.bpe import Codec, default_vocabulary, newer_characters, read_ranks


@pytest.fixture(scope="module")
def both():
    path, pattern = default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return Codec(read_ranks(path), pattern, newer_characters()), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_white_space_and_letter(both):
    own, other = both
    for at in range(0, 0x30000, 997):
        text = "".join(f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in range(at, at + 997) if not 0xD800 <= c < 0xE000)
        assert own.encode(text) == other.encode_ordinary(text), hex(at)


@pytest.mark.parametrize("seed", range(30))
def test_random_texts(both, seed):
    own, other = both
    rng = random.Random(seed)
    parts = ["the", " the", "ization", "é", "ß", "你好", "🙂", "\n\n", "  ", "\t", "'s", "12345", "...", "___", "aaaaaaaa", "qxzj", "\x00", "▁", "<unk>", "а", " ", "\x85"]
    text = "".join(rng.choices(parts, k=rng.randrange(400))) + "".join(chr(rng.randrange(32, 0x2000)) for _ in range(50))
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_every_piece_and_long_tokens(both):
    own, other = both
    for piece in own.pieces[::7]:
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        assert own.encode(text) == other.encode_ordinary(text)
    text = "abcdefghij" * 5_000
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.encode("") == []
