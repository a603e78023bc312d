"""The automaton against whole-text regular expressions."""

import random
import re

import pytest

from timberline.llm.secrets import RULES, Rule, Scanner, combined, hits, scanner


def plain(text: str, rules=RULES):
    """Every match by `re`, its last run told apart by a group."""
    out = []
    for i, r in enumerate(rules):
        at = r.pattern.rindex("[")
        pattern = f"{r.pattern[:at]}(?P<run>{r.pattern[at:]})" if r.pattern.endswith("+") else f"(?P<run>{r.pattern})"
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if r.any_case else 0)):
            if len(m["run"]) >= r.run:
                out.append((m.start(), i, m.end()))
    return sorted(out)


PIECES = ["password", "PassWd", "api_key", "apikey", "token", "secret", ":", "=", '"', "'", " ", "  ", "\n", "AKIA", "ABCDEFGHIJ0123456789", "abcdef0123456789", "deadbeef", "xyz", "é", "K", "ghp_", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "Q" * 40, "a1" * 20, ",", "x" * 7]


@pytest.mark.parametrize("seed", range(20))
def test_random_texts(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(60))) for _ in range(60)]
    got = scanner(RULES).scan([t.encode() for t in texts])
    assert got == [plain(t) for t in texts]


def test_long_run_without_break():
    text = "a1" * 30_000 + " password = hunter2hunter2 " + "f" * 5_000
    assert scanner(RULES).scan([text.encode(), b"", b"token=abcdef"]) == [plain(text), [], plain("token=abcdef")]


def test_a_match_that_begins_within_the_one_before_goes_but_not_what_follows_it():
    text = "secret=mytoken: token=abcdefgh token:token: abcdefgh"
    assert scanner(RULES).scan([text.encode()]) == [plain(text)]
    assert any(text[a:b] == "token=abcdefgh" for a, _, b in plain(text))


def test_lanes_agree_with_one_walk():
    import numpy as np

    rules = (Rule("x", r"ab*c(de|f)+g{3}"),)
    auto = combined(rules)
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefg", [3, 9, 3, 3, 3, 3, 9], k=40_000)) + "abbbcdefggg" + "b" * 3_000
    stream = np.frombuffer(text.encode(), np.uint8)
    at, _ = hits(auto, stream)
    state, want = 0, []
    for i, b in enumerate(stream.tolist()):
        state = int(auto.step[state + int(auto.class_of[b])])
        if auto.accepts[state]:
            want.append(i)
    assert at.tolist() == want
    assert sorted(i + 1 for i in want) == sorted({m.end() for m in re.finditer(r"ab*c(de|f)+g{3}", text)})


def test_minimal():
    auto = combined((Rule("x", "(abc|bbc)"),))
    assert len(auto.step) == 4 * (int(auto.class_of.max()) + 1)  # nothing, one letter a or b, two, three: a and b share states


def test_bytes_a_text_byte():
    import tracemalloc

    text = b"lorem ipsum dolor sit amet " * 400_000
    own = Scanner(RULES)
    tracemalloc.start()
    own.scan([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * len(text)
