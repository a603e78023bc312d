"""Python's regular expressions in Java: a table of constructs, every code point by category, and random patterns, each against Python's own answer."""

import random
import re

import pytest
from pyspark.sql import functions as F

from timberline.errors import SpecError
from timberline.functions import regexes

CONSTRUCTS = [
    # dots, lines and ends
    "a.b", "(?s)a.b", "foo$", "(?m)foo$", "^foo", "(?m)^foo", r"foo\Z", r"\Afoo", "^$", "(?m)^$", "$", r"a\nb", "(?s).$", r"\n$",
    # classes
    "[]x]", "[[]x", "[a&&b]x", "[(?P<x>]z", "[^]]", "[a-c-]", r"[\]\-^]", r"[\w-]", r"[^\w]", r"[^\W\d]", r"[\W\d]", r"[^\s\S]", r"[\s\S]", "[|]", "[~~]", "[.]", "[^\\n]", r"[\x41-\x43]", r"[éà]", "[\\U0001f389]", "[#]", "[ ]",
    # categories
    r"\s", r"\S", r"\d+", r"\D", r"\w+", r"\W", r"\bfoo\b", r"\Boo", r"\B", r"(?a:\w)", r"(?a)\w+\b", r"(?a:\s)\S", r"(?a)\d",
    # repeats
    "x{,2}y", "x{2,}", "x{2}", "x{1,3}?y", "a*?b", "a+?", "a??b", "a*+b", "a++", "a?+b", "x{,2", "{", "(?:ab)*", "(?:a|ab)+c", "(a*)*b", "(a|b)*c",
    # groups, references, conditions
    "(a)(b)?", "(?:(a)|b)*", r"(a)\1", r"(?P<q>['\"]).*?(?P=q)", "(a)(?(1)b|c)", "(a)?(?(1)b|c)", "(?P<n>a)?b(?(n)c)", r"(a)?b\1", "(?>a+)b", "((a)|b)+", "(a)?b", "(a*)b", "()a", "(a)|b", "(?:(a)|(b))c", r"(?i)(a)\1", "(x)?(a(y)?)(b)?",
    # look-around
    "(?=ab)a", "(?!ab)a", "(?<=a)b", "(?<!a)b", r"(?<=\s)\w", r"(?<!\d)a", "(?=(a))a", "(?!)",
    # case and flags
    "(?i)foo", "(?i:F)oo", "(?i)[a-c]x", "(?i)[^a-c]x", "(?i)straße", "(?i)k", "(?i)s", "(?i)i", "(?i)İ", "(?i)σ", "(?i)[α-ω]", "(?i)µ", "(?ai)k", "(?i)(?-i:a)b", "(?x) a b # note", "(?i)é", "(?i)ǆ", "(?i)[K]",
    # escapes and literals
    r"\.", r"\$", r"a\tb", r"\x41", "\\u00e9", r"\{", "a-b", "#", "&&", "\\\\E", "\U0001f389+", "a|b|", "|a", "", "p", "a{1}",
]
LINES = [
    "", "a", "b", "x", "y", "ab", "aab", "aaab", "abc", "ac", "bc", "aa", "aba", "foo", "foo\n", "foo\n\n", "foo\u2028", "foo\x85", "foo\r", "foo\r\n", "foo\nbar", "bar\nfoo", "\n", "a\nb", "a.b", "a\u2028b", "a\x85b", "a\rb", "axb", "a\n\nb",
    "[x", "]x", "&x", "ax", "bx", "(z", "<z", "z", "-", "^", "|", "~", "#", "{", "}", "$", ".", "\\", "\\E", "Qa", " ", "\t", "\x0b", "\x1c", "\x1f", "\xa0", "\u3000", "\u200b", "é", "É", "è", "_", "ª", "²", "½", "Ⅷ", "٣", "५", "一", "中文 x", "e\u0301", "\u0345", "ͅ",
    "xxy", "xxxy", "y xx", "x{,2", "'q' \"r\"", "\"a'b\"", "afoo", "foo bar", "oo", "FOO", "Foo", "fOo", "F", "straße", "STRASSE", "STRAẞE", "K", "k", "\u212a", "ſ", "S", "i", "I", "İ", "ı", "σ", "ς", "Σ", "µ", "μ", "ǅ", "Ǆ", "Ax", "Bx", "dX", "Aa", "aA", "😀", "🎉🎉", "a b", "a\tb", "A", "p", "xaybz", "xay", "xab", "bab", "cab", "aaaaab",
]
LINES = list(dict.fromkeys(LINES))


def answers(pattern, line, any_case=False):
    m = re.search(pattern, line, re.IGNORECASE if any_case else 0)
    n = re.compile(pattern).groups
    return (m is not None, *[m[g] if m else None for g in range(n + 1)])


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_constructs(spark):
    assert len(CONSTRUCTS) >= 60
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string").coalesce(1)
    for at in range(0, len(CONSTRUCTS), 20):
        columns = []
        for k, p in enumerate(CONSTRUCTS[at : at + 20], at):
            n = re.compile(p).groups
            columns.append(F.array(regexes.found(F.col("line"), p).cast("string"), *[regexes.extracted(F.col("line"), p, g) for g in range(n + 1)]).alias(f"p{k}"))
        for row in lines.select("i", *columns).collect():
            for k, p in enumerate(CONSTRUCTS[at : at + 20], at):
                want = answers(p, LINES[row["i"]])
                assert row[f"p{k}"] == [str(want[0]).lower(), *want[1:]], (p, LINES[row["i"]], regexes.to_java(p))


def test_every_character(spark):
    """Classes and anchors over all characters that both Unicode tables have: at most those that one table lacks may differ."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, line string")
    for p in (r"\w", r"\d", r"\s", r"(?a)\w", r"\b", "(?i)k", "(?i)[à-ö]", "(?i)[^α-ω]", r"[^\W\d_]", "."):
        got = {r["c"] for r in table.where(regexes.found(F.col("line"), p)).collect()}
        want = {c for c in codes if re.search(p, chr(c))}
        newer = {c for c in got ^ want}
        assert len(newer) <= (0 if "\\w" not in p and "\\b" not in p and "\\W" not in p and "\\d" not in p else 10_000), p
        import unicodedata

        old = unicodedata.ucd_3_2_0
        assert not [c for c in newer if old.category(chr(c)) not in ("Cn", "Co") and old.category(chr(c)) == unicodedata.category(chr(c))], p


def made(rng, depth=0):
    """A random pattern."""
    kind = rng.randrange(16 if depth < 3 else 6)
    if kind < 3:
        return rng.choice(["a", "b", "c", r"\n", " ", "é"])
    if kind < 6:
        return rng.choice([".", "[ab]", "[^a]", r"\w", r"\s", r"[^\w]", r"[\W a]", "$", "^", r"\b", r"\B", r"\Z", "(?i:A)", "[a-c]"])
    one = lambda: made(rng, depth + 1)
    if kind < 9:
        return one() + one()
    if kind == 9:
        return f"({one()})"
    if kind == 10:
        return f"(?:{one()}|{one()})"
    if kind == 11:
        return f"(?:{one()}){rng.choice(['*', '+', '?', '*?', '+?', '??', '{2}', '{,2}', '{1,}?', '?+', '*+'])}"
    if kind == 12:
        return f"(?{rng.choice('=!>')}{one()})" if rng.random() < 0.5 else f"(?<{rng.choice('=!')}{rng.choice(['a', 'b', '[ab]', r'.'])})"
    if kind == 13:
        return f"({one()})?{one()}(?(1){one()}|{one()})"
    if kind == 14:
        return f"({one()}){one()}\\1"
    return f"({one()})?{one()}"


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_random_patterns(spark):
    rng = random.Random(5)
    rows, wanted = [], []
    while len(rows) < 6000:
        p = made(rng)
        try:
            own = re.compile(p)
            java = regexes.java(p)
        except (re.error, SpecError):
            continue
        for _ in range(4):
            line = "".join(rng.choice("aabbc\n é") for _ in range(rng.randrange(8)))
            g = rng.randint(0, own.groups)
            m = own.search(line)
            rows.append((len(rows), java.pattern, java.groups[g], line))
            wanted.append((p, line, g, m is not None, (m[g] or "") if m else ""))
    table = spark.createDataFrame(rows, "i int, p string, g int, line string")
    wrong = []
    for r in table.select("i", F.expr("rlike(line, p)").alias("hit"), F.expr("regexp_extract(line, p, g)").alias("text")).collect():
        p, line, g, hit, text = wanted[r["i"]]
        if r["hit"] != hit or g == 0 and r["text"] != text:
            wrong.append((p, line, g, hit, text, r["hit"], r["text"]))
    assert not wrong, wrong[:5]


def test_what_is_refused():
    for bad in ("(", "a{4294967295}", r"(a)(?<=\1)b", None, "(?<=a+)b"):
        with pytest.raises(SpecError):
            regexes.to_java(bad)


def test_any_case_and_names(spark):
    line = spark.createDataFrame([("Key=ÄPFEL k2",)], "line string")
    got = line.select(
        regexes.extracted(F.col("line"), r"(?P<k>key)=(?P<v>äpfel)", "v", True), regexes.extracted(F.col("line"), r"k(\d)?", 1), regexes.extracted(F.col("line"), r"e(\d)?", 1),
        regexes.extracted(F.col("line"), "nothing", 0), regexes.extracted(F.col("line"), "Key", 7), regexes.found(F.col("line"), "key"), regexes.found(F.col("line"), "key", True),
    ).first()
    assert tuple(got) == ("ÄPFEL", "2", None, None, "Key", False, True)


def test_long_lines(spark):
    """The first match is found again where a group may be missing, over a long line, without deep recursion."""
    table = spark.createDataFrame([("x" * 300_000 + "b",), ("x" * 300_000 + "ab",)], "line string")
    assert [r[0] for r in table.select(regexes.extracted(F.col("line"), "(a)?b", 1)).collect()] == [None, "a"]
