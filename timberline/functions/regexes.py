"""Python regular expressions as Java ones.

Python parses the pattern on the driver; its parse tree is written out again in Java's syntax, every character by its code point, every class and
anchor by what Python means by it. What case differs in is asked of Python for each letter, so no flag of Java's decides. What Java
cannot say is refused with a SpecError before any job runs.

Known differences that stay: characters that are assigned in one of the two Unicode tables only, and patterns so ambiguous
that Java's recursion ends before Python's would (a repeated group of alternatives over many thousand characters).
"""

from __future__ import annotations

import re
import warnings
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.errors import SpecError, need
from timberline.functions.text import once

# What the categories hold, inside of a class; white space is str.isspace(), words are str.isalnum() and the underscore.
SPACES = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CATEGORIES = {
    op.CATEGORY_DIGIT: (r"\p{Nd}", r"0-9"),
    op.CATEGORY_SPACE: (SPACES, r"\x{9}-\x{d}\x{20}"),
    op.CATEGORY_WORD: (r"\p{L}\p{N}_", r"a-zA-Z0-9_"),
}
NEGATED = {op.CATEGORY_NOT_DIGIT: op.CATEGORY_DIGIT, op.CATEGORY_NOT_SPACE: op.CATEGORY_SPACE, op.CATEGORY_NOT_WORD: op.CATEGORY_WORD}
REPEATS = {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}
#: Any character; the end of the text, or what stands before its last line feed.
ANY, END = r"[\x{0}-\x{10ffff}]", r"(?=\x{a}?\z)"
#: Java's largest count of a repeat.
MOST = 2**31 - 1


@lru_cache(4096)
def compiled(pattern: str, any_case: bool = False) -> re.Pattern:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # of sets that may once be nested
            return re.compile(pattern, re.IGNORECASE if any_case else 0)
    except (re.error, TypeError, RecursionError, OverflowError) as e:
        raise SpecError(f"pattern {pattern!r}: {e}") from e


@lru_cache(1)
def letters() -> dict[int, tuple[int, ...]]:
    """Code points that have case: those that may equal each when case doesn't count."""
    by_lower = defaultdict(set)
    for code in range(0x110000):
        c = chr(code)
        if c.lower() != c or c.upper() != c or c.casefold() != c:
            for other in (c.lower(), c.upper(), c.lower().upper(), c.upper().lower(), c.casefold()):
                by_lower[code].add(ord(other[0]))
                by_lower[ord(other[0])].add(code)
    out = {}
    for code in by_lower:
        seen, todo = {code}, [code]
        while todo:
            new = by_lower[todo.pop()] - seen
            seen |= new
            todo += new
        out[code] = tuple(sorted(seen))
    return out


@lru_cache(100_000)
def variants(code: int, ascii_only: bool) -> tuple[int, ...]:
    """The code points that Python takes for this one when case doesn't count."""
    fits = re.compile(re.escape(chr(code)), re.IGNORECASE | (re.ASCII if ascii_only else 0)).fullmatch
    return tuple(c for c in letters().get(code, (code,)) if c == code or fits(chr(c)))


@dataclass(frozen=True)
class Java:
    """pattern: in Java's syntax; groups: the number there of each group of the Python pattern (0: the match)."""

    pattern: str
    groups: dict[int, int]


class Writer:
    """One pattern's tree in Java's syntax. first: the number before that of its first group; tested: groups that a condition asks about."""

    def __init__(self, first: int, tested: set[int]):
        self.last, self.tested, self.groups, self.marks = first, tested, {0: 0}, {}

    def sequence(self, items, flags: int, behind: bool) -> str:
        return "".join([self.item(kind, value, flags, behind) for kind, value in items])

    def letter(self, code: int, flags: int) -> str:
        """Inside of a class."""
        return "".join([rf"\x{{{c:x}}}" for c in (variants(code, bool(flags & re.ASCII)) if flags & re.IGNORECASE else (code,))])

    def category(self, name, flags: int) -> str:
        return CATEGORIES[name][bool(flags & re.ASCII)]

    def one_of(self, items, flags: int) -> str:
        """A class. Negated ones inside are alternatives, as Java's nested classes have rules of their own."""
        negate, inside, others = False, [], []
        for kind, value in items:
            if kind is op.NEGATE:
                negate = True
            elif kind is op.LITERAL:
                inside.append(self.letter(value, flags))
            elif kind is op.RANGE:
                low, high = value
                inside.append(rf"\x{{{low:x}}}-\x{{{high:x}}}")
                if flags & re.IGNORECASE:
                    inside += [self.letter(c, flags) for c in letters() if low <= c <= high]
            elif value in NEGATED:
                others.append(f"[^{self.category(NEGATED[value], flags)}]")
            else:
                inside.append(self.category(value, flags))
        if negate and not others:
            return f"[^{''.join(inside)}]"
        parts = ([f"[{''.join(inside)}]"] if inside else []) + others
        found = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:(?!{found}){ANY})" if negate else found

    def at(self, where, flags: int) -> str:
        word = f"[{self.category(op.CATEGORY_WORD, flags)}]"
        if where is op.AT_BEGINNING:
            return r"(?<![^\x{a}])" if flags & re.MULTILINE else r"\A"
        if where is op.AT_BEGINNING_STRING:
            return r"\A"
        if where is op.AT_END:
            return r"(?=\x{a}|\z)" if flags & re.MULTILINE else END
        if where is op.AT_END_STRING:
            return r"\z"
        edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        if where is op.AT_BOUNDARY:
            return edge
        if where is op.AT_NON_BOUNDARY:  # never in an empty text
            return rf"(?:(?!{edge})(?!\A\z))" if re.compile(r"\B").search("") is None else f"(?!{edge})"
        raise SpecError(f"anchor {where}")

    def item(self, kind, value, flags: int, behind: bool) -> str:
        if kind is op.LITERAL:
            return f"[{self.letter(value, flags)}]" if flags & re.IGNORECASE else rf"\x{{{value:x}}}"
        if kind is op.NOT_LITERAL:
            return f"[^{self.letter(value, flags)}]"
        if kind is op.ANY:
            return ANY if flags & re.DOTALL else r"[^\x{a}]"
        if kind is op.IN:
            return self.one_of(value, flags)
        if kind is op.AT:
            return self.at(value, flags)
        if kind is op.BRANCH:
            return f"(?:{'|'.join([self.sequence(part, flags, behind) for part in value[1]])})"
        if kind in REPEATS:
            least, most, part = value
            need(least <= MOST and (most is op.MAXREPEAT or most <= MOST), f"a repeat of more than {MOST}")
            count = f"{{{least},{'' if most is op.MAXREPEAT else most}}}"
            return f"(?:{self.sequence(part, flags, behind)}){count}{REPEATS[kind]}"
        if kind is op.SUBPATTERN:
            group, more, less, part = value
            flags = (flags | more) & ~less
            if group is None:
                return f"(?:{self.sequence(part, flags, behind)})"
            self.last += 1
            self.groups[group] = self.last
            inside = self.sequence(part, flags, behind)
            if group not in self.tested:
                return f"({inside})"
            self.last += 1  # an empty group that takes part whenever the group does
            self.marks[group] = self.last
            return f"({inside}())"
        if kind is op.ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags, behind)})"
        if kind in (op.ASSERT, op.ASSERT_NOT):
            direction, part = value
            sign = "=" if kind is op.ASSERT else "!"
            return f"(?{'<' if direction < 0 else ''}{sign}{self.sequence(part, flags, behind or direction < 0)})"
        if kind is op.FAILURE:
            return "(?!)"
        if kind is op.GROUPREF:
            need(not behind, "a group named in a look-behind")
            return rf"(?{'iu' if flags & re.IGNORECASE else ''}:\{self.groups[value]})"
        if kind is op.GROUPREF_EXISTS:
            group, yes, no = value
            need(not behind and group in self.marks, "a condition on a group that has not ended, or in a look-behind")
            there = rf"\{self.marks[group]}"
            return f"(?:{there}{self.sequence(yes, flags, behind)}|(?!{there}){self.sequence(no or [], flags, behind)})"
        raise SpecError(f"{kind} has no Java form")


def _tested(items) -> set[int]:
    """Groups that conditions ask about, anywhere in a tree."""
    out: set[int] = set()
    for kind, value in items:
        todo = [value] if kind is not op.GROUPREF_EXISTS else [value[1], value[2]]
        if kind is op.GROUPREF_EXISTS:
            out.add(value[0])
        while todo:
            part = todo.pop()
            if isinstance(part, parser.SubPattern):
                out |= _tested(part)
            elif isinstance(part, (tuple, list)):
                todo += part
    return out


@lru_cache(4096)
def java(pattern: str, any_case: bool = False, first: int = 0) -> Java:
    """first: how many groups stand before the pattern where it is used inside of another."""
    own = compiled(pattern, any_case)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = parser.parse(pattern, re.IGNORECASE if any_case else 0)
    need(not own.flags & re.LOCALE, f"pattern {pattern!r}: a locale's rules")
    writer = Writer(first, _tested(tree))
    try:
        return Java(writer.sequence(tree, own.flags, False), writer.groups)
    except SpecError as e:
        raise SpecError(f"pattern {pattern!r}: {e} has no Java form") from e


def to_java(pattern: str, any_case: bool = False) -> str:
    return java(pattern, any_case).pattern


def plain(pattern: str, any_case: bool = False) -> str | None:
    """The text that the pattern stands for, if it is one."""
    own = compiled(pattern, any_case)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = parser.parse(pattern, own.flags & ~re.UNICODE)
    return "".join([chr(v) for _, v in tree]) if not own.flags & re.IGNORECASE and all(kind is op.LITERAL for kind, _ in tree) else None


def found(line: Column, pattern: str, any_case: bool = False) -> Column:
    text = plain(pattern, any_case)
    return line.rlike(to_java(pattern, any_case)) if text is None else line.contains(text)


def group_number(pattern: str, group: int | str, any_case: bool = False) -> int:
    """A group that the pattern lacks is the whole match."""
    own = compiled(pattern, any_case)
    return own.groupindex.get(group, 0) if isinstance(group, str) else group if 0 <= group <= own.groups else 0


def takes_part(pattern: str, group: int, any_case: bool = False) -> bool:
    """Whether the group takes part in every match, as far as the tree tells: it stands in no alternative, option, condition or look-around."""

    def inside(items) -> bool | None:
        for kind, value in items:
            if kind is op.SUBPATTERN:
                if value[0] == group:
                    return True
                got = inside(value[3])
            elif kind in REPEATS:
                got = inside(value[2])
                got = got and value[0] > 0 if got is not None else None
            elif kind is op.ATOMIC_GROUP:
                got = inside(value)
            elif kind is op.ASSERT:
                got = inside(value[1])
            elif kind is op.BRANCH:
                got = False if any(inside(p) is not None for p in value[1]) else None
            elif kind is op.ASSERT_NOT:
                got = False if inside(value[1]) is not None else None
            elif kind is op.GROUPREF_EXISTS:
                got = False if any(p is not None and inside(p) is not None for p in value[1:]) else None
            else:
                got = None
            if got is not None:
                return got
        return None

    compiled(pattern, any_case)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return group == 0 or bool(inside(parser.parse(pattern, re.IGNORECASE if any_case else 0)))


def extracted(line: Column, pattern: str, group: int | str, any_case: bool = False) -> Column:
    """The group of the first match; null without a match, or where the group takes no part in it. A group the pattern lacks falls back to the whole match."""
    number = group_number(pattern, group, any_case)
    own = java(pattern, any_case)
    text = F.regexp_extract(line, own.pattern, own.groups[number])
    hit = found(line, pattern, any_case)
    if takes_part(pattern, number, any_case):
        return F.when(hit, text)
    # Spark gives '' for both: then the first match is made once more, and the group named after it; naming fails unless it took part
    again = java(pattern, any_case, own_groups(own))
    took = rf"\A(?:(?!{own.pattern}){ANY})*+(?>{again.pattern})\{again.groups[number]}"
    return F.when(hit, once(text, lambda t: F.when((t != "") | line.rlike(took), t)))


def own_groups(own: Java) -> int:
    """How many groups a Java pattern has, those for conditions included."""
    return len(re.findall(r"\((?!\?)", own.pattern))


def literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
