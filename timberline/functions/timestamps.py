"""Timestamps of log lines as expressions: patterns are tried in order, each at its first hit, and null ends it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.errors import SpecError, need
from timberline.functions.regexes import compiled, extracted, java
from timberline.functions.text import once


@dataclass(frozen=True)
class TimeFormat:
    """pattern: its first group (else the match) is the text; layout: how strptime would read it; iso: a T in it is a space; java, after lead:
    the same layout in Spark's letters, where the pattern fixes the number of digits."""

    pattern: str
    layout: str
    iso: bool = False
    java: str = ""
    lead: str = ""
    shape: "Shape" = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        compiled(self.pattern)
        object.__setattr__(self, "shape", Shape.of(self.layout))

    def strptime(self, line: str):
        """What `timestamp` reads from a line, by Python; for a few lines."""
        from datetime import datetime

        m = compiled(self.pattern).search(line)
        text = m and m[1 if m.re.groups else 0]
        if text is None:
            return None
        try:
            return datetime.strptime(f"1900 {text}", f"%Y {self.layout}").replace(tzinfo=None) if self.lead else datetime.strptime(text.replace("T", " ") if self.iso else text, self.layout).replace(tzinfo=None)
        except ValueError:
            return None


# Names in the C locale, and the text that each directive of strptime takes.
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
TEXTS = {
    "d": r"3[0-1]|[1-2][0-9]|0[1-9]|[1-9]| [1-9]", "f": r"[0-9]{1,6}", "H": r"2[0-3]|[0-1][0-9]|[0-9]", "I": r"1[0-2]|0[1-9]|[1-9]| [1-9]",
    "j": r"36[0-6]|3[0-5][0-9]|[1-2][0-9][0-9]|0[1-9][0-9]|00[1-9]|[1-9][0-9]|0[1-9]|[1-9]", "m": r"1[0-2]|0[1-9]|[1-9]", "M": r"[0-5][0-9]|[0-9]", "S": r"6[0-1]|[0-5][0-9]|[0-9]",
    "w": r"[0-6]", "u": r"[1-7]", "y": r"[0-9][0-9]", "Y": r"[0-9][0-9][0-9][0-9]", "z": r"[+-][0-9][0-9]:?[0-5][0-9](?::?[0-5][0-9](?:\.[0-9]{1,6})?)?|(?-i:Z)", "Z": "utc|gmt", "p": "am|pm",
    "b": "|".join(m[:3] for m in MONTHS), "B": "|".join(MONTHS), "a": "|".join(d[:3] for d in DAYS), "A": "|".join(DAYS),
}
# Directives that stand for several, in the C locale.
WHOLE = {"c": "%a %b %d %H:%M:%S %Y", "x": "%m/%d/%y", "X": "%H:%M:%S", "D": "%m/%d/%y", "T": "%H:%M:%S", "R": "%H:%M", "F": "%Y-%m-%d", "h": "%b"}


@dataclass(frozen=True)
class Shape:
    """A strptime layout as a pattern in any case, and the group of each directive in it."""

    pattern: str
    groups: tuple[str, ...]

    @classmethod
    def of(cls, layout: str) -> "Shape":
        need(bool(layout), "an empty time format")
        out, groups, i = "", [], 0
        while i < len(layout):
            c = layout[i]
            if c == "%":
                need(i + 1 < len(layout), f"time format {layout!r}: directive at {i}")
                name = layout[i + 1]
                if name in WHOLE:
                    layout = layout[:i] + WHOLE[name] + layout[i + 2 :]
                    continue
                if name == "%":
                    out += "%"
                else:
                    need(name in TEXTS, f"time format {layout!r}: directive at {i}")
                    need(name not in groups, f"time format {layout!r}: %{name} stands twice")
                    out += f"({TEXTS[name]})"
                    groups.append(name)
                i += 2
            elif c.isspace():
                while i < len(layout) and layout[i].isspace():
                    i += 1
                out += r"\s+"
            else:
                out, i = out + re.escape(c), i + 1
        need(not ("j" in groups and ({"m", "d", "b", "B"} & set(groups))), f"time format {layout!r}: the day twice")
        need(len({"b", "B", "m"} & set(groups)) < 2 and len({"y", "Y"} & set(groups)) < 2 and len({"H", "I"} & set(groups)) < 2, f"time format {layout!r}: a part twice")
        compiled(out, True)
        return cls(out, tuple(groups))

    def read(self, text: Column) -> Column:
        """TIMESTAMP_NTZ, or null where strptime raises. The text is matched once, its parts are taken from one string."""
        whole = rf"\A(?:{self.pattern})\Z"
        own = java(whole, True)
        if not self.groups:
            return F.when(text.rlike(own.pattern), F.lit("1900-01-01").cast("timestamp_ntz"))
        parts = F.split(F.regexp_replace(text, own.pattern, "\x1f".join(f"${own.groups[i]}" for i in range(1, len(self.groups) + 1))), "\x1f")
        return F.when(text.rlike(own.pattern), once(parts, self.made))

    def made(self, parts: Column) -> Column:
        part = {name: F.get(parts, F.lit(i)) for i, name in enumerate(self.groups)}
        number = lambda name, other: F.trim(part[name]).cast("int") if name in part else F.lit(other)
        name_of = lambda name, names: F.array_position(F.array(*map(F.lit, names)), F.lower(part[name])).cast("int")
        year = number("Y", 1900)
        if "y" in part:
            short = number("y", 0)
            year = short + F.when(short > 68, 1900).otherwise(2000)
        month = name_of("b", [m[:3] for m in MONTHS]) if "b" in part else name_of("B", MONTHS) if "B" in part else number("m", 1)
        hour = number("H", 0)
        if "I" in part:  # 12 is the first hour of its half
            hour = F.pmod(number("I", 12), F.lit(12)) + (F.when(F.lower(part["p"]) == "pm", 12).otherwise(0) if "p" in part else F.lit(0))
        second = number("S", 0)
        micros = F.rpad(part["f"], 6, "0").cast("decimal(16,6)") / 1_000_000 if "f" in part else F.lit(0)
        day = number("d", 1)
        made = F.call_function("try_make_timestamp_ntz", year, month, day, hour, number("M", 0), (second + micros).cast("decimal(16,6)"))
        if "j" in part:  # the day of the year
            days = number("j", 1)
            made = F.timestamp_add("DAY", days - 1, made)
        return F.when((year >= 1) & (second < 60), made)


# The built-in layouts, in the order in which they are tried.
ISO = TimeFormat(r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", "%Y-%m-%d %H:%M:%S", True, "yyyy-MM-dd HH:mm:ss")
SYSLOG = TimeFormat(r"([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2})", "%b %d %H:%M:%S", False, "yyyy MMM d HH:mm:ss", "1900 ")
APACHE = TimeFormat(r"(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2})", "%d/%b/%Y:%H:%M:%S", False, "dd/MMM/yyyy:HH:mm:ss")
DEFAULT = (ISO, SYSLOG, APACHE)


def strptime_format(fmt: str, pattern: str | None = None) -> TimeFormat:
    """From a strptime format: what datetime.strptime reads from the pattern's first group, fractions kept, offsets dropped. Without a pattern, the
    format's own shape is looked for, not beginning or ending inside of a number. Parts of a date that the format lacks are those of 1900-01-01.

    Digits are ASCII's. Week numbers and ISO years (%U, %W, %V, %G) are refused, as is a directive that stands twice; names are those of the C locale."""
    return TimeFormat(pattern or rf"(?i)(?<!\d)({Shape.of(fmt).pattern})(?!\d)", fmt)


def text_of(line: Column, f: TimeFormat) -> Column:
    return extracted(line, f.pattern, 1 if compiled(f.pattern).groups else 0)


def _time(text: Column, f: TimeFormat) -> Column:
    if not f.java:
        return once(text, f.shape.read)
    text = F.replace(text, F.lit("T"), F.lit(" ")) if f.iso else F.regexp_replace(text, r"\s+", " ")
    return F.try_to_timestamp(F.concat(F.lit(f.lead), text) if f.lead else text, F.lit(f.java)).cast("timestamp_ntz")


def timestamp(line: Column, formats: tuple[TimeFormat, ...] = DEFAULT) -> Column:
    """TIMESTAMP_NTZ or null; of the built-in layouts fractions and offsets are dropped; years that the layout lacks are 1900."""
    need(len(formats) > 0, "at least one time format")
    return F.coalesce(*[_time(text_of(line, f), f) for f in formats])


def timestamp_text(line: Column, formats: tuple[TimeFormat, ...] = DEFAULT) -> Column:
    """The text that the timestamp was read from, or null."""
    read = lambda f: once(text_of(line, f), lambda text: F.when(_time(text, f).isNotNull(), text))
    return F.coalesce(*map(read, formats))


# Layouts of bounds that users give.
BOUND_LAYOUTS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%b %d %H:%M:%S", "%d/%b/%Y:%H:%M:%S")


def bound(value):
    """A datetime from a string in one of four layouts (the year is 1900 where a layout lacks it), or a datetime (its zone dropped), or None."""
    import warnings
    from datetime import datetime

    if value is None:
        return None
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    for layout in BOUND_LAYOUTS:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", DeprecationWarning)  # a layout without a year
                return datetime.strptime(str(value).strip(), layout)
        except ValueError:
            continue
    raise SpecError(f"not a date and time: {value!r}")


def checked_range(start, end):
    start, end = bound(start), bound(end)
    need(start is None or end is None or start < end, "start must be before end")
    return start, end
