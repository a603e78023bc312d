"""String functions whose white space is Unicode's, as Python's str methods have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def once(c: Column, use) -> Column:
    """use(c), with c computed once and written once into the plan's code, however often use names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def blank(c: Column) -> Column:
    return strip(c) == ""


def without_first(c: Column, part: Column) -> Column:
    """c with the first occurrence of part removed; unchanged if part is null or absent."""
    at = F.locate(part, c) if isinstance(part, str) else F.instr(c, part)
    cut = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(part), F.length(c)))
    return F.when(part.isNull() | (part == "") | (at == 0), c).otherwise(cut)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
