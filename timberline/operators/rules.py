"""Row-local rules compiled into column expressions: nothing here shuffles or leaves the JVM, callables excepted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.errors import need
from timberline.functions.regexes import compiled, extracted, found, literal

# Severity names and what two of them are called.
LEVELS = r"\b(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL)\b"
ALIASES = {"WARN": "WARNING", "FATAL": "CRITICAL"}
KNOWN = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def severity(line: Column) -> Column:
    """The first level named as a word, in either case; WARN is WARNING and FATAL is CRITICAL; null if none."""
    level = F.upper(extracted(line, LEVELS, 1, True))
    return F.when(level == "WARN", "WARNING").when(level == "FATAL", "CRITICAL").otherwise(level)


def severity_filter(lines: DataFrame, levels: list[str] = ()) -> DataFrame:
    """Adds severity and keeps the levels given; without any, all lines, also those without a level."""
    wanted = [ALIASES.get(x.strip().upper(), x.strip().upper()) for x in levels]
    need(all(x in KNOWN for x in wanted), f"unknown level in {list(levels)}")
    out = lines.withColumn("severity", severity(F.col("line")))
    return out.where(F.col("severity").isin(wanted)) if wanted else out


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    group: str = ""
    is_regex: bool = True

    def __post_init__(self):
        if self.is_regex:
            compiled(self.pattern)

    def fits(self, line: Column) -> Column:
        return found(line, self.pattern) if self.is_regex else line.contains(self.pattern)


def first(rules, line: Column, value: Callable, default) -> Column:
    """value(rule) of the first rule that fits."""
    out = None
    for rule in rules:
        out = F.when(rule.fits(line), value(rule)) if out is None else out.when(rule.fits(line), value(rule))
    return default if out is None else out.otherwise(default)


def pattern_match(lines: DataFrame, rules: list[PatternRule]) -> DataFrame:
    """line, pattern, group of the first rule that fits; other lines go."""
    none = F.lit(None).cast("struct<pattern: string, group: string>")
    hit = first(rules, F.col("line"), lambda r: F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.group).alias("group")), none)
    return lines.withColumn("_hit", hit).where(F.col("_hit").isNotNull()).select("*", "_hit.pattern", "_hit.group").drop("_hit")


def annotate(lines: DataFrame, tags: dict[str, list[str]], timestamps: DataFrame | None = None) -> DataFrame:
    """Adds tags: those with any keyword in the line, in either case. timestamps (ord, timestamp): the n-th goes to the n-th line, and the
    shorter of both ends it."""
    need(all(t and ks for t, ks in tags.items()), "tags and keywords must not be empty")
    low = F.lower("line")
    marks = [F.when(F.greatest(*[low.contains(k.lower()) for k in ks], F.lit(False)), F.lit(t)) for t, ks in tags.items()]
    out = lines.withColumn("tags", F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))
    if timestamps is None:
        return out
    from timberline.operators.order import placed

    return placed(out).join(placed(timestamps.select("ord", "timestamp")).select("pos", "timestamp"), "pos").drop("pos")


@dataclass(frozen=True)
class TagRule:
    tag: str
    pattern: str
    any_case: bool = True

    def __post_init__(self):
        need(bool(self.tag), "a tag must not be empty")
        need(bool(self.pattern), "a pattern must not be empty")
        compiled(self.pattern, self.any_case)

    def fits(self, line: Column) -> Column:
        return found(line, self.pattern, self.any_case)


def tag(lines: DataFrame, rules: list[TagRule], time_patterns: list[str] = ()) -> DataFrame:
    """Adds tags in rule order and timestamp, the text of the first time pattern that hits; blank lines go."""
    from timberline.functions.text import blank

    marks = [F.when(r.fits(F.col("line")), F.lit(r.tag)) for r in rules]
    times = [extracted(F.col("line"), p, 0) for p in time_patterns]
    return lines.where(~blank(F.col("line"))).withColumns({
        "tags": F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"),
        "timestamp": F.coalesce(*times) if times else F.lit(None).cast("string"),
    })


@dataclass(frozen=True)
class ClassifierRule:
    name: str
    category: str
    pattern: str
    confidence: float = 1.0

    def __post_init__(self):
        need(bool(self.name and self.category and self.pattern), "name, category and pattern must not be empty")
        need(0.0 <= self.confidence <= 1.0, "confidence must be in [0, 1]")
        compiled(self.pattern)

    def fits(self, line: Column) -> Column:
        return found(line, self.pattern)


def classify(lines: DataFrame, rules: list[ClassifierRule]) -> DataFrame:
    """Adds category, confidence and matched_rule of the first rule that fits; else null, 0.0, null."""
    none = F.struct(F.lit(None).cast("string").alias("category"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("matched_rule"))
    hit = first(rules, F.col("line"), lambda r: F.struct(F.lit(r.category).alias("category"), F.lit(float(r.confidence)).alias("confidence"), F.lit(r.name).alias("matched_rule")), none)
    return lines.withColumn("_hit", hit).select("*", "_hit.category", "_hit.confidence", "_hit.matched_rule").drop("_hit")


@dataclass(frozen=True)
class ScoringRule:
    name: str
    pattern: str
    score: float

    def __post_init__(self):
        need(bool(self.name and self.pattern), "name and pattern must not be empty")
        compiled(self.pattern)

    def fits(self, line: Column) -> Column:
        return found(line, self.pattern)


def score(lines: DataFrame, rules: list[ScoringRule], threshold: float | None = None) -> DataFrame:
    """Adds total_score (the sum of the rules that fit) and matched_rules; a threshold keeps scores from it on."""
    need(threshold is None or isinstance(threshold, (int, float)), "threshold must be a number")
    total, names = F.lit(0.0), []
    for r in rules:
        total = total + F.when(r.fits(F.col("line")), float(r.score)).otherwise(0.0)
        names.append(F.when(r.fits(F.col("line")), F.lit(r.name)))
    out = lines.withColumns({"total_score": total, "matched_rules": F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")})
    return out if threshold is None else out.where(F.col("total_score") >= threshold)


@dataclass(frozen=True)
class RouteRule:
    name: str
    pattern: str
    destination: str
    any_case: bool = False

    def __post_init__(self):
        need(bool(self.name and self.pattern and self.destination), "name, pattern and destination must not be empty")
        compiled(self.pattern, self.any_case)

    def fits(self, line: Column) -> Column:
        return found(line, self.pattern, self.any_case)


def route(lines: DataFrame, rules: list[RouteRule], default: str = "unmatched") -> DataFrame:
    """Adds destination and rule_name of the first rule that fits; write.partitionBy("destination") makes the buckets."""
    none = F.struct(F.lit(default).alias("destination"), F.lit(None).cast("string").alias("rule_name"))
    hit = first(rules, F.col("line"), lambda r: F.struct(F.lit(r.destination).alias("destination"), F.lit(r.name).alias("rule_name")), none)
    return lines.withColumn("_hit", hit).select("*", "_hit.destination", "_hit.rule_name").drop("_hit")


def on_route(routed: DataFrame, callback: Callable) -> None:
    """Calls callback(row) for every routed line, on the executors, in no order."""
    routed.foreach(callback)


@dataclass(frozen=True)
class FieldRule:
    name: str
    pattern: str

    def __post_init__(self):
        need(bool(self.name and self.pattern), "name and pattern must not be empty")
        compiled(self.pattern)


def extract_fields(lines: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """Adds fields, a map: the group `value`, else the group named as the rule, else group 1, else the match. Of equal names the last that matches wins."""
    by_name: dict[str, list[Column]] = {}
    for r in rules:
        names = compiled(r.pattern).groupindex
        group = "value" if "value" in names else r.name if r.name in names else 1
        by_name.setdefault(r.name, []).insert(0, extracted(F.col("line"), r.pattern, group))
    entries = [F.struct(F.lit(n).alias("key"), F.coalesce(*cs).alias("value")) for n, cs in by_name.items()]
    if not entries:
        return lines.withColumn("fields", F.create_map().cast("map<string,string>"))
    return lines.withColumn("fields", F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())))


@dataclass(frozen=True)
class KeywordRule:
    keyword: str
    open: str = ">>>"
    close: str = "<<<"
    any_case: bool = True

    def __post_init__(self):
        need(bool(self.keyword), "a keyword must not be empty")

    @property
    def java(self) -> str:
        return ("(?iu)" if self.any_case else "") + literal(self.keyword)


def highlight(lines: DataFrame, rules: list[KeywordRule]) -> DataFrame:
    """Adds matched_keywords (judged on the line as it came) and highlighted (one keyword after the other, so a later
    one can match within an earlier one's marker); lines without any keyword go."""
    escape = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    marked = F.col("line")
    for r in rules:
        marked = F.regexp_replace(marked, r.java, f"{escape(r.open)}$0{escape(r.close)}")
    names = F.array_compact(F.array(*[F.when(F.col("line").rlike(r.java), F.lit(r.keyword)) for r in rules])) if rules else F.array().cast("array<string>")
    return lines.withColumns({"matched_keywords": names, "highlighted": marked}).where(F.size("matched_keywords") > 0)


@dataclass(frozen=True)
class FormatterStep:
    name: str
    change: Callable = field(compare=False)
    native: bool = True

    def __post_init__(self):
        need(bool(self.name) and callable(self.change), "a step needs a name and a callable")


def format_chain(lines: DataFrame, steps: list[FormatterStep], skip_on_none: bool = True) -> DataFrame:
    """Adds transformed and stages. A native step maps a Column to a Column; another one maps str to str or None, in
    Arrow batches. A null drops the line, or keeps the value as it was; the stage is named in either case."""
    value, dropped = F.col("line"), F.lit(False)
    for s in steps:
        new = s.change(value) if s.native else F.pandas_udf(lambda v, f=s.change: v.map(lambda x: None if x is None else f(x)), "string")(value)
        dropped, value = dropped | new.isNull(), F.coalesce(new, value)
    out = lines.withColumns({"transformed": value, "stages": F.array(*[F.lit(s.name) for s in steps]).cast("array<string>"), "_dropped": dropped})
    return (out.where(~F.col("_dropped")) if skip_on_none else out).drop("_dropped")
