"""Settings of single operators, put together step by step: each step gives a new value, and what is missing or wrong raises before anything runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.errors import need
from timberline.functions.timestamps import ISO, SYSLOG, TimeFormat, checked_range
from timberline.operators import aggregates, rules
from timberline.sources.indexed import lines_with_ends
from timberline.sources.lines import read_lines
from timberline.streaming import tail


@dataclass(frozen=True)
class Annotation:
    """Tags by keywords; naming a tag again adds to its keywords."""

    tags: tuple[tuple[str, tuple[str, ...]], ...] = ()
    source: str | None = None

    def tag(self, name: str, *keywords: str) -> "Annotation":
        need(bool(name) and bool(keywords) and all(keywords), "a tag and its keywords must not be empty")
        held = dict(self.tags)
        return replace(self, tags=tuple((held | {name: held.get(name, ()) + keywords}).items()))

    def of(self, source: str) -> "Annotation":
        return replace(self, source=source)

    def apply(self, lines: DataFrame, timestamps: DataFrame | None = None) -> DataFrame:
        need(bool(self.tags), "at least one tag")
        named = lines if self.source is None else lines.withColumn("source", F.lit(self.source))
        return rules.annotate(named, {t: list(ks) for t, ks in self.tags}, timestamps)


@dataclass(frozen=True)
class Highlighting:
    """Keywords with the markers and the case rule that held when each was named."""

    keywords: tuple[rules.KeywordRule, ...] = ()
    open: str = ">>>"
    close: str = "<<<"
    any_case: bool = True

    def marked(self, open: str, close: str) -> "Highlighting":
        need(bool(open and close), "markers must not be empty")
        return replace(self, open=open, close=close)

    def cased(self, exact: bool = True) -> "Highlighting":
        return replace(self, any_case=not exact)

    def words(self, *keywords: str) -> "Highlighting":
        return replace(self, keywords=self.keywords + tuple(rules.KeywordRule(k, self.open, self.close, self.any_case) for k in keywords))

    def apply(self, lines: DataFrame) -> DataFrame:
        need(bool(self.keywords), "at least one keyword")
        return rules.highlight(lines, list(self.keywords))


@dataclass(frozen=True)
class Comparison:
    """A diff of two files. Without stripping, lines are compared with their line feeds, so a last line that lacks one is another line."""

    baseline: str | None = None
    current: str | None = None
    strip_whitespace: bool = True

    def run(self, spark: SparkSession) -> DataFrame:
        need(bool(self.baseline), "the baseline's path is required")
        need(bool(self.current), "the current path is required")
        if not self.strip_whitespace:
            return aggregates.diff(lines_with_ends(spark, self.baseline, True), lines_with_ends(spark, self.current, True), False)
        return aggregates.diff(read_lines(spark, self.baseline, strict=True), read_lines(spark, self.current, strict=True))


@dataclass(frozen=True)
class Watch:
    """Follows a growing file. Both bounds are required; unless formats are given, ISO and syslog times are read."""

    path: str
    start: datetime | str | None = None
    end: datetime | str | None = None
    formats: tuple[TimeFormat, ...] = (ISO, SYSLOG)
    poll_seconds: float = 0.5
    max_idle: float | None = None

    def lines(self, spark: SparkSession) -> DataFrame:
        need(self.start is not None and self.end is not None, "both bounds are required")
        start, end = checked_range(self.start, self.end)
        return tail.tail(spark, self.path, start, end, formats=self.formats)

    def run(self, spark: SparkSession, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
        """Starts the query, which hands each batch to `each`; it ends by itself after max_idle seconds without a new line."""
        with tail.idle_events(spark, self.max_idle):
            query = self.lines(spark).writeStream.foreachBatch(each).trigger(processingTime=f"{self.poll_seconds} seconds").option("checkpointLocation", checkpoint).start()
        tail.stop_when_idle(query, self.max_idle)
        return query
