"""Groupings, rates, summaries, alerts, sets and merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.errors import need
from timberline.functions.regexes import compiled, extracted, found
from timberline.functions.text import strip
from timberline.operators.slicing import in_range


def aggregate_by_key(lines: DataFrame, pattern: str, group: int = 1, keep_lines: bool = False) -> DataFrame:
    """key, count, first_line, last_line, first_ord (and lines): one row a key, ordered by first_ord as first seen. Lines whose match has no such group are those of the null key.

    keep_lines puts a key's lines in one row; `order.grouped_lines` has them in rows of bounded size."""
    need(group >= 1, "the group must be at least 1")
    need(group <= compiled(pattern).groups, "the pattern lacks the group")
    keyed = lines.where(found(F.col("line"), pattern)).withColumn("key", extracted(F.col("line"), pattern, group))
    kept = [F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("lines")] if keep_lines else []
    return keyed.groupBy("key").agg(F.count("*").alias("count"), F.min_by("line", "ord").alias("first_line"), F.max_by("line", "ord").alias("last_line"), F.min("ord").alias("first_ord"), *kept)


def unmatched(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.agg(F.count("*").alias("total_lines"), F.count_if(~found(F.col("line"), pattern)).alias("unmatched_lines"))


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("category", F.lit("__unclassified__")).alias("category")).agg(F.count("*").alias("count"))


def rate(parsed: DataFrame, bucket_seconds: int = 60, mode: str = "minute_aligned") -> DataFrame:
    """window_start, window_end, count of the buckets that have lines. minute_aligned: buckets restart each minute; tumbling: they don't."""
    need(bucket_seconds >= 1, "the bucket must be at least a second")
    need(mode in ("minute_aligned", "tumbling"), f"unknown mode {mode}")
    timed = parsed.where(F.col("timestamp").isNotNull())
    ts = F.col("timestamp")
    if mode == "tumbling":
        return timed.groupBy(F.window(ts, f"{bucket_seconds} seconds").alias("w")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count")
    start = F.timestamp_add("SECOND", (F.floor(F.second(ts) / bucket_seconds) * bucket_seconds).cast("int"), F.date_trunc("MINUTE", ts)).cast("timestamp_ntz")
    return timed.groupBy(start.alias("window_start")).agg(F.count("*").alias("count")).select("window_start", F.timestamp_add("SECOND", F.lit(bucket_seconds), F.col("window_start")).cast("timestamp_ntz").alias("window_end"), "count")


def peak(buckets: DataFrame) -> DataFrame:
    """The bucket with most lines, the earliest of equals."""
    return buckets.orderBy(F.col("count").desc(), "window_start").limit(1)


# In the order in which a line is tested, as plain substrings.
SUMMARY_LEVELS = ("DEBUG", "INFO", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL")


def message(line: Column) -> Column:
    return F.substring(strip(F.substring(line, F.lit(21), F.length(line))), 1, 80)


def summary_totals(parsed: DataFrame) -> DataFrame:
    at = F.when(F.col("timestamp").isNotNull(), F.col("ord"))
    return parsed.agg(F.count("*").alias("total_lines"), F.count("timestamp").alias("matched_lines"), F.min_by("timestamp", at).alias("first_timestamp"), F.max_by("timestamp", at).alias("last_timestamp"))


def summary_severities(parsed: DataFrame) -> DataFrame:
    upper = F.upper("line")
    level = F.coalesce(*[F.when(upper.contains(x), F.lit(x)) for x in SUMMARY_LEVELS])
    return parsed.withColumn("severity", level).where(F.col("severity").isNotNull()).groupBy("severity").agg(F.count("*").alias("count"))


def summary_top(parsed: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent messages, the first seen of equals first; place from 1."""
    need(top >= 1, "top must be at least 1")
    counts = parsed.withColumn("message", message(F.col("line"))).where(F.col("message") != "").groupBy("message").agg(F.count("*").alias("count"), F.min("ord").alias("first_ord"))
    best = counts.orderBy(F.col("count").desc(), "first_ord").limit(top)
    from pyspark.sql import Window

    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("count").desc(), "first_ord")))


@dataclass(frozen=True)
class ThresholdRule:
    name: str
    pattern: str
    threshold: int

    def __post_init__(self):
        need(bool(self.name and self.pattern), "name and pattern must not be empty")
        need(self.threshold >= 1, "the threshold must be at least 1")


def alerts(lines: DataFrame, rules: list[ThresholdRule], keep_lines: bool = False) -> DataFrame:
    """rule_name, threshold, matched_count, triggered for every rule, in one pass of conditional counts."""
    need(len(rules) > 0, "at least one rule")
    counts = lines.agg(*[F.count_if(F.col("line").contains(r.pattern)).alias(f"c{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.threshold).cast("long").alias("threshold"), F.col(f"c{i}").alias("matched_count"), (F.col(f"c{i}") >= r.threshold).alias("triggered")) for i, r in enumerate(rules)])
    out = counts.select(F.inline(rows))
    if not keep_lines:
        return out
    hits = lines.select("ord", "line", F.explode(F.array_compact(F.array(*[F.when(F.col("line").contains(r.pattern), F.lit(r.name)) for r in rules]))).alias("rule_name"))
    return out.join(hits.groupBy("rule_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("matching_lines")), "rule_name", "left").withColumn("matching_lines", F.coalesce("matching_lines", F.array().cast("array<string>")))


def diff(baseline: DataFrame, current: DataFrame, strip_whitespace: bool = True) -> DataFrame:
    """line, section (added, removed or common) of the different lines of both, in one shuffle."""
    text = strip(F.col("line")) if strip_whitespace else F.col("line")
    both = baseline.select(text.alias("line"), F.lit(True).alias("old")).unionByName(current.select(text.alias("line"), F.lit(False).alias("old")))
    sides = both.groupBy("line").agg(F.bool_or("old").alias("was"), F.bool_or(~F.col("old")).alias("now"))
    return sides.select("line", F.when(F.col("was") & F.col("now"), "common").when(F.col("was"), "removed").otherwise("added").alias("section"))


def merge(*parsed: DataFrame) -> DataFrame:
    """Lines with a timestamp of all frames, by timestamp, then frame, then order: columns file_idx, ord, source, timestamp, line."""
    out = None
    for i, p in enumerate(parsed):
        part = p.where(F.col("timestamp").isNotNull()).select(F.lit(i).alias("file_idx"), "ord", "source", "timestamp", "line")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("timestamp", "file_idx", "ord")


def profile_stats(spark: SparkSession, parsed: DataFrame, profiles: list, times: dict[str, Column] | None = None) -> DataFrame:
    """For every profile (name, start, end): the counts of its range, all profiles in one scan. Of equal names the last wins.

    times: the timestamp as a profile reads it, by name, where that is not the column timestamp."""
    named = {p.name: p for p in profiles}
    need(len(named) > 0, "at least one profile")
    columns = []
    for i, p in enumerate(named.values()):
        ts = (times or {}).get(p.name, F.col("timestamp"))
        hit = in_range(ts, p.start, p.end) & ts.isNotNull()
        columns += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, ts)).alias(f"a{i}"), F.max(F.when(hit, ts)).alias(f"b{i}"), F.count_if(ts.isNull()).alias(f"u{i}")]
    totals = parsed.agg(F.count("*").alias("total"), *columns)
    rows = F.array(*[F.struct(F.lit(n).alias("profile"), F.col("total").alias("total_lines"), F.col(f"n{i}").alias("matched_lines"), F.col(f"u{i}").alias("unparseable_lines"), F.col(f"a{i}").alias("first_matched_ts"), F.col(f"b{i}").alias("last_matched_ts")) for i, n in enumerate(named)])
    return totals.select(F.inline(rows))
