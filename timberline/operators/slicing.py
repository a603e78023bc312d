"""Range filters over parsed lines, and what they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import once
from timberline.functions.timestamps import bound

NTZ = "timestamp_ntz"


def in_range(ts: Column, start=None, end=None, include_unparsed: bool = False) -> Column:
    """Both bounds inclusive, a null bound open; lines without a timestamp as the flag says. Equal bounds take one instant, reversed ones nothing."""
    start, end = bound(start), bound(end)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (ts >= F.lit(str(start)).cast(NTZ))
    if end is not None:
        inside = inside & (ts <= F.lit(str(end)).cast(NTZ))
    return F.when(ts.isNull(), F.lit(include_unparsed)).otherwise(inside)


def slice_lines(parsed: DataFrame, start=None, end=None, include_unparsed: bool = False) -> DataFrame:
    # once: Spark writes the timestamp's expression into the filter wherever the condition names it
    return parsed.where(once(F.col("timestamp"), lambda ts: in_range(ts, start, end, include_unparsed)))


def line_status(ts: Column, start=None, end=None) -> Column:
    start, end = bound(start), bound(end)
    out = F.when(ts.isNull(), "unparseable")
    if start is not None:
        out = out.when(ts < F.lit(str(start)).cast(NTZ), "before")
    if end is not None:
        out = out.when(ts > F.lit(str(end)).cast(NTZ), "after")
    return out.otherwise("matched")


def slice_stats(parsed: DataFrame, start=None, end=None) -> DataFrame:
    """One row: counts by status, first and last matched timestamp, and the raw match rate; one pass, partial sums only."""
    status = line_status(F.col("timestamp"), start, end)
    of = lambda s: F.count_if(status == s)
    hit = F.when(status == "matched", F.col("timestamp"))
    return parsed.agg(
        F.count("*").alias("total_lines"), of("matched").alias("matched_lines"), of("before").alias("skipped_before"), of("after").alias("skipped_after"), of("unparseable").alias("unparseable_lines"),
        F.min(hit).alias("first_matched_ts"), F.max(hit).alias("last_matched_ts"),
    ).withColumn("match_rate", F.when(F.col("total_lines") > 0, F.col("matched_lines") / F.col("total_lines")).otherwise(0.0))


def line_count(parsed: DataFrame, start=None, end=None) -> DataFrame:
    s = slice_stats(parsed, start, end)
    return s.select(F.col("total_lines").alias("total"), F.col("matched_lines").alias("matched"), "skipped_before", "skipped_after", F.col("unparseable_lines").alias("unparseable"), (F.col("total_lines") - F.col("matched_lines")).alias("skipped"))
