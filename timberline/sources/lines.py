"""Log lines as DataFrames: `ord` gives the order of lines, `source` their file, `line` the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.timestamps import DEFAULT, timestamp


def read_lines(spark: SparkSession, *paths: str, strict: bool = False) -> DataFrame:
    """ord struct<file, block, row>, source, line. Bytes that aren't UTF-8 become U+FFFD, or raise if strict."""
    out = None
    for i, path in enumerate(paths):
        text = spark.read.text(path)
        clean = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.lit(f"{path}: not UTF-8"))) if strict else F.make_valid_utf8("value")
        # each file's place, then the split's, then the row's within its task
        place = F.struct(F.lit(i).alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        part = text.select(place.alias("ord"), F.col("_metadata.file_path").alias("source"), clean.alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def from_list(spark: SparkSession, lines: list[str], source: str = "") -> DataFrame:
    rows = [(i, source, line.rstrip("\n")) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "ord long, source string, line string")


def parsed(lines: DataFrame, formats=DEFAULT) -> DataFrame:
    """Adds timestamp and parsed."""
    return lines.withColumn("timestamp", timestamp(F.col("line"), formats)).withColumn("parsed", F.col("timestamp").isNotNull())


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table rendered as log lines."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.concat(stamp, F.lit(" "), level, F.lit(" "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" props="), "props")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    return events.select(F.col("event_id").alias("ord"), F.lit("events").alias("source"), line.alias("line"))
