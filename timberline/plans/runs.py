"""Whole runs: slice a file, count, export; several profiles in one scan; results kept for unchanged files."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from timberline.errors import SpecError, need
from timberline.functions.timestamps import timestamp
from timberline.operators.aggregates import profile_stats
from timberline.operators.slicing import slice_lines, slice_stats
from timberline.plans.config import FilterProfile, SliceConfig
from timberline.sources.lines import parsed, read_lines
from timberline.sources.sinks import OutputRouter, export


def lines_of(spark: SparkSession, config: SliceConfig) -> DataFrame:
    need(config.input_path is not None, "an input path is needed")
    return parsed(read_lines(spark, config.input_path), config.formats)


def run(spark: SparkSession, config: SliceConfig, to: OutputRouter | None = None) -> Row:
    """Exports the slice (to the router, or the configured path if any) and returns its stats row."""
    lines = lines_of(spark, config)
    kept = slice_lines(lines, config.start, config.end).orderBy("ord")
    if to is not None:
        to.write(kept)
    elif config.output_path is not None:
        export(kept, config.output_path, config.output_format)
    return slice_stats(lines, config.start, config.end).first()


def run_profile(spark: SparkSession, profile: FilterProfile, path: str, output_path: str | None = None) -> Row:
    return run(spark, profile.config(path, output_path))


def run_profiles(spark: SparkSession, path: str, profiles: list[FilterProfile]) -> DataFrame:
    """All profiles in one scan, each with its own time formats; those of equal formats read the time once."""
    need(len(profiles) > 0, "at least one profile")
    kinds = list(dict.fromkeys(p.formats for p in profiles))
    lines = read_lines(spark, path).withColumns({f"_t{i}": timestamp(F.col("line"), formats) for i, formats in enumerate(kinds)})
    return profile_stats(spark, lines, profiles, {p.name: F.col(f"_t{kinds.index(p.formats)}") for p in profiles})


def fingerprint(spark: SparkSession, config: SliceConfig) -> str:
    """Of the input's files (path, size, modification time, as Spark's reader sees them) and of the whole configuration."""
    meta = spark.read.format("binaryFile").load(config.input_path).select("path", "length", F.col("modificationTime").cast("string")).orderBy("path").collect()
    return hashlib.sha256(json.dumps([list(map(list, meta)), config.to_dict()], default=str, sort_keys=True).encode()).hexdigest()


class StatsCache:
    """Stats by fingerprint, one small JSON file each."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def get(self, key: str) -> dict | None:
        try:
            return json.loads((self.folder / f"{key}.json").read_text())
        except (OSError, ValueError):
            return None

    def set(self, key: str, values: dict) -> None:
        (self.folder / f"{key}.json").write_text(json.dumps({k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in values.items()}))

    def invalidate(self, key: str) -> bool:
        held = self.folder / f"{key}.json"
        found = held.exists()
        held.unlink(missing_ok=True)
        return found

    def clear(self) -> int:
        return sum(self.invalidate(p.stem) for p in list(self.folder.glob("*.json")))


def run_cached(spark: SparkSession, config: SliceConfig, cache: StatsCache, use_cache: bool = True) -> dict:
    """The stats of an unchanged input and configuration are read; without use_cache they are computed and kept anew."""
    key = fingerprint(spark, config)
    held = cache.get(key) if use_cache else None
    if held is None:
        cache.set(key, run(spark, config).asDict())
        held = cache.get(key)
    if held is None:
        raise SpecError(f"{cache.folder} cannot be written")
    return held
