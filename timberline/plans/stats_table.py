"""Stats of log files that grow: partial counts by file in a shared table, so that only new bytes are read.

An entry says up to which byte a file is counted under a range and time formats, what was counted, and digests of the file's first bytes and of those
before that byte. A file that still has both is read from there on; any other is read anew. Entries are only appended, and the one of
most bytes stands, so two programs at once do no harm. A last line without line feed is counted each time and never entered.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from timberline.errors import need
from timberline.functions.timestamps import DEFAULT, bound
from timberline.operators.slicing import line_status
from timberline.sources.indexed import SpanReader, files_at, last_line_feed, lines_by
from timberline.sources.lines import parsed

#: Bytes of a file's beginning, and of those before the last one counted, that tell it from others.
HEAD = 4096
COUNTS = ("total_lines", "matched_lines", "skipped_before", "skipped_after", "unparseable_lines")
SCHEMA = "kind string, path string, upto long, head string, tail string, " + ", ".join(f"{c} long" for c in COUNTS) + ", first_matched_ts timestamp_ntz, last_matched_ts timestamp_ntz"


def digest(path: str, start: int, end: int) -> str:
    with open(path, "rb") as f:
        f.seek(start)
        return hashlib.sha256(f.read(end - start)).hexdigest()


def counted(timed: DataFrame, start, end, *by) -> DataFrame:
    """The counts of slicing.slice_stats, by columns."""
    status = line_status(F.col("timestamp"), start, end)
    hit = F.when(status == "matched", F.col("timestamp"))
    of = lambda s: F.count_if(status == s)
    return timed.groupBy(*by).agg(F.count("*").alias("total_lines"), of("matched").alias("matched_lines"), of("before").alias("skipped_before"), of("after").alias("skipped_after"), of("unparseable").alias("unparseable_lines"), F.min(hit).alias("first_matched_ts"), F.max(hit).alias("last_matched_ts"))


class StatsTable:
    """folder: in shared storage. `read_bytes` tells how many bytes the last call of `stats` counted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.read_bytes = spark, folder, 0

    def entries(self, kind: str) -> dict[str, Row]:
        """By path the entry of most bytes; a row a file."""
        try:
            held = self.spark.read.schema(SCHEMA).parquet(self.folder).where(F.col("kind") == kind)
            rows = held.groupBy("path", "head").agg(F.max_by(F.struct(*held.columns), "upto").alias("e")).select("e.*").collect()
        except Exception as e:  # the table is made by the first entry
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}
        # of a path that was written anew, the entry that fits is found by its digests
        out: dict[str, Row] = {}
        for r in sorted(rows, key=lambda r: r["upto"]):
            if self.fits(r):
                out[r["path"]] = r
        return out

    @staticmethod
    def fits(entry: Row) -> bool:
        path, upto = entry["path"], entry["upto"]
        return os.path.exists(path) and os.path.getsize(path) >= upto and digest(path, 0, min(HEAD, upto)) == entry["head"] and digest(path, max(0, upto - HEAD), upto) == entry["tail"]

    def stats(self, path: str, start=None, end=None, formats=DEFAULT) -> Row:
        """The row of slicing.slice_stats over a file, folder or pattern."""
        paths = files_at(path)
        need(len(paths) > 0, f"no file at {path}")
        start, end = bound(start), bound(end)
        kind = hashlib.sha256(json.dumps([str(start), str(end), [[f.pattern, f.layout, f.iso] for f in formats]]).encode()).hexdigest()
        held, ends = self.entries(kind), {}
        spans = []
        for i, p in enumerate(paths):  # even places are entered, odd ones are last lines without line feed
            size = os.path.getsize(p)
            ends[i] = last_line_feed(p, size)
            begin = held[p]["upto"] if p in held else 0
            spans += [(2 * i, p, begin, ends[i]), (2 * i + 1, p, ends[i], size)]
        spans = [s for s in spans if s[2] < s[3]]
        self.read_bytes = sum(b - a for _, _, a, b in spans)
        new = [r.asDict() for r in counted(parsed(lines_by(self.spark, SpanReader(spans)), formats), start, end, F.col("ord.file").alias("place")).collect()] if spans else []
        merged = [{c: held[p][c] for c in (*COUNTS, "first_matched_ts", "last_matched_ts")} for p in paths if p in held] + new
        entered = []
        for r in new:
            i, odd = divmod(r["place"], 2)
            if not odd:
                p, old = paths[i], held.get(paths[i])
                parts = [r] + ([old.asDict()] if old else [])
                entered.append((kind, p, ends[i], digest(p, 0, min(HEAD, ends[i])), digest(p, max(0, ends[i] - HEAD), ends[i]), *(sum(x[c] for x in parts) for c in COUNTS), *extremes(parts)))
        if entered:
            self.spark.createDataFrame(entered, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        totals = {c: sum(r[c] for r in merged) for c in COUNTS}
        first, last = extremes(merged)
        rate = totals["matched_lines"] / totals["total_lines"] if totals["total_lines"] else 0.0
        return Row(**totals, first_matched_ts=first, last_matched_ts=last, match_rate=rate)


def extremes(parts: list[dict]) -> tuple:
    return min((p["first_matched_ts"] for p in parts if p["first_matched_ts"] is not None), default=None), max((p["last_matched_ts"] for p in parts if p["last_matched_ts"] is not None), default=None)
