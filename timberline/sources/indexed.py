"""A range of a log file without reading all of it.

The times at some byte offsets are read first; between them the range's borders are found by binary search, and only the byte
spans that can hold lines of the range are planned as tasks. Where the probed times go backwards the lines are in no order: those spans, and
the ones around them, are read whole. The rows are then judged one by one, as everywhere.

What probes can't see is a lone line far from its place between two probes that are in order; `jitter` says by how much times may go back. Files of
too few probes to tell their order are read whole.
For files that driver and executors open by the same path.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from timberline.errors import need
from timberline.functions.timestamps import DEFAULT, TimeFormat, bound
from timberline.operators.slicing import slice_lines
from timberline.sources.lines import parsed, read_lines

#: Probes of a file at most and at least, and bytes between two at least; bytes that a probe reads at a time, and in all while it finds no time.
PROBES, FEWEST, APART, PROBE_BYTES, PROBE_MOST = 1024, 16, 256 << 10, 4 << 10, 64 << 10
#: Spans on either side of a step back that are read whole; bytes to which a border is searched; bytes of a task; bytes of a batch.
AROUND, BORDER, TASK_BYTES, BATCH_BYTES = 4, 64 << 10, 64 << 20, 4 << 20


class Span(InputPartition):
    """Lines that begin in [start, end) of a file."""

    def __init__(self, place: int, path: str, start: int, end: int):
        self.place, self.path, self.start, self.end = place, path, start, end


@dataclass
class LogFile:
    """Reads times at offsets; `probed` counts the bytes."""

    path: str
    formats: tuple[TimeFormat, ...]
    probed: int = 0

    def __post_init__(self):
        self.size = os.path.getsize(self.path)

    def time_at(self, at: int, end: int) -> datetime | None:
        """The time of the first line with one that begins in [at, end), as far as PROBE_MOST bytes tell."""
        with open(self.path, "rb") as f:
            f.seek(max(0, at - 1))
            held, first = b"", at > 0
            for _ in range(PROBE_MOST // PROBE_BYTES):
                data = f.read(min(PROBE_BYTES, max(1, end - f.tell() + PROBE_BYTES)))
                self.probed += len(data)
                lines = (held + data).split(b"\n")
                held = lines.pop() if data else b""
                for line in lines[first:]:
                    for fmt in self.formats:
                        if (t := fmt.strptime(line.decode("utf-8", "replace"))) is not None:
                            return t
                first = first and not lines
                if not data or f.tell() >= end:
                    break
        return None

    def border(self, low: int, high: int, passed) -> tuple[int, int]:
        """(low, high) narrowed by halves to BORDER bytes: passed(time) holds at high and beyond it, and not at low."""
        while high - low > BORDER:
            middle = (low + high) // 2
            t = self.time_at(middle, high)
            if t is None:
                break
            low, high = (low, middle) if passed(t) else (middle, high)
        return low, high

    def spans(self, start: datetime | None, end: datetime | None) -> list[tuple[int, int]]:
        """Byte spans that can hold lines from start to end, ascending and apart."""
        n = min(PROBES, self.size // APART)
        if n < FEWEST:
            return [(0, self.size)] if self.size else []
        offsets = [self.size * i // n for i in range(n)] + [self.size]
        times = [self.time_at(a, b) for a, b in zip(offsets, offsets[1:])]
        known = [(i, t) for i, t in enumerate(times) if t is not None]
        steps_back = [i for (i, a), (j, b) in zip(known, known[1:]) if b < a for i in (i, j)]
        doubtful = {k for i in steps_back for k in range(i - AROUND, i + AROUND + 1)}
        out: list[tuple[int, int]] = []
        earlier, later = None, [None] * n  # the last time known before the span, the first after it
        after = None
        for i in range(n - 1, -1, -1):
            later[i] = after
            after = times[i] if times[i] is not None else after
        for i in range(n):
            low, high = (times[i] if times[i] is not None else earlier), later[i]
            earlier = times[i] if times[i] is not None else earlier
            a, b = offsets[i], offsets[i + 1]
            if i not in doubtful and times[i] is not None:
                if (end is not None and low > end) or (start is not None and high is not None and high < start):
                    continue
                if start is not None and low < start:
                    a = self.border(a, b, lambda t: t >= start)[0]
                if end is not None and high is not None and high > end:
                    b = self.border(a, b, lambda t: t > end)[1]
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out


class SpanReader(DataSourceReader):
    """Spans of files, cut into tasks of TASK_BYTES. ends: lines keep their line feed, if they have one. errors: what bytes that aren't UTF-8 become, or `strict`."""

    ends, errors = False, "replace"

    def __init__(self, spans: list[tuple[int, str, int, int]], ends: bool = False, errors: str = "replace"):
        self.spans, self.ends, self.errors = spans, ends, errors

    def planned(self) -> list[tuple[int, str, int, int]]:
        return self.spans

    def partitions(self) -> list[Span]:
        out = [Span(place, path, at, min(b, at + TASK_BYTES)) for place, path, a, b in self.planned() for at in range(a, b, TASK_BYTES)]
        return out or [Span(0, "", 0, 0)]

    def read(self, span: Span) -> Iterator:
        import pyarrow as pa

        if span.start >= span.end:
            return
        with open(span.path, "rb") as f:
            at = max(0, span.start - 1)
            f.seek(at)
            if span.start:
                at += len(f.readline())  # ends the line before, if one does
            while at < span.end:
                data = f.read(min(BATCH_BYTES, span.end - at))
                if not data.endswith(b"\n"):
                    data += f.readline()
                if not data:
                    break
                lines = data.removesuffix(b"\n").split(b"\n")
                places, next_ = [], at
                for line in lines:
                    places.append(next_)
                    next_ += len(line) + 1
                text = [line.decode("utf-8", self.errors).removesuffix("\r") for line in lines]
                if self.ends:
                    text = [x + "\n" for x in text[:-1]] + [text[-1] + "\n" * data.endswith(b"\n")]
                ord_ = pa.StructArray.from_arrays([pa.array([span.place] * len(lines), pa.int32()), pa.array(places, pa.int64())], ["file", "at"])
                yield pa.RecordBatch.from_arrays([ord_, pa.array([span.path] * len(lines), pa.string()), pa.array(text, pa.string())], ["ord", "source", "line"])
                at += len(data)


class RangeReader(SpanReader):
    """The spans of files that can hold lines from start to end, found when the tasks are planned."""

    def __init__(self, paths: list[str], start, end, formats):
        self.paths, self.start, self.end, self.formats = paths, start, end, formats

    def planned(self) -> list[tuple[int, str, int, int]]:
        return [(place, path, a, b) for place, path in enumerate(self.paths) for a, b in LogFile(path, self.formats).spans(self.start, self.end)]


def lines_by(spark: SparkSession, reader: SpanReader) -> DataFrame:
    """ord struct<file, at>, source, line of a reader's spans."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "log_spans"

        def schema(self) -> str:
            return "ord struct<file: int, at: long>, source string, line string"

        def reader(self, schema) -> SpanReader:
            return reader

    spark.dataSource.register(Source)
    return spark.read.format("log_spans").load()


def files_at(path: str) -> list[str]:
    """A file, the files of a folder, or those of a pattern, by name; hidden ones (`_`, `.`) are left out."""
    local = path.removeprefix("file://")
    return sorted(p for p in glob.glob(f"{local}/*" if os.path.isdir(local) else local) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))


def lines_with_ends(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """ord, source, line of a file, folder or pattern, each line with its line feed, if it has one; CR LF is a line feed. strict: bytes that aren't UTF-8 raise."""
    paths = files_at(path)
    need(len(paths) > 0, f"no file at {path}")
    return lines_by(spark, SpanReader([(i, p, 0, os.path.getsize(p)) for i, p in enumerate(paths)], True, "strict" if strict else "replace"))


def last_line_feed(path: str, size: int) -> int:
    """Where the line after the last line feed below size begins; 0 without one."""
    at, step = size, 65_536
    with open(path, "rb") as f:
        while at > 0:
            begin = max(0, at - step)
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            at = begin
    return 0


def slice_files(spark: SparkSession, path: str, start=None, end=None, include_unparsed: bool = False, formats=DEFAULT, jitter: float = 0) -> DataFrame:
    """The lines of a file, folder or pattern from start to end, parsed: ord, source, line, timestamp, parsed.

    jitter: seconds by which a time may be before an earlier line's. With include_unparsed, and without any bound, all bytes are
    read. Files are taken by name; hidden ones (`_`, `.`) in folders are left out."""
    start, end = bound(start), bound(end)
    need(jitter >= 0, "the jitter must not be negative")
    paths = files_at(path)
    need(len(paths) > 0, f"no file at {path}")
    if include_unparsed or (start is None and end is None):
        return slice_lines(parsed(read_lines(spark, *paths), formats), start, end, include_unparsed)
    slack = timedelta(seconds=jitter)
    return slice_lines(parsed(lines_by(spark, RangeReader(paths, start and start - slack, end and end + slack, tuple(formats))), formats), start, end)
