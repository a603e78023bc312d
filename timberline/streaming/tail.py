"""Streaming: a source that follows a growing file, and windowed forms of the batch operators."""

from __future__ import annotations

import contextlib
import glob
import hashlib
import os
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from timberline.functions.timestamps import DEFAULT
from timberline.operators.slicing import slice_lines
from timberline.sources.indexed import last_line_feed
from timberline.sources.lines import parsed


#: Bytes of a task's share of what was appended.
SPAN_BYTES = 64 << 20
#: Bytes of a first line that tell a file.
FIRST_LINE = 1024


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def identity(path: str) -> str | None:
    """Inode and a digest of the first line: stays when a file is renamed or grows, changes when it is written anew. None while it has no whole line."""
    try:
        with open(path, "rb") as f:
            first = f.readline(FIRST_LINE)
            if not first.endswith(b"\n") and len(first) < FIRST_LINE:
                return None
            at = os.fstat(f.fileno())
    except OSError:
        return None
    return f"{at.st_dev}:{at.st_ino}:{hashlib.sha256(first).hexdigest()[:16]}"


class TailReader(DataSourceStreamReader):
    """Offsets are bytes by file identity, of the files that the path or pattern names. Bytes after the last line feed wait for theirs.

    A file that was renamed goes on under its new name; one that the pattern no longer names is read to its end, if it still is in its folder. A file written
    anew, longer or shorter than before, is another one and is read from its start."""

    def __init__(self, path: str, from_start: bool):
        self.path, self.from_start = path, from_start

    def _now(self) -> dict:
        out = {}
        for path in sorted(glob.glob(self.path)):
            if os.path.isfile(path) and (name := identity(path)):
                out[name] = {"path": path, "at": last_line_feed(path, os.path.getsize(path))}
        return out

    def initialOffset(self) -> dict:
        return {"files": {name: f | ({"at": 0} if self.from_start else {}) for name, f in self._now().items()}}

    def latestOffset(self) -> dict:
        return {"files": self._now()}

    def _find(self, name: str, path: str) -> str | None:
        """Where the file is now: in its place, or under another name in its folder."""
        if identity(path) == name:
            return path
        folder = os.path.dirname(path) or "."
        inode = int(name.split(":")[1])
        try:
            found = [e.path for e in os.scandir(folder) if e.inode() == inode and e.is_file()]
        except OSError:
            return None
        return next((p for p in found if identity(p) == name), None)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """Spans of whole lines, of about SPAN_BYTES each: a backlog is many tasks."""
        out = []
        for name, f in start["files"].items():
            if name not in end["files"] and (path := self._find(name, f["path"])):
                out += self._spans(path, f["at"], os.path.getsize(path))
        for name, f in end["files"].items():
            begin = start["files"].get(name, {"at": 0})["at"]
            path = self._find(name, f["path"])
            if path:
                out += self._spans(path, begin if begin <= f["at"] else 0, f["at"])
        return out

    def _spans(self, path: str, begin: int, end: int) -> list[Span]:
        out = []
        while begin < end:
            stop = min(end, begin + SPAN_BYTES)
            if stop < end:
                with open(path, "rb") as f:
                    f.seek(stop - 1)
                    stop = min(end, stop - 1 + len(f.readline()))
            out.append(Span(path, begin, stop))
            begin = stop
        return out

    def read(self, partition: Span):
        with open(partition.path, "rb") as f:
            f.seek(at := partition.start)
            while at < partition.end:
                raw = f.readline()
                if not raw:
                    break
                yield (at, partition.path, raw.removesuffix(b"\n").decode("utf-8", "replace").rstrip("\r"))
                at += len(raw)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """format("tail_lines"), options path (a file or a pattern) and fromStart (false: only what is appended to files that are there). For files that all
    executors see. ord: the byte in its file at which a line begins."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "ord long, source string, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("fromstart", self.options.get("fromStart", "false")).lower() == "true")


def tail(spark: SparkSession, path: str, start=None, end=None, from_start: bool = False, formats=DEFAULT) -> DataFrame:
    """Lines appended to a file, or to the files of a pattern, parsed and within the range."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail_lines").option("path", path).option("fromStart", str(from_start).lower()).load()
    return slice_lines(parsed(lines, formats), start, end)


class IdleStop(StreamingQueryListener):
    """Stops one query at the first idle event that comes max_idle seconds or more after its last new row. Starting up and working on rows is not idle: neither makes such events."""

    def __init__(self, query: StreamingQuery, max_idle: float):
        self.query, self.max_idle, self.last, self.streams = query, max_idle, time.monotonic(), SparkSession.active().streams

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == str(self.query.runId) and event.progress.numInputRows:
            self.last = time.monotonic()

    def onQueryIdle(self, event) -> None:
        if str(event.runId) == str(self.query.runId) and time.monotonic() - self.last >= self.max_idle:
            threading.Thread(target=self.query.stop, daemon=True).start()  # the listener's own thread must go on

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == str(self.query.runId):
            threading.Thread(target=self.streams.removeListener, args=(self,), daemon=True).start()

    def join(self, timeout: float | None = None) -> bool:
        """Waits until the query has ended."""
        return self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination() or True


@contextlib.contextmanager
def idle_events(spark: SparkSession, max_idle: float | None):
    """Queries that start within tell of idleness often enough for max_idle (Spark's own interval is ten seconds); the session's setting is put back."""
    name = "spark.sql.streaming.noDataProgressEventInterval"
    before = spark.conf.get(name, None)
    if max_idle is not None:
        spark.conf.set(name, str(max(50, min(10_000, int(max_idle * 500)))))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stop_when_idle(query: StreamingQuery, max_idle: float | None) -> IdleStop | None:
    """Stops the query after max_idle seconds without a new row; None: never. As exact as the interval of idle events, see idle_events."""
    if max_idle is None:
        return None
    listener = IdleStop(query, max_idle)
    listener.streams.addListener(listener)
    return listener


def rate_stream(timed: DataFrame, bucket_seconds: int, late: str = "1 minute") -> DataFrame:
    """Tumbling counts of a stream; windows close when the watermark has passed them. An extension of the batch form."""
    stamped = timed.withColumn("at", F.col("timestamp").cast("timestamp")).where(F.col("at").isNotNull()).withWatermark("at", late)
    return stamped.groupBy(F.window("at", f"{bucket_seconds} seconds").alias("w")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count")


def sessions_stream(timed: DataFrame, gap_seconds: int, late: str = "1 minute") -> DataFrame:
    """Sessions of each source by event time: lines without a timestamp go, late ones within the watermark still join. An extension of the batch form; see feeds.sessions_feed."""
    stamped = timed.withColumn("at", F.col("timestamp").cast("timestamp")).where(F.col("at").isNotNull()).withWatermark("at", late)
    return stamped.groupBy("source", F.session_window("at", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("entry_count"), F.min("at").alias("start"), F.max("at").alias("end")).drop("w")


def dedup_stream(timed: DataFrame, window_seconds: int, key, late: str = "1 minute") -> DataFrame:
    """Runs of a message as sessions of its key: they close, and their state goes, when the watermark passes their window."""
    stamped = timed.withColumn("key", key).withColumn("at", F.col("timestamp").cast("timestamp")).where(F.col("at").isNotNull()).withWatermark("at", late)
    return stamped.groupBy("key", F.session_window("at", f"{window_seconds} seconds").alias("w")).agg(F.count("*").alias("count"), F.min_by("line", "at").alias("raw"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")).drop("w")
