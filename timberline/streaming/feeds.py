"""Runs of messages and sessions over streams: the batch operators as state machines on event time.

State is one open run a key, in the RocksDB store. A run comes out when a line of its key begins the next one, or when the watermark
passes the time up to which a line could still join it (a timer at last_seen + window); either way its state goes. What is
open when a stream is stopped for good is read from its checkpoint by `open_runs`.

Lines of a key are taken in their order within a batch, and batches one after the other. As long as times go back by less than `late`, the rows are those of
the batch form, however lines fall into batches; Spark drops lines that come later than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from timberline.errors import need
from timberline.functions.text import blank
from timberline.functions.timestamps import DEFAULT
from timberline.operators.order import message_key

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of one open run: the first line and its order, how many lines, first and last time, in microseconds.
STATE = "raw string, first_ord long, count long, first long, last long"
RUNS = "key string, raw string, count long, first_seen timestamp_ntz, last_seen timestamp_ntz, first_ord long"
SESSIONS = "source string, entry_count long, start timestamp_ntz, end timestamp_ntz, duration_seconds double, first_ord long"


def _time(micros):
    import pandas as pd

    return pd.NaT if micros is None else pd.Timestamp(micros, unit="us")


def as_run(key, run) -> tuple:
    raw, first_ord, count, first, last = run
    return key, raw, count, _time(first), _time(last), first_ord


def as_session(key, run) -> tuple:
    _, first_ord, count, first, last = run
    return key, count, _time(first), _time(last), None if first is None else (last - first) // 1_000_000 * 1.0, first_ord


def next_run(run, line, most: int):
    """(run that closed or None, open run): a line within the window of the last one joins, without a time it never does."""
    at, ord_, raw = line
    if run is not None and at is not None and run[4] is not None and at - run[4] <= most:
        return None, (*run[:2], run[2] + 1, run[3], at)
    return run, (raw, ord_, 1, at, at)


def next_session(run, line, most: int):
    """A line more than the gap after the last time begins a session; one without a time joins the open one."""
    at, ord_, raw = line
    if run is None or (at is not None and run[4] is not None and at - run[4] > most):
        return run, (raw, ord_, 1, at, at)
    return None, (*run[:2], run[2] + 1, at if run[3] is None else run[3], run[4] if at is None else at)


class Feed(StatefulProcessor):
    """step(run or None, line, most) -> (closed or None, run); row(key, run) -> output. lone: a run without a time can get no line."""

    def __init__(self, step: Callable, row: Callable, output: str, most: int, lone: bool):
        self.step, self.row, self.most, self.lone = step, row, most, lone
        self.names = [field.split()[0] for field in output.split(", ")]

    def init(self, handle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", STATE)

    def told(self, rows: list[tuple]) -> Iterator:
        import pandas as pd

        if rows:
            yield pd.DataFrame(rows, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        run, out = self.run.get() if self.run.exists() else None, []
        lines = pd.concat(list(rows)).sort_values("ord")
        times = [None if pd.isna(t) else int(t) for t in lines["micros"]]
        for line in zip(times, map(int, lines["ord"]), lines["line"]):
            closed, run = self.step(None if run is None else tuple(run), line, self.most)
            if closed is not None:
                out.append(self.row(key[0], closed))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if run[4] is None and self.lone:
            out.append(self.row(key[0], run))
            self.run.clear()
        else:
            self.run.update(run)
            # a session that has no time yet waits for one, but no longer than a gap from now
            last = run[4] // 1000 if run[4] is not None else max(0, timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer(last + self.most // 1000 + 1)
        yield from self.told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.run.exists():
            run = tuple(self.run.get())
            self.run.clear()
            yield from self.told([self.row(key[0], run)])

    def close(self) -> None:
        pass


def fed(lines: DataFrame, by: str, feed: Feed, output: str, late: str) -> DataFrame:
    """lines: by, ord, line, timestamp. Sets the session's state store to RocksDB, which such state needs."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    at = F.col("timestamp").cast("timestamp")
    timed = lines.select(by, "ord", "line", at.alias("at"), F.unix_micros(at).alias("micros")).withWatermark("at", late)
    return timed.groupBy(by).transformWithStateInPandas(feed, output, "append", "EventTime")


def dedup_feed(timed: DataFrame, window_seconds: float, key=None, formats=DEFAULT, late: str = "1 minute") -> DataFrame:
    """The batch dedup over a stream: key, raw, count, first_seen, last_seen, first_ord of each run as it closes. Blank messages go. A line without a timestamp
    is a run of its own and comes out at once."""
    need(window_seconds > 0, "the window must be positive")
    keyed = timed.withColumn("key", message_key(F.col("line"), formats) if key is None else key).where(~blank(F.col("key")))
    return fed(keyed, "key", Feed(next_run, as_run, RUNS, int(window_seconds * 1_000_000), True), RUNS, late)


def sessions_feed(timed: DataFrame, gap_seconds: float, late: str = "1 minute") -> DataFrame:
    """The batch sessions of each source over a stream: source, entry_count, start, end, duration_seconds, first_ord of each session as it closes. Lines
    without a timestamp join the open session, or where none is open begin one; blank ones go. Sessions have no index, which would stay in the state for ever; first_ord tells their order."""
    need(gap_seconds > 0, "the gap must be positive")
    lines = timed.where(~blank(F.col("line"))).withColumn("source", F.coalesce("source", F.lit("")))
    return fed(lines, "source", Feed(next_session, as_session, SESSIONS, int(gap_seconds * 1_000_000), False), SESSIONS, late)


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What is open in a stopped feed, from its checkpoint: key, raw, first_ord, count, first_seen, last_seen. The flush of a stream at its end."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "run").load()
    key = F.col("key").getField(held.schema["key"].dataType.names[0])
    time = lambda c: F.timestamp_micros(F.col(f"value.{c}")).cast("timestamp_ntz")
    return held.select(key.alias("key"), "value.raw", "value.first_ord", "value.count", time("first").alias("first_seen"), time("last").alias("last_seen"))
