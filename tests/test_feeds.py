"""Feeds: replays at any batch size give the batch operators' rows, and the state is empty once the watermark has passed."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timberline.operators import order
from timberline.queries import timed as event_log
from timberline.streaming import feeds

SCHEMA = "ord long, source string, line string, timestamp timestamp_ntz"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def entries(n, seed):
    """Lines whose times go back by a few seconds at most; some have none, some are blank."""
    rng, t, out = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 1, 5, 20, 61, 200]))
        at = t - timedelta(seconds=rng.choice([0, 0, 3])) if rng.random() > 0.1 else None
        text = f"{at:%Y-%m-%d %H:%M:%S} " if at else ""
        out.append((i, rng.choice(["s", "t"]), text + rng.choice(["disk full", "heartbeat", "x", "" if at is None else "y"]), at))
    return out


def replayed(spark, tmp_path, rows, sizes, make):
    """The rows that come out of a feed over batches of the sizes given, then what is still open, then the number of states after a far later line."""
    import os

    folder, check = tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()

    def put(k, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(folder / f"b{k}"))
        os.utime(folder / f"b{k}")

    out = []

    def go():
        lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        query = make(lines).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    at = 0
    for k, size in enumerate(sizes):
        if rows[at : at + size]:
            put(k, rows[at : at + size])
            if k % 3 == 2:
                go()  # a restart in between
        at += size
    put(998, rows[at:] or rows[:0])
    go()
    closed = list(out)
    still_open = feeds.open_runs(spark, check).collect()
    far = datetime(2030, 1, 1)
    put(999, [(10**9, "end", f"{far:%Y-%m-%d %H:%M:%S} end", far)])
    go()
    put(1000, [(10**9 + 1, "end", f"{far:%Y-%m-%d %H:%M:%S} end", far)])
    go()
    left = {r["key"] for r in feeds.open_runs(spark, check).collect()}
    return closed, still_open, out, left


@pytest.mark.parametrize("sizes", [[40, 1, 7, 12], [5, 30, 2, 2, 2, 9]])
def test_dedup_replays(spark, tmp_path, sizes):
    rows = entries(60, 4)
    batch = order.dedup(spark.createDataFrame(rows, SCHEMA), 60).collect()
    want = sorted((r["key"], r["raw"], r["count"], str(r["first_seen"]), str(r["last_seen"]), r["first_ord"]) for r in batch)
    as_rows = lambda found: sorted((r["key"], r["raw"], r["count"], str(r["first_seen"]), str(r["last_seen"]), r["first_ord"]) for r in found)
    closed, still_open, out, left = replayed(spark, tmp_path, rows, sizes, lambda x: feeds.dedup_feed(x, 60))
    none = lambda found: sorted(tuple("None" if v == "NaT" else v for v in r) for r in found)
    assert none(as_rows(closed) + as_rows(still_open)) == want
    assert none(r for r in as_rows(out) if r[0] != "end") == want
    assert left == {"end"}
    order.release()


def test_session_replays(spark, tmp_path):
    rows = [r for r in entries(60, 5) if r[3] is not None]
    batch = order.sessions(spark.createDataFrame(rows, SCHEMA), 60, ["source"]).collect()
    want = sorted((r["source"], r["entry_count"], r["start"], r["end"], r["duration_seconds"]) for r in batch)
    closed, still_open, out, left = replayed(spark, tmp_path, rows, [10, 1, 20, 3], lambda x: feeds.sessions_feed(x, 60))
    assert sorted((r["source"], r["entry_count"], r["start"], r["end"], r["duration_seconds"]) for r in out if r["source"] != "end") == want
    assert len(closed) + len(still_open) == len(want) and left == {"end"}
    order.release()


def test_lines_without_a_time(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(0, "s", "no time", None), (1, "s", f"{at} x", at), (2, "s", "no time", None), (3, "s", "   ", None), (4, None, "y", None)]
    closed, still_open, out, left = replayed(spark, tmp_path, rows, [2, 1], lambda x: feeds.sessions_feed(x, 60))
    assert sorted((r["source"], r["entry_count"], r["first_ord"]) for r in out if r["source"] != "end") == [("", 1, 4), ("s", 3, 0)] and left == {"end"}


def test_event_log(spark, tmp_path):
    """The queries' own log, in batches of many keys."""
    rows = [tuple(r) for r in event_log(spark, "/root/testdata/sf0.001").select("ord", "source", "line", "timestamp").orderBy("ord").collect()]
    key = F.regexp_extract("line", r"^\S+ \S+ (\S+(?: \S+)?)", 1)
    batch = order.dedup(spark.createDataFrame(rows, SCHEMA), 300, key).collect()
    _, _, out, _ = replayed(spark, tmp_path, rows, [len(rows) // 3, len(rows) // 2], lambda x: feeds.dedup_feed(x, 300, key, late="400 days"))  # its times are in no order
    assert sorted((r["key"], r["raw"], r["count"], r["first_seen"], r["last_seen"], r["first_ord"]) for r in out if r["first_ord"] < 10**9) == sorted((r["key"], r["raw"], r["count"], r["first_seen"], r["last_seen"], r["first_ord"]) for r in batch)
    order.release()
