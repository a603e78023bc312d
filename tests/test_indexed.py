"""Ranges of log files by probes: the rows of the plain rule, and few bytes of sorted files."""

import random
from datetime import datetime, timedelta

import pytest

from timberline.errors import SpecError
from timberline.functions.timestamps import DEFAULT, bound, strptime_format
from timberline.operators.slicing import slice_lines
from timberline.sources import indexed
from timberline.sources.lines import parsed, read_lines

BEGIN = datetime(2024, 1, 1)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("APART", 2000), ("PROBE_BYTES", 200), ("PROBE_MOST", 1000), ("BORDER", 400), ("TASK_BYTES", 3000), ("BATCH_BYTES", 700)):
        monkeypatch.setattr(indexed, name, value)


def lines(n, seed=0, step=60):
    rng, t, out = random.Random(seed), BEGIN, []
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, step, 3 * step]))
        out.append(f"{t:%Y-%m-%d %H:%M:%S} line {i} é{'x' * rng.randrange(60)}")
        if rng.random() < 0.1:
            out.append("  no time " + "y" * rng.randrange(30))
    return out


def here(path, start, end, formats=DEFAULT, jitter=0):
    """The reader in this process, where the sizes are small."""
    slack = timedelta(seconds=jitter)
    reader = indexed.RangeReader([path], start and bound(start) - slack, end and bound(end) + slack, formats)
    texts = [(r["at"], x) for s in reader.partitions() for batch in reader.read(s) for r, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
    assert [a for a, _ in texts] == sorted({a for a, _ in texts})
    timed = [(x, next((t for f in formats if (t := f.strptime(x)) is not None), None)) for _, x in texts]
    return [(x, t) for x, t in timed if t is not None and (start is None or bound(start) <= t) and (end is None or t <= bound(end))]


def same(spark, path, start, end, **kw):
    if kw.get("include_unparsed") or start is None and end is None:
        got = [(r["line"], r["timestamp"]) for r in indexed.slice_files(spark, path, start, end, **kw).orderBy("ord").collect()]
    else:
        got = here(path, start, end, **kw)
    plain = slice_lines(parsed(read_lines(spark, path), kw.get("formats", DEFAULT)), start, end, kw.get("include_unparsed", False))
    assert sorted(got, key=repr) == sorted(((r["line"], r["timestamp"]) for r in plain.collect()), key=repr)
    return got


def test_sorted_file_reads_little(spark, tmp_path):
    """One hundredth of a sorted file: under a twentieth of its bytes, probes included."""
    log = tmp_path / "a.log"
    t = BEGIN
    with log.open("w") as f:
        for i in range(400_000):
            t += timedelta(seconds=1)
            f.write(f"{t:%Y-%m-%d %H:%M:%S} INFO request {i} took {i % 977} ms at the far end\n")
    file = indexed.LogFile(str(log), DEFAULT)
    start, end = BEGIN + timedelta(seconds=200_000), BEGIN + timedelta(seconds=204_000)
    spans = file.spans(start, end)
    assert (sum(b - a for a, b in spans) + file.probed) < 0.05 * file.size
    reader = indexed.RangeReader([str(log)], start, end, DEFAULT)
    times = [DEFAULT[0].strptime(x) for s in reader.partitions() for batch in reader.read(s) for x in batch.column(2).to_pylist()]
    assert sum(start <= x <= end for x in times) == 4001 and len(times) < 12_000
    got = indexed.slice_files(spark, str(log), start, end)
    assert got.count() == 4001 and got.rdd.getNumPartitions() == len(reader.partitions())


@pytest.mark.parametrize("order", ["sorted", "shuffled", "two halves", "backwards"])
def test_same_as_the_plain_rule(spark, tmp_path, small, order):
    own = lines(600)
    own = {"sorted": own, "shuffled": random.Random(1).sample(own, len(own)), "two halves": own[300:] + own[:300], "backwards": own[::-1]}[order]
    log = tmp_path / "a.log"
    log.write_text("\n".join(own) + ("\n" if order != "sorted" else ""))
    for start, end in (("2024-01-01 04:00:00", "2024-01-01 05:00:00"), (None, "2024-01-01 00:30:00"), ("2024-01-01 15:00:00", None), ("2023-01-01 00:00:00", "2023-02-01 00:00:00"), ("2024-01-01 04:00:00", "2024-01-01 04:00:00"), ("2030-01-01 00:00:00", None)):
        same(spark, str(log), start, end)
    same(spark, str(log), "2024-01-01 04:00:00", None, include_unparsed=True)
    same(spark, str(log), None, None)


def test_order_and_folders(spark, tmp_path, small):
    for k in range(3):
        (tmp_path / f"p{k}").write_text("".join(x + "\r\n" for x in lines(200, k)))
    (tmp_path / "_SUCCESS").write_text("2024-01-01 02:00:00 not a log")
    (tmp_path / "empty").write_text("")
    got = indexed.slice_files(spark, str(tmp_path), "2024-01-01 02:00:00", "2024-01-01 03:00:00").orderBy("ord").collect()
    want = [x for k in range(3) for x in lines(200, k) if "2024-01-01 02:00:00" <= x[:19] <= "2024-01-01 03:00:00"]
    assert [r["line"] for r in got] == want
    with pytest.raises(SpecError):
        indexed.slice_files(spark, str(tmp_path / "none"), "2024-01-01 02:00:00")


def test_jitter_formats_and_lines_without_times(spark, tmp_path, small):
    rng, rows = random.Random(3), []
    for i in range(800):
        t = BEGIN + timedelta(seconds=60 * i - rng.choice([0, 0, 0, 290]))
        rows.append(f"[{t:%d %b %Y %H:%M:%S}] {i}")
    (tmp_path / "j.log").write_text("\n".join(rows))
    own = (strptime_format("%d %b %Y %H:%M:%S"),)
    same(spark, str(tmp_path / "j.log"), "2024-01-01 04:00:00", "2024-01-01 05:00:00", formats=own, jitter=300)
    (tmp_path / "n.log").write_text("nothing here\n" * 2000 + "2024-01-01 04:00:00 x\n" + "or here\n" * 2000)
    assert len(same(spark, str(tmp_path / "n.log"), "2024-01-01 04:00:00", "2024-01-01 05:00:00")) == 1


def test_python_and_spark_read_the_same_times(spark):
    texts = ["2024-03-10T08:22:01 a", "Mar 10 08:22:01 b", "Feb 29 08:22:01 b", "10/Mar/2024:08:22:01 +0000", "2024-02-30 08:22:01", "none"]
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "ord long, source string, line string")
    for r in parsed(rows).collect():
        assert r["timestamp"] == next((t for f in DEFAULT if (t := f.strptime(r["line"])) is not None), None)
