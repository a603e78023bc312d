"""Stats of growing files read only what is new; a tail that knows files loses and doubles nothing."""

import os

import pytest

from timberline.errors import SpecError
from timberline.operators.slicing import slice_stats
from timberline.plans.stats_table import StatsTable
from timberline.sources.lines import parsed, read_lines
from timberline.streaming import tail

CUT = ("2024-01-01 08:00:00", "2024-01-01 10:00:00")


def line(i):
    return f"2024-01-01 {6 + i % 7:02d}:{i % 60:02d}:00 line {i}\n" if i % 5 else f"no time {i}\n"


def same(spark, table, path, *cut):
    got = table.stats(path, *cut).asDict()
    assert got == slice_stats(parsed(read_lines(spark, path)), *cut).first().asDict()
    return got


def test_stats_of_growing_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_text("".join(map(line, range(500))))
    table = StatsTable(spark, str(tmp_path / "table"))
    same(spark, table, str(logs), *CUT)
    assert table.read_bytes == a.stat().st_size
    same(spark, table, str(logs), *CUT)
    assert table.read_bytes == 0  # nothing is new
    before = a.stat().st_size
    with a.open("a") as f:
        f.write("".join(map(line, range(500, 600))) + "2024-01-01 09:00:00 no line feed yet")
    same(spark, table, str(logs), *CUT)
    assert table.read_bytes == a.stat().st_size - before
    b.write_text("".join(map(line, range(50))))
    same(spark, StatsTable(spark, str(tmp_path / "table")), str(logs), *CUT)
    with a.open("a") as f:
        f.write(", but now\n")
    same(spark, table, str(logs), *CUT)
    assert table.read_bytes == len("2024-01-01 09:00:00 no line feed yet, but now\n")
    same(spark, table, str(logs))  # another range is another entry
    assert table.read_bytes == a.stat().st_size + b.stat().st_size
    a.write_text("2024-01-01 09:00:00 anew\n")  # shorter
    same(spark, table, str(logs), *CUT)
    assert table.read_bytes == a.stat().st_size
    b.write_text("2024-01-01 09:30:00 x\n" + "".join(map(line, range(100))))  # longer, and another file
    same(spark, table, str(logs), *CUT)
    assert table.read_bytes == b.stat().st_size
    os.remove(b)
    same(spark, table, str(logs), *CUT)
    (logs / "empty").write_text("")
    same(spark, table, str(logs), *CUT)
    assert table.read_bytes == 0
    with pytest.raises(SpecError):
        table.stats(str(tmp_path / "none"))


def taken(reader, start, end):
    return [row[2] for span in reader.partitions(start, end) for row in reader.read(span)]


def test_rotation(tmp_path):
    """Renamed and written anew, longer than before: the old file is finished, then the new one begins; a restart in between changes nothing."""
    log, old = tmp_path / "app.log", tmp_path / "app.log.1"
    log.write_text("h\na1\na2\n")
    for restart in (False, True):
        reader = tail.TailReader(str(log), True)
        at = reader.initialOffset()
        end = reader.latestOffset()
        assert taken(reader, at, end) == ["h", "a1", "a2"]
        with log.open("a") as f:
            f.write("a3\na4 has no line feed")
        log.rename(old)
        log.write_text("n\n" + "".join(f"b{i}\n" for i in range(50)))
        if restart:
            reader = tail.TailReader(str(log), True)
        next_ = reader.latestOffset()
        assert taken(reader, end, next_) == ["a3", "a4 has no line feed", "n", *(f"b{i}" for i in range(50))]
        last = reader.latestOffset()
        assert taken(reader, next_, last) == []
        with log.open("a") as f:
            f.write("b50\n")
        assert taken(reader, last, reader.latestOffset()) == ["b50"]
        log.write_text("h\na1\na2\n")
        old.unlink()


def test_patterns_and_truncation(tmp_path):
    reader = tail.TailReader(str(tmp_path / "*.log"), False)
    (tmp_path / "a.log").write_text("old\n")
    at = reader.initialOffset()
    with (tmp_path / "a.log").open("a") as f:
        f.write("new\n")
    (tmp_path / "b.log").write_text("b0\nb1\npart")
    end = reader.latestOffset()
    assert taken(reader, at, end) == ["new", "b0", "b1"]
    (tmp_path / "b.log").rename(tmp_path / "c.log")  # still named by the pattern
    (tmp_path / "a.log").write_text("other first line, and longer than the old file was\nx\n")  # the same inode
    next_ = reader.latestOffset()
    assert sorted(taken(reader, end, next_)) == ["other first line, and longer than the old file was", "x"]
    (tmp_path / "a.log").write_text("other first line, and longer than the old file was\n")  # shorter, the same first line
    (tmp_path / "c.log").unlink()
    last = reader.latestOffset()
    assert taken(reader, next_, last) == ["other first line, and longer than the old file was"]


def test_rotation_in_a_stream(spark, tmp_path):
    log, seen = tmp_path / "t.log", []
    log.write_text("2024-01-01 10:00:00 old\n")
    query = tail.tail(spark, str(log), from_start=True).writeStream.foreachBatch(lambda df, _: seen.extend(r["line"][20:] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    with log.open("a") as f:
        f.write("2024-01-01 10:00:01 last\n")
    log.rename(tmp_path / "t.log.1")
    log.write_text("".join(f"2024-01-01 10:00:02 new {i}\n" for i in range(20)))
    query.processAllAvailable()
    query.stop()
    assert seen == ["old", "last", *(f"new {i}" for i in range(20))]
