"""Custom time formats against datetime.strptime."""

import random
import warnings
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberline.errors import SpecError
from timberline.functions import timestamps as ts
from timberline.sources.lines import from_list, parsed

CASES = [
    ("%Y-%m-%d %H:%M:%S", ["2024-03-01 08:22:01", "2024-3-1 8:22:01", "2024-02-30 08:22:01", "2024-03-01  08:22:01", "2024-03-01\t08:22:01", "24-03-01 08:22:01", "0000-01-01 00:00:00", "2024-03-01 24:00:00", "2024-03-01 08:22:60", "2024-03-01 08:22:61", ""]),
    ("UTC %Y-%m-%d %H:%M:%S", ["UTC 2024-03-01 08:22:01", "utc 2024-03-01 08:22:01", "CET 2024-03-01 08:22:01"]),
    ("%b %d %H:%M:%S", ["Mar  1 08:22:01", "Mar 1 08:22:01", "mar 31 08:22:01", "MAR 01 08:22:01", "Feb 29 00:00:00", "Apr 31 00:00:00", "Foo 01 00:00:00"]),
    ("%Y-%m-%dT%H:%M:%S.%f%z", ["2024-03-01T08:22:01.5+0100", "2024-03-01T08:22:01.123456Z", "2024-03-01T08:22:01.1234567Z", "2024-03-01T08:22:01.000001-05:30", "2024-03-01T08:22:01.5+01:00:30.25", "2024-03-01T08:22:01.5z"]),
    ("%A, %d %B %Y %I:%M %p", ["Friday, 01 March 2024 12:05 AM", "friday, 1 march 2024 12:05 pm", "Monday, 01 March 2024 01:00 PM", "Friday, 01 March 2024 13:00 PM", "Fri, 01 March 2024 01:00 PM", "Sunday, 31 May 2020 11:59 pm"]),
    ("%a %b %d %H:%M:%S %Y", ["Fri Mar 01 08:22:01 2024", "Xyz Mar 01 08:22:01 2024"]),
    ("%c", ["Fri Mar  1 08:22:01 2024"]), ("%x %X", ["03/01/24 08:22:01"]), ("%D %T", []),
    ("%y%m%d %H%M%S", ["240301 082201", "690101 000000", "680101 000000", "991231 235959"]),
    ("%Y%j", ["2024366", "2023366", "2024060", "2024001", "20241"]),
    ("%d/%m/%Y", ["1/2/2024", "31/12/1999", " 1/2/2024"]),
    ("100%% %Y", ["100% 2024", "100 2024"]), ("%H:%M", ["8:5", "23:59", "24:00"]), ("%I", ["12", "1", "00"]), ("%S.%f", ["59.999999", "1.000000", "0.1"]),
    ("%Y-%m-%d %Z", ["2024-03-01 UTC", "2024-03-01 gmt"]), ("[%Y] (%m)", ["[2024] (03)"]), ("%w %u"[:2] + " %Y", ["5 2024", "7 2024"]), ("'%Y' at %H", ["'2024' at 08"]), ("on %d.%m.%y", ["on 01.03.24", "ON 1.3.24"]),
]


def strptime(text, layout):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return datetime.strptime(text, layout).replace(tzinfo=None)
    except ValueError:
        return None


def test_formats(spark):
    for layout, texts in CASES:
        if not texts:
            continue
        shape = ts.Shape.of(layout)
        table = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
        got = [r[0] for r in table.select(shape.read(F.col("t"))).collect()]
        assert got == [strptime(t, layout) for t in texts], layout


def test_random_times(spark):
    rng = random.Random(1)
    layouts = ["%Y-%m-%d %H:%M:%S.%f", "%d %b %Y %I:%M:%S %p", "%A %B %d %Y %H", "%y/%m/%d", "%j %Y %H:%M", "%m-%d %H:%M:%S"]
    for layout in layouts:
        times = [datetime(rng.randint(1970, 2060), rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24), rng.randrange(60), rng.randrange(60), rng.randrange(10**6)) for _ in range(60)]
        texts = [t.strftime(layout) for t in times]
        table = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
        assert [r[0] for r in table.select(ts.Shape.of(layout).read(F.col("t"))).collect()] == [strptime(t, layout) for t in texts]


def test_in_lines(spark):
    assert [r[0] for r in spark.createDataFrame([("٢٠٢٤",)], "t string").select(ts.Shape.of("%Y").read(F.col("t"))).collect()] == [None]  # ASCII digits only
    lines = from_list(spark, ["x 2024-3-1 8:22:01 y", "12024-03-01 08:22:011", "UTC 2024-03-01 08:22:01 z", "[01/Mar/2024] t=08:22", "no"])
    first = (ts.strptime_format("%Y-%m-%d %H:%M:%S"), ts.strptime_format("%d/%b/%Y", r"\[(.*?)\]"))
    assert [r["timestamp"] for r in parsed(lines, first).orderBy("ord").collect()] == [datetime(2024, 3, 1, 8, 22, 1), None, datetime(2024, 3, 1, 8, 22, 1), datetime(2024, 3, 1), None]
    # the pattern hits and its text can't be read: the next format is tried
    again = (ts.strptime_format("%H:%M", r"\[(.*?)\]"), ts.strptime_format("%H:%M", r"t=(\S+)"))
    assert parsed(lines, again).where("parsed").first()["timestamp"] == datetime(1900, 1, 1, 8, 22)
    assert [r[0] for r in lines.orderBy("ord").select(ts.timestamp_text(F.col("line"), again)).collect()] == [None, None, None, "08:22", None]
    optional = ts.strptime_format("%H:%M", r"at(?: (\d\d:\d\d))?")
    assert [r["timestamp"] for r in parsed(from_list(spark, ["at 08:22", "at"]), (optional,)).orderBy("ord").collect()] == [datetime(1900, 1, 1, 8, 22), None]


def test_refused():
    for bad in ("%", "%Q", "%Y %y", "%H %I", "%Y %Y", "%U", "", "%j %d"):
        with pytest.raises(SpecError):
            ts.strptime_format(bad)
