"""Many profiles and many literals against plain loops."""

import random
import time
from datetime import datetime, timedelta

import pytest

from timberline.errors import SpecError
from timberline.operators import aggregates as agg
from timberline.operators import many, order
from timberline.sources.lines import from_list

BEGIN = datetime(2024, 1, 1)


def joined(spark, times, profiles):
    lines = spark.createDataFrame([(t,) for t in times], "timestamp timestamp_ntz")
    table = spark.createDataFrame(profiles, "profile string, start timestamp_ntz, end timestamp_ntz")
    return sorted((tuple(r) for r in many.profile_join(lines, table).collect()), key=repr)


def plain(times, profiles):
    known = [t for t in times if t is not None]
    out = []
    for name, start, end in profiles:
        own = [t for t in known if (start is None or t >= start) and (end is None or t <= end)]
        out.append((name, len(times), len(own), len(times) - len(known), min(own, default=None), max(own, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("unit", ["seconds", "microseconds", "hours"])
def test_profiles(spark, unit):
    rng = random.Random(unit)
    step = lambda n: timedelta(**{unit: n})
    times = [BEGIN + step(rng.randrange(100_000)) if rng.random() > 0.1 else None for _ in range(300)] + [BEGIN] * 5 + [datetime(1969, 12, 31, 23, 59, 59, 5)]
    profiles = []
    for i in range(400):
        a = BEGIN + step(rng.randrange(-1000, 100_000)) + timedelta(microseconds=rng.choice([0, 0, 1, 999_999]))
        b = a + step(rng.choice([0, 1, 10, 1000, 90_000])) + timedelta(microseconds=rng.choice([0, 0, 1, 999_999]))
        profiles.append((f"p{i % 390}", a if i % 17 else None, b if i % 19 else None))
    profiles += [("reversed", BEGIN + step(5), BEGIN), ("all", None, None), ("exact", times[0] or BEGIN, times[0] or BEGIN), ("before", datetime(1900, 1, 1), datetime(1901, 1, 1))]
    assert joined(spark, times, profiles) == plain(times, profiles)


def test_profiles_of_nothing(spark):
    profiles = [("a", BEGIN, None), ("b", None, None)]
    for times in ([], [None, None], [BEGIN]):
        assert joined(spark, times, profiles) == plain(times, profiles)
    assert joined(spark, [BEGIN], []) == []


def test_ten_thousand_profiles(spark):
    rng = random.Random(2)
    times = [BEGIN + timedelta(seconds=rng.randrange(10**7)) for _ in range(2000)]
    profiles = [(str(i), BEGIN + timedelta(seconds=(a := rng.randrange(10**7))), BEGIN + timedelta(seconds=a + rng.randrange(10**6))) for i in range(10_000)]
    began = time.time()
    got = joined(spark, times, profiles)
    assert time.time() - began < 120
    assert got == plain(times, profiles)


def test_profiles_are_not_broadcast(spark, monkeypatch):
    """The parts of all profiles were broadcast, so the driver held them. Several blocks; many bounds of one time."""
    monkeypatch.setattr(order, "BLOCK", 1000)
    rng = random.Random(3)
    times = [BEGIN + timedelta(seconds=rng.randrange(5000)) for _ in range(300)] + [BEGIN + timedelta(seconds=9)] * 5 + [None] * 3
    profiles = [(str(i), BEGIN + timedelta(seconds=a) if i % 7 else None, BEGIN + timedelta(seconds=a + rng.randrange(-3, 4000)) if i % 5 else None) for i in range(4000) for a in [rng.randrange(-5, 5500)]]
    profiles += [("same", BEGIN + timedelta(seconds=9), BEGIN + timedelta(seconds=9))] * 100
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        assert joined(spark, times, profiles) == plain(times, profiles)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
        order.release()


def test_literals(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", "🎉b"]
    rules = [agg.ThresholdRule(f"r{i}", "".join(rng.choice("abcé 🎉") for _ in range(rng.randint(1, 4))), rng.randint(1, 50)) for i in range(500)]
    rules += [rules[3], agg.ThresholdRule("long", "abc" * 50, 1)]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, line string").repartition(3)
    want = sorted((r.name, r.threshold, n := sum(r.pattern in t for t in texts if t is not None), n >= r.threshold) for r in rules)
    assert sorted(tuple(r) for r in many.alerts_many(lines, rules).collect()) == want
    assert sorted(tuple(r) for r in many.alerts_many(lines, rules[:20]).collect()) == sorted(tuple(r) for r in agg.alerts(lines, rules[:20]).collect())
    assert {tuple(r) for r in many.literal_counts(lines, ["", "a"]).collect()} == {(0, 302), (1, sum("a" in (t or "") for t in texts))}
    assert all(r["matched_count"] == 0 for r in many.alerts_many(lines.limit(0), rules).collect())
    with pytest.raises(SpecError):
        many.alerts_many(lines, [])


def test_time_grows_with_the_text_not_with_rules(spark):
    lines = from_list(spark, [f"line {i} of many, user={i % 977} and more text of no interest" for i in range(20_000)]).repartition(4).cache()
    lines.count()

    def took(n):
        rules = [agg.ThresholdRule(str(i), f"user={i} ", 1) for i in range(n)]
        began = time.time()
        many.alerts_many(lines, rules).collect()
        return time.time() - began

    took(10)
    assert took(5000) < 10 * took(50) + 10
    lines.unpersist()
