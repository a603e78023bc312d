"""Operators over small inline logs, random sequences against plain loops, and every query against its SQL."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timberline import queries
from timberline.errors import SpecError
from timberline.functions import timestamps as ts
from timberline.operators import aggregates as agg
from timberline.operators import order, rules, slicing
from timberline.plans import runs
from timberline.plans.config import FilterProfile, SliceConfig, profiles_from_json
from timberline.sources import reports, sinks
from timberline.sources.lines import from_list, parsed, read_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("line, want", [
    ("2024-03-10T08:22:01 INFO Server started", "2024-03-10 08:22:01"),
    ("2024-03-10 08:22:01.123 ERROR Disk full", "2024-03-10 08:22:01"),
    ("Mar 10 08:22:01 myhost sshd[1234]: Accepted", "1900-03-10 08:22:01"),
    ('127.0.0.1 - - [10/Mar/2024:08:22:01 +0000] "GET / HTTP/1.1" 200', "2024-03-10 08:22:01"),
    ("10/Mar/2024:08:22:01 GET /", "2024-03-10 08:22:01"), ("Mar\t10 08:22:01 x", "None"),
    ("no timestamp here", "None"), ("2024-02-30 08:22:01 bad day", "None"),
])
def test_timestamps(spark, line, want):
    assert str(parsed(from_list(spark, [line])).first()["timestamp"]) == want


def test_custom_format(spark):
    out = parsed(from_list(spark, ["2024/03/10 08:22:01 x"]), (ts.strptime_format("%Y/%m/%d %H:%M:%S"),)).first()
    assert out["timestamp"] == datetime(2024, 3, 10, 8, 22, 1) and out["parsed"]


def test_bounds():
    for text, want in (("2024-01-01T10:00:00", datetime(2024, 1, 1, 10)), ("2024-01-01 10:00:00", datetime(2024, 1, 1, 10)), ("Jan 15 08:00:00", datetime(1900, 1, 15, 8)), ("15/Jan/2024:08:00:00", datetime(2024, 1, 15, 8))):
        assert ts.bound(text) == want
    for bad in ("2024-01-01", "2024-01-01 10:00", "soon"):
        with pytest.raises(SpecError):
            ts.bound(bad)
    with pytest.raises(SpecError):
        ts.checked_range("2024-01-01 10:00:00", "2024-01-01 10:00:00")


SLICE = [f"2024-01-01 {h:02d}:00:00 INFO {h}" for h in (7, 8, 9, 10, 11)] + ["no time"]


def test_slice_and_stats(spark):
    lines = parsed(from_list(spark, SLICE))
    cut = ("2024-01-01 08:00:00", "2024-01-01 10:00:00")
    assert slicing.slice_lines(lines, *cut).count() == 3
    assert slicing.slice_lines(lines).count() == 5
    assert slicing.slice_lines(lines, "2024-01-01 08:00:00", "2024-01-01 08:00:00").count() == 1
    assert slicing.slice_lines(lines, "2024-01-01 09:00:00", "2024-01-01 08:00:00").count() == 0
    assert slicing.slice_lines(lines, *cut, include_unparsed=True).count() == 4
    row = slicing.slice_stats(lines, *cut).first()
    assert (row["total_lines"], row["matched_lines"], row["skipped_before"], row["skipped_after"], row["unparseable_lines"]) == (6, 3, 1, 1, 1)
    assert slicing.slice_stats(lines.limit(0), *cut).first()["match_rate"] == 0.0


def test_severity(spark):
    lines = from_list(spark, ["DEBUG a", "INFO b", "warn c", "ERROR d", "FATAL e", "none"])
    assert [r["severity"] for r in rules.severity_filter(lines).orderBy("ord").collect()] == ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", None]
    assert rules.severity_filter(lines, ["WARN"]).count() == 1
    with pytest.raises(SpecError):
        rules.severity_filter(lines, ["LOUD"])


def test_rules(spark):
    lines = from_list(spark, ["ERROR timeout", "WARN slow", "INFO ok ERROR", "   "])
    assert [r["total_score"] for r in rules.score(lines, [rules.ScoringRule("e", "ERROR", 10), rules.ScoringRule("t", "timeout", 5)], 5).orderBy("ord").collect()] == [15.0, 10.0]
    assert rules.tag(lines, [rules.TagRule("err", "error")]).count() == 3
    assert rules.pattern_match(lines, []).count() == 0
    assert rules.pattern_match(lines, [rules.PatternRule("", "", False)]).count() == 4
    fields = rules.extract_fields(lines, [rules.FieldRule("level", r"(?P<value>ERROR|WARN)"), rules.FieldRule("rest", r"timeout")]).orderBy("ord").collect()
    assert [r["fields"] for r in fields] == [{"level": "ERROR", "rest": "timeout"}, {"level": "WARN"}, {"level": "ERROR"}, {}]
    marked = rules.highlight(lines, [rules.KeywordRule("error", "$[", "]\\"), rules.KeywordRule("ERR", "<", ">")]).orderBy("ord").first()
    assert marked["highlighted"] == "$[<ERR>OR]\\ timeout" and marked["matched_keywords"] == ["error", "ERR"]
    chain = [rules.FormatterStep("strip", lambda c: F.trim(c)), rules.FormatterStep("drop", lambda s: None if "ERROR" in s else s, native=False)]
    assert rules.format_chain(lines, chain).count() == 2
    kept = rules.format_chain(lines, chain, skip_on_none=False).orderBy("ord").first()
    assert kept["transformed"] == "ERROR timeout" and kept["stages"] == ["strip", "drop"]
    for bad in (lambda: rules.TagRule("", "x"), lambda: rules.ClassifierRule("a", "b", "(", 1), lambda: rules.ClassifierRule("a", "b", "c", 2), lambda: rules.KeywordRule("")):
        with pytest.raises(SpecError):
            bad()


def test_aggregates(spark):
    lines = from_list(spark, ["service=auth a", "service=db b", "service=auth c", "none"])
    got = agg.aggregate_by_key(lines, r"service=(\w+)", keep_lines=True).orderBy("first_ord").collect()
    assert [(r["key"], r["count"], r["first_line"][-1], r["last_line"][-1], len(r["lines"])) for r in got] == [("auth", 2, "a", "c", 2), ("db", 1, "b", "b", 1)]
    assert agg.unmatched(lines, r"service=(\w+)").first()["unmatched_lines"] == 1
    alerts = agg.alerts(lines, [agg.ThresholdRule("a", "auth", 2), agg.ThresholdRule("z", "zzz", 1)], keep_lines=True)
    assert "[TRIGGERED] a: 2/2 matches" in reports.alert_report(alerts) and "[OK] z: 0/1 matches" in reports.alert_report(alerts)
    d = agg.diff(from_list(spark, ["a", " b ", "c"]), from_list(spark, ["b", "c", "d"]))
    assert {(r["line"], r["section"]) for r in d.collect()} == {("a", "removed"), ("b", "common"), ("c", "common"), ("d", "added")}


def test_groups_that_take_no_part_and_long_groups(spark):
    lines = from_list(spark, [f"{'a' if i % 3 else ''}b{i}" for i in range(100)] + ["none"])
    got = {r["key"]: r["count"] for r in agg.aggregate_by_key(lines, "(a)?b").collect()}
    assert got == {None: 34, "a": 66}
    chunks = order.grouped_lines(lines, "(a)?b", most=7).orderBy("key", "chunk").collect()
    assert max(len(r["lines"]) for r in chunks) <= 7
    for key in (None, "a"):
        assert [x for r in chunks if r["key"] == key for x in r["lines"]] == [f"{'a' if i % 3 else ''}b{i}" for i in range(100) if bool(i % 3) == (key == "a")]
    assert len([r for r in chunks if r["key"] == "a"]) >= 9
    order.release()


def entries(n, seed):
    rng, t, out = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 1, 20, 60, 61, 200, -30]))
        out.append((i, t if rng.random() > 0.1 else None, rng.choice("abc")))
    return out


def test_dedup_shuffles_lines_once(spark):
    """Keys that are no larger than a block: one exchange that carries lines, and the last aggregation needs none."""
    df = spark.createDataFrame([(i, t, k, f"{k}{i}") for i, t, k in entries(50, 1)], "ord long, timestamp timestamp_ntz, k string, line string")
    plan = order.dedup(df, 60, F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("block", [7, 40, 100_000])
def test_sessions_dedup_context_sample(spark, monkeypatch, block):
    monkeypatch.setattr(order, "BLOCK", block)
    rows = entries(120, 3)
    df = spark.createDataFrame([(i, t, k, f"{k}{i}") for i, t, k in rows], "ord long, timestamp timestamp_ntz, k string, line string").repartition(5)
    want, last = [], None
    for _, t, _ in rows:
        if not want or (t is not None and last is not None and (t - last).total_seconds() > 60):
            want.append(0)
        want[-1] += 1
        last = t or last
    assert [r["entry_count"] for r in order.sessions(df, 60).orderBy("index").collect()] == want

    runs_, last_of = {}, {}
    for _, t, k in rows:
        if not (k in last_of and t is not None and last_of[k] is not None and (t - last_of[k]).total_seconds() <= 60):
            runs_.setdefault(k, []).append(0)
        runs_[k][-1] += 1
        last_of[k] = t
    got = order.dedup(df, 60, F.col("k")).orderBy("first_ord").collect()
    assert {k: [r["count"] for r in got if r["key"] == k] for k in "abc"} == {k: runs_.get(k, []) for k in "abc"}

    by_key = order.sessions(df, 60, ["k"]).orderBy("k", "index").collect()
    for key in "abc":
        want, last = [], None
        for _, t, k in rows:
            if k == key:
                if not want or (t is not None and last is not None and (t - last).total_seconds() > 60):
                    want.append(0)
                want[-1] += 1
                last = t or last
        assert [r["entry_count"] for r in by_key if r["k"] == key] == want
    starts = {k: [r["first_ord"] for r in got if r["key"] == k] for k in "abc"}
    for r in got:  # a closed run is put where its successor begins
        later = [o for o in starts[r["key"]] if o > r["first_ord"]]
        assert r["order"] == ((False, min(later)) if later else (True, r["first_ord"]))

    lines = [r[2] + str(r[0]) for r in rows]
    found = {r["line_number"]: (r["before"], r["after"]) for r in order.context(df, F.col("k") == "a", 3, 2).collect()}
    assert found == {i + 1: (lines[max(0, i - 3) : i], lines[i + 1 : i + 3]) for i, r in enumerate(rows) if r[2] == "a"}
    assert [r["ord"] for r in order.sample(df, 7).orderBy("idx").collect()] == list(range(0, 120, 18))


def test_files_sinks_runs(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes("\n".join([*SLICE, 'quote " and, comma', "é"]).encode() + b"\n\xff bad\n")
    config = SliceConfig(str(log), "2024-01-01 08:00:00", "2024-01-01 10:00:00", output_path=str(tmp_path / "out"), output_format="JSON")
    cache = runs.StatsCache(str(tmp_path / "cache"))
    assert runs.run_cached(spark, config, cache)["matched_lines"] == 3 == runs.run_cached(spark, config, cache)["matched_lines"]
    assert [json.loads(r[0])["timestamp"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [f"2024-01-01T{h:02d}:00:00" for h in (8, 9, 10)]
    assert cache.clear() == 1
    lines = parsed(read_lines(spark, str(log)))
    assert [r["line"] for r in lines.orderBy("ord").collect()][-1] == "� bad"
    assert sinks.export(lines, str(tmp_path / "csv"), "csv") == 9
    (tmp_path / "p.json").write_text(json.dumps([{"name": "m", "start": "2024-01-01 08:00:00", "end": "2024-01-01 09:30:00"}, {"name": "a", "start": "2024-01-01 09:30:00", "end": "2024-01-01 23:00:00"}]))
    stats = runs.run_profiles(spark, str(log), profiles_from_json(str(tmp_path / "p.json")))
    assert {r["profile"]: r["matched_lines"] for r in stats.collect()} == {"m": 2, "a": 2}
    with pytest.raises(SpecError):
        SliceConfig.from_dict({"speed": 1})
    with pytest.raises(SpecError):
        FilterProfile("x", None, "2024-01-01 00:00:00")
    with pytest.raises(SpecError):
        sinks.OutputRouter(str(tmp_path / "r")).write(lines)


def test_tail(spark, tmp_path):
    from timberline.streaming.tail import tail

    log = tmp_path / "t.log"
    log.write_text("2024-01-01 10:00:00 old\n")
    seen = []
    query = tail(spark, str(log), "2024-01-01 10:00:00", "2024-01-01 10:00:10").writeStream.foreachBatch(lambda df, _: seen.extend(r["line"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    with log.open("a") as f:
        f.write("2024-01-01 10:00:03 new\n2024-01-01 10:00:20 late\n2024-01-01 10:00:04 part")
    query.processAllAvailable()
    query.stop()
    assert seen == ["2024-01-01 10:00:03 new"]


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def values(rows) -> list:
    return sorted(repr([round(x, 6) if isinstance(x, float) else str(x) for x in row]) for row in rows)


def test_a_range_reads_each_time_once(spark):
    """The filter held the timestamp's expression, three formats, at each place that the condition names it."""
    lines = spark.range(9).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") + 1).cast("string"), F.lit(" 00:00:00 x")).alias("line"))
    kept = slicing.slice_lines(parsed(lines), "2024-01-02 00:00:00", "2024-01-04 00:00:00").select("id")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp(") == 3
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3]


def test_a_sample_makes_its_lines_once(spark):
    """The range sort made them twice, for its bounds and for its rows. Lines of one place are each a line of their own."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    lines = spark.range(0, 1000, 1, 4).selectExpr("(999 - id) div 2 AS ord", "string(id) AS line").mapInArrow(counted, "ord long, line string")
    rows = order.sample(lines, 97).orderBy("idx").collect()
    assert made.value == 1000
    assert [(r["ord"], r["idx"], r["step"], r["is_exact"]) for r in rows] == [(p // 2, i, 11, False) for i, p in enumerate(range(0, 1000, 11))]
    assert len({r["line"] for r in rows}) == 91
    order.release()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    want = tables.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    assert values([r[c] for c in columns] for r in got.collect()) == values([r[i] for i in places] for r in want.fetchall())
    order.release()


def test_every_log_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLES.keys()
