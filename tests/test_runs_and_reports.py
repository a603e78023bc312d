"""Profiles with time formats of their own, context beyond a block, feeds over streams, reports, routes, strict reading and the command line."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timberline import cli
from timberline.errors import SpecError
from timberline.operators import aggregates as agg
from timberline.operators import order, rules, slicing
from timberline.plans import runs
from timberline.plans.config import FilterProfile
from timberline.sources import reports, sinks
from timberline.sources.lines import from_list, parsed, read_lines
from timberline.streaming import tail

LINES = ["2024-01-01 08:00:00 INFO a", "2024-01-01 09:00:00 ERROR b", "15/Jan/2024:08:00:00 GET /", "2024/01/01 08:30:00 own", "no time"]


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "x.log"
    path.write_text("\n".join(LINES) + "\n")
    return str(path)


def test_profiles_have_their_own_formats(spark, log):
    day = ("2024-01-01 00:00:00", "2024-01-01 23:00:00")
    got = {r["profile"]: (r["matched_lines"], r["unparseable_lines"]) for r in runs.run_profiles(spark, log, [FilterProfile("plain", *day), FilterProfile("own", *day, timestamp_formats=("%Y/%m/%d %H:%M:%S",))]).collect()}
    assert got == {"plain": (2, 2), "own": (1, 4)}


@pytest.mark.parametrize("before, after", [(12, 0), (0, 12), (12, 13), (3, 2)])
def test_context_beyond_a_block(spark, monkeypatch, before, after):
    monkeypatch.setattr(order, "BLOCK", 5)
    lines = [f"l{i}" for i in range(40)]
    for predicate in (F.col("line").isin("l0", "l20", "l21", "l39"), lambda x: x in ("l0", "l20", "l21", "l39")):
        got = {r["line_number"] - 1: (r["before"], r["after"]) for r in order.context(from_list(spark, lines).repartition(3), predicate, before, after).collect()}
        assert got == {i: (lines[max(0, i - before) : i], lines[i + 1 : i + 1 + after]) for i in (0, 20, 21, 39)}
    order.release()


def test_annotate_pairs_by_place(spark):
    lines = from_list(spark, ["a error", "b", "c"])
    times = spark.createDataFrame([(100, "t0"), (300, "t1")], "ord long, timestamp string")
    got = rules.annotate(lines, {"bad": ["ERROR"]}, times).orderBy("ord").collect()
    assert [(r["line"], r["tags"], r["timestamp"]) for r in got] == [("a error", ["bad"], "t0"), ("b", [], "t1")]


def test_dedup_by_whole_message(spark):
    at = lambda s: (datetime(2024, 1, 1) + timedelta(seconds=s)).strftime("%Y-%m-%d %H:%M:%S")
    lines = [f"{at(0)} ERROR disk full", f"{at(5)} INFO heartbeat", f"{at(10)} INFO heartbeat", f"{at(30)} ERROR disk full", f"{at(120)} ERROR disk full", "  ", "no time", "no time"]
    got = order.dedup(parsed(from_list(spark, lines)), 60).orderBy("first_ord").collect()
    assert [(r["key"], r["count"]) for r in got] == [("ERROR disk full", 2), ("INFO heartbeat", 2), ("ERROR disk full", 1), ("no time", 1), ("no time", 1)]
    order.release()


def test_windowed_streams_and_idle_stop(spark, tmp_path):
    log = tmp_path / "w.log"
    log.write_text("".join(f"2024-01-01 10:00:{s:02d} m\n" for s in (1, 2, 31)) + "2024-01-01 12:00:00 m\n")
    for name, make in (("rate", lambda x: tail.rate_stream(x, 30)), ("sessions", lambda x: tail.sessions_stream(x, 10)), ("dedup", lambda x: tail.dedup_stream(x, 10, F.substring("line", 21, 9)))):
        seen = []
        with tail.idle_events(spark, 0.5):
            q = make(tail.tail(spark, str(log), from_start=True)).writeStream.foreachBatch(lambda df, _: seen.extend(r.asDict().get("count", r.asDict().get("entry_count")) for r in df.collect())).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        assert sorted(seen) == [1, 2], name
        tail.stop_when_idle(q, 0.5).join(30)
        assert not q.isActive


def test_tail_spans_are_whole_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SPAN_BYTES", 7)
    log = tmp_path / "s.log"
    log.write_text("a\nbcdefghijkl\n\nmn\npart")
    reader = tail.TailReader(str(log), True)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) > 1
    assert [r[2] for p in parts for r in reader.read(p)] == ["a", "bcdefghijkl", "", "mn"]


def test_strict_reading(spark, tmp_path):
    path = tmp_path / "b.log"
    path.write_bytes(b"ok\n\xff\n")
    assert read_lines(spark, str(path)).count() == 2
    with pytest.raises(Exception, match="not UTF-8"):
        read_lines(spark, str(path), strict=True).collect()


def test_reports(spark, tmp_path):
    lines = parsed(from_list(spark, ["2024-01-01 08:00:00 ERROR disk", "2024-01-01 08:00:30 INFO disk", "2024-01-01 09:00:00 INFO disk", "x"]))
    stats = slicing.slice_stats(lines, "2024-01-01 08:00:00", "2024-01-01 08:59:00").first()
    assert reports.stats_report(stats) == "Processed 4 lines: 2 matched (50.0%), 0 before range, 1 after range, 1 unparseable."
    assert json.loads(reports.stats_report(stats, "json"))["first_matched_ts"] == "2024-01-01T08:00:00"
    counts = slicing.line_count(lines, "2024-01-01 08:00:00").first()
    assert reports.line_count_report(counts) == "Total: 4 | Matched: 3 | Skipped before: 0 | Skipped after: 0 | Unparseable: 1"
    diff = agg.diff(from_list(spark, ["a", "b"]), from_list(spark, ["b", "c"]))
    assert reports.diff_report(diff, path=str(tmp_path / "d")) == "Summary: +1 added, -1 removed, =1 common\n--- removed ---\n  - a\n+++ added +++\n  + c"
    assert (tmp_path / "d").read_text().startswith("Summary") and reports.diff_summary(diff) == "+1 added, -1 removed, =1 common"
    assert json.loads(reports.diff_report(diff, "json"))["summary"] == {"added": 1, "removed": 1, "common": 1, "has_changes": True}
    assert reports.diff_report(agg.diff(from_list(spark, ["a"]), from_list(spark, ["a"]))).endswith(reports.NO_DIFF)
    hits = rules.pattern_match(lines, [rules.PatternRule("ERROR", "bad"), rules.PatternRule("09:00")])
    assert reports.pattern_report(hits) == "[bad] 2024-01-01 08:00:00 ERROR disk\n2024-01-01 09:00:00 INFO disk"
    assert reports.pattern_report(hits.limit(0)) == "No matches found." and len(json.loads(reports.pattern_report(hits, "json"))) == 2
    scored = rules.score(lines, [rules.ScoringRule("e", "ERROR", 2)])
    assert reports.score_report(scored).splitlines()[0] in ("[score=2.00] [rules=e] 2024-01-01 08:00:00 ERROR disk",)
    assert reports.score_report(scored.limit(0)) == "No scored entries." and json.loads(reports.score_report(scored, "json"))[0]["matched_rules"] == ["e"]
    sessions = order.sessions(lines, 60)
    assert reports.session_report(sessions).splitlines() == ["Sessions found: 2", "  [0] entries=2  start=2024-01-01T08:00:00  end=2024-01-01T08:00:30  duration=30.0s", "  [1] entries=2  start=2024-01-01T09:00:00  end=2024-01-01T09:00:00  duration=0.0s"]
    assert json.loads(reports.session_report(sessions, "json"))["session_count"] == 2
    alerts = agg.alerts(lines, [agg.ThresholdRule("disk", "ERROR disk", 1)], keep_lines=True)
    assert reports.alert_report(alerts) == "[TRIGGERED] disk: 1/1 matches\n  > 2024-01-01 08:00:00 ERROR disk" and json.loads(reports.alert_report(alerts, "json"))[0]["triggered"]
    block = order.context(lines, F.col("line") == "x", 1, 1).first()
    assert reports.context_block(block) == "  2024-01-01 09:00:00 INFO disk\n> x"
    groups, totals = agg.aggregate_by_key(lines, r"(ERROR|INFO)"), agg.unmatched(lines, r"(ERROR|INFO)").first()
    assert reports.aggregation_report(groups, totals) == "Total lines: 4\nUnmatched: 1\n[ERROR] 1 entries\n[INFO] 2 entries"
    assert json.loads(reports.aggregation_report(groups, totals, "json"))["groups"]["INFO"]["count"] == 2
    summary = (agg.summary_totals(lines).first(), agg.summary_severities(lines), agg.summary_top(lines, 2))
    assert "  INFO      : 2" in reports.summary_report(*summary) and "  [   2] INFO disk" in reports.summary_report(*summary)
    assert json.loads(reports.summary_report(*summary, fmt="json"))["severity_counts"] == {"ERROR": 1, "INFO": 2}
    buckets = agg.rate(lines, 60)
    assert reports.rate_report(buckets, 60).splitlines()[-1] == "Peak window   : 2024-01-01T08:00:00 (2 entries)"
    assert reports.rate_report(buckets.limit(0), 60).endswith("n/a") and json.loads(reports.rate_report(buckets, 60, "json"))["total_entries"] == 3
    with pytest.raises(SpecError):
        reports.stats_report(stats, "xml")
    with pytest.raises(SpecError):
        reports.stats_report(stats, path=str(tmp_path / "none" / "x"))
    order.release()


def test_command_line(spark, log, tmp_path, capsys):
    assert cli.main(["slice", log, "--start", "2024-01-01 08:30:00"]) == 0
    out = capsys.readouterr()
    assert "ERROR b" in out.out and "INFO a" not in out.out and "2 matched" in out.err
    profiles = tmp_path / "p.json"
    profiles.write_text(json.dumps([{"name": "m", "start": "2024-01-01 08:00:00", "end": "2024-01-01 08:30:00"}]))
    assert cli.main(["profiles", log, str(profiles)]) == 0
    assert capsys.readouterr().out.strip() == "[m] matched=1 skipped=4 match_rate=20.0%"
    assert cli.main(["profiles", log, str(profiles), "--format", "json", "--output", str(tmp_path / "o.json")]) == 0
    assert json.loads((tmp_path / "o.json").read_text())[0]["matched_lines"] == 1
    assert cli.main(["slice", log, "--start", "soon"]) == 1 and cli.main(["slice", str(tmp_path / "none.log")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["slice"])


def test_on_route(spark):
    got = rules.route(from_list(spark, ["ERROR a", "b"]), [rules.RouteRule("e", "ERROR", "errors")]).orderBy("ord").collect()
    assert [(r["destination"], r["rule_name"]) for r in got] == [("errors", "e"), ("unmatched", None)]


def test_line_ends_count_without_stripping(spark, tmp_path):
    """A last line without line feed is another line than one with it; CR LF is a line feed; an empty file has no line."""
    from timberline.plans.specs import Comparison

    a, b, empty = (tmp_path / n for n in ("a", "b", "empty"))
    a.write_bytes(b"x\ny \r\n\nlast")
    b.write_bytes(b"x\ny \n\nlast\n")
    empty.write_bytes(b"")
    told = lambda *files, **kw: {(r["line"], r["section"]) for r in Comparison(*map(str, files), **kw).run(spark).collect()}
    assert told(a, b, strip_whitespace=False) == {("x\n", "common"), ("y \n", "common"), ("\n", "common"), ("last", "removed"), ("last\n", "added")}
    assert told(a, b) == {("x", "common"), ("y", "common"), ("", "common"), ("last", "common")}
    assert told(empty, b, strip_whitespace=False) == {(x, "added") for x in ("x\n", "y \n", "\n", "last\n")}
    a.write_bytes(b"\xff\n")
    with pytest.raises(Exception, match="(?i)utf"):
        told(a, b, strip_whitespace=False)


def test_router_opens_only_what_can_be_written(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    for bad in (tmp_path / "file", tmp_path / "file" / "below"):
        with pytest.raises(SpecError):
            sinks.OutputRouter(str(bad)).open()
    lines = parsed(from_list(spark, ["2024-01-01 10:00:00 a", "b"]))
    with sinks.OutputRouter(str(tmp_path / "new" / "deep"), fmt="json") as router:
        assert router.write(lines) == 2 and router.write(lines) == 2
    assert spark.read.text(str(tmp_path / "new" / "deep")).count() == 4
