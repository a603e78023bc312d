"""Operators set up step by step."""

import pytest

from timberline.errors import SpecError
from timberline.plans.specs import Annotation, Comparison, Highlighting, Watch
from timberline.sources.lines import from_list


def test_a_tag_named_again_gets_more_keywords(spark):
    spec = Annotation().tag("bad", "error").tag("slow", "timeout").tag("bad", "fatal").of("app.log")
    got = spec.apply(from_list(spark, ["FATAL x", "error timeout", "fine"])).orderBy("ord").collect()
    assert [(r["tags"], r["source"]) for r in got] == [(["bad"], "app.log"), (["bad", "slow"], "app.log"), ([], "app.log")]
    for bad in (lambda: Annotation().tag("", "x"), lambda: Annotation().tag("x"), lambda: Annotation().apply(from_list(spark, ["x"]))):
        with pytest.raises(SpecError):
            bad()


def test_markers_hold_for_later_words(spark):
    spec = Highlighting().words("error").marked("[", "]").cased().words("Disk")
    got = spec.apply(from_list(spark, ["ERROR disk Disk"])).first()
    assert got["highlighted"] == ">>>ERROR<<< disk [Disk]"
    for bad in (lambda: Highlighting().marked("", "x"), lambda: Highlighting().apply(from_list(spark, ["x"]))):
        with pytest.raises(SpecError):
            bad()


def test_comparison(spark, tmp_path):
    for name, text in (("a", "x\n y\n"), ("b", "y\nz\n")):
        (tmp_path / name).write_text(text)
    got = Comparison(str(tmp_path / "a"), str(tmp_path / "b")).run(spark)
    assert {(r["line"], r["section"]) for r in got.collect()} == {("x", "removed"), ("y", "common"), ("z", "added")}
    with pytest.raises(SpecError):
        Comparison(str(tmp_path / "a")).run(spark)


def test_watch(spark, tmp_path):
    log = tmp_path / "w.log"
    log.write_text("2024-01-01 10:00:00 old\n")
    seen = []
    watch = Watch(str(log), "2024-01-01 10:00:00", "2024-01-01 10:00:10", poll_seconds=0.1, max_idle=4)
    query = watch.run(spark, lambda df, _: seen.extend(r["line"] for r in df.collect()), str(tmp_path / "c"))
    query.processAllAvailable()
    with log.open("a") as f:
        f.write("2024-01-01 10:00:03 new\n01/Jan/2024:10:00:04 apache\n")
    query.awaitTermination(60)
    assert seen == ["2024-01-01 10:00:03 new"] and not query.isActive
    with pytest.raises(SpecError):
        Watch(str(log), "2024-01-01 10:00:00").lines(spark)
