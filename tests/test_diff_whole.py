"""The diff of the whole log takes every line's whole message."""

from datetime import datetime

from timberline import queries

SF = "/root/testdata/sf0.001"


def test_whole_messages(spark):
    rows = [(r["timestamp"] < datetime.fromisoformat(queries.MIDDLE), r["line"][20:].strip()) for r in queries.timed(spark, SF).collect()]
    old, new = {m for early, m in rows if early}, {m for early, m in rows if not early}
    assert old and new
    for name, want in (("added", new - old), ("removed", old - new), ("common", old & new)):
        assert {r["line"] for r in queries.QUERIES[f"q_diff_{name}"](spark, SF).collect()} == want
