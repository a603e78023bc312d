"""Thousands of profiles, and thousands of literals, in one pass over the lines.

Profiles: lines are counted by time; these times and the bounds of all profiles stand in one order, where each bound sees how many lines come
before it and which time is next. So the work grows with the lines and the profiles, whatever their lengths, and no side is broadcast.

Literals: one automaton finds which of all literals a line holds, in one pass over its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.errors import need
from timberline.operators.aggregates import ThresholdRule
from timberline.operators import order

#: Rows of the order of times: lines without a time, a profile's start (before the lines of its time), lines of one time, a profile's end (after them).
UNPARSED, START, LINES, END = range(4)
#: Where an open end stands, in microseconds.
LAST = (1 << 63) - 1


def profile_join(parsed: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile, total_lines, matched_lines, unparseable_lines, first_matched_ts, last_matched_ts for each row of profiles (profile, start, end:
    TIMESTAMP_NTZ, inclusive, null: open). Rows of equal names are counted each by itself; reversed bounds match nothing."""
    kind, at = F.col("kind"), F.col("at")
    times = parsed.groupBy(order.micros(F.col("timestamp")).alias("at")).agg(F.count("*").alias("n")).withColumn("kind", F.when(at.isNull(), UNPARSED).otherwise(LINES))
    wanted = profiles.select("profile", order.micros(F.col("start")).alias("s"), order.micros(F.col("end")).alias("e")).withColumn("uid", F.monotonically_increasing_id())
    # an open start is null, which stands first
    bounds = wanted.select("uid", "profile", F.inline(F.array(F.struct(F.col("s").alias("at"), F.lit(START).alias("kind")), F.struct(F.coalesce("e", F.lit(LAST)).alias("at"), F.lit(END).alias("kind")))))
    # uid spreads bounds of one time over the partitions
    numbered = order.placed(times.unionByName(bounds, allowMissingColumns=True), "at", "kind", "uid").withColumn("_block", F.floor(F.col("pos") / order.BLOCK))
    total = lambda *kinds: F.coalesce(F.sum(F.when(kind.isin(*kinds), F.col("n"))), F.lit(0))
    all_lines, unparsed = numbered.agg(total(UNPARSED, LINES), total(UNPARSED)).first()

    # between the blocks of the order only summaries travel, one row a block
    n, own = (F.when(kind == LINES, c) for c in (F.col("n"), at))
    so_far = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    up, down = (so_far(Window.orderBy(c), -1) for c in (F.asc("_block"), F.desc("_block")))
    blocks = numbered.groupBy("_block").agg(F.sum(n).alias("sum"), F.min(own).alias("least"), F.max(own).alias("most"))
    carried = blocks.select("_block", F.coalesce(F.sum("sum").over(up), F.lit(0)).alias("_sum"), F.max("most").over(up).alias("_most"), F.min("least").over(down).alias("_least"))
    up, down = (so_far(Window.partitionBy("_block").orderBy(c), 0) for c in (F.asc("pos"), F.desc("pos")))
    seen = numbered.join(F.broadcast(carried), "_block").select(
        "uid", "profile", "kind", (F.coalesce(F.sum(n).over(up), F.lit(0)) + F.col("_sum")).alias("n"),
        F.coalesce(F.max(own).over(up), "_most").alias("before"), F.coalesce(F.min(own).over(down), "_least").alias("after"),
    ).where(kind.isin(START, END))
    of = lambda k, c: F.max(F.when(kind == k, F.col(c)))
    found = seen.groupBy("uid", "profile").agg((of(END, "n") - of(START, "n")).alias("n"), of(START, "after").alias("first"), of(END, "before").alias("last"))
    time = lambda c: F.when(F.col("n") > 0, F.timestamp_micros(c).cast("timestamp_ntz"))
    return found.select("profile", F.lit(all_lines).cast("long").alias("total_lines"), F.greatest("n", F.lit(0)).alias("matched_lines"), F.lit(unparsed).cast("long").alias("unparseable_lines"), time("first").alias("first_matched_ts"), time("last").alias("last_matched_ts"))


def literal_counts(lines: DataFrame, literals: list[str]) -> DataFrame:
    """literal (its place in the list, from 0) and n, the lines that hold it, of literals that any line holds. An empty literal is in every line that isn't null."""
    import pyarrow as pa

    shared = lines.sparkSession.sparkContext.broadcast(list(literals))

    def counted(batches):
        import ahocorasick
        import numpy as np

        index, empty, places = ahocorasick.Automaton(), [], {}
        for i, text in enumerate(shared.value):
            if text:
                places.setdefault(text, []).append(i)
            else:
                empty.append(i)
        for k, (text, own) in enumerate(places.items()):
            index.add_word(text, k)
        found, seen = np.zeros(len(places), np.int64), 0
        if places:
            index.make_automaton()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if line is not None:
                    seen += 1
                    if places:
                        for k in {k for _, k in index.iter(line)}:
                            found[k] += 1
        rows = [(i, int(n)) for own, n in zip(places.values(), found) if n for i in own] + [(i, seen) for i in empty if seen]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64()))], ["literal", "n"])

    return lines.select("line").mapInArrow(counted, "literal int, n long").groupBy("literal").agg(F.sum("n").alias("n"))


def alerts_many(lines: DataFrame, rules: list[ThresholdRule]) -> DataFrame:
    """rule_name, threshold, matched_count, triggered for every rule, as `aggregates.alerts`; the time grows with the text, not with rules times lines."""
    need(len(rules) > 0, "at least one rule")
    named = lines.sparkSession.createDataFrame([(i, r.name, r.threshold) for i, r in enumerate(rules)], "literal int, rule_name string, threshold long")
    count = F.coalesce("n", F.lit(0)).cast("long")
    return named.join(literal_counts(lines, [r.pattern for r in rules]), "literal", "left").select("rule_name", "threshold", count.alias("matched_count"), (count >= F.col("threshold")).alias("triggered"))
