"""Order-dependent operators without one task for all rows.

A global place comes from a range sort, a row's number within its partition, and the partitions' counts. State
that runs along lines, of a key or all, is computed within blocks of places; each block's summary, one row, is carried to the next
blocks by a window over the summaries alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.errors import need
from timberline.functions.regexes import compiled, extracted, found
from timberline.functions.text import blank, once, strip, without_first
from timberline.functions.timestamps import DEFAULT, timestamp_text

#: Lines of a block, and of a key at most that is one window; rows of a table of large keys that is broadcast at most.
BLOCK, BROADCAST_ROWS = 100_000, 100_000
_held: list[DataFrame] = []


def release() -> None:
    """Frees what `placed` and `sample` keep. For when the results made so far have been read: one read later may number lines anew."""
    while _held:
        _held.pop().unpersist()


def placed(df: DataFrame, *by: str) -> DataFrame:
    """Adds pos, the 0-based place in the order of the columns `by` (ord, unless others are given).

    The sorted rows are kept (memory, then disk), as range bounds are drawn anew by each sort; see `release`."""
    by = by or ("ord",)
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()).persist()
    _held.append(ordered)
    counts = sorted(map(tuple, ordered.groupBy(F.shiftright("_id", 33).alias("p")).count().collect()))  # a row for each partition
    begins, total = [], 0
    for part, n in counts:
        begins += [F.lit(part), F.lit(total).cast("long")]
        total += n
    begin = F.element_at(F.create_map(*begins), F.shiftright("_id", 33)) if begins else F.lit(0).cast("long")
    return ordered.withColumn("pos", begin + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def runs(lines: DataFrame, keys: list[str], breaks: Callable[[Column], Column], skip_nulls: bool) -> DataFrame:
    """Adds _new (1 where a run begins by breaks(previous timestamp), else 0) and _run, the sum of _new so far.

    The previous timestamp is that of the line before of the same keys, or with skip_nulls the last that isn't null. Keys of at most BLOCK lines, counted
    first, are windows: one shuffle of lines. Larger ones, and all lines without keys, go in blocks."""
    if not keys:
        return in_blocks(lines, keys, breaks, skip_nulls)
    large = lines.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).drop("_n")
    n = large.count()
    if not n:
        return in_windows(lines, keys, breaks, skip_nulls)
    named = large.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)])
    named = F.broadcast(named) if n <= BROADCAST_ROWS else named
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    blocks, windows = in_blocks(lines.join(named, on, "left_semi"), keys, breaks, skip_nulls), in_windows(lines.join(named, on, "left_anti"), keys, breaks, skip_nulls)
    return windows.unionByName(blocks)


def in_windows(lines: DataFrame, keys: list[str], breaks: Callable[[Column], Column], skip_nulls: bool) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ord")
    before = F.last("timestamp", True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if skip_nulls else F.lag("timestamp").over(w)
    flagged = lines.withColumn("_before", before).withColumn("_new", breaks(F.col("_before")).cast("long")).drop("_before")
    return flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def in_blocks(lines: DataFrame, keys: list[str], breaks: Callable[[Column], Column], skip_nulls: bool) -> DataFrame:
    """Lines are sorted by keys and order and cut into blocks of places, so a key that holds most lines is many tasks; between the blocks of a key
    only summaries travel, one row a key and block: of keys of more than a block each, few."""
    numbered = placed(lines, *keys, "ord").withColumn("_block", F.floor(F.col("pos") / BLOCK))
    w, blocks = Window.partitionBy("_block", *keys).orderBy("pos"), Window.partitionBy(*keys).orderBy("_block")
    earlier = lambda over: over.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("timestamp").isNotNull(), F.col("pos")) if skip_nulls else F.col("pos")
    ends = numbered.groupBy("_block", *keys).agg(F.max_by("timestamp", at).alias("_last"))
    before = F.last("_last", True).over(earlier(blocks)) if skip_nulls else F.lag("_last").over(blocks)
    carried = same_keys(numbered, ends.select("_block", *keys, before.alias("_carried")), ["_block", *keys])
    within = F.last("timestamp", True).over(earlier(w)) if skip_nulls else F.lag("timestamp").over(w)
    flagged = carried.withColumn("_new", breaks(F.coalesce(within, F.col("_carried")) if skip_nulls else F.when(F.row_number().over(w) == 1, F.col("_carried")).otherwise(within)).cast("long"))
    sums = flagged.groupBy("_block", *keys).agg(F.sum("_new").alias("_sum"))
    begun = sums.select("_block", *keys, F.coalesce(F.sum("_sum").over(earlier(blocks)), F.lit(0)).alias("_begun"))
    inside = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return same_keys(flagged.withColumn("_run", inside), begun, ["_block", *keys]).withColumn("_run", F.col("_run") + F.col("_begun")).drop("_block", "_carried", "_begun", "pos")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null equal to null; the left side's keys stay."""
    named = right.select(*[F.col(k).alias(f"_r{i}") if k in keys else F.col(k) for i, k in enumerate(right.columns)])
    held = {k: f"_r{i}" for i, k in enumerate(right.columns) if k in keys}
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(held[k]))
    return left.join(named, on).drop(*held.values())


def context(lines: DataFrame, predicate: Column | Callable[[str], bool], before: int = 2, after: int = 2) -> DataFrame:
    """line_number (from 1), matched_line, before, after: neighbours are those of all lines; contexts may overlap.

    predicate: a column, or a Python function of the line, called in Arrow batches. A line goes to every block that a
    hit near it may be in, however many that are."""
    need(before >= 0 and after >= 0, "before and after must not be negative")
    if not isinstance(predicate, Column):
        fits = predicate
        predicate = F.pandas_udf(lambda texts: texts.map(lambda x: x is not None and bool(fits(x))), "boolean")(F.col("line"))
    numbered = placed(lines).withColumn("_hit", F.coalesce(predicate, F.lit(False)))
    own = F.floor(F.col("pos") / BLOCK)
    shared = numbered.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(F.floor(F.greatest(F.col("pos") - after, F.lit(0)) / BLOCK), F.floor((F.col("pos") + before) / BLOCK))))
    w = Window.partitionBy("_block").orderBy("pos")
    near = lambda a, b: F.collect_list("line").over(w.rowsBetween(a, b)) if b >= a else F.array().cast("array<string>")
    found = shared.withColumns({"_before": near(-before, -1), "_after": near(1, after)})
    return found.where(F.col("_hit") & (F.col("_own") == F.col("_block"))).select((F.col("pos") + 1).alias("line_number"), F.col("line").alias("matched_line"), F.col("_before").alias("before"), F.col("_after").alias("after"))


def grouped_lines(lines: DataFrame, pattern: str, group: int = 1, most: int = 10_000) -> DataFrame:
    """key, chunk, lines: the lines of each key in order, `most` a row at most; chunks of a key ascend. A key with most lines is many rows in many tasks."""
    need(most >= 1, "a chunk must have room for a line")
    need(1 <= group <= compiled(pattern).groups, "the pattern lacks the group")
    keyed = lines.where(found(F.col("line"), pattern)).select(extracted(F.col("line"), pattern, group).alias("key"), "ord", "line")
    chunks = placed(keyed, "key", "ord").groupBy("key", F.floor(F.col("pos") / most).alias("chunk"))
    return chunks.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))


def sample(lines: DataFrame, most: int) -> DataFrame:
    """Every step-th line, step = max(1, ceil(total / most)); adds idx, step and is_exact."""
    need(most >= 1, "the sample size must be at least 1")
    # lines are made once and kept as they come (see `release`); what is sorted is their order alone
    rows = lines.withColumn("_row", F.monotonically_increasing_id()).persist()
    _held.append(rows)
    numbered = placed(rows.select("ord", "_row"), "ord", "_row")
    total = numbered.count()
    step = max(1, -(-total // most))
    kept = -(-total // step)
    chosen = numbered.where(F.col("pos") % step == 0).select("_row", "pos")
    found = rows.join(F.broadcast(chosen) if kept <= BROADCAST_ROWS else chosen, "_row")
    return found.withColumns({"idx": F.floor(F.col("pos") / step), "step": F.lit(step).cast("long"), "is_exact": F.lit(total <= kept)}).drop("_row", "pos")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _sessions(flagged: DataFrame, keys: list[str]) -> DataFrame:
    return flagged.groupBy(*keys, "index").agg(
        F.count("*").alias("entry_count"),
        F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("ord"))).alias("start"),
        F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("ord"))).alias("end"),
    ).withColumn("duration_seconds", F.timestamp_diff("SECOND", F.col("start"), F.col("end")).cast("double"))


def sessions(parsed: DataFrame, gap_seconds: float, by: list[str] = (), compat_zero_duration_null: bool = False) -> DataFrame:
    """index (from 0), entry_count, start, end, duration_seconds of the runs of lines; a new one begins where a timestamp is
    more than the gap after the last one. Lines without a timestamp join the current session, blank ones go.
    by: sessions of each key; else of all lines."""
    need(gap_seconds > 0, "the gap must be positive")
    gap = int(gap_seconds * 1_000_000)
    breaks = lambda last: F.coalesce(micros(F.col("timestamp")) - micros(last) > gap, F.lit(False))
    found = runs(parsed.where(~blank(F.col("line"))), list(by), breaks, True)
    out = _sessions(found.withColumn("index", F.col("_run")), list(by))
    return out.withColumn("duration_seconds", F.nullif("duration_seconds", F.lit(0.0))) if compat_zero_duration_null else out


def message_key(line: Column, formats=DEFAULT) -> Column:
    """The line without the text of its timestamp, stripped."""
    return once(timestamp_text(line, formats), lambda text: strip(without_first(line, text)))


def dedup(parsed: DataFrame, window_seconds: float = 60, key: Column | None = None, formats=DEFAULT) -> DataFrame:
    """Repeats of a message within the window of its last one become one row: raw, timestamp, count, first_seen, last_seen.

    A line without a timestamp never joins another; blank messages go. order gives the output order: closed
    runs where their successor begins, then the open ones by first line."""
    need(window_seconds > 0, "the window must be positive")
    lines = parsed.withColumn("key", message_key(F.col("line"), formats) if key is None else key).where(~blank(F.col("key")))
    most = int(window_seconds * 1_000_000)
    found = runs(lines, ["key"], lambda last: ~F.coalesce(micros(F.col("timestamp")) - micros(last) <= most, F.lit(False)), False)
    # the first line of a run also tells the run before it where its successor begins
    own = F.struct(F.col("_run").alias("run"), F.lit(False).alias("told"))
    told = F.struct((F.col("_run") - 1).alias("run"), F.lit(True).alias("told"))
    spread = found.withColumn("_r", F.explode(F.when((F.col("_new") == 1) & (F.col("_run") > 1), F.array(own, told)).otherwise(F.array(own))))
    mine, next_ = (F.when(F.col("_r.told") == told_, F.col("ord")) for told_ in (False, True))
    out = spread.groupBy("key", F.col("_r.run").alias("_run")).agg(
        F.count(mine).alias("count"), F.min_by("line", mine).alias("raw"), F.min_by("timestamp", mine).alias("first_seen"),
        F.max_by("timestamp", mine).alias("last_seen"), F.min(mine).alias("first_ord"), F.min(next_).alias("_next"),
    )
    order = F.struct(F.col("_next").isNull().alias("open"), F.coalesce("_next", "first_ord").alias("at"))
    return out.withColumn("order", order).withColumn("timestamp", F.col("first_seen")).drop("_run", "_next")
