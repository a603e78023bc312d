"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document expects the same number of copies (target / size of the source). Documents are
ordered by size class, so neighbours are alike in size, then by a hash; the running sum of expected copies, plus one random
offset of the source, gives a document one copy for each whole number that it crosses.

The running sum needs no global sort: a tree of counts by (source, size class, first digits of the hash) gives the rank
at which each small group begins, and a window ranks within the group. The number of digits follows from the number of rows, so that
a group holds GROUP_ROWS rows on average even where one source and size hold all documents; the order doesn't depend on it.
A window over the tree sees the size classes of one source, or sixteen groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 11
GROUP_ROWS = 4096


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """rows as a table of sorted ranges, with _n, which grows with the order. No two rows may be equal in the order."""
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))


def running(table: DataFrame, sums: dict[str, str]) -> DataFrame:
    """A table of `ranged` with sums[c] for each of its columns c named there: the sum of c over the rows that come earlier.

    One window sees the rows of one range, another a row a range. An empty table gives none.
    """
    placed = table.withColumn("_range", F.shiftright("_n", 33))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("_range").agg(*(F.sum(c).alias(c) for c in sums))
    begun = ranges.select("_range", *(before(c, Window.orderBy("_range")).alias(f"_begin_{c}") for c in sums))
    own = {c: before(c, Window.partitionBy("_range").orderBy("_n")) for c in sums}
    counted = placed.withColumns({f"_own_{c}": w for c, w in own.items()}).join(F.broadcast(begun), "_range")
    return counted.select(*table.columns, *((F.col(f"_begin_{c}") + F.col(f"_own_{c}")).alias(name) for c, name in sums.items()))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with target: share of all sizes by weight, none above most * source_size.

    Sources take the weights in turn, by code point, null last. Capping and resharing until none is above its cap ends
    at one level (target / weight) of all uncapped sources. With the sources in order of cap / weight, what the first k
    caps leave, divided by the other weights, grows with k up to that level and falls after it, so the level is the
    largest of these. Sources may be as many as domains: both orders are range-sorted, and sums alone reach the driver.
    """
    by_name = ranged(sizes.select("source", "source_size", F.lit(1).alias("_one")), F.col("source").asc_nulls_last())
    turn = F.pmod("_place", F.lit(len(weights))).cast("int") + 1
    weighed = running(by_name, {"_one": "_place"}).drop("_n").withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
    capped = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    by_cap = ranged(capped, F.col("_ratio"), F.col("_place"))
    total, weight = by_cap.agg(F.sum("source_size"), F.sum("_weight")).first()
    left = F.lit(float(total or 0) * float(share)) - F.col("_caps")
    level = running(by_cap, {"_cap": "_caps", "_weight": "_weights"}).agg(F.max(left / (F.lit(weight) - F.col("_weights")))).first()[0]
    return by_cap.select("source", "source_size", F.least("_cap", F.lit(level).cast("double") * F.col("_weight")).alias("target"))


def hash_digits(rows: int) -> int:
    digits = 0
    while rows > GROUP_ROWS * 16**digits:
        digits += 1
    return digits


def begins(groups: DataFrame, digits: int) -> DataFrame:
    """(src, class, digits of the hash, n) -> with before: the rows of the source that come earlier than the group's."""
    levels = [groups.select("src", "class", "digits", "n")]
    for d in reversed(range(digits)):
        levels.append(levels[-1].groupBy("src", "class", F.substring("digits", 1, d).alias("digits")).agg(F.sum("n").alias("n")))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = levels[-1].withColumn("before", earlier(Window.partitionBy("src").orderBy("class")))
    for d, level in enumerate(reversed(levels[:-1]), 1):
        above = F.substring("digits", 1, d - 1)
        own = level.withColumn("above", above).withColumn("own", earlier(Window.partitionBy("src", "class", "above").orderBy("digits")))
        out = own.join(out.select("src", "class", F.col("digits").alias("above"), "before"), ["src", "class", "above"]).select("src", "class", "digits", (F.col("own") + F.col("before")).alias("before"))
    return out.select("src", "class", "digits", "before")


def copied(sized: DataFrame, rows: int, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sized (row struct, source string, size long, hash string of hex digits, tie) -> row, size, source_size, target, copies.

    rows: about how many there are. sized is read twice, and one shuffle carries its rows to their groups.
    """
    digits = hash_digits(rows)
    keyed = sized.withColumns({
        "src": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")),
        "class": F.floor(F.sqrt("size")).cast("long"),
        "digits": F.substring("hash", 1, digits) if digits else F.lit(""),
    })
    groups = written(keyed.groupBy("src", "class", "digits").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")))
    aims = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "src").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).select("src", "source_size", "target", offset.alias("offset"), rate.alias("rate"))
    begun = written(begins(groups, digits).join(aims, "src"))
    within = Window.partitionBy("src", "class", "digits").orderBy("hash", "tie")
    ranked = keyed.select("row", "size", "src", "class", "digits", F.row_number().over(within).alias("place")).join(begun, ["src", "class", "digits"]).withColumn("rank", F.col("place") + F.col("before"))
    crossed = lambda rank: F.floor(rank * F.col("rate") + F.col("offset"))
    copies = F.least(crossed(F.col("rank")) - crossed(F.col("rank") - 1), F.ceil("rate")).cast("long")
    return ranked.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """row (a struct of the columns of docs, whatever their names), size, source_size, target, copies (times that the mix takes the document).

    Null text: size 0. Null source: a source of its own, the last. Documents of size 0 may be given copies, which add no words.
    The order, and so what is taken, follows from the rows alone: reruns agree. Rows equal in all columns share what falls
    to them; they are ranked in one task. An empty table gives none.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    parts = [x for c in docs.columns for x in (F.col(f"row.`{c}`"), F.col(f"row.`{c}`").isNull())]
    hashed = F.md5(F.concat_ws("/", F.xxhash64(*parts).cast("string"), F.xxhash64(F.lit(1), *parts).cast("string")).cast("binary"))
    sized = row.select("row", F.col("row.source").cast("string").alias("source"), words(F.col("row.text").cast("string")).alias("size"), hashed.alias("hash"), F.lit(0).alias("tie"))
    return copied(sized, docs.count(), seed, weights, share, most)


def taken(docs: DataFrame) -> DataFrame:
    """The columns of docs, a row for each copy that the mix takes."""
    return mix(docs).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", words(F.col("text")).alias("size"))
    # the digest needs no text: sizes are counted once, and the order follows from the ids
    sized = written(docs).select(F.struct("doc_id").alias("row"), "source", "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("hash"), F.col("doc_id").alias("tie"))
    out = copied(sized, sized.count())
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT *, CAST(floor(sqrt(size)) AS BIGINT) AS class, coalesce('s' || source, '') AS src, md5(CAST(doc_id AS VARCHAR)) AS hash FROM sized
), sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place,
    CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM sources
), levels AS (
  SELECT *, cap / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighed
), aims AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels
), ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY class, hash, doc_id) AS r FROM keyed
), rated AS (
  SELECT doc_id, size, r, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('11/' || src), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM ranked JOIN aims ON ranked.source IS NOT DISTINCT FROM aims.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(r * rate + u) - floor((r - 1) * rate + u), ceil(rate)) AS BIGINT) AS taken FROM rated
"""
