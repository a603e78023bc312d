"""Hard-negative mining by distributed radix selection.

Each anchor's positives are its best rows of the same label (tiled products, merged in a tree). A positive opens a window of scores for the
negatives. For each window the tiles count the offsets of its rows from the window's upper end by their highest digit; the counts are summed,
the digit that holds the kth row is found, and the next digit is counted among the rows of that prefix, until the kth score is known to
the last digit. Only then rows are gathered: those at or above the kth score. A tile reports its digits from the best on until they
hold k rows, as the kth of all rows cannot lie beyond; of rows at the kth score it sends the k smallest ids, as no other can be wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm import tiles
from timberline.llm.common import written

#: Bits of a digit.
DIGIT = 8


def positives(candidates: DataFrame, n_candidates: int, anchors: DataFrame, n_queries: int, scale: float, k: int) -> DataFrame:
    """(uid, position from 1, positive_id, ps): the k best rows of each anchor's label."""
    import pyarrow as pa

    queries = tiles.packed(anchors, "qg", n_queries, scale, ("own", "uids"))

    def run(batches):
        import numpy as np

        for cg, qids, q, cids, c, labels, own, uids in tiles.each_tile(batches, 3):
            for at, scores in tiles.products(q, c):
                end = at + len(scores)
                barred = (labels[:, 0] != own[at:end]) | (cids == qids[at:end, None])
                row, place = tiles.best(scores, barred, cids, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), cg), pa.int64()), *map(pa.array, (uids[at + row, 0], cids[place], scores[row, place]))], ["node", "uid", "vec_id", "score"])

    lists = tiles.grid(candidates, n_candidates, queries, n_queries, ("labels",), ("own", "uids")).mapInArrow(run, "node long, uid long, vec_id long, score long")
    return tiles.merged(lists, "uid", n_candidates, k).select("uid", F.col("rank").alias("position"), F.col("vec_id").alias("positive_id"), F.col("score").alias("ps"))


def share(score: str, numerator: int, denominator: int, up: bool) -> Column:
    """floor (or ceiling) of score * numerator / denominator in whole numbers, without overflow for shares up to 1."""
    rest = F.pmod(F.col(score), F.lit(denominator).cast("long"))
    whole = F.call_function("div", F.col(score) - rest, F.lit(denominator).cast("long"))
    return F.lit(numerator) * whole + F.call_function("div", F.lit(numerator) * rest + F.lit(denominator - 1 if up else 0), F.lit(denominator).cast("long"))


def with_windows(anchors: DataFrame, states: DataFrame, most: int) -> DataFrame:
    """Anchors with the open windows of each, as (position, lo, hi, prefix, need) five longs apiece, `most` of them; the rest of them empty."""
    one = F.array(*[F.col(c).cast("long") for c in ("position", "lo", "hi", "prefix", "need")])
    own = states.groupBy("uid").agg(F.array_sort(F.collect_list(one)).alias("w"))  # at most `most`
    empty = F.array(*[F.lit(x).cast("long") for x in (-1, 1, 0, 0, 0)])
    return anchors.join(own, "uid").withColumn("windows", F.flatten(F.concat("w", F.array_repeat(empty, F.lit(most) - F.size("w"))))).drop("w")


def within(batches, take):
    """take(scores, ids, lo, hi, prefix, need) for each window of each anchor of each tile; scores are those of rows of other labels in the window, ids ascend."""
    for _, qids, q, cids, c, labels, own, uids, windows in tiles.each_tile(batches, 4):
        windows = windows.reshape(len(qids), -1, 5)
        for at, scores in tiles.products(q, c):
            for i, row in enumerate(scores, at):
                other = (labels[:, 0] != own[i]) & (row >= windows[i, :, 1].min()) & (row <= windows[i, :, 2].max()) & (cids != qids[i])
                ids, near = cids[other], row[other]
                for position, lo, hi, prefix, need in windows[i].tolist():
                    if lo <= hi and len(near):
                        inside = (near >= lo) & (near <= hi)
                        if inside.any():
                            yield int(uids[i, 0]), position, take(near[inside], ids[inside], lo, hi, prefix, need)


def batched(rows, names, kinds, size: int = 20_000):
    """Tuples as Arrow batches of bounded size."""
    import pyarrow as pa

    held = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kind) for i, kind in enumerate(kinds)], names)
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield make()
            held = []
    yield make()


def digits(grid: DataFrame, shift: int) -> DataFrame:
    """(uid, position, digit, n): how many rows of each window and prefix have each digit, as far as a tile needs to tell."""
    import pyarrow as pa

    def counted(scores, _, lo, hi, prefix, need):
        import numpy as np

        offset = hi - scores
        offset = offset[offset >> (shift + DIGIT) == prefix]
        counts = np.bincount((offset >> shift) & ((1 << DIGIT) - 1), minlength=1)
        held = np.flatnonzero(counts)
        held = held[: int(np.searchsorted(np.cumsum(counts[held]), need)) + 1]
        return zip(held.tolist(), counts[held].tolist())

    def run(batches):
        rows = ((uid, position, d, n) for uid, position, found in within(batches, counted) for d, n in found)
        return batched(rows, ["uid", "position", "digit", "n"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()])

    return grid.mapInArrow(run, "uid long, position int, digit int, n long").groupBy("uid", "position", "digit").agg(F.sum("n").alias("n"))


def refined(states: DataFrame, counts: DataFrame, first: bool) -> DataFrame:
    """The prefix that holds the kth row, one digit longer, and what it still needs. A window with fewer rows than needed takes all of them: its kth is its last row."""
    upto = F.sum("n").over(Window.partitionBy("uid", "position").orderBy("digit"))  # a row a digit
    total = F.sum("n").over(Window.partitionBy("uid", "position"))
    found = counts.withColumns({"upto": upto, "total": total}).join(states, ["uid", "position"])
    wanted = F.least("need", "total") if first else F.col("need")
    found = found.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
    need = wanted - (F.col("upto") - F.col("n"))
    return found.select("uid", "position", "positive_id", "ps", "lo", "hi", (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix"), need.cast("long").alias("need"))


def mine(rows: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, k: int = 3, least: tuple[int, int] = (50, 100), most: tuple[int, int] = (95, 100), scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank int (from 1), negative_id, positive_score, negative_score: for each anchor and each of its n_positives best
    rows of the same label the k best rows of another label whose score lies from `least` to `most` (numerator, denominator; at most 1) of the positive's.

    The score is the inner product of floor(scale * x) with the anchor's, exact; ties go to the smaller id. label is an integer. Rows with
    a null id or label, or a vector that is null, empty or holds null or non-finite components, take no part; only vectors of the same dimension
    meet. Rows that share an anchor's id are its own and no partner of it. Repeated rows of another id are partners each; repeated rows of an anchor are one anchor. A positive
    score of 0 admits negatives of score 0 alone, one below 0 none. Fewer partners than asked: all. Empty tables and tables without an anchor give none. Other columns of
    rows, whatever their names, are left out.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.array(label.cast("long")).alias("labels"), is_anchor.alias("asked")).where("id is not null and vector is not null and labels[0] is not null")
    n_candidates = tiles.groups(chosen, True)
    candidates = written(tiles.packed(chosen, "cg", n_candidates, scale, ("labels",)))
    anchors = chosen.where("asked").select("id", "vector", F.col("labels").alias("own")).distinct()
    anchors = written(anchors.withColumn("uid", F.monotonically_increasing_id())).withColumn("uids", F.array("uid"))
    n_queries = tiles.groups(anchors, False)

    states = positives(candidates, n_candidates, anchors, n_queries, scale, n_positives)
    states = written(states.select("*", share("ps", *least, True).alias("lo"), share("ps", *most, False).alias("hi"), F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need")).where("lo <= hi"))
    widest = states.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    levels = max(1, -(-widest.bit_length() // DIGIT))

    def dealt(states):
        queries = tiles.packed(with_windows(anchors, states, n_positives), "qg", n_queries, scale, ("own", "uids", "windows"))
        return tiles.grid(candidates, n_candidates, queries, n_queries, ("labels",), ("own", "uids", "windows"))

    for level in range(levels):
        counts = digits(dealt(states), DIGIT * (levels - 1 - level))
        states = written(refined(states, counts, level == 0))

    def gathered(scores, ids, lo, hi, prefix, need):
        import numpy as np

        order = np.lexsort((ids, -scores))[:k]
        return zip(ids[order].tolist(), scores[order].tolist())

    def run(batches):
        found = ((uid, position, i, s) for uid, position, part in within(batches, gathered) for i, s in part)
        return batched(found, ["uid", "position", "negative_id", "negative_score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    at_kth = dealt(states.withColumn("lo", F.col("hi") - F.col("prefix")))
    negatives = at_kth.mapInArrow(run, "uid long, position int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("uid", "position").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = negatives.withColumn("rank", rank).where(F.col("rank") <= k)
    named = ranked.join(states, ["uid", "position"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", F.col("ps").alias("positive_score"), "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 50 == 0, label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT * FROM ranked WHERE rank <= 3
"""
