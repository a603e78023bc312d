"""Exact inner products of queries with candidates in tiles: the ground of top-k search and of mining.

Vectors are dealt to groups by a hash, and each group is packed into blocks of bounded bytes, one matrix of whole numbers a row, in the
order of its ids: a task that runs again makes the same blocks. A grid of query groups by candidate groups joins the blocks; each tile is
a matrix product, taken for a bounded number of scores at a time. Every candidate meets every query once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import pieces
from timberline.llm.vectors import by_dimension

#: Bytes of a block's matrix at most, bytes of a group, rows of a group while there are fewer groups than SLOTS a core, scores of a tile that are made at once.
BLOCK_BYTES, GROUP_BYTES, SMALL_ROWS, SLOTS, SCORES = 8 << 20, 16 << 20, 2048, 2, 1 << 21
#: Lists merged at a time.
FAN_IN = 32
#: Scores are held to this size: whole numbers beyond it are no longs.
MOST = 2**63 - 1


def groups(rows: DataFrame, fill: bool) -> int:
    """How many groups (id, vector) rows make: by their bytes; with fill, enough to keep all cores busy."""
    total, components = rows.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(0)).cast("long")), F.lit(0))).first()
    slots = rows.sparkSession.sparkContext.defaultParallelism * SLOTS if fill else 1
    return max(1, -(-2 * components // GROUP_BYTES), min(-(-total // SMALL_ROWS), slots))


def packed(rows: DataFrame, group: str, count: int, scale: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id long, vector array, extra array<long> of one length) -> blocks (group, dim int, small boolean, ids binary, matrix binary, extra binary).

    The matrix is floor(scale * x), int16 if small, else float64; ids and extra are int64. Vectors that are null, empty or hold null or
    non-finite components are left out.
    """
    import pyarrow as pa

    dealt = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(count)).cast("int").alias("g"), "id", "vector", *extra, F.xxhash64("vector", *extra).alias("tie"))
    sorted_ = dealt.repartition("g").sortWithinPartitions("g", "id", "tie").select("g", "id", "vector", *extra)

    def run(batches):
        import numpy as np

        held: dict[int, list] = {}
        now = None

        def block(d, parts):
            columns = [np.concatenate([p[i] for p in parts]) for i in range(2 + len(extra))]
            matrix = columns.pop(1)
            small = bool(np.abs(matrix).max(initial=0) < 2**15)
            data = [columns[0].tobytes(), (matrix.astype(np.int16) if small else matrix).tobytes(), *(c.tobytes() for c in columns[1:])]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([d], pa.int32()), pa.array([small]), *(pa.array([x], pa.binary()) for x in data)], [group, "dim", "small", "ids", "matrix", *extra])

        for batch in pieces(batches):
            g = batch.column(0).to_numpy()
            for at in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1):
                if not len(at):
                    continue
                if g[at[0]] != now:
                    yield from (block(d, parts) for d, parts in held.items())
                    held, now = {}, int(g[at[0]])
                part = batch.slice(int(at[0]), len(at))
                ids = part.column(1).to_numpy().astype(np.int64)
                more = [np.stack(part.column(3 + i).to_numpy(zero_copy_only=False)).astype(np.int64) for i in range(len(extra))]
                for own, matrix in by_dimension(part.column(2)):
                    parts = held.setdefault(d := matrix.shape[1], [])
                    parts.append((ids[own], np.floor(scale * matrix), *(m[own] for m in more)))
                    if sum(len(p[0]) for p in parts) * d * 8 >= BLOCK_BYTES:
                        yield block(d, held.pop(d))
        yield from (block(d, parts) for d, parts in held.items())

    return sorted_.mapInArrow(run, ", ".join([f"{group} int, dim int, small boolean, ids binary, matrix binary", *(f"{e} binary" for e in extra)]))


def grid(candidates: DataFrame, n_candidates: int, queries: DataFrame, n_queries: int, candidate_extra: tuple[str, ...] = (), query_extra: tuple[str, ...] = ()) -> DataFrame:
    """The tiles: each block of candidates (group cg) beside each block of queries (group qg) of its dimension."""
    deal = lambda df, other, m: df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    c, q = deal(candidates, "qg", n_queries).alias("c"), deal(queries, "cg", n_candidates).alias("q")
    tiles = c.join(q.hint("shuffle_merge"), ["cg", "qg", "dim"])
    return tiles.select("cg", "dim", F.col("q.small").alias("qsmall"), F.col("q.ids").alias("qids"), F.col("q.matrix").alias("qmatrix"), F.col("c.small").alias("csmall"), F.col("c.ids").alias("cids"), F.col("c.matrix").alias("cmatrix"), *(F.col(f"c.{e}") for e in candidate_extra), *(F.col(f"q.{e}") for e in query_extra))


def products(queries, matrix) -> Iterator:
    """(first query, int64 scores) for runs of queries, SCORES at a time: exact, held to +-MOST."""
    import numpy as np

    bound = queries.shape[1] * max(1.0, float(np.abs(queries).max(initial=0))) * max(1.0, float(np.abs(matrix).max(initial=0)))
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    if kind is object:  # whole numbers of any size
        queries, matrix = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (queries, matrix))
    else:
        queries, matrix = queries.astype(kind), matrix.astype(kind)
    step = max(1, SCORES // max(1, len(matrix)))
    for at in range(0, len(queries), step):
        scores = queries[at : at + step] @ matrix.T
        yield at, np.array([[max(-MOST, min(MOST, x)) for x in r] for r in scores], np.int64).reshape(scores.shape) if kind is object else scores.astype(np.int64)


def best(scores, barred, ids, k: int):
    """(row, place) of the k best scores of each row, those barred left out; ids ascend: of equal scores the first places count."""
    import numpy as np

    n = scores.shape[1]
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if np.abs(scores).max(initial=0) < MOST // n:  # score and place in one number
        keys = np.where(barred, np.iinfo(np.int64).max, np.arange(n) - scores * n)
        at = np.argpartition(keys, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    else:
        at = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, barred), axis=1)[:, :k]
    row = np.repeat(np.arange(len(scores)), at.shape[1])
    at = at.reshape(-1)
    good = ~barred[row, at]
    return row[good], at[good]


def each_tile(batches, extra: int) -> Iterator:
    """(cg, query ids, queries, candidate ids, candidates, *extra int64 columns) of each tile, candidates by their ids ascending; the first of
    the extra columns belongs to the candidates, the others to the queries."""
    import numpy as np

    for batch in pieces(batches):
        for cg, d, qsmall, qids, q, csmall, cids, c, *more in zip(*(batch.column(i).to_pylist() for i in range(8 + extra))):
            qids, cids = np.frombuffer(qids, np.int64), np.frombuffer(cids, np.int64)
            queries, matrix = np.frombuffer(q, np.int16 if qsmall else np.float64).reshape(-1, d), np.frombuffer(c, np.int16 if csmall else np.float64).reshape(-1, d)
            more = [np.frombuffer(m, np.int64).reshape(len(qids) if i else len(cids), -1) for i, m in enumerate(more)]
            order = np.argsort(cids, kind="stable")
            yield cg, qids, queries, cids[order], matrix[order], *(m if i else m[order] for i, m in enumerate(more))


def merged(lists: DataFrame, key: str, width: int, k: int) -> DataFrame:
    """(node long, key, vec_id, score) -> (key, rank int from 1, vec_id, score): a tree merges the lists of `width` nodes to the k best of each key."""
    found = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("least"), "vec_id", "score"))), 1, k).alias("best")
    while True:
        lists = lists.groupBy(key, F.floor(F.col("node") / FAN_IN).alias("node")).agg(found)
        width = -(-width // FAN_IN)
        ranked = lists.select(key, "node", F.posexplode("best").alias("at", "b"))
        if width <= 1:
            return ranked.select(key, (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
        lists = ranked.select(key, "node", "b.vec_id", "b.score")
