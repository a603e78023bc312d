"""Embedding near-dedup by sorted projection passes.

In each pass the vectors of a label are ordered by the concatenated signs of random projections, and each is
compared with the WINDOW vectors after it. The number of passes follows from the size of the label, so that a pair
at the least similarity is met with probability RECALL, and from how evenly signs part it (where vectors share a direction, they
don't halve it); one pass meets all pairs of a label that fits the window. A pair is counted in the first pass that meets it (the places in all passes
travel with the vector), and a block gives its components as edges to one member: pairs are never emitted.
In a label of several passes the signs of the first FEWEST_PASSES passes, some bytes a vector, go through each pass ahead of the vectors: only
vectors with a neighbour within the window whose signs let it be a link take part in that pass as a whole.
Vectors whose window is full of links are compared with all such vectors of their label, in pairs of blocks,
so that groups larger than the window lose nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import components, local_roots, pieces, written
from timberline.llm.vectors import by_dimension

LEAST, WINDOW, BLOCK_ROWS, DENSE_BLOCK, BITS, RECALL, SEED = 0.93, 1024, 4096, 4096, 48, 0.999, 3
#: Of a label that is larger than the window. Signs by which its evenness is measured, over all its vectors.
FEWEST_PASSES, PROBES = 4, 16


def passes(size: Column, alike: Column, least: float = LEAST) -> Column:
    """With n vectors, of which two have a sign in common with probability `alike`, a window is reached by those that share the first
    log(n / window) / -log(alike) signs; a pair at the least similarity shares a sign with probability 1 - angle / pi."""
    signs = F.log(size / WINDOW) / -F.log(F.least(alike, F.lit(0.95)))
    shared = F.pow(F.lit(1 - math.acos(least) / math.pi), signs)
    needed = F.ceil(F.lit(math.log(1 - RECALL)) / F.log(1 - shared))
    return F.when(size <= WINDOW + 1, 1).otherwise(F.greatest(F.lit(FEWEST_PASSES), needed)).cast("int")


def farthest(least: float) -> int:
    """Signs of FEWEST_PASSES passes in which a pair at `least` differs at most: seven standard deviations above the mean."""
    bits, part = FEWEST_PASSES * BITS, math.acos(least) / math.pi
    return math.ceil(bits * part + 7 * math.sqrt(bits * part * (1 - part)))


def near_duplicates(rows: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row.

    Only vectors of one label (not null) and one dimension are compared; vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Equal vectors collapse to one first: their links are counted from the number
    of copies. Rows that share an id and a vector are copies like any others. An empty table gives none.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    every = every.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    distinct = written(every.where(usable).groupBy("label", "h1", "h2", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()))
    label_type = distinct.schema["label"].dataType.simpleString()

    def probe(batches):
        import numpy as np

        for batch in pieces(batches):
            bits = np.zeros(len(batch), np.int32)
            for at, matrix in by_dimension(batch.column(1)):
                planes = np.random.default_rng([SEED, PROBES, matrix.shape[1]]).standard_normal((matrix.shape[1], PROBES))
                bits[at] = (matrix / np.abs(matrix).max(axis=1, keepdims=True) @ planes > 0) @ (1 << np.arange(PROBES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int32())], ["label", "bits"])

    shares = [F.avg(F.shiftright("bits", i).bitwiseAND(1)) for i in range(PROBES)]
    alike = sum((p * p + (1 - p) * (1 - p) for p in shares), F.lit(0.0)) / PROBES
    sizes = distinct.select("label", "v").mapInArrow(probe, f"label {label_type}, bits int").groupBy("label").agg(F.count("*").alias("n"), alike.alias("alike"))
    turns = written(sizes.select("label", passes(F.col("n"), F.col("alike"), least).alias("turns")))  # a row a label
    rounds = turns.agg(F.max("turns")).first()[0] or 1

    def keys(batches):
        import numpy as np

        planes: dict[int, object] = {}
        for batch in pieces(batches):
            out = np.zeros((len(batch), rounds), np.int64)
            for at, matrix in by_dimension(batch.column(1)):
                d = matrix.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, rounds * BITS))
                signs = (matrix / np.abs(matrix).max(axis=1, keepdims=True) @ planes[d] > 0).reshape(len(at), rounds, BITS)
                out[at] = signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            offsets = np.arange(0, out.size + 1, rounds, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1))), batch.column(2), batch.column(3)], ["uid", "keys", "label", "dim"])

    hashed = distinct.select("uid", "v", "label", F.size("v").alias("dim")).mapInArrow(keys, f"uid long, keys array<long>, label {label_type}, dim int")
    # places in each pass: one range sort of all passes; a row's number within its partition plus the partitions before
    signs = [f"s{i}" for i in range(FEWEST_PASSES)]
    ordered = hashed.join(turns, "label").select("uid", "label", "dim", "turns", *(F.when(F.col("turns") > 1, F.get("keys", F.lit(i))).alias(s) for i, s in enumerate(signs)), F.posexplode(F.slice("keys", F.lit(1), F.col("turns"))).alias("pass", "key")).repartitionByRange("pass", "label", "dim", "key", "uid").sortWithinPartitions("pass", "label", "dim", "key", "uid")
    numbered = written(ordered.select("uid", "pass", "turns", *signs, F.monotonically_increasing_id().alias("n")))
    begins, total = {}, 0
    for part, count in sorted(map(tuple, numbered.groupBy(F.shiftright("n", 33).alias("part")).count().collect())):  # a row for each partition
        begins[part], total = total, total + count
    begin = F.create_map(*[F.lit(x) for pair in begins.items() for x in pair]) if begins else F.create_map(F.lit(0), F.lit(0))
    placed = numbered.select("uid", "pass", "turns", *signs, (F.element_at(begin, F.shiftright("n", 33).cast("int")) + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    met = lambda pa_, pb: (abs(pa_ - pb) <= WINDOW)

    def linked(uid, label, matrix, copies, place, owned, turn):
        """Links and roots of one group. turn: the pass, by whose places rows are sorted; or None, all with all."""
        import numpy as np

        unit = matrix / np.abs(matrix).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        n, links, fullness, pairs = len(uid), np.zeros(len(uid), np.int64), np.zeros(len(uid), np.int64), []
        for at in range(0, n, 256):
            end = min(n, at + 256)
            upto = n if turn is None else min(n, end + WINDOW)
            i, j = np.nonzero(unit[at:end] @ unit[at:upto].T >= least)
            i, j = i + at, j + at
            good = (j > i) & (label[i] == label[j]) & (owned(i, j))
            if turn is not None:
                good &= place[j, turn] - place[i, turn] <= WINDOW
            i, j = i[good], j[good]
            for p in range(rounds if turn is None else turn):
                new = ~met(place[i, p], place[j, p])
                if turn is not None:
                    np.add.at(fullness, np.concatenate([i[~new], j[~new]]), 1)
                i, j = i[new], j[new]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            np.add.at(fullness, np.concatenate([i, j]), 1)
            pairs.append((i, j))
        return links, fullness >= WINDOW // 4, local_roots(n, pairs)

    def groups(batches, keys_):
        """Columns of the rows of each run of equal keys (the first keys_ columns)."""
        held, name = [], None
        for batch in batches:
            values = list(zip(*(batch.column(i).to_pylist() for i in range(keys_))))
            cuts = [i for i in range(1, len(values)) if values[i] != values[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(values)]):
                if held and values[a] != name:
                    yield name, pa.Table.from_batches(held).combine_chunks()
                    held = []
                name = values[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield name, pa.Table.from_batches(held).combine_chunks()

    def in_blocks(rows):
        """Rows with their block of places; those that the block before can reach, with that one too."""
        block = F.floor(F.col("place") / BLOCK_ROWS)
        again = (F.col("place") % BLOCK_ROWS < WINDOW) & (block > 0)
        return rows.withColumn("block", F.explode(F.when(again, F.array(block - 1, block)).otherwise(F.array(block)))).repartition("pass", "block").sortWithinPartitions("pass", "block", "place")

    def near_by_signs(batches):
        import numpy as np

        for (turn, _), table in groups(batches, 2):
            uid, place = (table.column(c).to_numpy() for c in ("uid", "place"))
            own = np.stack([table.column(s).to_numpy() for s in signs])
            near = np.zeros(len(uid), bool)
            for at in range(0, len(uid), 256):
                end, upto = min(len(uid), at + 256), min(len(uid), at + 256 + WINDOW)
                differ = sum(np.bitwise_count(k[at:end, None] ^ k[None, at:upto]) for k in own)
                i, j = np.nonzero(differ <= radius)
                good = (j > i) & (place[j + at] - place[i + at] <= WINDOW)
                near[i[good] + at] = near[j[good] + at] = True
            yield pa.RecordBatch.from_arrays([pa.array(uid[near]), pa.array(np.full(near.sum(), turn, np.int32))], ["uid", "pass"])

    radius = farthest(least)
    near = in_blocks(placed.where("turns > 1").drop("turns")).select("pass", "block", "uid", "place", *signs).mapInArrow(near_by_signs, "uid long, pass int")
    near = near.groupBy("uid").agg(F.collect_set("pass").alias("near"))
    places = placed.groupBy("uid").agg(F.max("turns").alias("turns"), F.transform(F.array_sort(F.collect_list(F.struct("pass", "place"))), lambda x: x["place"]).alias("places"))
    places = places.join(near, "uid", "left").where("turns = 1 or near is not null")
    ready = written(distinct.select("uid", "label", "v", "copies").join(places, "uid"))

    def matrices(table, names):
        import numpy as np

        column = lambda c: table.column(c).combine_chunks()
        vectors = column("v")
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        labels = np.unique(np.array([str(x) for x in table.column("label").to_pylist()]), return_inverse=True)[1]
        uid, copies = (table.column(c).to_numpy() for c in ("uid", "copies"))
        # a label of fewer passes has places in these alone; in the others its vectors lie apart
        place = np.repeat(-(np.arange(len(uid), dtype=np.int64) + 1)[:, None] * (2 * WINDOW + 2), rounds, axis=1)
        for i, own in enumerate(table.column("places").to_pylist()):
            place[i, : len(own)] = own
        extra = [table.column(c).to_numpy() for c in names]
        for at, matrix in by_dimension(vectors):
            yield uid[at], labels[at], matrix, copies[at], place[at], [e[at] for e in extra]

    def result(uid, links, dense, root):
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(links), pa.array(dense), pa.array(uid[root])], ["uid", "links", "dense", "root"])

    def window_pass(batches):
        for (turn, block), table in groups(batches, 2):
            for uid, label, matrix, copies, place, _ in matrices(table, ()):
                low = block * BLOCK_ROWS
                yield result(uid, *linked(uid, label, matrix, copies, place, lambda i, j: place[i, turn] < low + BLOCK_ROWS, turn))

    taking_part = ready.select("*", F.posexplode("places").alias("pass", "place")).where((F.col("turns") == 1) | F.array_contains("near", F.col("pass")))
    dealt = in_blocks(taking_part).select("pass", "block", "uid", "label", "v", "copies", "places")
    out = "uid long, links long, dense boolean, root long"
    first = written(dealt.mapInArrow(window_pass, out))

    def dense_pass(batches):
        import numpy as np

        for (_, _, _), table in groups(batches, 3):
            for uid, label, matrix, copies, place, (block, pair, k) in matrices(table, ("block", "pair", "k")):
                # a pair of rows of one block meets in each of the block's pairs, and counts in that of the block with itself
                own = pair == block.astype(np.int64) * k + block + 1
                yield result(uid, *linked(uid, label, matrix, copies, place, lambda i, j: (block[i] != block[j]) | own[i] | (pair[i] == 0), None))

    dense = ready.join(first.where("dense").select("uid").distinct(), "uid")
    sizes = dense.groupBy("label").count().withColumn("k", F.ceil(F.col("count") / DENSE_BLOCK).cast("long")).drop("count")
    met_again = dense.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("k")))
    met_again = met_again.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda t: F.least("block", t) * F.col("k") + F.greatest("block", t) + 1)))
    met_again = met_again.repartition("label", "pair").sortWithinPartitions("label", "pair").select("label", "pair", "k", "uid", "v", "copies", "places", "block")
    second = written(met_again.mapInArrow(dense_pass, out))

    found = first.unionByName(second)
    graph = components(found.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    named = distinct.select("label", "h1", "h2", "uid", "least", "copies").join(links, "uid", "left").join(graph.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # vectors that aren't usable have no row in `named`
    joined = every.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: All pairs of a label. The operator meets every pair as long as no label has more than WINDOW vectors, and nearly all beyond.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.93
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), smallest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN smallest ON vec_id = smallest.a LEFT JOIN counts ON vec_id = counts.a
"""
