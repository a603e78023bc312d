"""Vector code compression: every part of a vector becomes the index of the nearest entry of its position's codebook.

Components become whole numbers, so equal parts of a position collapse to one row with a weight. Lloyd's rounds run over these distinct
rows alone: a task assigns its rows and sums them, by weight, for each entry; the sums of a round, some numbers an entry, give the next codebooks.
The last assignment is joined back to the vectors by part.

Whole numbers are exact at any size: sums travel in limbs of 32 bits, and parts with components of 2^31 or more are reckoned in Python's integers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import BROADCAST_ROWS, pieces, read_table, written
from timberline.llm.vectors import by_dimension

#: Parts of a vector, entries of a codebook, rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: A key with more than one of this many rows is joined by broadcast: there are fewer such keys than that.
SHARE = 2000
#: Bits of a limb.
LIMB = 32
#: Errors are held to this: whole numbers beyond it are no longs.
MOST = 2**63 - 1


def keys(vectors, parts: int, scale: float):
    """(row, dimension, keys by part) of a list column. A key is the bytes of a part's whole numbers, int16, int32 or float64 by what they need.
    Vectors that can't be cut into equal parts, or hold null or non-finite components, are left out."""
    import numpy as np

    for at, matrix in by_dimension(vectors):
        d = matrix.shape[1]
        if d % parts:
            continue
        with np.errstate(over="ignore"):
            whole = np.floor(scale * matrix)
        good = np.isfinite(whole).all(axis=1)
        at, whole = at[good], whole[good].reshape(good.sum(), parts, d // parts)
        top = np.abs(whole).max(axis=2, initial=0)
        data = [whole.astype(t) if t is not np.float64 else whole for t in (np.int16, np.int32, np.float64)] if (top < 2**31).all() else [np.clip(whole, -(2**15), 2**15 - 1).astype(np.int16), np.clip(whole, -(2**31), 2**31 - 1).astype(np.int32), whole]
        kind = np.where(top < 2**15, 0, np.where(top < 2**31, 1, 2)).tolist()
        for i, row in enumerate(at.tolist()):
            yield row, d, [data[k][i, p].tobytes() for p, k in enumerate(kind[i])]


def numbers(column, width: int):
    """The whole numbers of a column of keys of parts of `width` components: int64 where squares of differences fit, else Python's."""
    import numpy as np

    kinds = {2 * width: np.int16, 4 * width: np.int32, 8 * width: np.float64}
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0, np.int32)
    if len(sizes) and (sizes == sizes[0]).all() and kinds[int(sizes[0])] is not np.float64:  # all of one kind: read in one piece
        begin = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
        return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + int(sizes.sum())].view(kinds[int(sizes[0])]).reshape(len(column), width).astype(np.int64)
    rows = [np.frombuffer(k, kinds[len(k)]) for k in column.to_pylist()]
    if (sizes == 8 * width).any():
        return np.array([[int(x) for x in r] for r in rows], object).reshape(len(rows), width)
    return np.stack(rows).astype(np.int64) if rows else np.empty((0, width), np.int64)


def nearest(values, book):
    """(index, squared distance) of the nearest entry, ties to the lower index. Exact."""
    import numpy as np

    book = np.array(book, object).reshape(len(book), values.shape[1])
    top = max([abs(x) for x in book.reshape(-1)], default=0)
    if values.dtype == np.int64 and top < 2**31:
        if values.shape[1] * (2 * max(top, int(np.abs(values).max(initial=0)))) ** 2 < 2**53:  # in doubles by the binomial formula, exact
            v, b = values.astype(np.float64), book.astype(np.float64)
            distances = (v * v).sum(axis=1)[:, None] - 2 * (v @ b.T) + (b * b).sum(axis=1)
            return distances.argmin(axis=1), distances.min(axis=1).astype(np.int64)
        if values.shape[1] * (top + int(np.abs(values).max(initial=0))) ** 2 < 2**63:
            distances = ((values[:, None, :] - book.astype(np.int64)[None]) ** 2).sum(axis=2)
            return distances.argmin(axis=1), distances.min(axis=1)
    distances = ((values.astype(object)[:, None, :] - book[None]) ** 2).sum(axis=2)
    at = np.array([min(range(len(book)), key=lambda j: (d[j], j)) for d in distances], np.int64)
    return at, np.array([min(int(d[j]), MOST) for d, j in zip(distances, at)], np.int64)


def limbs(x: int):
    """(limb, signed part) of a whole number of any size."""
    sign, x, i = (-1 if x < 0 else 1), abs(x), 0
    while x:
        yield i, sign * (x & ((1 << LIMB) - 1))
        x, i = x >> LIMB, i + 1


def by_position(batches):
    """(dimension, position, keys, other columns) of runs of rows with columns dim, position, key, ..."""
    import numpy as np
    import pyarrow as pa

    for batch in pieces(batches):
        dim, position = (batch.column(i).to_numpy() for i in range(2))
        name = dim.astype(np.int64) << 32 | position
        for n in np.unique(name):
            at = np.flatnonzero(name == n)
            part = batch.take(at)
            yield int(n >> 32), int(n & 0xFFFFFFFF), part.column(2).cast(pa.binary()), [part.column(i) for i in range(3, part.num_columns)]


def sums(distinct: DataFrame, books: dict) -> DataFrame:
    """(dim, position, entry, place, limb, value): the sum of each component of each entry's rows, by weight; place -1: how many."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        total: dict[tuple, list] = {}
        for d, position, keys_, (weights,) in by_position(batches):
            values, weights = numbers(keys_, d // len(books[d])), weights.to_numpy()
            at, _ = nearest(values, books[d][position])
            for e in np.unique(at).tolist():
                own, w = values[at == e], weights[at == e]
                exact = own.dtype == np.int64 and int(np.abs(own).max(initial=0)) * int(w.sum()) < 2**62
                added = (own * w[:, None]).sum(axis=0).tolist() if exact else [sum(int(x) * int(y) for x, y in zip(c, w)) for c in own.T]
                held = total.setdefault((d, position, e), [0] * (1 + len(added)))
                total[d, position, e] = [a + int(b) for a, b in zip(held, [int(w.sum()), *added])]
        rows = [(*name, i - 1, limb, part) for name, numbers_ in total.items() for i, x in enumerate(numbers_) for limb, part in limbs(x)]
        kinds = [pa.int32()] * 5 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["dim", "position", "entry", "place", "limb", "value"])

    made = distinct.select("dim", "position", "key", "weight").mapInArrow(run, "dim int, position int, entry int, place int, limb int, value long")
    return made.groupBy("dim", "position", "entry", "place", "limb").agg(F.sum("value").alias("value"))


def joined(rows: DataFrame, found: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows with the columns of found (a row a key, with how many of rows have it) joined by `on`. Keys of many rows, few in number, are
    broadcast; the rest is shuffled. Null keys must not occur."""
    total = found.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    large = F.col(weight) * SHARE > total  # fewer than SHARE keys
    heavy = found.where(large).drop(weight)
    names = [c for c in heavy.columns if c not in on]
    first = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), on, "left")
    done, rest = first.where("_heavy").drop("_heavy"), first.where("_heavy is null").drop("_heavy", *names)
    return done.unionByName(rest.join(found.where(~large).drop(weight).hint("shuffle_merge"), on))


def seeds(parted: DataFrame, parts: int, entries: int) -> dict[int, list[list[list[int]]]]:
    """By dimension: for each position that part of the vectors with the `entries` smallest ids, ascending. One vector an id, that of the least keys; null ids give none."""
    import pyarrow as pa

    books = {}
    for (d,) in parted.select("dim").distinct().collect():
        first = parted.where((F.col("dim") == d) & F.col("id").isNotNull()).groupBy("id").agg(F.min("keys").alias("keys")).orderBy("id").limit(entries).collect()
        books[d] = [[[int(x) for x in numbers(pa.array([bytes(r["keys"][p])], pa.binary()), d // parts)[0]] for r in first] for p in range(parts)]
    return books


def moved(books: dict, distinct: DataFrame) -> dict:
    """The codebooks after one round: each entry the floor of its rows' mean; unused entries stay."""
    total: dict[tuple, int] = {}
    for d, position, entry, place, limb, value in sums(distinct, books).collect():  # some numbers an entry
        name = (d, position, entry, place)
        total[name] = total.get(name, 0) + (value << LIMB * limb)
    return {d: [[[total.get((d, p, e, i), 0) // total[d, p, e, -1] for i in range(len(old))] if (d, p, e, -1) in total else old for e, old in enumerate(book)] for p, book in enumerate(own)] for d, own in books.items()}


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """vec_id long, code string, error long, label_error long, codebooks_sha256 string, then codes array<int>: one row per row that is kept.

    Components become floor(scale * x). Codebooks begin with the parts of the vectors of the smallest ids (fewer vectors: fewer entries). code:
    two hexadecimal digits a part; error: the squared distances to the entries, summed over parts; label_error: error over equal labels,
    nulls together; codebooks_sha256: of all final entries. Vectors of each dimension are compressed by themselves. Left out are rows whose vector is null, empty, holds null or non-finite components (scaled ones
    too), or can't be cut into equal parts, and all vectors of a dimension none of which has an id. Repeated rows count as often and come back as often; a null id seeds no
    codebook. An empty table gives none. Other columns of rows, whatever their names, are left out.
    """
    import pyarrow as pa

    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where("vector is not null")
    label_type = chosen.schema["label"].dataType.simpleString()

    def cut(batches):
        import numpy as np

        for batch in pieces(batches):
            found = list(keys(batch.column(2), parts, scale))
            at = pa.array(np.array([r for r, _, _ in found], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([d for _, d, _ in found], pa.int32()), pa.array([k for _, _, k in found], pa.list_(pa.binary()))], ["id", "label", "dim", "keys"])

    parted = chosen.select("id", "label", "vector").mapInArrow(cut, f"id long, label {label_type}, dim int, keys array<binary>")
    parted = written(parted.withColumn("uid", F.monotonically_increasing_id()))
    spread = parted.select("uid", "dim", F.posexplode("keys").alias("position", "key"))
    distinct = written(spread.groupBy("dim", "position", "key").agg(F.count("*").alias("weight")))

    books = {d: own for d, own in seeds(parted, parts, entries).items() if own[0]}
    distinct = distinct.where(F.col("dim").isin(list(books)))
    for _ in range(rounds if books else 0):
        books = moved(books, distinct)
    digests = {d: hashlib.sha256(",".join(str(x) for book in own for entry in book for x in entry).encode()).hexdigest() for d, own in books.items()}

    def assigned(batches):
        for d, position, keys_, (weights,) in by_position(batches):
            at, error = nearest(numbers(keys_, d // parts), books[d][position])
            n = len(keys_)
            yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int32()), pa.array([position] * n, pa.int32()), keys_, weights, pa.array(at, pa.int32()), pa.array(error, pa.int64())], ["dim", "position", "key", "weight", "entry", "off"])

    final = written(distinct.select("dim", "position", "key", "weight").mapInArrow(assigned, "dim int, position int, key binary, weight long, entry int, off long"))
    held = lambda c: F.least(c, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    off = F.sum(F.col("off").cast("decimal(20,0)"))
    back = joined(spread, final, ["dim", "position", "key"], "weight").groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"]).alias("codes"), held(off).alias("error"))  # `parts` rows each
    coded = written(parted.select("uid", "id", "label", "dim").join(back, "uid").withColumns({"no_label": F.col("label").isNull(), "h": F.xxhash64("label")}).drop("uid"))
    # labels meet by their hash and then by themselves, as equal labels of any type
    by_label = written(coded.groupBy("no_label", "h", "label").agg(held(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count("*").alias("n")))
    told = joined(coded, by_label.where("not no_label").drop("no_label", "h"), ["label"], "n") if by_label.count() > BROADCAST_ROWS else coded.join(F.broadcast(by_label.where("not no_label").drop("no_label", "h", "n")), "label")
    nameless = by_label.where("no_label").select("label_error").first()
    told = told.unionByName(coded.where("no_label").withColumn("label_error", F.lit(nameless[0] if nameless else None).cast("long")))
    digest = F.element_at(F.create_map(*[F.lit(x) for pair in digests.items() for x in pair]), F.col("dim")) if digests else F.lit("")
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return told.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"), "codes")


def query(spark, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])).drop("codes")


def oracle(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """The rounds written out one by one."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (SELECT vec_id, i AS part, e[i * (len(e) // {parts}) + 1 : (i + 1) * (len(e) // {parts})] AS e FROM v, range({parts}) t(i)
), b0 AS MATERIALIZED (SELECT part, entry, e FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) USING (vec_id) WHERE entry < {entries})"""]
    nearest_ = "SELECT p.vec_id, p.part, min({{d: list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.e, b.e)]), entry: b.entry}}) AS m FROM p JOIN b{0} b USING (part) GROUP BY ALL"
    for r in range(rounds):
        steps.append(f""", a{r} AS MATERIALIZED ({nearest_.format(r)}
), s{r} AS (SELECT part, m.entry AS entry, i, CAST(floor(CAST(sum(p.e[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x, FROM a{r} JOIN p USING (vec_id, part), generate_series(1, len(p.e)) t(i) GROUP BY ALL
), n{r} AS (SELECT part, entry, list(x ORDER BY i) AS e FROM s{r} GROUP BY ALL
), b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN n{r} USING (part, entry))""")
    steps.append(f""", a AS MATERIALIZED ({nearest_.format(rounds)}
), c AS (SELECT vec_id, string_agg(format('{{:02x}}', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a GROUP BY ALL
), h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h""")
    return "".join(steps)


ORACLE = oracle()
