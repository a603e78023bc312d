"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of a block lie vertically: word w of plane p holds bit p of 64 fingerprints. A query meets 64
stored fingerprints with one XOR per plane; carry-save counters and an overflow bit hold the 64
distances at once, and words in which all 64 exceed the radius are abandoned early.

`near_duplicates` links fingerprints within a small radius. Its candidates come by the pigeonhole rule: of r blocks of
bits, two fingerprints within distance d agree on r - d at least, so every pair within the radius meets under some
choice of r - d blocks. Nothing is approximate.

`similar` links texts by the Jaccard similarity of their word shingles (0.8 of five words). At 0.8 some 15 % of the bits
differ, too many for the pigeonhole rule. So fingerprints are four times as long (256 bits, which tell 0.8 from 0.5), the blocks
are the texts that share a key (the least hashes of the shingles under a few permutations), and texts that the bit-sliced
comparison finds within the radius are compared by their whole sets of shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import block_pairs, components, local_roots, pieces, written

BITS, SEED = 64, 42
#: Words of a text hashed at once, so that a very long text needs bounded memory.
CHUNK_WORDS = 200_000
#: Fingerprints that should share a bucket at most, on average; sets the number of blocks.
BUCKET_ROWS = 2048
#: Rows of a bucket compared within one group; larger buckets are dealt to pairs of such blocks.
BLOCK_ROWS = 16_384
#: (query, word) lanes compared at a time.
LANES = 1 << 16

#: Of `similar`: words of a shingle, least similarity as a fraction, longs of a fingerprint, and its radius. Two sets of similarity 0.8 differ in 39 of 256 bits on
#: average, with a standard deviation of 5.7: about one such pair in a million is beyond the radius.
SHINGLE, SIMILAR, LONGS, WIDE_RADIUS = 5, (4, 5), 4, 68
#: Keys of a text, and least hashes that make a key: a pair at 0.8 shares none with probability (1 - 0.8^4)^24, 3 in a million.
KEYS, MINIMA = 24, 4
#: Ways over which the pairs of one pivot are dealt; rows and shingles of a block of a pivot's contents.
SALTS, FAMILY_ROWS, FAMILY_SHINGLES = 64, 4096, 4_000_000


def shingle_hashes(words: list[bytes], shingle: int):
    """Arrays of the XXH64 of each run of `shingle` words, joined by blanks; of fewer words, of them all. In parts of CHUNK_WORDS."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        if words:
            yield np.array([digest(b" ".join(words), SEED)], np.uint64)
        return
    for at in range(0, len(words) - shingle + 1, CHUNK_WORDS):
        part = words[at : at + CHUNK_WORDS + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate([[0], ends[: len(part) - shingle]]).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def majority(parts):
    """The bits that are 1 in over half of the hashes, as bytes; all zero without any."""
    import numpy as np

    counts, total = 0, 0
    for h in parts:
        for at in range(0, len(h), CHUNK_WORDS):
            some = h[at : at + CHUNK_WORDS]
            counts = counts + np.unpackbits(np.ascontiguousarray(some).view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(some)
    return np.packbits(2 * counts > total, bitorder="little") if total else np.zeros(BITS // 8, np.uint8)


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the shingles of ASCII-lower-cased words; 0 without words."""
    return int.from_bytes(majority(shingle_hashes((text or b"").lower().split(), shingle)).tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp long (the 64 bits as a signed number); one row per row of docs. Null text: no words."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in pieces(batches):
            fps = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], [id_col, "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, fp long")


def tables(distinct: int, radius: int) -> list[tuple[int, ...]]:
    """Bit positions of each key: the fewest blocks for which a bucket holds BUCKET_ROWS on average."""
    for r in range(radius + 1, radius + 5):
        edges = [BITS * i // r for i in range(r + 1)]
        key_bits = BITS * (r - radius) // r
        if distinct >> key_bits <= BUCKET_ROWS // r or r == radius + 4:
            blocks = [tuple(range(edges[i], edges[i + 1])) for i in range(r)]
            return [sum(c, ()) for c in combinations(blocks, r - radius)]
    raise AssertionError


def bit_planes(fps):
    """(64 * longs, words) of a padded (rows, longs) array of fingerprints, 64 rows a word: plane p has bit p of each."""
    import numpy as np

    longs = fps.shape[1]
    out = np.empty((BITS * longs, len(fps) // 64), np.uint64)
    for at in range(0, out.shape[1], 512):
        part = np.ascontiguousarray(fps[at * 64 : (at + 512) * 64])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 64, 8 * longs), axis=2, bitorder="little")
        out[:, at : at + 512] = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]
    return out


def within(query, words, planes, valid, radius: int):
    """Of lanes (query fingerprint, word): bit set for each of the word's 64 fingerprints within the radius.

    Carry-save counters, as many as the radius has binary digits, and `over`, which keeps what passed them.
    """
    import numpy as np

    digits = radius.bit_length()

    def exceeded(counters, over):
        more, same = over, ~over
        for k in reversed(range(digits)):  # the counter against the radius, highest digit first
            if radius >> k & 1:
                same = same & counters[k]
            else:
                more = more | same & counters[k]
                same = same & ~counters[k]
        return more

    live = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(digits)]
    over, out = np.zeros(len(query), np.uint64), np.zeros(len(query), np.uint64)
    q, w = query, words
    for p in range(len(planes)):
        carry = planes[p][w] ^ (np.uint64(0) - (q[:, p // BITS] >> np.uint64(p % BITS) & np.uint64(1)))
        for k in range(digits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7 and p >= radius or p == len(planes) - 1:
            near = ~exceeded(counters, over) & valid[w]
            keep = near != 0
            if p == len(planes) - 1:
                out[live[keep]] = near[keep]
            elif not keep.all():
                live, q, w, over = (a[keep] for a in (live, q, w, over))
                counters = [c[keep] for c in counters]
                if not len(live):
                    break
    return out


def near_pairs(fps, group, radius: int):
    """Yields (a, b) index arrays, a < b, of the rows of one group within the radius; fps (rows, longs) sorted by group."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(fps)))
    words = (sizes + 63) // 64
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    slot = np.arange(len(fps)) - np.repeat(starts, sizes) + np.repeat(first_word * 64, sizes)
    total = int(words.sum())
    padded, row_of = np.zeros((total * 64, fps.shape[1]), np.uint64), np.full(total * 64, -1)
    padded[slot], row_of[slot] = fps, np.arange(len(fps))
    planes = bit_planes(padded)
    valid = np.packbits((row_of >= 0).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    own_word, last_word = slot // 64, np.repeat(first_word + words, sizes)
    per_row = last_word - own_word  # a row meets its own word and the later ones of its group
    upto = np.concatenate([[0], np.cumsum(per_row)])
    at = 0
    while at < len(fps):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + LANES, "right")) - 1)
        rows = np.repeat(np.arange(at, end), per_row[at:end])
        lane_words = np.arange(len(rows)) - (upto[rows] - upto[at]) + own_word[rows]
        near = within(fps[rows], lane_words, planes, valid, radius)
        hit = np.flatnonzero(near)
        for part in np.array_split(hit, len(hit) // 4096 + 1):
            lane, bit = np.nonzero(np.unpackbits(near[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = rows[part][lane], row_of[lane_words[part][lane] * 64 + bit]
            yield a[a < b], b[a < b]
        at = end


def near_roots(fps, group, radius: int):
    """Index of the smallest row linked, over any chain within its group; rows are sorted by group."""
    return local_roots(len(fps), near_pairs(fps.reshape(len(fps), -1), group, radius))


def whole_groups(batches, columns: int, keys: int):
    """int64 arrays of the rows of whole runs of equal keys (the first columns), some 16,384 rows or one larger run at a time."""
    import numpy as np

    held, rows = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(columns)], axis=1))
        rows += len(batch)
        if rows >= 16_384:  # whole groups go; the last one may go on in the next batch
            joined = np.concatenate(held)
            new = np.flatnonzero((joined[1:, :keys] != joined[:-1, :keys]).any(axis=1))
            if len(new):
                yield joined[: new[-1] + 1]
                joined = joined[new[-1] + 1 :]
            held, rows = [joined], len(joined)
    if rows:
        yield np.concatenate(held)


def group_numbers(rows, keys: int):
    import numpy as np

    return np.cumsum(np.concatenate([[False], (rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)]))


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Distinct fp long -> (a, b): edges whose components are those of all pairs within the radius."""
    import pyarrow as pa

    chosen = tables(distinct.count(), radius)

    def key(bits):
        out = F.lit(0).cast("long")
        runs = [(bits[0], bits[0])]
        for b in bits[1:]:
            runs[-1:] = [(runs[-1][0], b)] if b == runs[-1][1] + 1 else [runs[-1], (b, b)]
        for a, b in runs:
            width = b - a + 1
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return out

    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), key(bits).alias("key")) for t, bits in enumerate(chosen)])).alias("k")).select("fp", "k.t", "k.key")
    dealt = block_pairs(keyed, ["t", "key"], F.col("fp"), BLOCK_ROWS)
    grouped = dealt.repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair")

    def run(batches):
        import numpy as np

        for rows in whole_groups(batches, 4, 3):
            fps = rows[:, 3]
            root = near_roots(np.ascontiguousarray(fps).view(np.uint64), group_numbers(rows, 3), radius)
            other = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(fps[other]), pa.array(fps[root[other]])], ["a", "b"])

    return grouped.select("t", "key", "pair", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp long, component_id long: the smallest id reachable over fingerprints at most radius bits apart.

    Null and empty texts have fingerprint 0 and are linked as any other; equal rows come back as often as they
    came; a null id is kept, never chosen as component id unless all ids of the component are null. An empty table gives none.
    Copies collapse to one fingerprint before any comparison, and only fingerprints travel.
    """
    fps = written(fingerprints(docs, id_col, text_col))
    least = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = components(links(least.select("fp"), radius))
    named = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "component").select("fp", "component_id")
    return fps.join(ids, "fp")


def shingle_set(text: bytes | None):
    """Sorted distinct hashes of a text's shingles."""
    import numpy as np

    parts = list(shingle_hashes((text or b"").lower().split(), SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def spread_bits(hashes):
    """(n, LONGS) of independent bits for each hash, so that a fingerprint has 64 * LONGS."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    out = np.empty((len(hashes), LONGS), np.uint64)
    out[:, 0] = hashes
    for i in range(1, LONGS):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * (rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * (rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        out[:, i] = mixed ^ (mixed >> np.uint64(32))
    return out


def set_keys(hashes):
    """KEYS keys: each of MINIMA least hashes of the set, under as many permutations."""
    import numpy as np

    factors = np.random.default_rng(SEED + 1).integers(1 << 62, size=(KEYS * MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(KEYS * MINIMA, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096] * factors).min(axis=1), out=least)
    out = np.arange(1, KEYS + 1, dtype=np.uint64)
    for m in least.reshape(KEYS, MINIMA).T:
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + m
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def alike(a, b) -> bool:
    """Whether two sorted sets have a Jaccard similarity of SIMILAR at least."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def sketches(texts: DataFrame) -> DataFrame:
    """(r1, r2, rank, text) -> r1, r2, rank, c1, c2 (stand for the set of shingles), n (its size), fp0 .. (the fingerprint), keys."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        import xxhash

        for batch in pieces(batches):
            content, sizes, fps, keys = [], [], [], []
            for text in batch.column(3).cast(pa.binary()).to_pylist():
                s = shingle_set(text)
                content.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                sizes.append(len(s))
                fps.append(np.resize(majority(spread_bits(s[at : at + CHUNK_WORDS]) for at in range(0, len(s), CHUNK_WORDS)), 8 * LONGS).view(np.int64))
                keys.append(set_keys(s).view(np.int64) if len(s) >= SIMILAR[0] else np.empty(0, np.int64))  # smaller sets are alike if they are equal
            both, prints = np.array(content).reshape(-1, 2), np.array(fps).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int64()), *(pa.array(prints[:, i]) for i in range(LONGS)), pa.array(keys, pa.list_(pa.int64()))],
                ["r1", "r2", "rank", "c1", "c2", "n", *(f"fp{i}" for i in range(LONGS)), "keys"],
            )

    rank = texts.schema["rank"].dataType.simpleString()
    prints = ", ".join(f"fp{i} long" for i in range(LONGS))
    return texts.select("r1", "r2", "rank", "text").mapInArrow(run, f"r1 long, r2 long, rank {rank}, c1 long, c2 long, n long, {prints}, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike. texts: (node, text). The pairs of one b are dealt over SALTS ways."""
    import pyarrow as pa

    def run(batches):
        last, held = None, None
        for batch in pieces(batches):
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), *(batch.column(i).cast(pa.binary()) for i in (2, 3))):
                if b != last:
                    last, held = b, shingle_set(y.as_py())
                keep.append(alike(shingle_set(x.as_py()), held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    salted = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    hubs = pairs.select("b", F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt")).distinct().join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return salted.join(hubs, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near(a: str, b: str):
    """Sizes and fingerprints of two sketches (structs) let their sets be alike."""
    x, y = F.col(a), F.col(b)
    distance = sum((F.bit_count(x[f"fp{i}"].bitwiseXOR(y[f"fp{i}"])) for i in range(LONGS)), F.lit(0))
    return (SIMILAR[1] * F.least(x["n"], y["n"]) >= SIMILAR[0] * F.greatest(x["n"], y["n"])) & (distance <= WIDE_RADIUS)


def similar(texts: DataFrame) -> DataFrame:
    """(r1 long, r2 long, rank, text) -> contents: node, c1, c2, component, rank, r1, r2.

    r1 and r2 name a row; rows with equal names are equal. A content stands for all rows with one set of shingles and has the least
    (rank, r1, r2) of them; contents joined by any chain of sets with a Jaccard similarity of SIMILAR share a component. Texts without words,
    and nulls, have the empty set. An empty table gives none.

    Pairs are not expanded. The pivot of a key is the content that shares most keys with others, in a family of copies the one that they were
    made of. Each content meets its pivots; then the contents of one pivot that are still in different components meet each
    other, in blocks of bounded size, of which only the links that join components come out.
    """
    prints = [f"fp{i}" for i in range(LONGS)]
    rows = sketches(texts)
    each = rows.groupBy("c1", "c2").agg(F.min(F.struct("rank", "r1", "r2")).alias("least"), F.first("n").alias("n"), *(F.first(p).alias(p) for p in prints), F.first("keys").alias("keys"))
    each = written(each.withColumn("node", F.monotonically_increasing_id()), "zstd")  # written: node stays
    spread = each.select("node", F.explode("keys").alias("key"))
    live = written(spread.join(spread.groupBy("key").agg(F.count("*").alias("count")).where("count > 1"), "key"), "zstd")  # few texts share a key
    score = live.groupBy("node").agg(F.sum("count").alias("score"))
    pivots = live.join(score, "node").groupBy("key").agg(F.max(F.struct("score", F.xxhash64("node").alias("order"), "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    families = written(live.select("node", "key").join(pivots, "key").select("node", "pivot").distinct(), "zstd")
    some = live.select("node").distinct()
    sketch = written(each.join(some, "node").select("node", F.struct("n", *prints).alias("s")), "zstd")
    first = families.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    first = first.join(sketch.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sketch.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    first = written(first.where(near("x", "y")).select("a", "b"))
    # the texts of contents that share a key are fetched once
    wanted = each.join(some, "node", "left_semi").select(F.col("least.r1").alias("r1"), F.col("least.r2").alias("r2"), "node")
    held = written(texts.select("r1", "r2", "text").join(wanted, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("node", "text"), "zstd")
    links = written(verified(first, held))
    found = components(links)

    named = families.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).select("node", "pivot", "c")
    parted = named.groupBy("pivot").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("pivot")
    more = written(within_families(written(named.join(parted, "pivot").join(sketch, "node").select("pivot", "node", "c", "s.*"), "zstd"), held))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    contents = each.select("node", "c1", "c2", "least").join(found, "node", "left")
    return contents.select("node", "c1", "c2", F.coalesce("component", "node").alias("component"), "least.*")


def within_families(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(pivot, node, c, n, fp0 ..) -> (a, b): links between nodes of one pivot, as many as join its components c as all would."""
    import pyarrow as pa

    prints = [f"fp{i}" for i in range(LONGS)]
    dealt = block_pairs(members, ["pivot"], F.col("node"), FAMILY_ROWS, F.col("n"), FAMILY_SHINGLES)
    grouped = dealt.join(texts, "node").repartition("pivot", "pair").sortWithinPartitions("pivot", "pair", "node").select("pivot", "pair", "node", "c", *prints, "text")

    def run(batches):
        import numpy as np

        name, rows, sets = None, [], []
        for batch in pieces(batches):
            numbers = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4 + LONGS)], axis=1)
            for row, text in zip(numbers, batch.column(4 + LONGS).cast(pa.binary())):
                if name is not None and tuple(row[:2]) != name:
                    yield joined(rows, sets)
                    rows, sets = [], []
                name = tuple(row[:2])
                rows.append(row)
                sets.append(shingle_set(text.as_py()))
        if rows:
            yield joined(rows, sets)

    def joined(rows, sets):
        import numpy as np

        found = np.array(family_links(np.array(rows), sets), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return grouped.mapInArrow(run, "a long, b long").distinct()


def family_links(rows, sets) -> list[tuple[int, int]]:
    """rows: (pivot, pair, node, c, fingerprint); sets: their shingles. Pairs of nodes whose sets are alike, that join different c.

    Where P is what most of the sets hold, two sets share at most the lesser of their parts of P, and what they share outside of P.
    """
    import numpy as np

    node, sizes = rows[:, 2], np.array(list(map(len, sets)))
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    most, again = every[2 * counts > len(sets)], every[counts > 1]
    common = np.array([len(np.intersect1d(s, most, assume_unique=True)) for s in sets])
    bit = lambda s: np.bitwise_or.reduce(np.uint64(1) << (s >> np.uint64(58)), initial=np.uint64(0))
    outside = np.array([bit(np.setdiff1d(np.intersect1d(s, again, assume_unique=True), most, assume_unique=True)) for s in sets], np.uint64)
    root = np.unique(rows[:, 3], return_inverse=True)[1]
    out = []
    for a, b in near_pairs(np.ascontiguousarray(rows[:, 4:]).view(np.uint64), np.zeros(len(rows), np.int64), WIDE_RADIUS):
        needed = -(-SIMILAR[0] * (sizes[a] + sizes[b]) // sum(SIMILAR))  # common shingles
        inside = np.minimum(common[a], common[b])
        can = np.where(outside[a] & outside[b] != 0, inside + np.minimum(sizes[a] - common[a], sizes[b] - common[b]), inside) >= needed
        good = can & (root[a] != root[b]) & (np.minimum(sizes[a], sizes[b]) >= needed)
        for i, j in zip(a[good].tolist(), b[good].tolist()):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                out.append((int(node[i]), int(node[j])))
                root[root == root[j]] = root[i]
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near duplicates (see `similar`) the row with the smallest id; all columns, whatever their names.

    Rows are judged, not ids: a null id comes after all others, and rows of one id with different texts stay once for each
    group. Of rows that are equal in all columns one stays. Texts without words, and nulls, are one group.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    parts = [x for c in docs.columns for x in (F.col(f"row.`{c}`"), F.col(f"row.`{c}`").isNull())]
    named = row.withColumns({"r1": F.xxhash64(F.lit(1), *parts), "r2": F.xxhash64(F.lit(2), *parts)})
    own = F.col(f"row.`{id_col}`")
    contents = similar(named.select("r1", "r2", F.struct(own.isNull().alias("none"), own.alias("id")).alias("rank"), F.col(f"row.`{text_col}`").cast("string").alias("text")))
    stay = written(contents.groupBy("component").agg(F.min(F.struct("rank", "r1", "r2")).alias("m")).select("m.r1", "m.r2"))
    return named.join(stay, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
