"""Substring dedup by compressed FM-indexes.

A window is `length` consecutive words. Each window has an anchor, the run of ANCHOR words in it with the least
hash (the first of equals); equal windows have equal anchors. Consecutive windows with the same anchor place form
a segment. Segments whose anchor occurs once in the corpus hold no repeated window and go no further; the others
meet in shards by anchor, so that every occurrence of a window is in one shard, in exactly one segment.

A shard is indexed as an FM-index: suffix order, Burrows-Wheeler transform, and a wavelet matrix over its words
with packed bits and rank blocks. The shard's segments stream against it: backward search finds for each end the
longest match that occurs twice (matching statistics), all segments in step, and reports the intervals that reach
`length`. Segments with the same words collapse first, with the number of occurrences as their weight; only one
body of each travels, and its intervals are joined back to its places. Of documents with the same words one is cut.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import in_pairs, pieces, written

LENGTH, ANCHOR = 35, 12
#: Different segments of one anchor held together at most; larger groups are dealt to pairs of blocks.
BLOCK_SEGMENTS = 8_192
#: Anchors with more than a HOTth of the rows are dealt with apart.
HOT = 1000
#: Words of segments that make a shard complete (at the next change of anchor).
SHARD_WORDS = 400_000
MIX = 0x9E3779B97F4A7C15


def word_hashes(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(hashes, length: int, anchor: int):
    """(anchor hash, first window, windows, content hash) of each segment of a document with `length` words or more."""
    import numpy as np

    runs = np.zeros(len(hashes) - anchor + 1, np.uint64)
    for i in range(anchor):
        runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(MIX) + hashes[i : len(hashes) - anchor + 1 + i]
    runs ^= runs >> np.uint64(32)
    runs *= np.uint64(0xD6E8FEB86659FD93)
    runs ^= runs >> np.uint64(32)
    span = length - anchor + 1  # runs of a window
    best, place, width = runs, np.arange(len(runs)), 1
    while width < span:  # the least of 2, 4, ... runs, then of all, the first of equals
        shift = min(width, span - width)
        left, right = best[:-shift], best[shift:]
        later = right < left
        best, place = np.where(later, right, left), np.where(later, place[shift:], place[:-shift])
        width += shift
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    windows = np.diff(np.append(starts, len(place)))
    ends = starts + windows + length - 1
    # sums of hash * MIX^i, modulo 2^64; MIX is odd, so a difference of sums is moved to the same power by its inverse
    powers = np.cumprod(np.full(len(hashes), MIX, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
    inverse = np.cumprod(np.full(len(hashes), pow(MIX, -1, 1 << 64), np.uint64))
    content = (sums[ends] - sums[starts]) * inverse[starts]
    return best[starts], starts, windows, content ^ (content >> np.uint64(31))


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits):
        import numpy as np

        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at):
        import numpy as np

        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """Over words with ids from 1; 0 ends each of the joined segments."""

    def __init__(self, ids, ends):
        """ids: the segments' ids, each segment followed by a 0; ends: the places of these."""
        import numpy as np

        n = len(ids)
        rank = ids.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # each end is a symbol of its own: suffixes differ before they pass one
        step = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            sorted_key = key[order]
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank, step = new, step * 2
            if rank.max() == n - 1:
                break
        last = ids[order - 1]
        counts = np.bincount(ids, minlength=int(ids.max()) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels, self.zeros, symbols = [], [], last
        begin = np.zeros(len(counts), np.int64)
        every = np.arange(len(counts))
        for level in reversed(range(max(1, int(ids.max()).bit_length()))):
            bits = (symbols >> level & 1).astype(np.uint8)
            level_bits = Bits(bits)
            zeros = n - int(bits.sum())
            self.levels.append((level, level_bits))
            self.zeros.append(zeros)
            ones = level_bits.ones(begin)
            begin = np.where(every >> level & 1, zeros + ones, begin - ones)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.begin = begin

    def extend(self, symbols, low, high):
        """The suffix intervals of symbol + match, from those of the matches."""
        import numpy as np

        at = np.concatenate([low, high])
        both = np.concatenate([symbols, symbols])
        for (level, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.ones(at)
            at = np.where(both >> level & 1, zeros + ones, at - ones)
        at = at - self.begin[both] + self.first[both]
        return at[: len(low)], at[len(low) :]


def repeats(index: FmIndex, ids, starts, stops, asked, length: int):
    """(segment, from, to) of the places in the joined words where matches that occur twice reach `length`.

    For each end, from the segment's last, the match is extended to the left as long as it occurs twice. Where that
    fails at a place, no window that holds both that place and the end is repeated, which gives the next end.
    """
    import numpy as np

    out = []
    seg = np.asarray(asked)
    first, end = starts[seg], stops[seg].copy()
    at, low, high = end.copy(), np.zeros(len(seg), np.int64), np.full(len(seg), len(ids), np.int64)
    while len(seg):
        low2, high2 = index.extend(ids[at - 1], low, high)
        twice = high2 - low2 >= 2
        at = np.where(twice, at - 1, at)
        low, high = np.where(twice, low2, 0), np.where(twice, high2, len(ids))
        stop = ~twice | (at == first)
        hit = stop & (end - at >= length)
        if hit.any():
            out.append(np.column_stack([seg[hit], at[hit], end[hit]]))
        next_end = np.where(stop, np.minimum(end - 1, at - 1 + length), end)
        at = np.where(stop, next_end, at)
        low, high = np.where(stop, 0, low), np.where(stop, len(ids), high)
        # a match as far as the segment's start leaves nothing to ask, nor does a rest shorter than a window
        live = ~stop | (~twice & (next_end - first >= length))
        end = next_end
        seg, first, end, at, low, high = (x[live] for x in (seg, first, end, at, low, high))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def shard_repeats(bodies: list[bytes], totals: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Of each of the different bodies: the (from, to) word intervals covered by windows that occur twice or more.

    totals: occurrences of each body as a whole; a body that has two needs no search, but others are matched with it.
    """
    import numpy as np

    arrays = [np.frombuffer(b, np.uint64) for b in bodies]
    sizes = np.array([len(a) for a in arrays])
    found: list[list[tuple[int, int]]] = [[(0, len(a))] if n > 1 else [] for a, n in zip(arrays, totals)]
    asked = np.flatnonzero(np.array(totals) < 2)
    if len(asked) and len(arrays) > 1:
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        stops = starts + sizes
        ids = np.zeros(int((sizes + 1).sum()), np.int64)
        inside = np.ones(len(ids), bool)
        inside[stops] = False
        ids[inside] = np.unique(np.concatenate(arrays), return_inverse=True)[1] + 1
        for s, a, b in repeats(FmIndex(ids, stops), ids, starts, stops, asked, length).tolist():
            found[s].append((a - int(starts[s]), b - int(starts[s])))
    return found


def identity(words: list[bytes]) -> tuple[int, int]:
    """128 bits that stand for a word sequence, as two signed numbers."""
    import xxhash

    h = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256: one row per row of docs.

    Every word covered by a window that also starts elsewhere, in the same or another row, is removed; windows are judged on the
    input. Null and empty texts have no words. Rows with the same words, with any ids, count as repeats of each other. An empty table gives none.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    anchor = min(ANCHOR, length)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def read(batches):
        for batch in pieces(batches):
            rows: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                found = (None,) * 4
                if len(words) >= length:
                    best, starts, windows, content = anchors(word_hashes(words), length, anchor)
                    found = (best.view("int64"), starts.astype("int32"), windows.astype("int32"), content.view("int64"))
                for column, value in zip(rows, (*identity(words), len(words), kept_digest(words), *found)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows, kinds)], ["id", "k1", "k2", "n_words", "whole", "anchor", "start", "windows", "content"])

    read_schema = "id long, k1 long, k2 long, n_words long, whole string, anchor array<long>, start array<int>, windows array<int>, content array<long>"
    seen = written(texts.mapInArrow(read, read_schema).withColumn("uid", F.monotonically_increasing_id()), "zstd")  # written: uid stays
    # a row for each segment; `at` packs its first window and their number
    spread = seen.select("uid", F.explode(F.arrays_zip("anchor", "start", "windows", "content")).alias("s")).select(
        "uid", "s.anchor", (F.shiftleft(F.col("s.start").cast("long"), 20) + F.col("s.windows")).alias("at"), "s.content"
    )
    often = written(spread.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    # no more than HOT anchors can have so large a share of the rows: that few are broadcast, and their rows stay where they are
    large = F.col("n") > (often.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(often.where(large).select("anchor"))
    live = written(spread.join(hot, "anchor", "left_semi").unionByName(spread.join(hot, "anchor", "left_anti").join(often.where(~large).select("anchor"), "anchor")), "zstd")
    bodies = written(live.groupBy("anchor", "content").agg(F.count("*").alias("total"), F.min(F.struct("uid", "at")).alias("first")).select("anchor", "content", "total", "first.*"), "zstd")
    wanted = bodies.groupBy("uid").agg(F.collect_list(F.struct("anchor", "content", "total", F.shiftright("at", 20).alias("start"), F.col("at").bitwiseAND(F.lit((1 << 20) - 1)).alias("windows"))).alias("s"))
    # one row stands for all with the same words: the first by uid, which is also the first to hold any of its segments
    standing = seen.where(F.col("n_words") >= length).groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.min("id").alias("id"))
    needed = standing.join(live.select("uid").distinct(), "uid").join(wanted, "uid", "left")

    def keyed(batches):
        for batch in pieces(batches):
            keys = [identity((t or b"").split()) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *batch.columns], ["k1", "k2", "id", "text"])

    # the texts travel once, to the documents that hold a live segment; those are written for the last step
    content, w = texts.mapInArrow(keyed, "k1 long, k2 long, id long, text string").alias("t"), needed.alias("w")
    same = (F.col("t.k1") == F.col("w.k1")) & (F.col("t.k2") == F.col("w.k2")) & F.col("t.id").eqNullSafe(F.col("w.id"))
    held = written(content.join(w, same).select("t.k1", "t.k2", "w.uid", "text", "s"), "zstd")

    def cut(batches):
        for batch in pieces(batches):
            for text, s in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                hashes = word_hashes(text.split())
                parts = [hashes[x["start"] : x["start"] + x["windows"] + length - 1].tobytes() for x in s]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in s], pa.int64()) for c in ("anchor", "content", "total")), pa.array(parts, pa.binary())], ["anchor", "content", "total", "body"])

    segments = held.where("s is not null").select("text", "s").mapInArrow(cut, "anchor long, content long, total long, body binary")
    dealt = shards(segments, bodies)

    def search(batches):
        held_rows: dict[tuple, tuple] = {}
        words, last = 0, None

        def answer():
            out: list[list] = [[], [], [], []]
            rows = list(held_rows.items())
            for ((anchor_, content_), _), spans in zip(rows, shard_repeats([r[0] for _, r in rows], [r[1] for _, r in rows], length)):
                for span in spans:
                    for column, value in zip(out, (anchor_, content_, *span)):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["anchor", "content", "from", "to"])

        for batch in batches:
            for anchor_, content_, total, body, pair in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (anchor_, pair) != last and words >= SHARD_WORDS:
                    yield answer()
                    held_rows, words = {}, 0
                if last is not None and pair != last[1] and anchor_ == last[0] and held_rows:
                    yield answer()  # pairs of one anchor's blocks hold the same segments: each is a shard of its own
                    held_rows, words = {}, 0
                last = (anchor_, pair)
                held_rows[anchor_, content_] = (body, total)
                words += len(body) // 8
        if held_rows:
            yield answer()

    found = written(dealt.select("anchor", "content", "total", "body", "pair").mapInArrow(search, "anchor long, content long, `from` int, `to` int").distinct())
    start = F.shiftright("at", 20)
    spans = live.join(found, ["anchor", "content"]).select("uid", F.struct((start + F.col("from")).alias("from"), (start + F.col("to")).alias("to")).alias("span"))
    merged = spans.groupBy("uid").agg(F.collect_list("span").alias("spans"))

    def remove(batches):
        import numpy as np

        for batch in pieces(batches):
            removed, digests = [], []
            for text, spans in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                change = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    change[s["from"]] += 1
                    change[s["to"]] -= 1
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                digests.append(kept_digest([w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["k1", "k2", "n_removed", "kept"])

    changed = held.select("uid", "k1", "k2", "text").join(merged, "uid").select("k1", "k2", "text", "spans").mapInArrow(remove, "k1 long, k2 long, n_removed long, kept string").distinct()
    result = lambda df, removed, kept: df.select(F.col("id").alias(id_col), "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
    long = seen.where(F.col("n_words") >= length).select("id", "k1", "k2", "n_words", "whole").join(changed, ["k1", "k2"], "left")
    short = seen.where(F.col("n_words") < length)  # has no window; as many empty texts as there may be stay where they are
    return result(long, F.coalesce("n_removed", F.lit(0)), F.coalesce("kept", "whole")).unionByName(result(short, F.lit(0), F.col("whole")))


def shards(segments: DataFrame, bodies: DataFrame) -> DataFrame:
    """Segments dealt by anchor; one with too many different segments is dealt to pairs of blocks, in which any two of
    its segments meet. The sizes come from the narrow table of bodies."""
    blocks = bodies.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK_SEGMENTS).cast("int").alias("_k"))
    return in_pairs(segments, ["anchor"], F.col("content"), blocks).repartition("anchor", "pair").sortWithinPartitions("anchor", "pair")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (SELECT r, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), windows AS (SELECT r, i, word, CASE WHEN i + 34 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS w FROM placed
), often AS (SELECT w FROM windows WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1
), marked AS (SELECT r, i, word, max(CASE WHEN often.w IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM windows LEFT JOIN often ON windows.w = often.w
), cut AS (SELECT r, count(*) FILTER (WHERE gone = 1) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
