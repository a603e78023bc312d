"""What several corpus operators share: the shared folder, written intermediate tables,
splitting of oversized groups, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data that a Python worker handles at once; a single longer row is handled alone. Spark itself ends a batch at
#: spark.sql.execution.arrow.maxBytesPerBatch (64 MB), so the session's settings need no change.
PIECE_BYTES = 4 << 20
#: Rows of a table of large keys that is broadcast at most.
BROADCAST_ROWS = 100_000


def pieces(batches, most: int = PIECE_BYTES) -> Iterator:
    """The batches cut into slices of at most about `most` bytes, of one row at least."""
    for batch in batches:
        rows = max(1, len(batch))
        step = max(1, int(most * rows // max(1, batch.nbytes)))
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            if len(part) > 1 and part.nbytes > 4 * most:  # a few very long rows among short ones
                for i in range(len(part)):
                    yield part.slice(i, 1)
            else:
                yield part


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a temporary folder, but only if driver and executors are one process; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
        base = "file://" + tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return base.rstrip("/")


#: File system and path of each table that this process wrote; both outlive the session that made them.
_written: list[tuple] = []


def _placed(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written` or `new_path` made."""
    files, at = _placed(spark, path)
    files.delete(at, True)


@atexit.register
def delete_all() -> None:
    """What this process wrote goes when it ends, also after spark.stop(): results may be read until then."""
    while _written:
        files, at = _written.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone
            files.delete(at, True)


def new_path(spark: SparkSession, *names: str) -> str:
    """A path in the shared folder for one table, in a folder of its own that is deleted when this process ends."""
    folder = "/".join([shared_dir(spark), *names[:-1], uuid.uuid4().hex])
    _written.append(_placed(spark, folder))
    return f"{folder}/{names[-1]}"


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    return _write(df, codec)[0]


def _write(df: DataFrame, codec: str = "snappy") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, "tables", "t")
    df.write.option("compression", codec).parquet(path)
    spark.sparkContext._jvm.System.gc()  # frees the shuffle files of plans that are no longer referenced
    return spark.read.schema(df.schema).parquet(path), path


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def block_pairs(df: DataFrame, keys: list[str], row_id: Column, block_rows: int, weight: Column | None = None, block_weight: int = 1) -> DataFrame:
    """Adds `pair`, so that (keys, pair) names a group of bounded size, in rows and, if given, in weight.

    A key with at most block_rows rows stays whole (pair 0). The rows of a larger key are dealt by the hash of
    row_id to k blocks, and each row is copied to the k pairs of its block with every block: any two rows of a
    key meet in at least one pair, no pair holds much more than 2 * block_rows rows, and nothing is dropped.
    """
    size = F.count("*") / block_rows if weight is None else F.greatest(F.count("*") / block_rows, F.sum(weight) / block_weight)
    return in_pairs(df, keys, row_id, df.groupBy(*keys).agg(F.ceil(size).cast("int").alias("_k")))


def in_pairs(df: DataFrame, keys: list[str], row_id: Column, blocks: DataFrame) -> DataFrame:
    """block_pairs with the number of blocks of each key given: blocks (keys, _k int). Without a key of several, df isn't shuffled."""
    large = written(blocks.where("_k > 1"))
    n = large.count()
    if not n:
        return df.withColumn("pair", F.lit(0).cast("long"))
    dealt = df.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, keys, "left").withColumn("_s", F.when(F.col("_k").isNotNull(), F.pmod(F.xxhash64(row_id, F.lit(7)), F.col("_k")).cast("int")))
    low, high = (lambda t: F.least("_s", t)), (lambda t: F.greatest("_s", t))
    pairs = F.when(F.col("_k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda t: low(t).cast("long") * F.col("_k") + high(t) + 1)
    )
    return dealt.withColumn("pair", F.explode(pairs)).drop("_k", "_s")


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, component long): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a partial aggregation and a join on
    the node, so that a hub's edges are never gathered in one task. Ends when a round changes nothing; each
    round is written to the shared folder.
    """
    now, path = _write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = tuple(seen)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old = path
        now, path = _write(small)
        delete(now.sparkSession, old)


def local_roots(n: int, pairs) -> "object":
    """The smallest member of each of n nodes' component under pairs (an iterable of index array pairs)."""
    import numpy as np

    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            live = ra != rb
            if not live.any():
                break
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root
