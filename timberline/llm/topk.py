"""Exact top-k search by tiled matrix products.

Queries and candidates meet in tiles (see tiles.py); of each tile's scores one partition keeps the k best of every query, and a query's lists are merged in a
tree. Every candidate meets every query once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm import tiles


def search(rows: DataFrame, is_query: Column, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id long, rank int (from 1), vec_id long, score long: for each query its k best candidates of all rows.

    The score is the inner product of floor(scale * x), exact; ties go to the smaller id. Rows with a null id, or a vector that is
    null, empty or holds null or non-finite components, take no part; only vectors of the same dimension meet. Rows that share a query's id are
    its own. Repeated rows of another id are candidates each. Fewer candidates than k: all. An empty table gives none.
    """
    import pyarrow as pa

    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asked")).where("id is not null and vector is not null")
    asked = chosen.where("asked").select("id", "vector").distinct()
    n_candidates, n_queries = tiles.groups(chosen, True), tiles.groups(asked, False)
    grid = tiles.grid(tiles.packed(chosen, "cg", n_candidates, scale), n_candidates, tiles.packed(asked, "qg", n_queries, scale), n_queries)

    def run(batches):
        import numpy as np

        for cg, qids, q, cids, c in tiles.each_tile(batches, 0):
            for at, scores in tiles.products(q, c):
                row, place = tiles.best(scores, cids == qids[at : at + len(scores), None], cids, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), cg), pa.int64()), *map(pa.array, (qids[at + row], cids[place], scores[row, place]))], ["node", "query_id", "vec_id", "score"])

    return tiles.merged(grid.mapInArrow(run, "node long, query_id long, vec_id long, score long"), "query_id", n_candidates, k)


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
