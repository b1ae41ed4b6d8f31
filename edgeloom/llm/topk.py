"""Exact top-k search by inner product: tiles of queries times shards of candidates, merged as a tree.

Queries are dealt by hash into tiles and candidates into shards, both of bounded size; each (tile, shard) pair is one task's
matrix product, from which every query keeps its k best by partial selection. The lists are merged in rounds of FAN shards each.
Nothing is broadcast, and what a task holds does not grow with the data: the number of tiles and shards does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries in a tile, candidates in a shard, lists merged at a time; queries multiplied at a time.
TILE, SHARD, FAN, SLICE = 4096, 8192, 16, 256


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as long; null for a null vector or one with a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~odd, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the range's ends."""
    top = [max(1, int(np.abs(x.astype(object)).max()) if x.size else 1) for x in (q, c)]
    if top[0] * top[1] * max(1, q.shape[1]) < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top[0] * top[1] * max(1, q.shape[1]) < 1 << 63:
        return q @ c.T
    ends = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ c.astype(object).T, ends.min, ends.max).astype(np.int64)


def _first_of_each(ids: pd.Series, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    ids = ids.to_numpy(np.int64)
    rows = np.stack([np.asarray(v, dtype=np.int64) for v in vectors])
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    keep = np.r_[True, ids[1:] != ids[:-1]]
    return ids[keep], rows[keep]


def search(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, all if fewer, ties to the smaller id.

    Both inputs: (id long, v array<long>). Rows with a null id or vector take no part; vectors are only compared with those of as
    many components; a candidate of the query's own id is left out. Of rows with the same id and dimension one counts: that whose
    vector is smallest. Queries without candidates have no row.
    """
    ok = lambda df: df.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dim"))
    queries, candidates = ok(queries), ok(candidates)
    tiles = max(1, -(-queries.count() // TILE))
    shards = max(1, -(-candidates.count() // SHARD))
    bucket = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "v", "dim", bucket(tiles).alias("tile"), spread(shards).alias("shard"))
    # other names on the right: a cogroup of one table with itself would mix up the columns
    right = candidates.select(F.col("id").alias("c_id"), F.col("v").alias("c_v"), F.col("dim").alias("c_dim"), spread(tiles).alias("c_tile"), bucket(shards).alias("c_shard"))
    left, right = left.groupBy("dim", "tile", "shard"), right.groupBy("c_dim", "c_tile", "c_shard")

    def tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "shard", "vec_id", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        (qi, q), (ci, c) = _first_of_each(a.id, a.v), _first_of_each(b.c_id, b.c_v)
        parts = []
        for lo in range(0, len(qi), SLICE):
            s, own = _products(q[lo : lo + SLICE], c), qi[lo : lo + SLICE]
            for row, query in zip(s, own):
                there = np.flatnonzero(ci != query) if (at := np.searchsorted(ci, query)) < len(ci) and ci[at] == query else None
                row, ids = (row, ci) if there is None else (row[there], ci[there])
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    top = np.flatnonzero(row >= least)  # ids ascend, so among ties the first are the smaller
                    top = np.r_[top[row[top] > least], top[row[top] == least]][:k]
                    row, ids = row[top], ids[top]
                parts.append((np.full(len(ids), query), ids, row))
        out = [np.concatenate(x) for x in zip(*parts)]
        return pd.DataFrame({"query_id": out[0], "shard": np.full(len(out[0]), key[2]), "vec_id": out[1], "score": out[2]})

    lists = left.cogroup(right).applyInPandas(tile, "query_id long, shard long, vec_id long, score long")
    while True:
        best = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        shards = -(-shards // FAN)
        if shards <= 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("v"))
    return search(rows.where(F.col("id") % 100 == 0), rows, 10)


OP3_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score
      from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 10
"""
