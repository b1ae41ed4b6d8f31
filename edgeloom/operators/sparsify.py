"""Pruning by score and rank. Every operator ranks once; any number of rates is then a filter on the rank.

Global ranks never put all edges in one task; see graph.ranked(). Variants carry (algo, prune_rate, run).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.rng import digest, uniform
from edgeloom.graph import Graph, Log, based, both_ways, keep, keep_counted, ranked, ranked_in_parts, remove_folder, tasks, tidied
from edgeloom.operators.neighbors import common_neighbors, jaccard, scan_similarity

#: Parts of the vertices whose neighbours are ranked one after the other.
SHARES = 4


def rank_by_hash(edges: DataFrame, seed: int = 7) -> DataFrame:
    return ranked(edges.withColumn("h", digest(seed, "src", "dst")), ["h", "src", "dst"]).drop("h")


def rank_by_score(scored: DataFrame) -> DataFrame:
    """Highest score first; ties by (src, dst)."""
    return ranked(scored, [F.desc("score"), "src", "dst"])


def _by_score(scored: DataFrame) -> DataFrame:
    """rank_by_score() of rows that lie in files already."""
    return ranked_in_parts(scored, F.struct((-F.col("score")).alias("score"), "src", "dst"))


def variants(edges: DataFrame, algo: str, rates: list[float], run: int = 0) -> DataFrame:
    """The edges kept at each prune rate, floor((1 - rate) * m + 0.5) of them. edges: with rank and m."""
    at = F.explode(F.array(*(F.struct(F.lit(r).alias("prune_rate"), F.lit(1 - r).alias("ratio")) for r in rates)))
    v = edges.select("src", "dst", "w", "rank", "m", at.alias("p"))
    v = v.where(F.col("rank") <= F.floor(F.col("p.ratio") * F.col("m") + 0.5))
    return v.select("src", "dst", "w", F.lit(algo).alias("algo"), F.col("p.prune_rate").alias("prune_rate"), F.lit(run).alias("run"))


def random_edges(g: Graph, rates: list[float], seed: int = 7) -> DataFrame:
    return variants(rank_by_hash(g.edges, seed), "random", rates, seed)


@tidied
def g_spar(g: Graph, rates: list[float], common: DataFrame | None = None) -> DataFrame:
    """common, here and below: common_neighbors(g), if they are there already."""
    return variants(_by_score(jaccard(g, common).select("src", "dst", "w", "score")), "gspar", rates)


@tidied
def scan(g: Graph, rates: list[float], common: DataFrame | None = None) -> DataFrame:
    return variants(_by_score(scan_similarity(g, common).select("src", "dst", "w", "score")), "scan", rates)


def _local(rows: DataFrame, order: list) -> DataFrame:
    """Score of each edge from its rank rk among d neighbours: 1 - ln(rk)/ln(d), the higher of its two ends; rounded."""
    return _highest(_ends(rows, order))


def _ends(rows: DataFrame, order: list) -> DataFrame:
    """(src, dst, w, s), src < dst: the score s of each edge from one of its ends."""
    w = Window.partitionBy("src").orderBy(*order)
    s = F.when(F.col("d") == 1, 1.0).otherwise(F.round(1 - F.log("rk") / F.log("d"), 9))
    return rows.withColumn("rk", F.row_number().over(w)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w", s.alias("s"))


def _highest(ends: DataFrame) -> DataFrame:
    return ends.groupBy("src", "dst").agg(F.max("s").alias("score"), F.max("w").alias("w"))


def local_degree(g: Graph, rates: list[float]) -> DataFrame:
    """Each vertex ranks its neighbours by degree."""
    g = based(g)
    d = keep(g.degrees(), "degrees")
    e = g.edges.join(d.select(F.col("id").alias("src"), F.col("deg").alias("du")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("dv")), "dst")
    pair = F.array(F.struct("src", "dst", "w", F.col("du").alias("d"), F.col("dv").alias("dn")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.col("dv").alias("d"), F.col("du").alias("dn")))
    rows = e.select(F.explode(pair).alias("e")).select("e.*")
    return variants(rank_by_score(_local(rows, [F.desc("dn"), "dst"])), "local_degree", rates)


def _both_scored(g: Graph, common: DataFrame | None = None) -> DataFrame:
    pair = F.array(F.struct("src", "dst", "w", "score", F.col("du").alias("d")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "score", F.col("dv").alias("d")))
    return jaccard(g, common).select(F.explode(pair).alias("e")).select("e.*")


@tidied
def local_similarity(g: Graph, rates: list[float], common: DataFrame | None = None) -> DataFrame:
    """Each vertex ranks its neighbours by Jaccard similarity."""
    made = common_neighbors(g) if common is None else common
    rows, ends, scores = _both_scored(g, made), Log(g.spark, "ends"), Log(g.spark, "scores")
    for share in range(SHARES):  # rows of a share of the vertices move at a time, and then of the edges
        ends.append(_ends(rows.where(F.pmod(F.xxhash64("src"), F.lit(SHARES)) == share), [F.desc("score"), "dst"]))
    if common is None:
        for folder in {file.rsplit("/", 2)[0] for file in made.inputFiles()}:
            remove_folder(g.spark, folder)
    for share in range(SHARES):
        scores.append(_highest(ends.all().where(F.pmod(F.xxhash64("src"), F.lit(SHARES)) == share)))
    remove_folder(g.spark, ends.path)
    return variants(_by_score(scores.all()), "local_similarity", rates)


@tidied
def l_spar(g: Graph, c: float, common: DataFrame | None = None) -> DataFrame:
    """Each vertex keeps its floor(d ** c) most similar neighbours; the union of what the ends keep."""
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    picked, rows = Log(g.spark, "picked"), _both_scored(g, common)
    for share in range(SHARES):  # rows of a share of the vertices move at a time
        own = rows.where(F.pmod(F.xxhash64("src"), F.lit(SHARES)) == share)
        picked.append(own.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= F.floor(F.pow("d", F.lit(c)) + 1e-9)).select("src", "dst", "w"))
    return _union(picked.all())


def _union(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))


def _first(rows: DataFrame, n: int, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key with their number rk, in n tasks. Rows move without their digests, which are made where they are
    sorted."""
    return rows.repartition(n, key).withColumn("rk", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rk") <= k)


def k_neighbor(g: Graph, k: int, seed: int = 7) -> DataFrame:
    """Each vertex picks up to k neighbours at random; the union of the picks."""
    e, got = keep_counted(g.edges.select("src", "dst", "w"), "base")
    rows = e if g.directed else both_ways(e)
    picked = _first(rows, tasks(g.spark, got["rows"] * (1 if g.directed else 2)), "src", [digest(seed, "src", "dst"), "dst"], k)
    return picked.select("src", "dst", "w") if g.directed else _union(picked)


def degree_cap(g: Graph, cap: int, side: str = "out", seed: int = 6) -> DataFrame:
    """At most cap out-edges (or in-edges) of each vertex, at random."""
    e, got = keep_counted(g.edges, "base")
    return _first(e, tasks(g.spark, got["rows"]), "src" if side == "out" else "dst", [digest(seed, "src", "dst"), "src", "dst"], cap).drop("rk")


def symmetric_degree_cap(g: Graph, cap: int, seed: int = 6) -> DataFrame:
    """Undirected edges that are among the cap first, in hashed order, at both ends: no degree exceeds cap."""
    e, got = keep_counted(g.edges.select("src", "dst", "w"), "base")
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("v"), "src", "dst", "w"), F.struct(F.col("dst").alias("v"), "src", "dst", "w"))).alias("e")).select("e.*")
    ok = _first(ends, tasks(g.spark, 2 * got["rows"]), "v", [digest(seed, "src", "dst"), "src", "dst"], cap)
    return ok.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).where("n = 2").select("src", "dst", "w")


def bernoulli(edges: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """Each edge stays with chance 1 - rate."""
    return edges.where(uniform(digest(seed, "src", "dst")) < F.lit(1 - rate))


def cut_sparsify(g: Graph, n: int, eps: float = 10.0, d: int = 1, k: float = 10.0, seed: int = 7) -> DataFrame:
    """Each edge stays with chance min(1, 16 (d + 2) ln n / eps^2 / k)."""
    return g.edges.where(uniform(digest(seed, "src", "dst")) < F.lit(min(1.0, 16 * (d + 2) * math.log(max(n, 1)) / eps**2 / k)))


def over_degree(edges: DataFrame, t: int, side: str = "dst") -> DataFrame:
    """One row: how many vertices have more than t edges on that side."""
    return edges.groupBy(side).count().where(F.col("count") > t).agg(F.count(F.lit(1)).alias("n"))
