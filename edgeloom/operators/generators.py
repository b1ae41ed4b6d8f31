"""Synthetic graphs, all of them reproducible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.rng import digest, normal, uniform


def _w(df: DataFrame) -> DataFrame:
    return df.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(1.0).alias("w"))


def ring(spark: SparkSession, n: int) -> DataFrame:
    i = spark.range(n)
    nxt = F.pmod(F.col("id") + 1, F.lit(n))
    return _w(i.select(F.explode(F.array(F.struct(F.col("id").alias("src"), nxt.alias("dst")), F.struct(nxt.alias("src"), F.col("id").alias("dst")))).alias("e")).select("e.*"))


#: Ids of a block of a complete graph's edges.
BLOCK = 1024


def complete(spark: SparkSession, n: int, seed: int | None = None, first: int = 0) -> DataFrame:
    """Each pair once; with a seed, weights in (0, 1].

    The triangle of pairs is cut into squares of BLOCK by BLOCK ids, dealt out evenly, at most 64 a task. In a square an id meets the
    same few others as the id before, so a column file holds little more than the differences, though it has a row for each pair.
    """
    side = -(-n // BLOCK)
    squares = side * (side + 1) // 2
    cuts = max(1, min(squares, 4 * spark.sparkContext.defaultParallelism), -(-squares // 64))
    s = spark.range(0, squares * BLOCK, 1, cuts).select(F.expr(f"id div {BLOCK}").alias("square"), F.expr(f"id % {BLOCK}").alias("at"))
    s = s.withColumn("b", F.floor((F.sqrt(8.0 * F.col("square") + 1) - 1) / 2).cast("long"))
    s = s.select(F.expr(f"(square - b * (b + 1) div 2) * {BLOCK} + at").alias("src"), (F.col("b") * BLOCK).alias("begin"), (F.least((F.col("b") + 1) * BLOCK, F.lit(n)) - 1).alias("end"))
    e = s.where("src < end").select("src", F.explode(F.sequence(F.greatest(F.col("src") + 1, "begin"), "end")).alias("dst"))
    e = _w(e.select(F.col("src") + first, F.col("dst") + first).toDF("src", "dst"))
    return e if seed is None else e.withColumn("w", 1 - uniform(digest(seed, "src", "dst")))


def dumbbell(spark: SparkSession, n: int) -> DataFrame:
    """Two cliques of n / 2 and one bridge."""
    h = n // 2
    return complete(spark, h).unionByName(complete(spark, h, first=h)).unionByName(spark.createDataFrame([(h - 1, h, 1.0)], "src long, dst long, w double"))


def communities(spark: SparkSession, sizes: list[int], bridges: int, seed: int = 7) -> DataFrame:
    """Cliques of the given sizes and random bridges between successive ones."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    out = complete(spark, sizes[0])
    for s, f in zip(sizes[1:], starts[1:]):
        out = out.unionByName(complete(spark, s, first=f))
    b = spark.range(bridges).crossJoin(spark.createDataFrame([(f, s, f2, s2) for f, s, f2, s2 in zip(starts, sizes, starts[1:], sizes[1:])] or [], "f long, s long, f2 long, s2 long")) if len(sizes) > 1 else None
    if b is None:
        return out
    pick = lambda name, first, size: F.col(first) + F.floor(uniform(digest(f"{seed}{name}", "id", "f")) * F.col(size))
    return out.unionByName(_w(b.select(pick("a", "f", "s").alias("src"), pick("b", "f2", "s2").alias("dst")).distinct()))


def uniform_graph(spark: SparkSession, scale: int, degree: int, seed: int = 7) -> DataFrame:
    n = 1 << scale
    i = spark.range(n * degree)
    return _w(i.select(F.floor(uniform(digest(f"{seed}a", "id")) * n).alias("src"), F.floor(uniform(digest(f"{seed}b", "id")) * n).alias("dst")))


def rmat(spark: SparkSession, scale: int, degree: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 7, permute: bool = True) -> DataFrame:
    """Recursive matrix: each bit of both ids falls in one of four quadrants; then ids are permuted by an odd multiplier."""
    n = 1 << scale
    e = spark.range(n * degree).withColumn("src", F.lit(0)).withColumn("dst", F.lit(0))
    for bit in range(scale):
        u = uniform(digest(f"{seed}:{bit}", "id"))
        e = e.withColumn("u", u).select("id", (F.col("src") * 2 + (F.col("u") >= a + b).cast("int")).alias("src"), (F.col("dst") * 2 + (((F.col("u") >= a) & (F.col("u") < a + b)) | (F.col("u") >= a + b + c)).cast("int")).alias("dst"))
    mix = (lambda x: F.pmod(F.col(x).cast("long") * 2654435761 + 12345, F.lit(n))) if permute else F.col
    return _w(e.select(mix("src").alias("src"), mix("dst").alias("dst")))


def random_walk(spark: SparkSession, n: int, steps: int, seed: int = 7) -> DataFrame:
    """Symmetric: successive vertices of a hashed sequence, without loops and repeats. Step i and i + 1 are both functions of i."""
    at = lambda i: F.floor(uniform(digest(seed, i)) * n)
    e = spark.range(steps).select(at("id").alias("a"), at(F.col("id") + 1).alias("b")).where("a <> b")
    return _w(e.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").distinct())


def random_numbers(spark: SparkSession, n: int, kind: str = "uniform", seed: int = 7) -> DataFrame:
    h = digest(seed, "id")
    return spark.range(n).select("id", (uniform(h) if kind == "uniform" else normal(h)).alias("x"))
