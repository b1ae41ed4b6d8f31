"""Comparison statistics between a graph and its pruned variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def bhattacharyya(p: Column, q: Column) -> Column:
    """Aggregate: -ln(sum(sqrt(p*q))), infinite where the two share nothing."""
    s = F.sum(F.sqrt(F.coalesce(p, F.lit(0.0)) * F.coalesce(q, F.lit(0.0))))
    return F.when(s <= 0, F.lit(INF)).otherwise(-F.log(s))


def ratio(value: Column, base: Column) -> Column:
    """value / base; infinite where the base is 0 or infinite or the value is."""
    bad = base.isNull() | (base == 0) | (base == INF) | value.isNull() | (value == INF)
    return F.when(bad, F.lit(INF)).otherwise(value / base)


def ratio_stats(r: Column) -> list[Column]:
    """Aggregates: least, largest, mean, population deviation of the finite ratios, and the share that is infinite."""
    ok = F.when(r != INF, r)
    return [
        F.min(ok).alias("ratio_min"),
        F.max(ok).alias("ratio_max"),
        F.avg(ok).alias("ratio_mean"),
        F.stddev_pop(ok).alias("ratio_std"),
        F.avg(F.when(r == INF, 1.0).otherwise(0.0)).alias("unreachable"),
    ]


def top_n(scores: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The n highest (score desc, id) of each group with their rank from 1. A partial limit runs before the shuffle."""
    w = Window.partitionBy(*(by or [])).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_n_agreement(a: DataFrame, b: DataFrame, n: int = 100) -> DataFrame:
    """precision = shared / n and the rank correlation of the shared items, re-ranked within them; null if fewer than two."""
    both = top_n(a, n).select("id", F.col("rank").alias("ra")).join(top_n(b, n).select("id", F.col("rank").alias("rb")), "id")
    both = both.select(F.row_number().over(Window.orderBy("ra")).alias("ra"), F.row_number().over(Window.orderBy("rb")).alias("rb"))  # at most n rows
    return both.agg((F.count(F.lit(1)) / F.lit(float(n))).alias("precision"), F.when(F.count(F.lit(1)) > 1, F.corr("ra", "rb")).alias("correlation"))


def cosine(a: Column, b: Column) -> Column:
    """Aggregate: the cosine of two columns."""
    return F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))
