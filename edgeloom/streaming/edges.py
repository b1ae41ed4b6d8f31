"""Edges that arrive as files: running degrees, and a hashed sample that needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.rng import digest, uniform


def read_edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """Edge rows (src, dst, w) from the Parquet files that appear in a folder."""
    return spark.readStream.schema("src long, dst long, w double").parquet(path)


def sample_stream(edges: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """Each edge stays with chance 1 - rate, decided by its hash alone: the same edges as in a batch."""
    return edges.where(uniform(digest(seed, "src", "dst")) < F.lit(1 - rate))


def degree_stream(edges: DataFrame) -> DataFrame:
    """(id, deg): running degrees of an undirected edge stream."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
