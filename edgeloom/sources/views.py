"""Graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.graph import Graph, canonical


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: from each event's user to the next event's, weighted by how often.

    The order of events is global, but no task sees it all: each hour finds its own successors, and the last user of the hour before
    is carried over from a table of one row an hour.
    """
    e = _table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "user_id")
    last = e.groupBy("hour").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    last = last.select("hour", F.lag("last").over(Window.orderBy("hour")).alias("before"))
    w = Window.partitionBy("hour").orderBy("ts", "event_id")
    p = e.join(last, "hour").select(F.coalesce(F.lag("user_id").over(w), F.when(F.row_number().over(w) == 1, F.col("before"))).alias("src"), F.col("user_id").alias("dst"))
    edges = p.where("src is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return Graph(e.select(F.col("user_id").alias("id")).distinct(), edges, directed=True)


def _shared_orders(spark: SparkSession, sf_dir: str, key: str, vertices: DataFrame) -> Graph:
    x = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(key).alias("k")).distinct()
    pairs = x.alias("a").join(x.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.k") < F.col("b.k")))
    edges = pairs.groupBy(F.col("a.k").alias("src"), F.col("b.k").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return Graph(vertices, edges)


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected: parts that stand in one order, weighted by the number of orders."""
    return _shared_orders(spark, sf_dir, "l_partkey", _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


def supplier_graph(spark: SparkSession, sf_dir: str, least: float = 0.0) -> Graph:
    """Undirected: suppliers that stand in one order, from weight `least` on."""
    g = _shared_orders(spark, sf_dir, "l_suppkey", _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
    return g.with_edges(g.edges.where(F.col("w") >= least))


def part_supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed and bipartite: parts to suppliers, whose ids follow the largest part's."""
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    shift = parts.agg((F.max("id") + 1).alias("shift"))
    sup = _table(spark, sf_dir, "supplier").join(F.broadcast(shift)).select((F.col("s_suppkey") + F.col("shift")).alias("id"))  # one row
    e = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("w"))
    edges = e.join(F.broadcast(shift)).select("src", (F.col("l_suppkey") + F.col("shift")).alias("dst"), "w")
    return Graph(parts.unionByName(sup), edges, directed=True)


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected and without loops: nations of customers and of their suppliers; 25 vertices, the small case for exact methods."""
    o = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    o = o.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    raw = o.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return Graph(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), canonical(raw))
