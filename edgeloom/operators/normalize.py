"""Conversions of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.graph import Graph, both_ways, ranked


def to_undirected(edges: DataFrame) -> DataFrame:
    """Rows with src < dst of a symmetric edge table; loops vanish. Symmetrise first, or one-way edges with src > dst are lost."""
    return edges.where("src < dst")


def to_directed(edges: DataFrame) -> DataFrame:
    """Each row in both directions, duplicates kept."""
    return both_ways(edges)


def symmetrize(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """The set of the edges and their inverses; with weights the weight is part of what makes rows distinct."""
    return both_ways(edges).dropDuplicates(["src", "dst", "w"] if weighted else ["src", "dst"])


def unweight(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.lit(1.0))


def squish(edges: DataFrame) -> DataFrame:
    """Without loops and repeated edges; of the latter the smallest weight stays."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def rebase(edges: DataFrame, by: int = 1) -> DataFrame:
    """Ids counted from another base."""
    return edges.select((F.col("src") + by).alias("src"), (F.col("dst") + by).alias("dst"), "w")


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges whose inverse is missing."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def is_symmetric(edges: DataFrame) -> DataFrame:
    """One row: symmetric boolean."""
    return asymmetric(edges).agg((F.count(F.lit(1)) == 0).alias("symmetric"))


def renumber(edges: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(renumbered edges, id map (old_id, new_id)): dense ids from 0, by first appearance as a source, then as a destination.

    order: what the order of rows is (default src, dst), since a table has none of its own.
    """
    order = order or ["src", "dst"]
    key = F.struct(*order)
    s = edges.groupBy(F.col("src").alias("old_id")).agg(F.min(key).alias("k")).select("old_id", F.lit(0).alias("part"), "k")
    d = edges.groupBy(F.col("dst").alias("old_id")).agg(F.min(key).alias("k")).select("old_id", F.lit(1).alias("part"), "k")
    first = s.unionByName(d).groupBy("old_id").agg(F.min(F.struct("part", "k")).alias("f"))
    ids = ranked(first, ["f", "old_id"]).select("old_id", (F.col("rank") - 1).alias("new_id"))
    return apply_map(edges, ids), ids


def apply_map(edges: DataFrame, ids: DataFrame, missing: int | None = None) -> DataFrame:
    """Edges in new ids; those with an unknown id are dropped, or take `missing`."""
    how = "inner" if missing is None else "left"
    a = ids.select(F.col("old_id").alias("src"), F.col("new_id").alias("_s"))
    b = ids.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_d"))
    new = lambda c: F.col(c) if missing is None else F.coalesce(c, F.lit(missing))
    return edges.join(a, "src", how).join(b, "dst", how).select(new("_s").alias("src"), new("_d").alias("dst"), "w")


def map_lines(lines: DataFrame, ids: DataFrame, missing: int = 0) -> DataFrame:
    """(line_no, ids): ragged lines of ids (line_no, tokens array<long>) in new ids and in order."""
    t = lines.select("line_no", F.posexplode("tokens").alias("pos", "old_id")).join(ids, "old_id", "left")
    got = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("new_id", F.lit(missing)).alias("v"))))
    return t.groupBy("line_no").agg(F.transform(got, lambda x: x["v"]).alias("ids"))


def match_reference(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """Edges that the reference has."""
    return edges.join(reference.select("src", "dst"), ["src", "dst"], "left_semi")


def removed(original: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges that pruning took away."""
    return original.join(kept.select("src", "dst"), ["src", "dst"], "left_anti")


def relabel_by_degree(g: Graph) -> Graph:
    """Ids from 0 by descending degree, ties by descending id."""
    ids = ranked(g.degrees(), [F.desc("deg"), F.desc("id")]).select(F.col("id").alias("old_id"), (F.col("rank") - 1).alias("new_id"))
    e = apply_map(g.edges, ids)
    e = e if g.directed else e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return Graph(ids.select(F.col("new_id").alias("id")), e, g.directed)


def degree_table(g: Graph) -> DataFrame:
    """(id, out_deg, in_deg, in_weight, out_weight) of every vertex."""
    ways = F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0.0).alias("iw"), F.col("w").alias("ow")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("w").alias("iw"), F.lit(0.0).alias("ow")),
    )
    s = g.edges.select(F.explode(ways).alias("x")).groupBy("x.id").agg(*(F.sum(f"x.{c}").alias(c) for c in ("o", "i", "iw", "ow")))
    z = lambda c, t: F.coalesce(c, F.lit(0)).cast(t)
    return g.vertices.join(s, "id", "left").select("id", z("o", "long").alias("out_deg"), z("i", "long").alias("in_deg"), z("iw", "double").alias("in_weight"), z("ow", "double").alias("out_weight"))


def overview(g: Graph) -> DataFrame:
    """One row: n, m, isolated, loops, least, largest and mean degree, density."""
    d = g.degrees().agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("deg") == 0).cast("long")).alias("isolated"), F.min("deg").alias("min_degree"), F.max("deg").alias("max_degree"), F.avg("deg").alias("avg_degree"))
    e = g.edges.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("long")), F.lit(0)).alias("loops"))
    pairs = F.col("n") * (F.col("n") - 1) / F.lit(1.0 if g.directed else 2.0)
    return d.join(e).withColumn("density", F.col("m") / pairs)  # one row each


def validate(g: Graph) -> None:
    """Raises ValueError for null ends, negative weights, ends that are no vertices or undirected rows out of form."""
    bad = g.edges.where("src is null or dst is null or w is null or w < 0" + ("" if g.directed else " or src >= dst")).limit(1).count()
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(g.vertices, "id", "left_anti").limit(1).count()
    if bad or ends:
        raise ValueError("not a well-formed graph")
