"""Betweenness by sampled pairs until an error bound holds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.rng import digest, uniform
from edgeloom.graph import Graph, Log, adjacency, keep, keep_counted, ranked, release, tidied


def shortest_path_shares(spark: SparkSession, ahead: DataFrame, behind: DataFrame, pairs: DataFrame, directed: bool) -> DataFrame:
    """(pair, id, share): of the shortest paths of each pair (pair, s, t), the share through each inner vertex.

    Searches go from both ends of all pairs at once; a round extends the side whose last level is the smaller one in all. Where the
    levels of a pair meet first, its paths cross; their counts there are carried back to both ends. ahead and behind are adjacencies
    (src, dst) along and against the edges. Pairs without a path have no rows.
    """
    sides = {"s": Log(spark, "ahead"), "t": Log(spark, "behind")}
    over = {"s": ahead, "t": behind}
    last, size = {}, {}
    for x, log in sides.items():
        last[x] = log.append(pairs.select("pair", F.col(x).alias("id"), F.lit(1.0).alias("sigma")))
        size[x] = log.rows
    out = Log(spark, "shares")
    while all(size.values()):
        x = min(size, key=size.get)
        y = "t" if x == "s" else "s"
        step = last[x].join(over[x], last[x]["id"] == over[x]["src"]).groupBy("pair", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        known = sides[x].all() if directed else sides[x].last(2)
        new = sides[x].append(step.join(known.select("pair", "id"), ["pair", "id"], "left_anti"))
        both, got = keep_counted(new.join(last[y].select("pair", "id", F.col("sigma").alias("other")), ["pair", "id"]), "meet")
        last[x] = new
        if got["rows"]:
            total = both.groupBy("pair").agg(F.sum(F.col("sigma") * F.col("other")).alias("total"))
            meet = keep(both.join(total, "pair").select("pair", "id", (F.col("sigma") * F.col("other") / F.col("total")).alias("share"), "sigma", "other"), "meet")
            out.append(meet.select("pair", "id", "share"))
            for z, own in ((x, "sigma"), (y, "other")):  # the last level of each side is the one that has met
                back, here = over["t" if z == "s" else "s"], meet.select("pair", "id", (F.col("share") / F.col(own)).alias("part"))
                for k in range(len(sides[z].parts) - 2, 0, -1):
                    level = sides[z].part(k)
                    near = here.join(back, here["id"] == back["src"]).groupBy("pair", F.col("dst").alias("id")).agg(F.sum("part").alias("part"))
                    here = keep(level.join(near, ["pair", "id"]).select("pair", "id", (F.col("sigma") * F.col("part")).alias("share"), "part"), "back")
                    out.append(here.select("pair", "id", "share"))
                    here = here.select("pair", "id", "part")
            for z in last:
                last[z], got = keep_counted(last[z].join(meet.select("pair").distinct(), "pair", "left_anti"), "open")
                size[z] = got["rows"]
        else:
            size[x] = sides[x].rows
    if not out.parts:
        return pairs.select("pair", F.col("s").alias("id"), F.lit(0.0).alias("share")).limit(0)
    ends = pairs.select("pair", F.explode(F.array("s", "t")).alias("id"))
    return out.all().join(ends, ["pair", "id"], "left_anti")


def path_samples(eps: float, delta: float, vertices: int) -> int:
    """Samples after which, with chance 1 - delta, no estimate is off by more than eps, if a shortest path has at most so many vertices:
    0.5 / eps^2 (floor(log2(vertices - 2)) + 1 + ln(1 / delta))."""
    return math.ceil(0.5 / eps**2 * ((math.floor(math.log2(vertices - 2)) if vertices > 2 else 0) + 1 + math.log(1 / delta)))


@tidied
def approximate_betweenness(g: Graph, eps: float = 0.05, delta: float = 0.1, seed: int = 7, batch: int | None = None, log: list | None = None) -> DataFrame:
    """(id, score): the mean over ordered pairs of different vertices of the share of their shortest paths through a vertex, each within
    eps of the truth with chance 1 - delta for all together.

    Pairs are drawn by hash, in batches that double. It ends when the deviation that each vertex's own variance allows (empirical
    Bernstein bound, delta spread over vertices and batches) is at most eps, or at the number that the vertex diameter asks for
    whatever the variance (path_samples). log: takes (pairs drawn, what the bound came to).
    """
    n = g.vertices.count()
    zero = g.vertices.select("id", F.lit(0.0).alias("score"))
    if n < 3:
        return zero
    e = g.both().select("src", "dst").where("src <> dst").distinct()
    ahead = adjacency(e, name="ahead")
    behind = adjacency(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), name="behind") if g.directed else ahead
    cap = path_samples(eps, delta / 2, _vertex_diameter(g, n))
    names = keep(ranked(g.vertices.select("id"), ["id"]).select("id", (F.col("rank") - 1).alias("nth")), "names")
    drawn, sums, round_, size = 0, Log(g.spark, "sums"), 0, batch or max(32, math.ceil(math.log(n) / eps))
    while True:
        size = min(size, cap - drawn)
        k = digest(seed, "pair")
        p = g.spark.range(drawn, drawn + size).select(F.col("id").alias("pair")).withColumns({"a": F.floor(uniform(k) * n), "b": F.floor(uniform(k, 9) * (n - 1))})
        p = p.withColumn("b", F.when(F.col("b") >= F.col("a"), F.col("b") + 1).otherwise(F.col("b")))
        p = keep(p.join(names.select(F.col("nth").alias("a"), F.col("id").alias("s")), "a").join(names.select(F.col("nth").alias("b"), F.col("id").alias("t")), "b").select("pair", "s", "t"), "pairs")
        shares = shortest_path_shares(g.spark, ahead, behind, p, g.directed)
        sums.append(shares.groupBy("id").agg(F.sum("share").alias("x"), F.sum(F.col("share") * F.col("share")).alias("xx")))
        release(p)
        drawn, round_ = drawn + size, round_ + 1
        spread = math.log(4 * n * round_ * (round_ + 1) / delta)  # two-sided, over all vertices, delta / 2 over all rounds
        most = sums.all().groupBy("id").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx")).agg(F.max((F.col("xx") - F.col("x") * F.col("x") / drawn) / max(drawn - 1, 1))).first()[0] or 0.0
        off = math.sqrt(2 * max(most, 0.0) * spread / drawn) + 7 * spread / (3 * max(drawn - 1, 1))
        if off <= eps or drawn >= cap:
            break
        size *= 2
    if log is not None:
        log.append((drawn, min(off, eps)))
    s = sums.all().groupBy("id").agg((F.sum("x") / F.lit(float(drawn))).alias("score"))
    return g.vertices.join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _vertex_diameter(g: Graph, n: int) -> int:
    """A bound of the vertices on a shortest path: twice the farthest that a component's first vertex sees, and one; n if directed."""
    from edgeloom.operators.distances import hop_distances
    from edgeloom.operators.traverse import connected_components

    if g.directed:
        return n
    far = hop_distances(g, connected_components(g).select(F.col("comp").alias("source")).distinct()).agg(F.max("dist")).first()[0] or 0
    return min(n, 2 * int(far) + 1)
