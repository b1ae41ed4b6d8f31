"""Frontier traversals: components, forests, distances, centralities, and prunings that walk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.rng import digest
from edgeloom.graph import Graph, Grid, Log, adjacency, by_cell, grid, keep, keep_counted, ranked, release, tidied
from edgeloom.operators import distances as far
from edgeloom.operators.neighbors import triangles


@tidied
def connected_components(g: Graph) -> DataFrame:
    """(id, comp): the smallest id of each vertex's (weakly) connected component.

    Rounds of the smallest neighbouring label and the label's own label, until nothing moves; about the logarithm of the diameter.
    """
    n = adjacency(Graph(g.vertices, g.edges).both().select("src", "dst").where("src <> dst"))
    labels = keep(g.vertices.select("id", F.col("id").alias("comp")), "comp")
    while True:
        near = n.join(labels, n["src"] == labels["id"]).groupBy("dst").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels["id"] == near["dst"], "left").select("id", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        up = labels.select(F.col("id").alias("up"), F.col("comp").alias("upper"))
        new, got = keep_counted(low.join(up, low["low"] == up["up"]).select("id", F.least("low", "upper").alias("comp"), (F.least("low", "upper") < F.col("comp")).alias("moved")), "comp", moved=F.max("moved"))
        release(labels)
        labels = new.select("id", "comp")
        if not got["moved"]:
            return labels


@tidied
def spanning_forest(g: Graph, seed: int = 7) -> DataFrame:
    """The minimum spanning forest under the order (hash, src, dst): n minus the number of components edges.

    Boruvka with contraction: each component takes its least outgoing edge, components merge into one vertex, and edges within a
    component go, so a round has at most half the vertices of the one before. Edges are ranked by the order once, so a round moves and
    compares numbers only.
    """
    order = ranked(g.edges.where("src <> dst").select("src", "dst", "w", digest(seed, "src", "dst").alias("h")), ["h", "src", "dst"]).select("src", "dst", "w", F.col("rank").alias("r"))
    e, got = keep_counted(order.select(F.col("src").alias("a"), F.col("dst").alias("b"), "r"), "edges")
    chosen = Log(g.spark, "forest")
    while got["rows"]:
        ways = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "r")
        least = keep(ways.groupBy("x.a").agg(F.min_by("x.b", "r").alias("b"), F.min("r").alias("r")), "least")
        chosen.append(least.select("r").distinct())
        comp = connected_components(Graph(least.select(F.col("a").alias("id")), least.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))))
        ca, cb = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        inner = e.join(ca, "a").join(cb, "b").where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.min("r").alias("r"))
        last, (e, got) = e, keep_counted(inner, "edges")
        release(last, least)
    return keep(order.join(chosen.all(), "r", "left_semi").select("src", "dst", "w"), "forest") if chosen.parts else g.edges.select("src", "dst", "w").limit(0)


def distances(g: Graph, sources: DataFrame, weighted: bool = False, depth: int | None = None) -> DataFrame:
    """(source, id, dist): shortest distances from each source (source long) along edges: hops level by level, weights by rounds
    over what the last one improved."""
    if weighted and depth is not None:
        raise ValueError("a depth is of hops")
    return far.weighted_distances(g, sources) if weighted else far.hop_distances(g, sources, depth)


def sample_vertices(g: Graph, n: int, seed: int = 7, nonzero: bool = False) -> DataFrame:
    """(id): n vertices in hashed order."""
    v = g.degrees().where("deg > 0").select("id") if nonzero else g.vertices
    return v.orderBy(digest(seed, "id"), "id").limit(n)


def eccentricity(dist: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(source, ecc): the largest finite distance (to targets), infinite if there is none or it is 0."""
    d = dist if targets is None else dist.join(targets, "id", "left_semi")
    far = d.groupBy("source").agg(F.max("dist").alias("far"))
    return dist.select("source").distinct().join(far, "source", "left").select("source", F.when(F.col("far") > 0, F.col("far")).otherwise(F.lit(float("inf"))).alias("ecc"))


@tidied
def largest_component(g: Graph) -> Graph:
    """The subgraph of the component of most vertices; of equally large ones that of the smallest id."""
    comp = keep(connected_components(g), "comp")
    top = comp.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(1).select("comp")
    v = keep(comp.join(F.broadcast(top), "comp", "left_semi").select("id"), "largest")  # one row
    return Graph(v, g.edges.join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi"), g.directed)


def effective_diameter(g: Graph, sources: DataFrame, share: float = 0.9) -> DataFrame:
    """One row: the least number of hops within which `share` of the reachable pairs from the sources lie."""
    hops = distances(g, sources).where("dist > 0").groupBy("dist").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("dist")
    run = hops.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a hop count
    return run.where(F.col("upto") >= share * F.col("total")).agg(F.min("dist").alias("effective_diameter"))


@tidied
def pseudo_diameter(g: Graph, starts: DataFrame) -> DataFrame:
    """(start, diameter): from each start to its farthest vertex and on from there, until the distance grows no more."""
    at = keep(starts.select(F.col("source").alias("start"), F.col("source").alias("at"), F.lit(-1.0).alias("best")), "at")
    while True:
        d = distances(g, at.select(F.col("at").alias("source")).distinct())
        far = d.groupBy("source").agg(F.max(F.struct("dist", F.col("id"))).alias("f"))
        new = keep(at.join(far, at["at"] == far["source"]).select("start", F.when(F.col("f.dist") > F.col("best"), F.col("f.id")).otherwise(F.col("at")).alias("at"), F.greatest("best", "f.dist").alias("best"), (F.col("f.dist") > F.col("best")).alias("grown")), "at")
        at = new.select("start", "at", "best")
        if not new.where("grown").limit(1).count():
            return at.select("start", F.col("best").alias("diameter"))


def closeness(g: Graph, sources: DataFrame) -> DataFrame:
    """(id, score) of the sources: (r - 1) / sum of distances, times (r - 1) / (n - 1), with r the vertices reached."""
    n = g.vertices.agg(F.count(F.lit(1)).alias("n"))
    s = distances(g, sources).groupBy("source").agg(F.count(F.lit(1)).alias("r"), F.sum("dist").alias("total"))
    s = s.join(F.broadcast(n))  # one row
    r = F.col("r") - 1
    return s.select(F.col("source").alias("id"), F.when(F.col("total") > 0, r / F.col("total") * r / (F.col("n") - 1)).otherwise(0.0).alias("score"))


#: Sources whose numbers of paths stand in one row, a column each.
PATHS = 16
_SIGMA = [f"s{k}" for k in range(PATHS)]


@tidied
def betweenness(g: Graph, pivots: DataFrame) -> DataFrame:
    """(id, score): dependencies of shortest paths from the pivots; with every vertex as a pivot, exact betweenness (both ways).

    A row tells of 16 pivots, and edges lie in a grid of cells within which what they bring is added up, so what is shuffled grows with
    pivots times vertices, not edges.
    """
    e = grid(g.both().select("src", "dst").distinct())
    back = grid(e.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "behind") if g.directed else e
    every, give = Log(g.spark, "delta"), None
    with by_cell(g.spark):
        paths = _path_counts(e, pivots, g.directed)
        for level in range(len(paths.parts) - 2, 0, -1):  # the pivots themselves take no part
            low = paths.part(level)
            got = {c: F.lit(0.0) for c in _SIGMA}
            if give is not None:
                near = back.ahead(give.drop("delta")).groupBy("word", "id").agg(*(F.sum(c).alias(f"g{c}") for c in _SIGMA))
                low, got = low.join(near, ["word", "id"], "left"), {c: F.coalesce(f"g{c}", F.lit(0.0)) for c in _SIGMA}
            delta = sum((F.col(c) * got[c] for c in _SIGMA), F.lit(0.0))
            give = every.append(low.select("word", "id", *(F.when(F.col(c) > 0, (1 + F.col(c) * got[c]) / F.col(c)).otherwise(0.0).alias(c) for c in _SIGMA), delta.alias("delta")))
    if not every.parts:
        return g.vertices.select("id", F.lit(0.0).alias("score"))
    s = every.all().groupBy("id").agg(F.sum("delta").alias("score"))
    return g.vertices.join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


@tidied
def betweenness_sampled(g: Graph, pairs: DataFrame) -> DataFrame:
    """(id, score): the mean over sampled pairs (s, t) of the share of their shortest paths that pass through a vertex, an estimate of
    betweenness over all pairs. Pairs are searched from both ends and meet; see between.shortest_path_shares()."""
    from edgeloom.operators.between import shortest_path_shares

    t = keep(pairs.where("s <> t").select(F.monotonically_increasing_id().alias("pair"), "s", "t"), "pairs")
    n = max(1, pairs.count())
    e = adjacency(g.both().select("src", "dst").where("src <> dst").distinct(), name="ahead")
    back = adjacency(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), name="behind") if g.directed else e
    s = shortest_path_shares(g.spark, e, back, t, g.directed).groupBy("id").agg((F.sum("share") / F.lit(float(n))).alias("score"))
    return g.vertices.join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def closeness_sampled(g: Graph, pivots: DataFrame) -> DataFrame:
    """(id, score): the pivots reached over the sum of distances from them, an estimate of closeness; 0 where none is."""
    s = distances(g, pivots).where("source <> id").groupBy("id").agg((F.count(F.lit(1)) / F.sum("dist")).alias("score"))
    return g.vertices.join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _path_counts(e: Grid, sources: DataFrame, directed: bool) -> Log:
    """(word, id, s0 .. s15, bits): for 16 sources the numbers of shortest paths, 0 unless a vertex is at this level, and which are not 0;
    a part a level, the last is empty."""
    words = far.packed(sources, PATHS)
    log = Log(words.sparkSession, "sigma")
    bits = sum((F.when(F.col(c) > 0, 1 << k).otherwise(0) for k, c in enumerate(_SIGMA)), F.lit(0)).alias("bits")
    start = words.select("word", F.posexplode("sources").alias("_at", "id"))
    front = log.append(start.select("word", "id", *(F.when(F.col("_at") == k, 1.0).otherwise(0.0).alias(c) for k, c in enumerate(_SIGMA)), F.expr("shiftleft(1, _at)").alias("bits")))
    while log.rows:
        step = e.ahead(front.drop("bits")).withColumn("had", F.lit(0))
        known = (log.all() if directed else log.last(2)).select("word", "id", *(F.lit(0.0).alias(c) for c in _SIGMA), F.col("bits").alias("had"))
        both = step.unionByName(known).groupBy("word", "id").agg(*(F.sum(c).alias(c) for c in _SIGMA), F.bit_or("had").alias("had"))
        new = both.select("word", "id", *(F.when(F.col("had").bitwiseAND(F.lit(1 << k)) == 0, F.col(c)).otherwise(0.0).alias(c) for k, c in enumerate(_SIGMA)))
        front = log.append(new.select("*", bits).where("bits <> 0"))
    return log


@tidied
def core_numbers(g: Graph) -> DataFrame:
    """(id, core): the largest k for which the vertex stays when all of degree below k are peeled away again and again.

    Rounds of h-indices instead of peeling: starting at its degree, each vertex takes the largest h of which h neighbours have at
    least h; the fixed point is the core number, reached in far fewer rounds than there are shells.
    """
    n = keep(g.both().select("src", "dst").where("src <> dst").distinct(), "nbrs")
    deg = n.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("core"))
    core = keep(g.vertices.join(deg, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core")), "core")
    down = Window.partitionBy("src").orderBy(F.desc("core"))
    while True:
        values = n.join(core, n["dst"] == core["id"]).groupBy("src", "core").agg(F.count(F.lit(1)).alias("c"))  # a row for each distinct value
        h = values.withColumn("upto", F.sum("c").over(down)).groupBy("src").agg(F.max(F.least("core", "upto")).cast("int").alias("h"))
        new, got = keep_counted(core.join(h, core["id"] == h["src"], "left").select("id", F.coalesce("h", F.lit(0)).alias("core"), (F.coalesce("h", F.lit(0)) < F.col("core")).alias("moved")), "core", moved=F.max("moved"))
        last, core = core, new.select("id", "core")
        release(last)
        if not got["moved"]:
            return core


@tidied
def k_path(g: Graph, walks: int = 1000, length: int = 5, seed: int = 7) -> DataFrame:
    """(id, score): how often hashed walks of the given length visit a vertex. Walk k starts at the vertex whose place in hashed order
    is k modulo the number of vertices, so a vertex starts as many walks as fall to it."""
    w = Window.partitionBy("src").orderBy("dst")
    n = keep(g.both().select("src", "dst").distinct().withColumn("at", F.row_number().over(w) - 1).withColumn("deg", F.count(F.lit(1)).over(Window.partitionBy("src"))), "nbrs")
    order = keep(ranked(g.vertices.select("id", digest(seed, "id").alias("h")), ["h", "id"]), "order")
    start = order.where(F.col("rank") <= walks).select("id", "rank", F.explode(F.sequence(F.col("rank") - 1, F.lit(walks - 1).cast("long"), F.col("m"))).alias("walk")).select("walk", F.col("id").alias("here"))
    log = Log(g.spark, "walks")
    here = log.append(start.select(F.col("walk").cast("long").alias("walk"), "here"))
    for step in range(length):
        pick = F.pmod(F.conv(F.substring(digest(f"{seed}:{step}", "walk"), 1, 8), 16, 10).cast("long"), F.col("deg"))
        here = log.append(here.join(n, here["here"] == n["src"]).where(F.col("at") == pick).select("walk", F.col("dst").alias("here")))
    visits = log.all().groupBy(F.col("here").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return g.vertices.join(visits, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def local_clustering(g: Graph) -> DataFrame:
    """(id, score): closed share of each vertex's pairs of neighbours; 0 below two neighbours."""
    v, _, t = triangles(g)
    t = t.select(F.explode(F.array("a", "b", "c")).alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("t"))
    d = v.join(t, "rank", "left")
    return d.select("id", F.when(F.col("deg") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0).alias("score"))


@tidied
def directed_clustering(g: Graph) -> DataFrame:
    """(id, score): of a directed graph, the share of ordered pairs of out-neighbours that have an edge.

    Each triangle of the graph without directions is listed once, from low to high degree, so hubs do not square; which of its six
    possible edges there are says what it adds to each of its corners.
    """
    e = g.edges.select("src", "dst").where("src <> dst").distinct()
    d = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    there = e.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("up"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("down"))
    way = (F.col("up") + 2 * F.col("down")).cast("double")  # which of both edges there are
    order, pairs, t = triangles(Graph(g.vertices, there.select(F.col("x").alias("src"), F.col("y").alias("dst"), way.alias("w"))))
    ends = order.select(F.col("id").alias("src"), F.col("rank").alias("lo"), F.lit(True).alias("same"))
    pairs = pairs.join(ends, ["src", "lo"], "left").select("lo", "hi", F.col("w").cast("int").alias("w"), F.col("same").isNotNull().alias("same"))
    to, fro = F.col("w").bitwiseAND(F.lit(1)), F.shiftright("w", 1)
    pairs = keep(pairs.select("lo", "hi", F.when(F.col("same"), to).otherwise(fro).alias("up"), F.when(F.col("same"), fro).otherwise(to).alias("down")), "pairs")
    for x, y in ("ab", "ac", "bc"):
        t = t.join(pairs.select(F.col("lo").alias(x), F.col("hi").alias(y), F.col("up").alias(x + y), F.col("down").alias(y + x)), [x, y])
    corner = lambda u, v, w: F.struct(F.col(u).alias("rank"), (F.col(u + v) * F.col(u + w) * (F.col(v + w) + F.col(w + v))).alias("t"))
    closed = t.select(F.explode(F.array(corner("a", "b", "c"), corner("b", "a", "c"), corner("c", "a", "b"))).alias("x")).groupBy("x.rank").agg(F.sum("x.t").alias("t"))
    s = order.select("id", "rank").join(d, "id", "left").join(closed, "rank", "left")
    return s.select("id", F.when(F.col("deg") > 1, F.coalesce("t", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0).alias("score"))


def global_clustering(g: Graph) -> DataFrame:
    """One row: triangles, triples, transitivity."""
    v, _, t = triangles(g)
    t = t.agg(F.count(F.lit(1)).alias("triangles"))
    w = v.agg(F.coalesce(F.sum(F.expr("deg * (deg - 1) div 2")), F.lit(0)).alias("triples"))
    return t.join(w).select("triangles", "triples", F.when(F.col("triples") > 0, 3 * F.col("triangles") / F.col("triples")).otherwise(0.0).alias("transitivity"))  # one row each


def rank_degree(g: Graph, ratio: float, seeds: int = 10, rho: float = 0.1, seed: int = 7) -> DataFrame:
    """Seeds add their top max(1, int(rho * d)) neighbours by degree, which are the next seeds; fresh hashed seeds when none are left;
    rho rises by 0.1 when a thousand rounds bring at most a hundredth; ends once ratio * m edges are chosen."""
    return rank_degree_at(g, [ratio], seeds, rho, seed).select("src", "dst", "w")


@tidied
def rank_degree_at(g: Graph, ratios: list[float], seeds: int = 10, rho: float = 0.1, seed: int = 7) -> DataFrame:
    """(src, dst, w, ratio): rank_degree() for several ratios, of which each is one stage of the same walk.

    The walk is not followed round by round. What a vertex chooses does not depend on when it is met, so between two changes of rho all its
    rounds are found together: the first seed that reaches each vertex, from these the seeds of each start, and then the rounds from all
    starts side by side. An edge is written once, with the round that chose it; a ratio's edges are those up to the round that reached it.
    """
    d = g.degrees()
    rows = g.both().join(d.select(F.col("id").alias("src"), F.col("deg").alias("d")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("dn")), "dst")
    rows = keep(rows.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("dn"), "dst"))), "ranked")
    order = keep(ranked(d.where("deg > 0").select("id", digest(seed, "id").alias("h")), ["h", "id"]).select("id", "rank"), "order")
    targets = {r: int(g.edges.count() * r) for r in ratios}
    most = max(targets.values(), default=0)
    reached = {r: 0 for r, n in targets.items() if n <= 0}
    chosen, front, size, still, round_ = Log(g.spark, "chosen"), None, 0, 0, 0
    while size < most:
        top = adjacency(rows.where(F.col("rk") <= F.greatest(F.lit(1), F.floor(F.lit(rho) * F.col("d")))).select("src", "dst", "w"), name="top")
        met = _met(order, top, front, seeds)
        picks = met.join(top, met["id"] == top["src"]).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min(F.struct("start", "step")).alias("at"), F.max("w").alias("w"))
        picks = keep(picks if not chosen.parts else picks.join(chosen.all().select("src", "dst"), ["src", "dst"], "left_anti"), "picks")
        every = met.select("start", "step").distinct().join(picks.groupBy("at.start", "at.step").agg(F.count(F.lit(1)).alias("n")), ["start", "step"], "left")
        began, last, raised = round_, None, False
        rounds = every.select("start", "step", F.coalesce("n", F.lit(0)).alias("n")).orderBy("start", "step").toLocalIterator()  # a row a round
        for start, step, more in rounds:
            size, round_, last = size + more, round_ + 1, (start, step)
            for r, n in targets.items():
                if size >= n:
                    reached.setdefault(r, round_)
            still = still + 1 if more <= 0.01 * most else 0
            raised = still > 1000 and rho < 0.99
            if size >= most or raised:
                break
        if last is None:
            break
        # rounds are numbered in order of their starts and steps
        numbers = ranked(met.select("start", "step").distinct(), ["start", "step"]).select("start", "step", (F.col("rank") + (began - 1)).alias("round"))
        chosen.append(picks.select("src", "dst", "w", "at.start", "at.step").join(numbers, ["start", "step"]).where(F.col("round") < round_).select("src", "dst", "w", "round"))
        done = rho >= 0.99 and not raised
        if raised:  # the walk goes on from what this round has chosen
            at = met.where((F.col("start") == last[0]) & (F.col("step") == last[1]))
            front, rho, still = keep(at.join(top, at["id"] == top["src"]).select(F.col("dst").alias("id")).distinct(), "front"), rho + 0.1, 0
        elif size < most:
            front, rho = None, min(1.0, rho + 0.1)
        release(picks, met, top)
        if done:
            break
    if not chosen.parts:
        return g.edges.select("src", "dst", "w", F.lit(0.0).alias("ratio")).limit(0)
    ends = F.array(*(F.struct(F.lit(r).alias("ratio"), F.lit(reached.get(r, round_)).alias("end")) for r in ratios))
    return chosen.all().withColumn("x", F.explode(ends)).where("round < x.end").select("src", "dst", "w", "x.ratio")


def _met(order: DataFrame, top: DataFrame, front: DataFrame | None, seeds: int) -> DataFrame:
    """(id, start, step): at which start of a walk along top each vertex is met, and in how many steps. A start takes the first `seeds`
    vertices in order that are not met yet, until none is left; start 0 takes the front instead. Kept.

    A vertex is met from the start of the first vertex in order that reaches it. Starts are given out in one task, 8 bytes a vertex.
    """
    own = order if front is None else order.join(front.withColumn("zero", F.lit(0).cast("long")), "id", "left").select("id", F.coalesce("zero", "rank").alias("rank"))
    first = _spread(own.select("id", F.struct(F.col("rank").alias("first")).alias("x")), top, lambda x: x)
    rows = first.select("id", "x.first").join(order, "id").select("id", "rank", "first")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of rank; a vertex whose first is its own rank is sure to begin."""
        at, taken, start = {0: 0}, 0, 1
        for b in batches:
            ids, out = b.column("id").to_pylist(), ([], [])
            for k, (rank, root) in enumerate(zip(b.column("rank").to_pylist(), b.column("first").to_pylist())):
                if root == 0:
                    continue
                if root != rank and at[root] < start:
                    continue  # met from an earlier start
                if root == rank:
                    at[rank] = start
                out[0].append(ids[k])
                out[1].append(start)
                taken += 1
                if taken == seeds:
                    taken, start = 0, start + 1
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["id", "start"])

    begun = keep(rows.repartition(1).sortWithinPartitions("rank").mapInArrow(starts, "id long, start long"), "starts")
    if front is not None:
        begun = begun.unionByName(front.select("id", F.lit(0).cast("long").alias("start")))
    met = _spread(begun.select("id", F.struct("start", F.lit(0).alias("step")).alias("x")), top, lambda x: F.struct(x["start"].alias("start"), (x["step"] + 1).alias("step")))
    release(first, begun)
    return keep(met.select("id", "x.start", "x.step"), "met")


def _spread(had: DataFrame, top: DataFrame, onward: Callable[[Column], Column]) -> DataFrame:
    """(id, x): the least x that comes to each vertex along top (src, dst) from had (id, x), onward an edge. A round follows what the last
    one lowered. Kept."""
    log = Log(had.sparkSession, "spread")
    front = log.append(had)
    best = keep(had, "least")
    while log.rows:
        come = front.join(top, front["id"] == top["src"]).select(F.col("dst").alias("id"), onward(F.col("x")).alias("x"))
        now = best.select("id", "x", F.col("x").alias("was")).unionByName(come.select("id", "x", F.lit(None).cast(best.schema["x"].dataType).alias("was")))
        now = keep(now.groupBy("id").agg(F.min("x").alias("x"), F.min("was").alias("was")), "least")
        front = log.append(now.where("was is null or x < was").select("id", "x"))
        release(best)
        best = now.select("id", "x")
    return best


@tidied
def forest_fire(g: Graph, ratio: float, fires: int = 32, burnt_ratio: float = 5.0, seed: int = 7) -> DataFrame:
    """Fires from hashed vertices burn each edge of a burning vertex with chance 0.2 (ratio above one half) or 0.6, each until it is
    out; `fires` at a time are lit until burnt_ratio times as many edges have burnt as there are, or every vertex has lit one. An
    edge's score is how many fires burnt it; the highest scores are kept, as many as the ratio says, ties in hashed order."""
    from edgeloom.functions.rng import uniform

    chance = 0.2 if ratio > 0.5 else 0.6
    n = adjacency(g.both().select("src", "dst"))
    starts = keep(ranked(g.degrees().where("deg > 0").select("id", digest(seed, "id").alias("h")), ["h", "id"]), "starts")
    left, goal, lit = starts.count(), burnt_ratio * g.edges.count(), 0
    total, burnt = 0, Log(g.spark, "burnt")
    while total < goal and lit < left:
        front, got = keep_counted(starts.where((F.col("rank") > lit) & (F.col("rank") <= lit + fires)).select(F.col("id").alias("fire"), "id"), "front")
        lit, r, seen = lit + fires, 0, Log(g.spark, "seen")
        while got["rows"]:
            seen.append(front)
            fire = burnt.append(front.join(n, front["id"] == n["src"]).where(uniform(digest(f"{seed}:{r}", "fire", "src", "dst")) < chance).select("fire", "src", "dst"))
            total += burnt.rows
            last, (front, got) = front, keep_counted(fire.select("fire", F.col("dst").alias("id")).distinct().join(seen.all(), ["fire", "id"], "left_anti"), "front")
            release(last)
            r += 1
    if not burnt.parts:
        return g.edges.select("src", "dst", "w").limit(0)
    burnt = burnt.all()
    s = burnt.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.countDistinct("fire").alias("visits"))
    e = g.edges.join(s, ["src", "dst"], "left").withColumn("visits", F.coalesce("visits", F.lit(0))).withColumn("h", digest(seed, "src", "dst"))
    e = ranked(e, [F.desc("visits"), "h", "src", "dst"])
    return e.where(F.col("rank") <= F.floor(F.lit(ratio) * F.col("m") + 0.5)).select("src", "dst", "w")
