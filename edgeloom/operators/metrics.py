"""Properties of graphs and of all their variants at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions.rng import digest
from edgeloom.functions.stats import bhattacharyya
from edgeloom.graph import Graph, Log, adjacency, both_ways, canonical, keep, keep_counted, release, tidied

KEYS = ["algo", "prune_rate", "run"]


def degree_histogram(variants: DataFrame, vertices: DataFrame, directed: bool, nbin: int = 100) -> DataFrame:
    """(KEYS, bin, p): share of vertices in each of nbin bins between the variant's own smallest and largest normalised degree."""
    end = lambda c: F.when(F.col("src") != F.col("dst"), F.col(c))  # noqa: E731  a loop has no ends, but stands for its variant
    ends = variants.select(*KEYS, end("src").alias("id")) if directed else variants.select(*KEYS, F.explode(F.array(end("src"), end("dst"))).alias("id"))
    deg = ends.groupBy(*KEYS, "id").agg(F.count("id").alias("deg"))
    some = deg.groupBy(*KEYS, "deg").agg(F.count("id").alias("c"))
    n = vertices.count()
    alone = some.groupBy(*KEYS).agg((F.lit(n) - F.sum("c")).alias("c"))  # isolated vertices count by their number; a row a variant
    d = some.where("c > 0").unionByName(alone.where("c > 0").select(*KEYS, F.lit(0).cast("long").alias("deg"), "c"))
    w = Window.partitionBy(*KEYS)  # one row a distinct degree
    d = d.withColumn("lo", F.min("deg").over(w)).withColumn("hi", F.max("deg").over(w)).withColumn("n", F.sum("c").over(w))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(nbin // 2)).otherwise(F.least(F.floor((F.col("deg") - F.col("lo")) * nbin / (F.col("hi") - F.col("lo"))), F.lit(nbin - 1)))
    return d.groupBy(*KEYS, b.cast("int").alias("bin")).agg((F.sum("c") / F.first("n")).alias("p"))


def degree_distance(variants: DataFrame, original: Graph, nbin: int = 100) -> DataFrame:
    """(KEYS, distance): Bhattacharyya distance of each variant's degree histogram to the original's."""
    o = original.edges.select("src", "dst", "w", F.lit("original").alias("algo"), F.lit(0.0).alias("prune_rate"), F.lit(0).alias("run"))
    h = degree_histogram(variants.select(o.columns).unionByName(o), original.vertices, original.directed, nbin)
    base = h.where("algo = 'original'").select("bin", F.col("p").alias("q"))  # nbin rows
    return h.join(base, "bin", "left").groupBy(*KEYS).agg(bhattacharyya(F.col("p"), F.col("q")).alias("distance"))


@tidied
def label_propagation(g: Graph, rounds: int | None = 5) -> DataFrame:
    """(id, comm): each vertex takes the label of the largest weight among its neighbours and itself, ties to the smallest.

    rounds: None goes on until nothing changes, or until the labels are those of two rounds before, between which they would swing.
    """
    n = keep(g.both().select("src", "dst", "w"), "nbrs")
    labels = keep(g.vertices.select("id", F.col("id").alias("comm")), "labels")
    before, step = None, 0
    while rounds is None or step < rounds:
        step += 1
        votes = n.join(labels, n["dst"] == labels["id"]).groupBy("src", "comm").agg(F.sum("w").alias("votes"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("votes")).alias("v"), "comm"))["comm"].alias("best"))
        new = keep(labels.join(best, labels["id"] == best["src"], "left").select("id", F.coalesce("best", "comm").alias("comm")), "labels")
        settled = rounds is None and any(x is not None and not new.exceptAll(x).limit(1).count() for x in (labels, before))
        release(before)
        before, labels = labels, new
        if settled:
            break
    return labels


@tidied
def louvain(g: Graph, rounds: int = 20, levels: int = 8, seed: int = 7) -> DataFrame:
    """(id, comm): communities by moves that raise the weighted modularity, on the graph and then on the graph of its communities.

    In a round every vertex finds the neighbouring community of the largest gain; of those that gain, a hashed half moves at once, so
    neighbours seldom swap. The best labels of a level are kept; a level ends after three rounds that are no better.
    """
    e = keep(canonical(g.edges), "level")
    where = keep(g.vertices.select("id", F.col("id").alias("comm")), "labels")
    loops = where.select("id", F.lit(0.0).alias("inner"))  # weight inside what a vertex of this level stands for
    m = e.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    if not m:
        return where
    for level in range(levels):
        n = keep(both_ways(e).select("src", "dst", "w"), "nbrs")
        k = keep(loops.join(n.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("out")), "id", "left").select("id", "inner", (F.coalesce("out", F.lit(0.0)) + 2 * F.col("inner")).alias("k")), "weights")
        comm = keep(k.select("id", F.col("id").alias("c")), "comm")
        best, kept, worse = -1.0, comm, 0
        for step in range(rounds):
            now = comm.join(k, "id")
            size = now.groupBy("c").agg(F.sum("k").alias("tot"), F.sum("inner").alias("loops"))
            links = n.join(comm, n["dst"] == comm["id"]).groupBy("src", "c").agg(F.sum("w").alias("to"))
            inside = links.join(comm.withColumnRenamed("c", "own"), links["src"] == comm["id"]).where("c = own").groupBy("c").agg((F.sum("to") / 2).alias("links"))
            q = size.join(inside, "c", "left").agg(F.sum((F.coalesce("links", F.lit(0.0)) + F.col("loops")) / m - F.pow(F.col("tot") / (2 * m), 2))).first()[0]
            if q > best + 1e-9:
                best, kept, worse = q, comm, 0
            else:
                worse += 1
            if worse == 3:
                break
            every = links.withColumnRenamed("src", "id").unionByName(comm.select("id", "c", F.lit(0.0).alias("to"))).groupBy("id", "c").agg(F.sum("to").alias("to"))
            every = every.join(now.select("id", F.col("c").alias("own"), "k"), "id").join(size.select("c", "tot"), "c")
            gain = F.col("to") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / (2 * m)
            pick = every.withColumn("gain", gain).groupBy("id").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.max("gain").alias("top"), F.min(F.struct((-F.col("gain")).alias("g"), "c"))["c"].alias("to"), F.first("own").alias("own"))
            moves = (F.col("top") > F.col("stay") + 1e-9) & (F.substring(digest(f"{seed}:{level}:{step}", "id"), 1, 1) < "8")
            comm = keep(pick.select("id", F.when(moves, F.col("to")).otherwise(F.col("own")).alias("c")), "comm")
        if not kept.where("id <> c").limit(1).count():
            return where
        where = keep(where.join(kept.select(F.col("id").alias("comm"), "c"), "comm").select("id", F.col("c").alias("comm")), "labels")
        a, b = kept.select(F.col("id").alias("src"), F.col("c").alias("ca")), kept.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        joined = keep(e.join(a, "src").join(b, "dst").groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("w").alias("w")), "level")
        inner = joined.where("src = dst").select(F.col("src").alias("id"), F.col("w").alias("x"))
        loops = keep(kept.join(loops, "id").groupBy(F.col("c").alias("id")).agg(F.sum("inner").alias("inner")).join(inner, "id", "left").select("id", (F.col("inner") + F.coalesce("x", F.lit(0.0))).alias("inner")), "loops")
        e = joined.where("src <> dst")
    return where


def modularity(g: Graph, labels: DataFrame) -> DataFrame:
    """One row: communities, modularity = sum of L/m - (D/2m)^2, on unit weights."""
    m = g.edges.count()
    a, b = labels.select(F.col("id").alias("src"), F.col("comm").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("comm").alias("cb"))
    e = g.edges.join(a, "src").join(b, "dst").select(F.explode(F.array(F.struct(F.col("ca").alias("comm"), (F.col("ca") == F.col("cb")).cast("long").alias("inner")), F.struct(F.col("cb").alias("comm"), F.lit(0).cast("long").alias("inner")))).alias("x"))
    s = e.groupBy("x.comm").agg(F.sum("x.inner").alias("l"), F.count(F.lit(1)).alias("d"))
    c = labels.select("comm").distinct().join(s, "comm", "left")
    q = F.coalesce(F.col("l") / F.lit(float(max(m, 1))) - F.pow(F.col("d") / F.lit(2.0 * max(m, 1)), 2), F.lit(0.0))
    return c.agg(F.count(F.lit(1)).alias("communities"), F.coalesce(F.sum(q), F.lit(0.0)).alias("modularity"))


def cover_f1(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: f1, the mean over a's communities of their best F1 with one of b's. Covers: (comm, node), overlaps allowed."""
    size = lambda c, n: c.groupBy("comm").agg(F.count(F.lit(1)).alias(n))
    both = a.select(F.col("comm").alias("ca"), "node").join(b.select(F.col("comm").alias("cb"), "node"), "node").groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("x"))
    sa, sb = size(a, "na").withColumnRenamed("comm", "ca"), size(b, "nb").withColumnRenamed("comm", "cb")
    best = both.join(sa, "ca").join(sb, "cb").groupBy("ca").agg(F.max(2 * F.col("x") / (F.col("na") + F.col("nb"))).alias("f"))
    return sa.join(best, "ca", "left").agg(F.avg(F.coalesce("f", F.lit(0.0))).alias("f1"))


@tidied
def grow_communities(g: Graph, seeds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(comm, node): the natural community of each seed (id), which names it. Communities may overlap.

    A community's fitness is k_in / k^alpha, k the weight of its nodes' edges and k_in of those that stay inside, by both ends. In a
    round every open community takes in the neighbours that raise it most (one, or a quarter of its size once that is more), and then
    loses the nodes, but for the seed, without which it is fitter. A community whose round brings no more fitness is left as before.
    """
    n = adjacency(g.both().where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
    deg = keep(g.vertices.join(n.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg")), "id", "left").select(F.col("id").alias("node"), F.coalesce("deg", F.lit(0.0)).alias("deg")), "degrees")
    done = Log(g.spark, "cover")
    now, left = keep_counted(seeds.select(F.col("id").alias("comm"), F.col("id").alias("node")).distinct(), "cover")
    fit = keep(now.select("comm", F.lit(0.0).alias("had")).distinct(), "fitness")

    def inner(c: DataFrame) -> DataFrame:
        """(comm, node, own, inside, deg) of the members and their neighbours."""
        near = c.join(n, c["node"] == n["src"]).select("comm", F.col("dst").alias("node"), F.lit(0).alias("own"), F.col("w").alias("inside"))
        t = near.unionByName(c.select("comm", "node", F.lit(1).alias("own"), F.lit(0.0).alias("inside")))
        return t.groupBy("comm", "node").agg(F.max("own").alias("own"), F.sum("inside").alias("inside")).join(deg, "node")

    def sums(t: DataFrame) -> DataFrame:
        return t.where("own = 1").groupBy("comm").agg(F.sum("inside").alias("k_in"), F.sum("deg").alias("k"), F.count(F.lit(1)).alias("size"))

    def fitness(k_in: Column, k: Column) -> Column:
        return F.when(k > 1e-12, k_in / F.pow(k, F.lit(alpha))).otherwise(0.0)

    eps = 1e-12
    while left["rows"]:
        t = keep(inner(now), "inside")
        s = sums(t)
        gain = fitness(F.col("k_in") + 2 * F.col("inside"), F.col("k") + F.col("deg")) - fitness(F.col("k_in"), F.col("k"))
        w = Window.partitionBy("comm").orderBy(F.desc("gain"), "node")
        better = t.where("own = 0").join(s, "comm").withColumn("gain", gain).where(F.col("gain") > eps).withColumn("nth", F.row_number().over(w))
        more = better.where(F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("size") / 4))).select("comm", "node")
        grown = keep(now.unionByName(more), "cover")
        t2 = keep(inner(grown).where("own = 1"), "inside")
        s2 = sums(t2)
        loss = fitness(F.col("k_in") - 2 * F.col("inside"), F.col("k") - F.col("deg")) - fitness(F.col("k_in"), F.col("k"))
        next_ = keep(t2.join(s2, "comm").where((loss <= eps) | (F.col("node") == F.col("comm"))).select("comm", "node"), "cover")
        now_fit = keep(sums(inner(next_)).select("comm", fitness(F.col("k_in"), F.col("k")).alias("fit")), "fitness")
        up = keep(now_fit.join(fit, "comm").where(F.col("fit") > F.col("had") + eps).select("comm", F.col("fit").alias("had")), "fitness")
        done.append(now.join(up, "comm", "left_anti"))
        last = (now, fit, t, t2, grown, now_fit)
        now, left = keep_counted(next_.join(up, "comm", "left_semi"), "cover")
        fit = up
        release(*last, next_)
    return done.all() if done.parts else now


@tidied
def cover(g: Graph, alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """(comm, node): overlapping communities that together cover every vertex; see grow_communities().

    Seeds are taken among the vertices that are not covered yet: those whose hash is less than that of their uncovered neighbours, so
    that seeds do not lie side by side. Of equal communities that of the smallest seed stays.
    """
    g = Graph(g.vertices, keep(g.edges.select("src", "dst", "w"), "edges"), g.directed)
    near = adjacency(g.both().select("src", "dst").where("src <> dst").distinct())
    left, got = keep_counted(g.vertices.select("id", F.struct(digest(seed, "id").alias("h"), "id").alias("h")), "left")
    found = Log(g.spark, "cover")
    while got["rows"]:
        beside = left.join(near, left["id"] == near["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("h").alias("low"))
        seeds = left.join(beside, "id", "left").where("low is null or h < low").select("id")
        new = found.append(grow_communities(g, seeds, alpha))
        last, (left, got) = left, keep_counted(left.join(new.select(F.col("node").alias("id")).distinct(), "id", "left_anti"), "left")
        release(last)
    if not found.parts:
        return g.vertices.select(F.col("id").alias("comm"), F.col("id").alias("node")).limit(0)
    every = found.all()
    same = every.groupBy("comm").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    first = same.groupBy("n", "a", "b").agg(F.min("comm").alias("comm")).select("comm")
    return every.join(first, "comm", "left_semi")


def local_communities(g: Graph, seeds: DataFrame, alpha: float = 1.0, rounds: int = 3) -> DataFrame:
    """(comm, node): from each seed, in rounds, the neighbours join whose edges into the community are at least alpha times those
    out of it: a quick expansion in which nothing leaves; see grow_communities() for one by fitness."""
    n = keep(g.both().select("src", "dst"), "nbrs")
    deg = g.degrees()
    c = keep(seeds.select(F.col("id").alias("comm"), F.col("id").alias("node")).unionByName(seeds.join(n, seeds["id"] == n["src"]).select(F.col("id").alias("comm"), F.col("dst").alias("node"))).distinct(), "cover")
    for _ in range(rounds):
        inside = c.join(n, c["node"] == n["src"]).groupBy("comm", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inside")).join(deg, F.col("node") == deg["id"])
        more = inside.where(F.col("inside") >= alpha * (F.col("deg") - F.col("inside"))).select("comm", "node")
        last, c = c, keep(c.unionByName(more).distinct(), "cover")
        release(last)
    return c


def read_cover(spark: SparkSession, path: str) -> DataFrame:
    """(comm, node) of a text file with a community a line: its nodes, parted by blanks. Communities are numbered by their lines;
    blank lines and those that begin with # are none."""
    from edgeloom.sources.files import numbered_lines

    t = numbered_lines(spark, path, (F.trim("line") != "") & ~F.col("line").startswith("#"))
    return t.select(F.col("at").alias("comm"), F.explode(F.array_distinct(F.split(F.trim("line"), "\\s+"))).cast("long").alias("node"))


def degree_centrality(g: Graph) -> DataFrame:
    return g.degrees().select("id", F.col("deg").cast("double").alias("score"))


def spsp_stretch(base: DataFrame, pruned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, id, ratio): pruned over base distance for the pairs (source, id); infinite where either has none or base is 0."""
    from edgeloom.functions.stats import ratio

    t = pairs.join(base.withColumnRenamed("dist", "b"), ["source", "id"], "left").join(pruned.withColumnRenamed("dist", "d"), ["source", "id"], "left")
    return t.select("source", "id", ratio(F.col("d"), F.col("b")).alias("ratio"))


def stacked(variants: DataFrame, vertices: DataFrame, directed: bool = False) -> tuple[Graph, DataFrame]:
    """(graph of all variants side by side, (KEYS, nth)): variant nth has its vertices shifted by nth times the number of ids, so one
    traversal serves all. The number of variants is that of a sweep; a row of nth each."""
    step = int(vertices.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
    names = variants.select(*KEYS).distinct().orderBy(*KEYS).collect()
    nth = variants.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(names)], variants.select(*KEYS, F.lit(0).cast("long").alias("nth")).schema)
    move = lambda c: (F.col(c) + F.col("nth") * step).alias(c)
    e = variants.join(F.broadcast(nth), KEYS).select(move("src"), move("dst"), "w")
    return Graph(vertices.join(F.broadcast(nth.select("nth"))).select(move("id")), e, directed), nth.withColumn("shift", F.col("nth") * step)


def eccentricities(variants: DataFrame, original: Graph, sources: DataFrame) -> DataFrame:
    """(KEYS, source, ecc, base): hops to the farthest vertex that is reached, 0 if there is none, in each variant and in the original."""
    from edgeloom.operators.traverse import distances

    o = original.edges.select("src", "dst", "w", F.lit("").alias("algo"), F.lit(0.0).alias("prune_rate"), F.lit(0).alias("run"))
    g, nth = stacked(variants.select(o.columns).unionByName(o), original.vertices, original.directed)
    s = sources.join(F.broadcast(nth)).select(*KEYS, F.col("source").alias("of"), (F.col("source") + F.col("shift")).alias("source"))
    far = distances(g, s.select("source")).groupBy("source").agg(F.max("dist").alias("ecc"))
    t = keep(s.join(far, "source").select(*KEYS, F.col("of").alias("source"), "ecc"), "ecc")
    return t.where("algo <> ''").join(t.where("algo = ''").select("source", F.col("ecc").alias("base")), "source").select(*KEYS, "source", "ecc", "base")


def eccentricity_distance(ecc: DataFrame, groups: int = 20) -> DataFrame:
    """(KEYS, distance, ratio_min, ratio_max, ratio_mean, ratio_std) of eccentricities(): how far the distribution over `groups` equal
    parts of 0 .. its own largest lies from the original's, and the ratios where the original's is not 0."""
    w = Window.partitionBy(*KEYS)  # as many rows as sources

    def parts(c: str, name: str) -> DataFrame:
        top = ecc.withColumn("n", F.max(c).over(w) + 1).withColumn("all", F.count(F.lit(1)).over(w))
        at = F.ceil((F.col(c) + 1) * groups / F.col("n")) - 1
        return top.groupBy(*KEYS, at.alias("part")).agg((F.count(F.lit(1)) / F.first("all")).alias(name))

    d = parts("ecc", "p").join(parts("base", "q"), [*KEYS, "part"], "full").groupBy(*KEYS).agg(bhattacharyya(F.col("p"), F.col("q")).alias("distance"))
    r = F.when(F.col("base") != 0, F.col("ecc") / F.col("base"))
    s = ecc.groupBy(*KEYS).agg(F.min(r).alias("ratio_min"), F.max(r).alias("ratio_max"), F.avg(r).alias("ratio_mean"), F.stddev_pop(r).alias("ratio_std"))
    return d.join(s, KEYS)


def score_ratios(base: DataFrame, pruned: DataFrame) -> DataFrame:
    """One row: ratio_min, ratio_max, ratio_mean, ratio_std of pruned over base scores (id, score) where base is not 0, and the mean of
    the pruned ones."""
    t = base.withColumnRenamed("score", "b").join(pruned, "id")
    r = F.when(F.col("b") != 0, F.col("score") / F.col("b"))
    return t.agg(F.min(r).alias("ratio_min"), F.max(r).alias("ratio_max"), F.avg(r).alias("ratio_mean"), F.stddev_pop(r).alias("ratio_std"), F.avg("score").alias("mean"))


def sample_pairs(g: Graph, sources: int = 100, targets: int = 1000, seed: int = 7) -> DataFrame:
    """(source, id): hashed sources times up to `targets` hashed other vertices each; both numbers are bounds of the sample."""
    s = g.vertices.orderBy(digest(f"{seed}s", "id"), "id").limit(sources).select(F.col("id").alias("source"))
    t = g.vertices.orderBy(digest(f"{seed}t", "id"), "id").limit(targets)
    return s.join(F.broadcast(t), s["source"] != t["id"])  # at most sources * targets rows
