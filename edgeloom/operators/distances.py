"""Shortest distances from many sources, and what rests on them: farness bounds, neighbourhood sketches."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.graph import Graph, Log, adjacency, by_cell, grid, keep, keep_counted, ranked, release, tidied


def packed(sources: DataFrame, wide: int = 64) -> DataFrame:
    """(word, sources): the different sources in order, `wide` a word; the place in a word is the bit that stands for a source. Kept."""
    t = ranked(sources.select("source").distinct(), ["source"]).select("source", (F.col("rank") - 1).alias("nth"))
    own = F.sort_array(F.collect_list(F.struct("nth", "source")))["source"]
    return keep(t.groupBy(F.expr(f"cast(nth div {wide} as int)").alias("word")).agg(own.alias("sources")), "sources")


def unpacked(t: DataFrame, words: DataFrame) -> DataFrame:
    """t (word, bits and more) with a row for each source instead. words: packed(); 8 bytes a source are broadcast."""
    more = [c for c in t.columns if c not in ("word", "bits")]
    each = t.join(F.broadcast(words), "word").select(*more, "bits", F.posexplode("sources").alias("_at", "source"))
    return each.where(F.expr("shiftright(bits, _at) & 1L = 1L")).select("source", *more)


def levels(adj: DataFrame, words: DataFrame, directed: bool, depth: int | None = None) -> Log:
    """(word, id, bits, dist): hops, a part a level, each (source, id) in one of them; a row tells of up to 64 sources. adj: adjacency
    (src, dst); words: packed() sources.

    In an undirected graph neighbours are at most a level apart, so what a level reaches is compared with the last two levels only.
    """
    log = Log(adj.sparkSession, "levels")
    front = log.append(words.select("word", F.posexplode("sources").alias("_at", "id")).select("word", "id", F.expr("shiftleft(1L, _at)").alias("bits"), F.lit(0).alias("dist")))
    while log.rows and (depth is None or len(log.parts) <= depth):
        step = front.join(adj, front["id"] == adj["src"]).select("word", F.col("dst").alias("id"), "bits", F.lit(0).cast("long").alias("had"))
        known = (log.all() if directed else log.last(2)).select("word", "id", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("had"))
        both = step.unionByName(known).groupBy("word", "id").agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"))
        front = log.append(both.select("word", "id", F.expr("bits & ~had").alias("bits"), F.lit(len(log.parts)).alias("dist")).where("bits <> 0"))
    return log


@tidied
def hop_distances(g: Graph, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, id, dist double): hops from each source (source long) along edges."""
    words = packed(sources)
    adj = adjacency(g.both().select("src", "dst").where("src <> dst"))
    return unpacked(levels(adj, words, g.directed, depth).all(), words).select("source", "id", F.col("dist").cast("double").alias("dist"))


#: Sources whose weighted distances stand in one row, a column each.
WAYS = 16
_WAY = [f"d{k}" for k in range(WAYS)]


@tidied
def weighted_distances(g: Graph, sources: DataFrame) -> DataFrame:
    """(source, id, dist): weighted distances from each source (source long) along edges; weights are not negative.

    A row tells of 16 sources, and edges lie in a grid of cells within which the least of what they bring is taken, so what is shuffled
    grows with sources times vertices, not edges. A round follows the edges of what the last one improved, and writes what it improves;
    there are as many rounds as the least ways have edges at most.
    """
    e, size = keep_counted(g.both().where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("len")), "lengths", least=F.min("len"))
    if size["least"] is not None and size["least"] < 0:
        raise ValueError("a weight is negative")
    words, cells = packed(sources, WAYS), grid(e, more=("len",))
    least = [F.min(c).alias(c) for c in _WAY]
    log = Log(g.spark, "ways")
    front = log.append(words.select("word", F.posexplode("sources").alias("_at", "id")).select("word", "id", *(F.when(F.col("_at") == k, 0.0).alias(c) for k, c in enumerate(_WAY))))
    with by_cell(g.spark):
        while log.rows:
            step = keep(cells.ahead(front, "len").groupBy("word", "id").agg(*(F.min(F.col(c) + F.col("len")).alias(c) for c in _WAY)), "reached")
            had = log.all().join(step.select("word", "id"), ["word", "id"], "left_semi").groupBy("word", "id").agg(*(F.min(c).alias(f"had_{c}") for c in _WAY))
            better = [F.when(F.col(f"had_{c}").isNull() | (F.col(c) < F.col(f"had_{c}")), F.col(c)).alias(c) for c in _WAY]
            front = log.append(step.join(had, ["word", "id"], "left").select("word", "id", *better).where(F.coalesce(*_WAY).isNotNull()))
            release(step)
    t = keep(log.all().groupBy("word", "id").agg(*least), "distances")
    each = t.join(F.broadcast(words), "word").select("id", "sources", F.posexplode(F.array(*_WAY)).alias("_at", "dist"))  # 8 bytes a source
    return each.where("dist is not null").select(F.col("sources")[F.col("_at")].alias("source"), "id", "dist")


@tidied
def delta_stepping(g: Graph, sources: DataFrame, delta: float | None = None) -> DataFrame:
    """(source, id, dist): weighted distances from each source (source long) along edges; weights are not negative.

    Distances are settled in buckets of width delta (default: four mean weights, as a bucket costs a few jobs). Within a bucket only light edges (up to delta) are
    relaxed, round by round, from what the last round improved; then the bucket is settled and its heavy edges are relaxed, whose
    ends lie in later buckets. Settled rows are written once; open ones wait, as candidates, in the part of their bucket. In an
    undirected graph a settled vertex is met again only from buckets that lie within the largest weight, so a round reads as many.
    """
    e, size = keep_counted(g.both().where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("len")), "lengths", mean=F.avg("len"), most=F.max("len"), least=F.min("len"))
    if size["least"] is not None and size["least"] < 0:
        raise ValueError("a weight is negative")
    delta = float(delta or 4 * (size["mean"] or 0.0) or 1.0)
    light = adjacency(e.where(F.col("len") <= delta), name="light")
    any_heavy = (size["most"] or 0.0) > delta
    heavy = adjacency(e.where(F.col("len") > delta), name="heavy") if any_heavy else None
    back = 2 * math.ceil((size["most"] or 0.0) / delta) + 2
    bucket = F.floor(F.col("dist") / F.lit(delta))
    waiting: dict[int, list[DataFrame]] = {}
    settled, at = Log(g.spark, "settled"), []

    def wait(found: DataFrame) -> None:
        t, got = keep_counted(found.groupBy("source", "id").agg(F.min("dist").alias("dist")).withColumn("bucket", bucket), "candidates", buckets=F.collect_set("bucket"))
        for b in got["buckets"]:  # a number a bucket
            waiting.setdefault(b, []).append(t.where(F.col("bucket") == b).select("source", "id", "dist"))

    def relax(front: DataFrame, edges: DataFrame) -> DataFrame:
        return front.join(edges, front["id"] == edges["src"]).select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("len")).alias("dist"))

    def best(t: DataFrame) -> DataFrame:
        return t.groupBy("source", "id").agg(F.min("dist").alias("dist"))

    wait(sources.select("source", F.col("source").alias("id"), F.lit(0.0).alias("dist")).distinct())
    while waiting:
        now = min(waiting)
        cands = waiting.pop(now)
        first = cands[0]
        for more in cands[1:]:
            first = first.unionByName(more)
        near = [k for k, b in enumerate(at) if g.directed or b >= now - back]
        old = settled.spark.read.schema(settled.schema).parquet(*(settled.parts[k] for k in near)).select("source", "id") if near else None
        fresh = lambda t: t if old is None else t.join(old, ["source", "id"], "left_anti")  # noqa: B023, E731
        own = Log(g.spark, "bucket")
        front = own.append(fresh(best(first)))
        while own.rows:
            step, got = keep_counted(best(relax(front, light)).withColumn("bucket", bucket), "relaxed", latest=F.max("bucket"))
            if (got["latest"] or 0) > now:
                wait(step.where(F.col("bucket") > now).drop("bucket"))
            have = best(own.all()).withColumnRenamed("dist", "had")
            inside = step.where(F.col("bucket") <= now).drop("bucket").join(have, ["source", "id"], "left").where("had is null or dist < had").drop("had")
            front = own.append(fresh(inside))
            release(step)
        if not any(x["rows"] for x in own.sums):
            continue
        at.append(now)
        done = settled.append(best(own.all()))
        if any_heavy:
            wait(relax(done, heavy))
    return settled.all()


@tidied
def top_closeness(g: Graph, k: int, slack: float = 1e-8, batch: int | None = None, count: list | None = None) -> DataFrame:
    """(id, score): the vertices whose closeness is among the k largest, and those within slack of the k-th; see traverse.closeness().

    Sources are searched in batches, most promising first. Of a source that has searched d levels, what is farther lies at d + 1 at
    least, and of that no more at d + 1 than the last level's degrees allow; the rest at d + 2. That bounds its farness from below and
    its score from above. A source whose bound falls under the k-th best score so far is dropped, and the search ends with the first
    batch of which none is left. count: takes the number of (source, vertex) rows made.

    The number of vertices that a source reaches is its component's in an undirected graph; in a directed one it may be anything up
    to that, and the bound is the larger of the two ends', as it is convex in between.
    """
    from edgeloom.operators.traverse import connected_components

    adj = adjacency(g.both().select("src", "dst").where("src <> dst").distinct())
    n = g.vertices.count()
    comp = connected_components(g)
    size = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("most"))
    deg = g.vertices.join(adj.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    back = 0 if g.directed else 1  # in an undirected graph each vertex but the source has an edge to the level before
    deg = keep(deg.withColumn("on", F.greatest(F.col("deg") - back, F.lit(0))), "degrees")

    def bound(d: Column | int, reached: Column, far: Column, on: Column, most: Column) -> Column:
        def end(r: Column) -> Column:
            rest = F.greatest(r - reached, F.lit(0))
            next_ = F.least(rest, on)
            total = far + (d + 1) * next_ + (d + 2) * (rest - next_)
            return F.when(total > 0, (r - 1) * (r - 1) / total / F.lit(max(n - 1, 1))).otherwise(0.0)

        return F.greatest(end(most), end(reached)) if g.directed else end(most)

    ahead = adj.join(deg.select(F.col("id").alias("dst"), "on"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("on").alias("ahead"))
    start = deg.join(comp, "id").join(size, "comp").join(ahead, "id", "left").select("id", "most", bound(1, F.col("deg") + 1, F.col("deg"), F.coalesce("ahead", F.lit(0)), F.col("most")).alias("bound"))
    order = keep(ranked(start, [F.desc("bound"), "id"]).select("id", "most", "bound", "rank"), "order")
    done, kth, lo, width, made = Log(g.spark, "scores"), -1.0, 0, batch or max(k, 16), 0
    while lo < n:
        todo = order.where((F.col("rank") > lo) & (F.col("rank") <= lo + width) & (F.col("bound") >= kth - slack))
        state, got = keep_counted(todo.select(F.col("id").alias("source"), "most", F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("far")), "state")
        if not got["rows"]:
            break
        log = Log(g.spark, "search")
        front = log.append(state.select("source", F.col("source").alias("id")))
        d = 0
        while True:
            level = front.join(deg, "id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("on").alias("on"))
            new = state.join(level, "source", "left").select("source", "most", (F.col("reached") + F.coalesce("n", F.lit(0))).alias("reached"), (F.col("far") + d * F.coalesce("n", F.lit(0))).alias("far"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("on", F.lit(0)).alias("on"))
            ended = (F.col("n") == 0) | (F.col("reached") == F.col("most"))
            last, (state, got) = state, keep_counted(new, "state", made=F.sum("n"), ended=F.count(F.when(ended, 1)))
            release(last)
            made += got["made"] or 0
            if got["ended"]:
                r = F.col("reached") - 1
                done.append(state.where(ended).select(F.col("source").alias("id"), F.when(F.col("far") > 0, r / F.col("far") * r / F.lit(max(n - 1, 1))).otherwise(0.0).alias("score")))
                best = done.all().orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count(F.lit(1))).first()  # k rows
                kth = best[0] if best[1] == k else -1.0
            on = F.col("on") + (back if d == 0 else 0)
            state = state.where(~ended & (bound(d, F.col("reached"), F.col("far"), on, F.col("most")) >= kth - slack)).select("source", "most", "reached", "far")
            if got["ended"] == got["rows"] or not state.limit(1).count():
                break
            d += 1
            alive = front.join(state.select("source"), "source", "left_semi")
            step = alive.join(adj, alive["id"] == adj["src"]).select("source", F.col("dst").alias("id")).distinct()
            front = log.append(step.join(log.all() if g.directed else log.last(2), ["source", "id"], "left_anti"))
        lo, width = lo + width, 2 * width
    if count is not None:
        count.append(made)
    if not done.parts:
        return g.vertices.select("id", F.lit(0.0).alias("score")).limit(0)
    return done.all().where(F.col("score") >= kth - slack)


#: Registers of a slice of a sketch; vertices whose slices stand in one row; edges of a cell; vertices of a block at most.
SLICE, CHUNK, CELL, BLOCK = 512, 4096, 8_000_000, 1 << 19


def _cardinality(zeros: np.ndarray, inverse: np.ndarray, m: int) -> np.ndarray:
    """Ertl's estimate from each sketch's number of registers at 0 and the sum of 2^-register over the others; m registers."""
    x, y = zeros / m, 1.0
    with np.errstate(divide="ignore"):
        z = x.copy()
        for _ in range(64):
            x = x * x
            z, y = z + x * y, 2 * y
        return m * m / (2 * math.log(2)) / (m * np.where(zeros == m, np.inf, z) + inverse)


def _put(acc: np.ndarray, regs: np.ndarray, src: np.ndarray, dst: np.ndarray, join: np.ufunc = np.maximum) -> None:
    """acc[dst] becomes the larger of itself and regs[src], or what join makes of them; edges are sorted by dst. Rows of one dst are halved
    until one is left."""
    for lo in range(0, len(src), 1 << 15):
        d, rows = dst[lo : lo + (1 << 15)], regs[src[lo : lo + (1 << 15)]]
        while True:
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            nth = np.arange(len(d)) - np.repeat(first, np.diff(np.r_[first, len(d)]))
            odd = np.flatnonzero(nth % 2)
            if not len(odd):
                break
            rows[odd - 1] = join(rows[odd - 1], rows[odd])
            even = np.flatnonzero(nth % 2 == 0)
            d, rows = d[even], rows[even]
        acc[d] = join(acc[d], rows)


def _table(like: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(like), like)], schema=like)


def _cells(g: Graph, v: DataFrame, n: int) -> tuple[DataFrame, int, int]:
    """(cell, regs): the edges from one block of vertices to another, as bytes; side, the number of blocks, and the number of edges. v: the n
    vertices (id, nth); the block is what is left of nth by side."""
    ends = g.both().select("src", "dst").where("src <> dst")
    ends = ends.join(v.select(F.col("id").alias("dst"), F.col("nth").alias("a")), "dst").join(v.select(F.col("id").alias("src"), F.col("nth").alias("b")), "src")
    ends, got = keep_counted(ends.select("a", "b"), "ends")
    side = max(1, math.ceil(math.sqrt(got["rows"] / CELL)), math.ceil(n / BLOCK))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        """Edges of a part of a cell, sorted by their ends: places of their vertices in the blocks, as bytes."""
        a, b = (t[c].to_numpy() // side for c in ("a", "b"))
        o = np.lexsort((a, b))
        return _table(packs, [(key[0].as_py(), np.r_[a[o], b[o]].astype("<i4").tobytes())])

    packs = pa.schema([("cell", pa.int32()), ("regs", pa.binary())])
    cell = (F.pmod("a", F.lit(side)) * side + F.pmod("b", F.lit(side))).cast("int").alias("cell")
    edges = keep(ends.select(cell, "a", "b", F.expr(f"cast(b div {side} div {CHUNK} as int)").alias("_to")).groupBy("cell", "_to").applyInArrow(pack, "cell int, regs binary"), "edges")
    release(ends)
    return edges, side, got["rows"]


@tidied
def neighbourhood(g: Graph, log_k: int = 12, tolerance: float = 1e-4, enough: float | None = None) -> DataFrame:
    """(hops, pairs): how many ordered pairs of vertices, each with itself too, lie within so many hops; estimated.

    Every vertex has a sketch of what it reaches (HyperLogLog, 2^log_k registers of a byte), which grows by its neighbours' sketches, a
    round a hop; no pairs are made. Ends when a round adds less than tolerance, or with enough: when that share of the pairs of different
    vertices is reached that there would be if each vertex reached all.

    Registers grow apart from one another. So a task takes a slice of them for a cell of edges: the edges from one block of vertices to
    another. There are side * side cells of about CELL edges, so a sketch is sent side times and comes back side times, however many
    edges a vertex has and however many tasks there are.
    """
    m = 1 << log_k
    wide = min(m, SLICE)
    h = F.xxhash64("id", F.lit(log_k))
    rest = F.shiftrightunsigned(h, log_k)
    zeros = 65 - log_k - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    v = ranked(g.vertices.select("id").distinct(), ["id"]).select("id", (F.col("rank") - 1).alias("nth"), F.pmod(h, F.lit(m)).cast("int").alias("register"), zeros.cast("int").alias("value"))
    v, got = keep_counted(v, "numbered")
    n = got["rows"]
    if not n:
        return g.spark.createDataFrame([(0, 0.0)], "hops int, pairs double")
    edges, side, _ = _cells(g, v, n)
    size = [len(range(k, n, side)) for k in range(side)]

    def start(key: tuple, t: pa.Table) -> pa.Table:
        block, chunk = (k.as_py() for k in key)
        regs = np.zeros((min(CHUNK, size[block] - chunk * CHUNK), m), np.uint8)
        regs[t["nth"].to_numpy() // side - chunk * CHUNK, t["register"].to_numpy()] = t["value"].to_numpy()
        return _table(states, [(block, chunk, k, *told(regs[:, k * wide : (k + 1) * wide])) for k in range(m // wide)])

    def told(regs: np.ndarray) -> tuple[bytes, bytes, bytes]:
        none = (regs == 0).sum(1)
        return regs.tobytes(), none.astype("<f8").tobytes(), (powers[regs].sum(1) - none).astype("<f8").tobytes()

    powers = np.ldexp(1.0, -np.arange(256))
    states = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("slice", pa.int32()), ("regs", pa.binary()), ("none", pa.binary()), ("inverse", pa.binary())])
    state = "block int, chunk int, slice int, regs binary, none binary, inverse binary"

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        """(block, chunk, slice, regs): what the edges of a cell bring to its second block, for one slice."""
        at, one = divmod(key[0].as_py(), side), key[1].as_py()
        regs = np.zeros((size[at[0]], wide), np.uint8)
        chunks, blobs = t["chunk"].to_pylist(), t["regs"]
        for k, c in enumerate(chunks):
            if c is not None:
                x = np.frombuffer(blobs[k].as_buffer(), np.uint8).reshape(-1, wide)
                regs[c * CHUNK : c * CHUNK + len(x)] = x
        acc = regs.copy() if at[0] == at[1] else np.zeros((size[at[1]], wide), np.uint8)
        for k, c in enumerate(chunks):
            if c is None:
                e = np.frombuffer(blobs[k].as_buffer(), "<i4").reshape(2, -1)
                _put(acc, regs, e[0], e[1])
        return _table(sent, [(at[1], c, one, acc[c * CHUNK : (c + 1) * CHUNK].tobytes()) for c in range(-(-len(acc) // CHUNK))])

    sent = pa.schema(list(states)[:4])

    def most(key: tuple, t: pa.Table) -> pa.Table:
        got = [np.frombuffer(x.as_buffer(), np.uint8) for x in t["regs"]]
        return _table(states, [(*(k.as_py() for k in key), *told(np.maximum.reduce(got).reshape(-1, wide)))])

    def count(key: tuple, t: pa.Table) -> pa.Table:
        none, inverse = (sum(np.frombuffer(x.as_buffer(), "<f8") for x in t[c]) for c in ("none", "inverse"))
        return pa.table({"pairs": [float(_cardinality(none, inverse, m).sum())]})

    def pairs(t: DataFrame) -> float:
        return t.select("block", "chunk", "none", "inverse").groupBy("block", "chunk").applyInArrow(count, "pairs double").agg(F.sum("pairs")).first()[0]

    whole = np.zeros(m, np.uint8)
    for r in v.groupBy("register").agg(F.max("value").alias("value")).collect():  # a number a register
        whole[r.register] = r.value
    none = float((whole == 0).sum())
    every = n * float(_cardinality(np.array([none]), np.array([powers[whole].sum() - none]), m)[0])
    first = v.select(F.pmod("nth", F.lit(side)).cast("int").alias("block"), F.expr(f"cast(nth div {side} div {CHUNK} as int)").alias("chunk"), "nth", "register", "value")
    own = keep(first.groupBy("block", "chunk").applyInArrow(start, state), "sketches")
    slices = F.explode(F.sequence(F.lit(0), F.lit(m // wide - 1))).alias("slice")
    rows, hop = [], 0
    while True:
        total = pairs(own)
        if rows and total <= rows[-1][1] * (1 + tolerance):
            break
        rows.append((hop, total))
        if enough is not None and total - rows[0][1] >= enough * (every - rows[0][1]):
            break
        hop += 1
        to = F.explode(F.sequence(F.col("block") * side, F.col("block") * side + side - 1)).alias("cell")
        both = own.select(to, "slice", "chunk", "regs").unionByName(edges.select("cell", slices, F.lit(None).cast("int").alias("chunk"), "regs"))
        new = both.groupBy("cell", "slice").applyInArrow(meet, "block int, chunk int, slice int, regs binary")
        last, own = own, keep(new.groupBy("block", "chunk", "slice").applyInArrow(most, state), "sketches")
        release(last)
    return g.spark.createDataFrame(rows, "hops int, pairs double")


#: Words of 64 sources that a task takes at most; bytes on disk of the slices that are followed at a time.
WORDS, AT_ONCE = 64, 1 << 30


@tidied
def hops_of_share(g: Graph, share: float) -> int | None:
    """The least number of hops within which `share` of the pairs of different vertices lie; g is connected. None without vertices.

    Every vertex has a bit for each source that reaches it. Sources are cut into slices, of which a few are followed at a time, so what is on
    disk does not grow with the square of the vertices. A task takes one slice for a cell of edges, see neighbourhood(), and follows the
    edges of vertices that the last hop brought something.
    """
    v, got = keep_counted(ranked(g.vertices.select("id").distinct(), ["id"]).select("id", (F.col("rank") - 1).alias("nth")), "numbered")
    n = got["rows"]
    if not n:
        return None
    edges, side, m = _cells(g, v, n)
    size = [len(range(k, n, side)) for k in range(side)]
    words = -(-n // 64)
    wide = min(WORDS, max(16, -(-words // int(g.spark.conf.get("spark.sql.shuffle.partitions")))))
    some = max(1, AT_ONCE // (8 * (wide * n * (2 * side + 3) + m)))
    states = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("slice", pa.int32()), ("regs", pa.binary()), ("fresh", pa.binary()), ("new", pa.int32()), ("pairs", pa.int64())])
    state = "block int, chunk int, slice int, regs binary, fresh binary, new int, pairs long"

    def told(key: list, bits: np.ndarray, had: np.ndarray | int) -> pa.Table:
        fresh = (bits != had).any(1)
        return _table(states, [(*key, bits.tobytes(), fresh.tobytes(), int(fresh.sum()), int(np.bitwise_count(bits).sum()))])

    def start(key: tuple, t: pa.Table) -> pa.Table:
        block, chunk, one = (k.as_py() for k in key)
        bits, nth = np.zeros((min(CHUNK, size[block] - chunk * CHUNK), wide), np.uint64), t["nth"].to_numpy()
        bits[nth // side - chunk * CHUNK, nth // 64 - one * wide] = np.uint64(1) << (nth % 64).astype(np.uint64)
        return told([block, chunk, one], bits, 0)

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        """(block, chunk, slice, regs): what the edges of a cell bring to its second block, for one slice."""
        at, one = divmod(key[0].as_py(), side), key[1].as_py()
        bits, acc = (np.zeros((size[at[k]], wide), np.uint64) for k in (0, 1))
        fresh, chunks, blobs, marks = np.zeros(size[at[0]], bool), t["chunk"].to_pylist(), t["regs"], t["fresh"]
        for k, c in enumerate(chunks):
            if c is not None:
                x = np.frombuffer(blobs[k].as_buffer(), np.uint64).reshape(-1, wide)
                bits[c * CHUNK : c * CHUNK + len(x)], fresh[c * CHUNK : c * CHUNK + len(x)] = x, np.frombuffer(marks[k].as_buffer(), bool)
        for k, c in enumerate(chunks):
            if c is None:
                e = np.frombuffer(blobs[k].as_buffer(), "<i4").reshape(2, -1)
                e = e[:, fresh[e[0]]]
                _put(acc, bits, e[0], e[1], np.bitwise_or)
        parts = ((c, acc[c * CHUNK : (c + 1) * CHUNK]) for c in range(-(-len(acc) // CHUNK)))
        return _table(sent, [(at[1], c, one, x.tobytes()) for c, x in parts if x.any()])

    sent = pa.schema(list(states)[:4])

    def join(key: tuple, t: pa.Table) -> pa.Table:
        """What a chunk has had, which is the row with fresh if there is one, and what has come to it."""
        got = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, wide) for x in t["regs"]]
        had = [x for x, f in zip(got, t["fresh"]) if f.is_valid]
        return told([k.as_py() for k in key], np.bitwise_or.reduce(got), had[0] if had else 0)

    pairs = F.sum("pairs")
    near = [0]  # pairs by hops, each vertex with itself too
    for first in range(0, words, some * wide):
        own = v.where(f"nth div 64 >= {first} and nth div 64 < {first + some * wide}")
        own = own.select(F.pmod("nth", F.lit(side)).cast("int").alias("block"), F.expr(f"cast(nth div {side} div {CHUNK} as int)").alias("chunk"), F.expr(f"cast(nth div 64 div {wide} as int)").alias("slice"), "nth")
        own, got = keep_counted(own.groupBy("block", "chunk", "slice").applyInArrow(start, state), "reached", pairs=pairs)
        hop, total, every = 0, got["pairs"], n * (min(n, 64 * (first + some * wide)) - 64 * first)
        near[0] += total
        while total < every:
            hop += 1
            ahead = own.where("new > 0").select(F.explode(F.sequence(F.col("block") * side, F.col("block") * side + side - 1)).alias("cell"), "slice", "chunk", "regs", "fresh")
            asked = ahead.select("cell", "slice").distinct()  # a row a cell and slice at most
            both = ahead.unionByName(edges.join(F.broadcast(asked), "cell").select("cell", "slice", F.lit(None).cast("int").alias("chunk"), "regs", F.lit(None).cast("binary").alias("fresh")))
            come = both.groupBy("cell", "slice").applyInArrow(meet, "block int, chunk int, slice int, regs binary").withColumn("fresh", F.lit(None).cast("binary"))
            last, (own, got) = own, keep_counted(own.select(*come.columns).unionByName(come).groupBy("block", "chunk", "slice").applyInArrow(join, state), "reached", pairs=pairs)
            release(last)
            if got["pairs"] == total:
                raise ValueError("the graph is not connected")
            near += [0] * (hop + 1 - len(near))
            near[hop] += got["pairs"] - total
            total = got["pairs"]
        release(own)
    reached = itertools.accumulate(near)
    return next(hop for hop, x in enumerate(reached) if float(x - n) >= share * float(n * n - n))


@tidied
def effective_diameter(g: Graph, share: float = 0.9, sketched: bool = False, log_k: int = 12) -> DataFrame:
    """One row: the least number of hops within which `share` of the pairs of different vertices of the largest component lie.

    Exact from all vertices as sources, or sketched, without pairs, for any size. A single vertex: 0. No vertices: null.
    """
    from edgeloom.operators.traverse import largest_component

    big = largest_component(g)
    big = Graph(big.vertices, big.edges.select("src", "dst", "w"))
    if sketched:
        return neighbourhood(big, log_k, enough=share).where("pairs > 0").agg(F.max("hops").cast("double").alias("effective_diameter"))
    hops = hops_of_share(big, share)
    return g.spark.createDataFrame([(None if hops is None else float(hops),)], "effective_diameter double")
