"""Common neighbours, found once and shared by all similarity scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.graph import Graph, Log, based, keep, keep_counted, ranked, release, tidied

#: Edges that a cell holds, at about 40 bytes each, and wedges looked up at a time.
CELL, WEDGES = 8_000_000, 1 << 21
#: Cells whose wedges common_neighbors() looks up at a time, at least one line of the grid.
ROWS = 8
_MIX = np.uint32(2654435761), np.uint32(2246822519)


@tidied
def triangles(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, triangles) of an undirected graph: vertices (id, deg, rank), edges with du, dv (degrees of both ends) and the
    ranks of their ends, lo < hi, and (a, b, c), a < b < c: each triangle once, by ranks.

    Edges point from lower to higher rank, which is in order of (degree, id), so no vertex has more than about sqrt(2m) ahead and hubs
    do not square. Wedges are not shuffled: edges are dealt to a grid of cells by the residues of both ends, and a vertex sends each
    cell those of its neighbours ahead that may begin and end an edge there. What moves is about 2 * side ints an edge, and a cell
    holds about CELL edges, however large the graph.
    """
    g = based(g)
    v = keep(ranked(g.degrees(), ["deg", "id"]).select("id", "deg", F.col("rank").cast("int").alias("rank")), "order")
    end = lambda *names: v.toDF(*names)
    e = g.edges.join(end("src", "du", "ru"), "src").join(end("dst", "dv", "rv"), "dst")
    e, got = keep_counted(e.select("src", "dst", "w", "du", "dv", F.least("ru", "rv").alias("lo"), F.greatest("ru", "rv").alias("hi")), "ordered")
    side = max(4, math.ceil(math.sqrt(got["rows"] / CELL)))
    return v, e, _closed(_ahead(e, side), side, range(side))


def _ahead(e: DataFrame, side: int) -> DataFrame:
    """(lo, p0, p1, ...): what edges (lo, hi) lead to, by the residue of hi."""
    part = lambda j: F.sort_array(F.collect_list(F.when(F.col("hi") % side == j, F.col("hi")))).alias(f"p{j}")
    return e.where("lo < hi").groupBy("lo").agg(*(part(j) for j in range(side)))


def _closed(ahead: DataFrame, side: int, lines: range) -> DataFrame:
    """(a, b, c) whose b has a residue in lines: those lines of a grid of side * side cells."""
    row = lambda cell, asks, bs, cs: F.struct(cell.cast("int").alias("cell"), F.lit(asks).alias("asks"), F.col("lo").alias("a"), bs.alias("bs"), F.col(cs).alias("cs"))
    at = F.col("lo") % side - lines[0]
    held = [row(at * side + j, False, F.lit(None).cast("array<int>"), f"p{j}") for j in range(side)]
    asked = [row(F.lit((i - lines[0]) * side + j), True, F.col(f"p{i}"), f"p{j}") for i in lines for j in range(side)]
    sent = ahead.select(F.explode(F.array(*held, *asked)).alias("x")).select("x.*").where(F.when(F.col("asks"), F.get("bs", F.lit(0)) < F.get("cs", F.size("cs") - 1)).otherwise(F.size("cs") > 0)).where((F.col("cell") >= 0) & (F.col("cell") < len(lines) * side))
    dealt = sent.repartitionById(len(lines) * side, F.col("cell")).sortWithinPartitions("cell", "asks")
    return dealt.mapInArrow(_cells, "a int, b int, c int")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their cells, first the lists that a cell holds, then those that ask it."""
    cell, parts, index = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(2 * cells + asks)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(cells)]):
            if cells[lo] != cell:
                cell, parts, index = cells[lo], [], None
            a, bs, cs = (batch.column(c).slice(lo, hi - lo) for c in ("a", "bs", "cs"))
            if not asks[lo]:
                parts.append(np.repeat(a.to_numpy().astype(np.int64) << 32, cs.value_lengths().to_numpy()) | cs.flatten().to_numpy())
                continue
            if index is None:
                index, parts = _index(parts), []
            for found in _ends(a.to_numpy(), bs, cs, *index):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in found], ["a", "b", "c"])


def _index(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.uint32]:
    """The edges that a cell holds, sorted, and a table that tells most others apart at one look; see _ends()."""
    keys = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int64)
    bits = min(27, max(10, (16 * len(keys)).bit_length()))
    seen = np.zeros(1 << bits, bool)
    seen[(((keys >> 32).astype(np.uint32) * _MIX[0]) + (keys.astype(np.uint32) * _MIX[1])) >> np.uint32(32 - bits)] = True
    return keys, seen, np.uint32(32 - bits)


def _ends(a: np.ndarray, bs: pa.ListArray, cs: pa.ListArray, keys: np.ndarray, seen: np.ndarray, shift: np.uint32) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, c) for b < c of a row's lists whose edge is among the keys."""
    if not len(keys):
        return
    rows, nb, nc = np.arange(len(a)), bs.value_lengths().to_numpy(), cs.value_lengths().to_numpy()
    bs, cs, row = bs.flatten().to_numpy(), cs.flatten().to_numpy(), np.repeat(rows, nb)
    first = np.searchsorted(np.repeat(rows << 32, nc) | cs, row << 32 | bs, "right")
    n = np.cumsum(nc)[row] - first
    upto, hb, hc = np.cumsum(n), bs.astype(np.uint32) * _MIX[0], cs.astype(np.uint32) * _MIX[1]
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WEDGES, "right")))
        k = n[lo:hi]
        ends = np.cumsum(k)
        at = np.repeat(first[lo:hi] - (ends - k), k)
        at += np.arange(len(at))
        some = np.flatnonzero(seen[(np.repeat(hb[lo:hi], k) + hc[at]) >> shift])
        pair, c = lo + np.searchsorted(ends, some, "right"), cs[at[some]]
        key = bs[pair].astype(np.int64) << 32 | c
        ok = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        if ok.any():
            yield a[row[pair[ok]]], bs[pair[ok]], c[ok]
        lo = hi


@tidied
def common_neighbors(g: Graph) -> DataFrame:
    """edges with du, dv (degrees of both ends) and common (shared neighbours). Kept.

    Triangles are found over the grid of triangles(), a few rows of cells at a time, and counted by edge; then edges get their counts
    a share of the edges at a time. So of what moves only a part is on disk at once. Edges stay as (lo, hi) until then.
    """
    base = based(g)
    v = keep(ranked(base.degrees(), ["deg", "id"]).select("id", "deg", F.col("rank").cast("int").alias("rank")), "order")
    end = lambda *names: v.toDF(*names)
    e = base.edges.join(end("src", "du", "ru"), "src").join(end("dst", "dv", "rv"), "dst")
    e = e.select(F.least("ru", "rv").alias("lo"), F.greatest("ru", "rv").alias("hi"), "w", (F.col("ru") > F.col("rv")).alias("turned"))
    e, got = keep_counted(e.sortWithinPartitions("lo", "hi"), "ordered")
    if base is not g:
        release(base.edges)
    side = max(4, math.ceil(math.sqrt(got["rows"] / CELL)))
    ahead, counts, out = keep(_ahead(e, side), "ahead"), Log(g.spark, "counts"), Log(g.spark, "common")
    pair = lambda x, y: F.struct(F.col(x).alias("lo"), F.col(y).alias("hi"))
    some = max(1, ROWS // side)
    for first in range(0, side, some):
        t = _closed(ahead, side, range(first, min(side, first + some)))
        t = t.select(F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("e")).groupBy("e.lo", "e.hi").agg(F.count(F.lit(1)).alias("common"))
        counts.append(t.sortWithinPartitions("lo", "hi"))
    release(ahead)
    for share in range(side):
        own = lambda d: d.where(F.col("lo") % side == share)  # noqa: B023, E731
        n = own(counts.all()).groupBy("lo", "hi").agg(F.sum("common").alias("common"))
        t = own(e).join(n, ["lo", "hi"], "left").join(own(end("a", "da", "lo")), "lo").join(end("b", "db", "hi"), "hi")
        ends = [F.when(F.col("turned"), F.col(y)).otherwise(F.col(x)).alias(c) for c, x, y in (("src", "a", "b"), ("dst", "b", "a"), ("du", "da", "db"), ("dv", "db", "da"))]
        out.append(t.select(*ends[:2], "w", *ends[2:], F.coalesce("common", F.lit(0)).cast("long").alias("common")))
    return out.all()


def jaccard(g: Graph, common: DataFrame | None = None) -> DataFrame:
    """common: common_neighbors(g), if they are there already."""
    return (common_neighbors(g) if common is None else common).withColumn("score", F.col("common") / (F.col("du") + F.col("dv") - F.col("common")))


def scan_similarity(g: Graph, common: DataFrame | None = None) -> DataFrame:
    """Structural similarity of closed neighbourhoods. common: as for jaccard()."""
    return (common_neighbors(g) if common is None else common).withColumn("score", (F.col("common") + 2) / F.sqrt(((F.col("du") + 1) * (F.col("dv") + 1)).cast("double")))
