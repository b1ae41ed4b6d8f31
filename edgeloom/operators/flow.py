"""Algorithms that follow one path at a time: flows, cuts, spanners.

They have no relational form. Each runs on one graph that a single task can hold; many variants or pairs run in parallel tasks.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.rng import digest
from edgeloom.graph import Graph


def _max_flow(src: np.ndarray, dst: np.ndarray, cap: np.ndarray, s: int, t: int) -> float:
    """Dinic's algorithm: breadth-first levels, blocking flows by an explicit stack."""
    head: dict[int, list[int]] = {}
    to, left = [], []
    for u, v, c in zip(src.tolist(), dst.tolist(), cap.tolist()):
        for a, b, x in ((u, v, c), (v, u, 0.0)):
            head.setdefault(a, []).append(len(to))
            to.append(b)
            left.append(x)
    total = 0.0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for i in head.get(u, ()):
                if left[i] > 1e-12 and to[i] not in level:
                    level[to[i]] = level[u] + 1
                    queue.append(to[i])
        if t not in level:
            return total
        at = dict.fromkeys(level, 0)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(left[i] for i in path)
                for i in path:
                    left[i] -= push
                    left[i ^ 1] += push
                total += push
                path, u = [], s
                continue
            while at[u] < len(head.get(u, ())):
                i = head[u][at[u]]
                if left[i] > 1e-12 and level.get(to[i]) == level[u] + 1:
                    break
                at[u] += 1
            else:
                if not path:
                    break
                i = path.pop()
                u = to[i ^ 1]
                at[u] += 1
                continue
            path.append(i)
            u = to[i]


def max_flow(g: Graph, pairs: DataFrame, salt: int = 64) -> DataFrame:
    """(s, t, flow) for each pair: the largest flow, which is also the smallest cut between the two.

    pairs is a bounded sample; each bucket of pairs gets the edges once and is one task.
    """
    p = pairs.select(F.col("s").alias("u"), F.col("t").alias("v"), F.lit(None).cast("double").alias("w"), F.pmod(F.xxhash64("s", "t"), F.lit(salt)).alias("k"))
    used = p.select("k").distinct()
    e = g.both().select(F.col("src").alias("u"), F.col("dst").alias("v"), "w").join(F.broadcast(used))  # at most `salt` rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf.w.isna()], pdf[~pdf.w.isna()]
        out = [(u, v, _max_flow(r.u.to_numpy(), r.v.to_numpy(), r.w.to_numpy(), u, v)) for u, v in zip(q.u, q.v) if u != v]
        return pd.DataFrame(out, columns=["s", "t", "flow"])

    return e.select("u", "v", "w", "k").unionByName(p).groupBy("k").applyInPandas(run, "s long, t long, flow double")


def global_min_cut(variants: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cut): the smallest cut of each undirected variant, by Stoer and Wagner; 0 if it is not connected."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf.src, pdf.dst])
        m = np.zeros((len(ids), len(ids)))
        a, b = np.searchsorted(ids, pdf.src), np.searchsorted(ids, pdf.dst)
        np.add.at(m, (a, b), pdf.w)
        np.add.at(m, (b, a), pdf.w)
        np.fill_diagonal(m, 0)
        best, left = np.inf, list(range(len(ids)))
        while len(left) > 1:
            weight, order = m[np.ix_(left, left)], [0]
            w = weight[0].copy()
            w[0] = -np.inf
            while len(order) < len(left):
                nxt = int(np.argmax(w))
                last = w[nxt]
                order.append(nxt)
                w += weight[nxt]
                w[order] = -np.inf
            best = min(best, last)
            s, t = left[order[-2]], left[order[-1]]
            m[s] += m[t]
            m[:, s] += m[:, t]
            m[s, s] = 0
            left.remove(t)
        return pd.DataFrame([(*key, float(best))], columns=[*keys, "cut"])

    fields = ", ".join(f"{k} {variants.schema[k].dataType.simpleString()}" for k in keys)
    return variants.groupBy(*keys).applyInPandas(run, f"{fields}, cut double")


def greedy_spanner(g: Graph, t: int, seed: int = 7) -> DataFrame:
    """edges of the greedy t-spanner in hashed order: an edge stays unless the ends are within t hops in the edges that stayed.

    Components are independent, so each is a task; within one the order is what defines the result.
    """
    from edgeloom.operators.traverse import connected_components

    comp = connected_components(g)
    e = g.edges.withColumn("h", digest(seed, "src", "dst")).join(comp.select(F.col("id").alias("src"), "comp"), "src")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        kept = []
        pdf = pdf.sort_values(["h", "src", "dst"])
        for u, v, w in zip(pdf.src, pdf.dst, pdf.w):
            ends = [{u}, {v}]
            seen = [{u}, {v}]
            for _ in range(t):  # from both ends, always the smaller frontier
                i = 0 if len(ends[0]) <= len(ends[1]) else 1
                ends[i] = {y for x in ends[i] for y in near.get(x, ())} - seen[i]
                seen[i] |= ends[i]
                if not ends[i] or ends[i] & seen[1 - i]:
                    break
            if not ends[i] & seen[1 - i]:
                near.setdefault(u, []).append(v)
                near.setdefault(v, []).append(u)
                kept.append((u, v, w))
        return pd.DataFrame(kept, columns=["src", "dst", "w"])

    return e.groupBy("comp").applyInPandas(run, "src long, dst long, w double")
