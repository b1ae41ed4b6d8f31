"""A sweep: every algorithm at every rate as one table of variants, evaluated in grouped plans."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.graph import Graph, based, canonical, keep
from edgeloom.operators import flow, linalg, sparsify, traverse
from edgeloom.operators.neighbors import common_neighbors
from edgeloom.plans.summary import union_rows, with_prune_rate

RATES = [round(0.1 * i, 1) for i in range(1, 10)]
#: What algorithms without a target rate are run with: neighbours, exponents, stretches, accuracies.
GRIDS: dict[str, list] = {"k_neighbor": [1, 2, 5, 8, 12, 17, 24, 33, 47, 70], "lspar": [0.15, 0.3, 0.45, 0.6, 0.75, 0.9], "spanner": [3, 5, 7], "er": [0.1, 0.25, 0.7, 2.5]}
#: Algorithms that rank edges once and are cut at every rate.
RANKED = {"gspar": sparsify.g_spar, "scan": sparsify.scan, "local_degree": sparsify.local_degree, "local_similarity": sparsify.local_similarity}
#: Algorithms that rest on common neighbours.
SIMILAR = {"gspar", "scan", "local_similarity", "lspar"}
RANDOM = {"random", "k_neighbor", "rank_degree", "forest_fire", "er"}
ALGORITHMS = sorted([*RANKED, *RANDOM, "lspar", "spanner", "spanning_forest"])


def _measured(edges: DataFrame, algo: str, m: int, run: int) -> DataFrame:
    """A variant whose rate is what it came to, half-even to two digits; kept, since it is counted first."""
    e = keep(edges.select("src", "dst", "w"), algo)
    return e.select("*", F.lit(algo).alias("algo"), F.lit(round(1 - e.count() / max(m, 1), 2)).alias("prune_rate"), F.lit(run).alias("run"))


def sweep(g: Graph, algos: list[str], rates: list[float] | float = RATES, runs: int = 1, grids: dict[str, list] | None = None, dense: int = linalg.DENSE) -> DataFrame:
    """Variants (src, dst, w, algo, prune_rate, run) of the named ALGORITHMS; random ones run several times, others once.

    Algorithms with a target take the rates; the others take their grid, and their rate is what it came to. Forests and spanners are of
    the undirected graph. dense: up to so many vertices resistances are exact.
    """
    rates, grids = rates if isinstance(rates, list) else [rates], GRIDS | (grids or {})
    if unknown := set(algos) - set(ALGORITHMS):
        raise ValueError(f"unknown algorithms {sorted(unknown)}; known: {ALGORITHMS}")
    g = based(g)
    plain = g if not g.directed else Graph(g.vertices, canonical(g.edges))
    m, parts = g.edges.count(), []
    common = keep(common_neighbors(plain), "common") if SIMILAR & set(algos) else None  # found once for all of them
    more = lambda a: {"common": common} if a in SIMILAR else {}
    one: dict[str, Callable] = {"k_neighbor": lambda k, run: sparsify.k_neighbor(g, k, run), "lspar": lambda c, run: sparsify.l_spar(plain, c, common), "spanner": lambda t, run: flow.greedy_spanner(plain, t)}
    target: dict[str, Callable] = {"forest_fire": lambda r, run: traverse.forest_fire(plain, 1 - r, seed=run)}
    for a in algos:
        for run in range(runs if a in RANDOM else 1):
            if a == "random":
                parts.append(sparsify.random_edges(g, rates, run))
            elif a in RANKED:
                parts.append(RANKED[a](plain, rates, **more(a)))
            elif a in one:
                parts += [_measured(one[a](x, run), a, m, run) for x in grids[a]]
            elif a == "rank_degree":
                ratio = F.round(1 - F.col("ratio"), 6)
                parts.append(traverse.rank_degree_at(plain, [1 - r for r in rates], seed=run).select("src", "dst", "w", F.lit(a).alias("algo"), ratio.alias("prune_rate"), F.lit(run).alias("run")))
            elif a in target:
                parts += [target[a](r, run).select("src", "dst", "w", F.lit(a).alias("algo"), F.lit(r).alias("prune_rate"), F.lit(run).alias("run")) for r in rates]
            elif a == "spanning_forest":
                parts.append(_measured(traverse.spanning_forest(plain), a, m, run))
        if a == "er":
            p = keep(linalg.probabilities(resistances(plain, dense)), "probabilities")  # solved once, sampled at every accuracy and run
            parts.append(linalg.er_sweep(p, plain.vertices.count(), grids[a], runs))
    return union_rows(parts)


def resistances(g: Graph, dense: int = linalg.DENSE) -> DataFrame:
    """edges with r: exact for graphs of up to `dense` vertices, which one task can hold, else the approximation."""
    return linalg.resistance_exact(g) if g.vertices.count() <= dense else linalg.resistance(g)


def variant_sizes(variants: DataFrame, original: Graph) -> DataFrame:
    """(algo, prune_rate, run, edges): sizes with the rate that came out."""
    n = variants.groupBy("algo", F.col("prune_rate").alias("asked"), "run").agg(F.count(F.lit(1)).alias("edges"))
    o = original.edges.agg(F.lit("original").alias("algo"), F.lit(0.0).alias("asked"), F.lit(0).alias("run"), F.count(F.lit(1)).alias("edges"))
    return with_prune_rate(n.unionByName(o.select(n.columns)))


def timed(algos: dict[str, Callable[[], DataFrame]]) -> list[tuple[str, int, float]]:
    """(name, edges, seconds) of each algorithm, run to its end."""
    out = []
    for name, f in algos.items():
        began = time.monotonic()
        n = f().count()
        out.append((name, n, time.monotonic() - began))
    return out
