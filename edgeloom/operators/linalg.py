"""Matrices as (i, j, v) tables, power iterations, and effective resistance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.rng import digest, normal, sign, uniform
from edgeloom.graph import Graph, adjacency, by_cell, grid, keep, keep_counted, release, tasks, tidied

#: Up to so many vertices the pseudo-inverse is taken densely, in one task (72 MB).
DENSE = 3000


def laplacian(g: Graph) -> DataFrame:
    """(i, j, v): weighted degree on the diagonal, minus the weight off it."""
    n = g.both()
    off = n.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v"))
    return n.groupBy(F.col("src").alias("i")).agg(F.sum("w").alias("v")).select("i", F.col("i").alias("j"), "v").unionByName(off)


def incidence(g: Graph, weighted: bool = True) -> DataFrame:
    """(src, dst, node, v): a row for each end of each edge, plus and minus the root of the weight."""
    r = F.sqrt("w") if weighted else F.lit(1.0)
    return g.edges.select("src", "dst", F.explode(F.array(F.struct(F.col("src").alias("node"), r.alias("v")), F.struct(F.col("dst").alias("node"), (-r).alias("v")))).alias("x")).select("src", "dst", "x.node", "x.v")


def quadratic_form(vertices_x: Column, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, vector, q): sum of w (x_u - x_v)^2; see random_forms()."""
    return edges.groupBy(*by, "vector").agg(F.sum(F.col("w") * F.pow(vertices_x, 2)).alias("q"))


def random_forms(edges: DataFrame, vectors: int = 100, by: list[str] | None = None, seed: int = 7, gaussian: bool = False) -> DataFrame:
    """(by, vector, q): x'Lx for hashed vectors x of signs (or normals), all variants in one plan and no matrix.

    Signs are the bits of a vertex's digest, 128 vectors to one, so an edge's two digests serve for as many.
    """
    number = F.explode(F.sequence(F.lit(0), F.lit(vectors - 1))).alias("vector")
    if gaussian:
        x = lambda c: normal(digest(seed, "vector", c))
        return quadratic_form(x("src") - x("dst"), edges.select("*", number), by or [])
    word = lambda c, k: F.conv(F.substring(digest(f"{seed}:{k // 4}", c), 1 + k % 4 * 8, 8), 16, 10).cast("long")
    differ = F.array(*(word("src", k).bitwiseXOR(word("dst", k)) for k in range(-(-vectors // 32))))
    e = edges.select(*(by or []), "w", differ.alias("d")).select("*", number)
    bit = F.getbit(F.get("d", (F.col("vector") / 32).cast("int")), F.col("vector") % 32)
    return quadratic_form(2.0 * bit, e, by or [])


@tidied
def form_similarity(variants: DataFrame, original: Graph, keys: list[str], vectors: int = 100, seed: int = 7) -> DataFrame:
    """(keys, ratio_min, ratio_max, ratio_mean, ratio_std): x'L_H x over x'L_G x for normal vectors x, of each variant H."""
    names = [tuple(r) for r in variants.select(*keys).distinct().collect()]  # a row a variant
    nth = variants.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(names)], variants.select(*keys, F.lit(0).alias("nth")).schema)
    each = variants.join(F.broadcast(nth), keys).select("src", "dst", "w", "nth").unionByName(original.edges.select("src", "dst", "w", F.lit(-1).alias("nth")))
    q = normal_forms(each, vectors, seed)
    r = q.where("nth >= 0").join(F.broadcast(q.where("nth < 0").select("vector", F.col("q").alias("base"))), "vector")  # a row a vector
    r = r.withColumn("r", F.col("q") / F.col("base")).join(F.broadcast(nth), "nth")
    return r.groupBy(*keys).agg(F.min("r").alias("ratio_min"), F.max("r").alias("ratio_max"), F.avg("r").alias("ratio_mean"), F.stddev_pop("r").alias("ratio_std"))


def normal_forms(edges: DataFrame, vectors: int = 100, seed: int = 7) -> DataFrame:
    """(nth, vector, q): x'Lx for hashed normal vectors x of each graph nth, whose edges are (src, dst, w, nth).

    An edge that several graphs have is weighed once. A vertex's numbers are drawn once and sent to the cells of a grid in which edges
    from it or to it lie.
    """
    spark = edges.sparkSession
    e, got = keep_counted(edges.groupBy("src", "dst", "w").agg(F.collect_list("nth").alias("nths")), "forms")
    side = math.ceil(math.sqrt(tasks(spark, got["rows"])))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    e = e.withColumn("cell", block("src") * side + block("dst")).repartition(side * side, "cell")
    x = keep(ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(vectors - 1)), lambda v: normal(digest(seed, v, F.col("id")))).alias("x")), "normals")
    others = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    tail = x.select("id", "x", others.alias("other")).select(F.col("id").alias("src"), F.col("x").alias("xs"), (block("id") * side + F.col("other")).alias("cell"))
    head = x.select("id", "x", others.alias("other")).select(F.col("id").alias("dst"), F.col("x").alias("xd"), (F.col("other") * side + block("id")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                a, c = (b.column(k).flatten().to_numpy().reshape(-1, vectors) for k in ("xs", "xd"))
                d = b.column("w").to_numpy()[:, None] * (a - c) ** 2
                row, own = np.repeat(np.arange(len(d)), b.column("nths").value_lengths().to_numpy()), b.column("nths").flatten().to_numpy()
                for k in np.unique(own):
                    total[int(k)] = total.get(int(k), 0.0) + d[row[own == k]].sum(0)
        for k, q in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(vectors, k, np.int32)), pa.array(np.arange(vectors, dtype=np.int32)), pa.array(q)], ["nth", "vector", "q"])

    with by_cell(spark):
        t = e.join(tail.hint("shuffle_hash"), ["cell", "src"]).join(head.hint("shuffle_hash"), ["cell", "dst"]).select("w", "nths", "xs", "xd")
        return keep(t.mapInArrow(run, "nth int, vector int, q double").groupBy("nth", "vector").agg(F.sum("q").alias("q")), "forms")


@tidied
def top_eigenvalues(g: Graph, k: int = 4, rounds: int = 30, seed: int = 7) -> DataFrame:
    """(nth, value): the largest eigenvalues of the Laplacian, by orthogonal iteration on k hashed columns: products are joins, the k by
    k matrices of inner products reach the driver."""
    lap = keep(laplacian(g), "laplacian")
    cols = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("col")
    x = keep(g.vertices.select("id", cols).select("id", "col", normal(digest(seed, "id", "col")).alias("x")), "basis")
    values = np.zeros(k)
    for _ in range(rounds):
        got = {(r["a"], r["b"]): r["v"] for r in x.join(x.select("id", F.col("col").alias("b"), F.col("x").alias("y")), "id").groupBy(F.col("col").alias("a"), "b").agg(F.sum(F.col("x") * F.col("y")).alias("v")).collect()}
        turn = np.linalg.inv(np.linalg.cholesky(np.array([[got[i, j] for j in range(k)] for i in range(k)])))  # rows: the new basis in the old
        rows = g.spark.createDataFrame([(j, i, float(turn[i, j])) for i in range(k) for j in range(k)], "col long, new long, t double")
        q = keep(x.join(F.broadcast(rows), "col").groupBy("id", F.col("new").cast("int").alias("col")).agg(F.sum(F.col("x") * F.col("t")).alias("x")), "basis")
        y = lap.join(q.select(F.col("id").alias("j"), "col", "x"), "j").groupBy(F.col("i").alias("id"), "col").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
        new = keep(q.join(y, ["id", "col"], "left").select("id", "col", "x", F.coalesce("y", F.lit(0.0)).alias("y")), "basis")
        values = np.array([r["v"] for r in new.groupBy("col").agg(F.sum(F.col("x") * F.col("y")).alias("v")).orderBy("col").collect()])
        release(x, q)
        x = new.select("id", "col", F.col("y").alias("x"))
    return g.spark.createDataFrame([(i, float(v)) for i, v in enumerate(sorted(values, reverse=True))], "nth int, value double")


def electrical_closeness(g: Graph) -> DataFrame:
    """(id, score): (n - 1) over the sum of effective resistances to all others, by the dense pseudo-inverse; up to DENSE vertices of a
    connected graph."""
    n = g.vertices.count()
    if n > DENSE:
        raise ValueError(f"electrical closeness is for at most {DENSE} vertices")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf.src, pdf.dst])
        a, b = np.searchsorted(ids, pdf.src), np.searchsorted(ids, pdf.dst)
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (a, b), -pdf.w)
        np.add.at(m, (b, a), -pdf.w)
        m[np.diag_indices(len(ids))] = -m.sum(1)
        d = np.diag(np.linalg.pinv(m, hermitian=True))
        return pd.DataFrame({"id": ids, "score": (len(ids) - 1) / (len(ids) * d + d.sum())})

    s = g.edges.select("src", "dst", "w").groupBy(F.lit("all").alias("one")).applyInPandas(run, "id long, score double")
    return g.vertices.join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _propagate(x: DataFrame, e: DataFrame, value: Column) -> DataFrame:
    return e.join(x, e["src"] == x["id"]).groupBy(F.col("dst").alias("to")).agg(F.sum(value).alias("got"))


@tidied
def pagerank(g: Graph, rounds: int = 20, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(id, score): x' = d * sum over in-edges of w / outw * x + (1 - d) / n * sum(x). Vertices without out-edges pass nothing on.

    With a tolerance it ends, before `rounds`, once the step's norm is below it, with the vector before that step.
    """
    n = g.vertices.count()
    e = g.both()
    out = e.groupBy(F.col("src").alias("s")).agg(F.sum("w").alias("outw"))
    e = adjacency(e.join(out, e["src"] == out["s"]).select("src", "dst", (F.col("w") / F.col("outw")).alias("p")), name="transition")
    x = keep(g.vertices.select("id", F.lit(1.0 / max(n, 1)).alias("score")), "rank")
    for _ in range(rounds):
        total = x.agg(F.sum("score")).first()[0]
        y = _propagate(x, e, F.col("p") * F.col("score"))
        new = keep(x.join(y, x["id"] == y["to"], "left").select("id", "score", (F.lit(damping) * F.coalesce("got", F.lit(0.0)) + F.lit((1 - damping) / n * total)).alias("next")), "rank")
        if tolerance is not None and new.agg(F.sqrt(F.sum(F.pow(F.col("next") - F.col("score"), 2)))).first()[0] < tolerance:
            return new.select("id", "score")
        release(x)
        x = new.select("id", F.col("next").alias("score"))
    return x


def katz(g: Graph, rounds: int = 10, alpha: float = 0.5, beta: float = 1.0) -> DataFrame:
    """(id, score): x' = alpha * A'x + beta, scaled to unit norm each round, since alpha may lie above 1 / lambda_max."""
    return _power(g, rounds, alpha, beta)


def eigenvector(g: Graph, rounds: int = 20) -> DataFrame:
    """(id, score): the power iteration x' = A'x / |A'x|."""
    return _power(g, rounds, 1.0, 0.0)


@tidied
def _power(g: Graph, rounds: int, alpha: float, beta: float) -> DataFrame:
    n = g.vertices.count()
    e = adjacency(g.both(), name="edges")
    x = keep(g.vertices.select("id", F.lit(1.0 / math.sqrt(max(n, 1))).alias("score")), "power")
    for _ in range(rounds):
        y = _propagate(x, e, F.col("w") * F.col("score"))
        new = keep(x.join(y, x["id"] == y["to"], "left").select("id", (alpha * F.coalesce("got", F.lit(0.0)) + beta).alias("score")), "power")
        norm = new.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
        release(x)
        x = new.select("id", (F.col("score") / F.lit(norm)).alias("score"))
    return x


@tidied
def hits(g: Graph, rounds: int = 20) -> DataFrame:
    """(id, hub, score): score is the authority; both of unit norm after each round."""
    e = adjacency(g.both().select("src", "dst", "w"), name="edges")
    back = adjacency(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), name="behind") if g.directed else e
    n = g.vertices.count()
    hub = keep(g.vertices.select("id", F.lit(1.0 / math.sqrt(max(n, 1))).alias("score")), "hub")
    auth = hub

    def step(x: DataFrame, over: DataFrame) -> DataFrame:
        y = _propagate(x, over, F.col("w") * F.col("score"))
        new = keep(g.vertices.join(y, g.vertices["id"] == y["to"], "left").select("id", F.coalesce("got", F.lit(0.0)).alias("score")), "hits")
        norm = new.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
        return new.select("id", (F.col("score") / F.lit(norm)).alias("score"))

    for _ in range(rounds):
        auth = step(hub, e)
        hub = step(auth, back)
    return auth.join(hub.withColumnRenamed("score", "hub"), "id").select("id", "hub", "score")


def laplacian_centrality(g: Graph) -> DataFrame:
    """(id, score): d^2 + d + 2 * sum of the neighbours' degrees, the drop of Laplacian energy when the vertex goes."""
    d = g.degrees()
    n = g.both().join(d.select(F.col("id").alias("dst"), F.col("deg").alias("dn")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("dn").alias("s"))
    return d.join(n, "id", "left").select("id", (F.col("deg") * F.col("deg") + F.col("deg") + 2 * F.coalesce("s", F.lit(0))).cast("double").alias("score"))


# -- effective resistance -------------------------------------------------------------------------------------------------


def resistance_exact(g: Graph) -> DataFrame:
    """edges with r, the effective resistance, by the dense pseudo-inverse of the Laplacian; up to DENSE vertices."""
    if g.vertices.count() > DENSE:
        raise ValueError(f"exact resistance is for at most {DENSE} vertices; see resistance()")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf.src, pdf.dst])
        a, b = np.searchsorted(ids, pdf.src), np.searchsorted(ids, pdf.dst)
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (a, b), -pdf.w)
        np.add.at(m, (b, a), -pdf.w)
        m[np.diag_indices(len(ids))] = -m.sum(1)
        p = np.linalg.pinv(m, hermitian=True)
        return pdf.assign(r=p[a, a] + p[b, b] - 2 * p[a, b])[["src", "dst", "w", "r"]]

    return g.edges.select("src", "dst", "w").groupBy(F.lit("all").alias("one")).applyInPandas(run, "src long, dst long, w double, r double")


#: Right-hand sides that stand in one row, a column each.
SIDES = 16


def _each(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(SIDES)]


@tidied
def _embedded(g: Graph, k: int, tolerance: float, rounds: int, seed: int) -> DataFrame:
    """(id, word, z0 to z15): see embedding(); column c is z of c % 16 in word c div 16, and 0 from k on. Vertices without edges have no row."""
    from edgeloom.operators.traverse import connected_components

    spark = g.spark
    comp = keep(connected_components(g), "comp")
    words = F.explode(F.sequence(F.lit(0), F.lit((k - 1) // SIDES))).alias("word")
    flat = g.edges.select("src", "dst", (F.sqrt("w") / F.lit(math.sqrt(k))).alias("v"), words)
    nth = [F.col("word") * SIDES + c for c in range(SIDES)]
    flat = flat.select("src", "dst", "word", *(F.when(n < k, F.col("v") * sign(digest(seed, "src", "dst", n))).otherwise(0.0).alias(c) for n, c in zip(nth, _each("v"))))
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1.0).alias("to")), F.struct(F.col("dst").alias("id"), F.lit(-1.0).alias("to")))).alias("end")
    b = flat.select(ends, "word", *_each("v")).groupBy("end.id", "word").agg(*(F.sum(F.col("end.to") * F.col(v)).alias(r) for v, r in zip(_each("v"), _each("r"))))
    cells = grid(g.both().select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), "laplacian", ("w",))
    diag = cells.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("d"))

    def centred(df: DataFrame, cs: list[str]) -> DataFrame:
        mean = df.groupBy("comp", "word").agg(*(F.avg(c).alias(f"_{c}") for c in cs))  # partial sums first, so a giant component is no one task
        return df.join(mean, ["comp", "word"]).select(*(c for c in df.columns if c not in cs), *((F.col(c) - F.col(f"_{c}")).alias(c) for c in cs))

    def sums(df: DataFrame, **by: list[Column]) -> dict[str, dict[int, list[float]]]:
        got = df.groupBy("word").agg(*(F.sum(c).alias(f"{n}{i}") for n, cs in by.items() for i, c in enumerate(cs))).collect()  # a row a word
        return {n: {r["word"]: [r[c] for c in _each(n)] for r in got} for n in by}

    def numbers(name: str, x: dict[int, list[float]]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(w, *v) for w, v in x.items()], "word int, " + ", ".join(f"{c} double" for c in _each(name))))

    def over(x: dict[int, list[float]], y: dict[int, list[float]]) -> dict[int, list[float]]:
        return {w: [a / b if b > 0 else 0.0 for a, b in zip(x[w], y[w])] for w in x}

    def cols(name: str) -> list[Column]:
        return [F.col(c) for c in _each(name)]

    def size(r: list[Column]) -> dict[str, list[Column]]:
        return {"rz": [x * x / F.col("d") for x in r], "norm": [x * x for x in r]}

    s = diag.join(comp, "id").select("id", "comp", "d", words).join(b, ["id", "word"], "left")
    raw = keep(s.select("id", "word", "comp", "d", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in _each("r"))), "cg")
    s = keep(centred(raw, _each("r")), "cg")
    release(raw)
    had = sums(s, **size(cols("r")))
    rz, goal = had["rz"], {w: [tolerance**2 * x for x in v] for w, v in had["norm"].items()}
    base = s
    s = s.select("*", *(F.lit(0.0).alias(c) for c in _each("x")), *((r / F.col("d")).alias(p) for r, p in zip(cols("r"), _each("p"))))
    with by_cell(spark):
        for _ in range(rounds):
            met = cells.ahead(s.select("id", "word", *_each("p")), "w").groupBy("id", "word").agg(*(F.sum(F.col("w") * p).alias(m) for p, m in zip(cols("p"), _each("m"))))
            joined = s.join(met, ["id", "word"], "left")
            t = keep(joined.select(*s.columns, *((F.col("d") * p - F.coalesce(m, F.lit(0.0))).alias(c) for p, m, c in zip(cols("p"), cols("m"), _each("ap")))), "cg")
            release(base)
            base = t
            alpha = over(rz, sums(t, pap=[p * q for p, q in zip(cols("p"), cols("ap"))])["pap"])
            left = [(r - a * q).alias(c) for r, a, q, c in zip(cols("r"), cols("alpha"), cols("ap"), _each("r"))]
            t = t.join(numbers("alpha", alpha), "word").select("id", "word", "comp", "d", *((x + a * p).alias(c) for x, a, p, c in zip(cols("x"), cols("alpha"), cols("p"), _each("x"))), *left, *_each("p"))
            new = sums(t, **size(cols("r")))
            beta = over(new["rz"], rz)
            rz = new["rz"]
            s = t.join(numbers("beta", beta), "word").select("id", "word", "comp", "d", *_each("x"), *_each("r"), *((r / F.col("d") + q * p).alias(c) for r, q, p, c in zip(cols("r"), cols("beta"), cols("p"), _each("p"))))
            if all(x <= y for w in goal for x, y in zip(new["norm"][w], goal[w])):
                break
    z = centred(s.select("id", "word", "comp", *_each("x")), _each("x"))
    return keep(z.select("id", "word", *(F.col(x).alias(c) for x, c in zip(_each("x"), _each("z")))), "embedding")


def embedding(g: Graph, k: int | None = None, tolerance: float = 1e-2, rounds: int = 300, seed: int = 7) -> DataFrame:
    """(id, col, z): L+ times k random sign combinations of the weighted incidence rows (k = round(4 ln n) by default).

    Conjugate gradients with the diagonal as preconditioner; a row holds 16 of the k right-hand sides, a column each, and edges lie in a
    grid of cells within which what they bring is added up, so a round moves vertices times sides of the grid, not edges times k. Each
    connected component's mean is taken out, as the Laplacian is singular on each.
    """
    k = k or max(1, round(4 * math.log(max(g.vertices.count(), 2))))
    t = _embedded(g, k, tolerance, rounds, seed).select("id", "word", F.posexplode(F.array(*_each("z"))).alias("_at", "z"))
    return t.select("id", (F.col("word") * SIDES + F.col("_at")).cast("int").alias("col"), "z").where(F.col("col") < k)


def resistance(g: Graph, k: int | None = None, tolerance: float = 1e-2, seed: int = 7) -> DataFrame:
    """edges with r, the squared distance of the ends' embeddings: an approximation of the effective resistance."""
    k = k or max(1, round(4 * math.log(max(g.vertices.count(), 2))))
    z = _embedded(g, k, tolerance, 300, seed).groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("word", F.array(*_each("z")).alias("z")))), lambda x: x["z"])).alias("z"))  # k values a vertex
    e = g.edges.join(z.select(F.col("id").alias("src"), F.col("z").alias("a")), "src").join(z.select(F.col("id").alias("dst"), F.col("z").alias("b")), "dst")
    return e.select("src", "dst", "w", F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("r"))


def probabilities(resistances: DataFrame) -> DataFrame:
    """edges with p = max(0, w) max(0, r), made to sum to 1."""
    p = F.greatest(F.lit(0.0), "w") * F.greatest(F.lit(0.0), "r")
    t = resistances.withColumn("p", p)
    total = t.agg(F.sum("p").alias("total"))
    return t.join(F.broadcast(total)).withColumn("p", F.col("p") / F.col("total")).drop("total")  # one row


def draws(n: int, eps: float, c: float = 4 / 30) -> int:
    """How many samples the accuracy eps asks for. c = 4 / 30 and the factor 9 c^2."""
    return round(n * math.log(n) * 9 * c**2 / eps**2)


def er_sample(probs: DataFrame, q: int, run: int = 0) -> DataFrame:
    """Edges drawn with chance p, q times on average, with weight count * w / (q p): the Laplacian is kept in expectation.

    Each edge draws its count by itself, as Poisson(q p) from its hash, so there is no global sort and no order of sampling; the
    counts of a multinomial draw are these, given their sum.
    """
    h = digest(run, "src", "dst")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            lam, u = (q * pdf.p).to_numpy(), pdf.u.to_numpy()
            n, term = np.zeros(len(lam)), np.exp(-np.minimum(lam, 700))
            total = term.copy()
            open_ = (u >= total) & (lam <= 700)
            k = 0
            while open_.any():
                k += 1
                term = term * lam / k
                total = total + term
                n[open_] = k
                open_ &= (u >= total) & (k < 10 * lam + 100)
            n = np.where(lam > 700, np.maximum(0, np.round(lam + np.sqrt(lam) * pdf.z)), n)  # so close to normal there
            yield pdf.assign(n=n)[["src", "dst", "w", "p", "n"]]

    t = probs.select("src", "dst", "w", "p", uniform(h).alias("u"), normal(digest(f"{run}z", "src", "dst")).alias("z")).mapInPandas(count, "src long, dst long, w double, p double, n double").where("n > 0")
    return t.select("src", "dst", (F.col("n") * F.col("w") / (F.lit(float(q)) * F.col("p"))).alias("w"))


def er_sweep(probs: DataFrame, n: int, eps: list[float], runs: int = 1) -> DataFrame:
    """Variants (src, dst, w, algo, prune_rate, run): samples at each accuracy, from one table of probabilities; prune_rate is what
    each sample takes away."""
    m, parts = probs.count(), None
    for e in eps:
        for run in range(runs):
            s = er_sample(probs, draws(n, e), run).withColumn("asked", F.lit(e)).withColumn("run", F.lit(run))
            parts = s if parts is None else parts.unionByName(s)
    sizes = parts.groupBy("asked", "run").agg(F.bround(1 - F.count(F.lit(1)) / F.lit(max(m, 1)), 2).alias("prune_rate"))
    return parts.join(F.broadcast(sizes), ["asked", "run"]).select("src", "dst", "w", F.lit("er").alias("algo"), "prune_rate", "run")  # a row a sample


def er_sample_min1(resistances: DataFrame, n: int, eps: float = 0.3, c: float = 4.0, run: int = 0) -> DataFrame:
    """The other formula: p = min(1, r w c ln n / eps^2), ceil(n ln n / eps^2) draws, each adding w / p."""
    p = F.least(F.lit(1.0), F.col("r") * F.col("w") * F.lit(c * math.log(n) / eps**2))
    t = resistances.withColumn("p0", p)
    total = t.agg(F.sum("p0").alias("total")).first()[0]
    q = math.ceil(n * math.log(n) / eps**2)
    s = er_sample(t.withColumn("p", F.col("p0") / F.lit(total)), q, run)
    return s.withColumn("w", F.col("w") * F.lit(q / total))
