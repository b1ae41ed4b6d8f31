"""The data model: vertices and edges as DataFrames."""

from __future__ import annotations

import atexit
import functools
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Graph:
    """vertices (id long); edges (src long, dst long, w double). Undirected edges are stored once with src < dst.

    The vertices are fixed: pruning never changes them, so isolated ones count in every property.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def both(self) -> DataFrame:
        """Each undirected edge in both directions, from one scan; the edges themselves if directed."""
        return self.edges if self.directed else both_ways(self.edges)

    def degrees(self) -> DataFrame:
        """(id, deg): number of out-neighbours of every vertex."""
        d = self.both().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
        return self.vertices.join(d, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def both_ways(edges: DataFrame) -> DataFrame:
    pair = F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return edges.select(F.explode(pair).alias("e")).select("e.src", "e.dst", "e.w")


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected simple form: src < dst, no loops, weights of parallel edges added."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))


#: Folders kept by the calls of tidied() functions that run now, the innermost last.
_OPEN: list[list[str]] = []


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the process ends if it is still there then, even after the session's end."""
    path = f"{shared_folder(spark)}/edgeloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark.sparkContext._jsc.hadoopConfiguration(), path)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written within removes its shuffle files when it ends; else they stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, had)


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write df to the folder that the cluster shares (spark.checkpoint.dir) and read it back.

    What iterations need to stay short, and what survives a lost executor. The files go when the process ends, or with the tidied()
    call that kept them.
    """
    path = _folder(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    t = df.sparkSession.read.schema(df.schema).parquet(path)
    t.__dict__["_edgeloom_kept"] = True
    return t


def based(g: Graph) -> Graph:
    """g with its edges kept, unless they are a kept table: for plans that read them more than once."""
    return g if g.edges.__dict__.get("_edgeloom_kept") else g.with_edges(keep(g.edges.select("src", "dst", "w"), "base"))


def keep_counted(df: DataFrame, name: str = "step", **sums: Column) -> tuple[DataFrame, dict[str, Any]]:
    """keep(), and aggregates of the rows, by name, taken while they are written: `rows`, their number, and what else is asked for."""
    path = _folder(df.sparkSession, name)
    got = _observed(df, path, sums)
    return df.sparkSession.read.schema(df.schema).parquet(path), got


def _observed(df: DataFrame, path: str, sums: dict[str, Column]) -> dict[str, Any]:
    seen = Observation()
    with swept(df.sparkSession):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in sums.items())).write.parquet(path)
    return seen.get


def _frames(x: Any) -> list[DataFrame]:
    if isinstance(x, DataFrame):
        return [x]
    if isinstance(x, Graph):
        return [x.vertices, x.edges]
    return [f for y in x for f in _frames(y)] if isinstance(x, (tuple, list)) else []


def tidied(f: Callable) -> Callable:
    """f, after which only those tables stay that it kept and that its outcome reads."""

    @functools.wraps(f)
    def run(*args: Any, **more: Any) -> Any:
        _OPEN.append([])
        try:
            out = f(*args, **more)
        except BaseException:
            _OPEN.pop()
            raise
        made, frames = _OPEN.pop(), _frames(out)
        read = {part for t in frames for file in t.inputFiles() for part in file.split("/")}
        for path in made:
            if path.rsplit("/", 1)[1] not in read:
                _remove(frames[0].sparkSession if frames else SparkSession.active(), path)
            elif _OPEN:
                _OPEN[-1].append(path)
        return out

    return run


class Log:
    """A table in the shared folder that grows by parts, each written once. However many parts there are, all() is one scan."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, _folder(spark, name)
        self.parts: list[str] = []
        self.sums: list[dict[str, Any]] = []
        self.schema: StructType | None = None

    def append(self, df: DataFrame, **sums: Column) -> DataFrame:
        """df, written as the next part; see rows and keep_counted()."""
        self.schema = self.schema or df.schema
        path = f"{self.path}/{len(self.parts)}"
        self.sums.append(_observed(df.select(*self.schema.names), path, sums))
        self.parts.append(path)
        return self.last(1)

    @property
    def rows(self) -> int:
        """Rows of the last part."""
        return self.sums[-1]["rows"] if self.sums else 0

    def last(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts[-n:])

    def part(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.parts[n])

    def all(self) -> DataFrame:
        return self.last(len(self.parts))


#: Edges that a task sorts.
BUCKET = 4_000_000


def tasks(spark: SparkSession, rows: int) -> int:
    """As many tasks as shuffle partitions, or one for BUCKET rows if that is more."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET))


def adjacency(edges: DataFrame, key: str = "src", name: str = "adjacency") -> DataFrame:
    """edges, written in buckets by key and sorted within them: a join on key shuffles the other side only, however often it is done.
    There are as many buckets as shuffle partitions, or one for BUCKET edges if that is more, so what a task sorts does not grow with
    the graph. The table is in the session's catalog until its files go."""
    spark = edges.sparkSession
    path = _folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    edges, got = keep_counted(edges, "unsorted")
    n = tasks(spark, got["rows"])
    with swept(spark):
        edges.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    release(edges)
    return spark.table(table)


@dataclass(frozen=True)
class Grid:
    """edges (cell, src, dst and more), written in one bucket a cell: a cell has the edges of one block of src and one block of dst, side blocks
    of each. What many edges bring to one dst is combined within a cell, so that at most side rows of it are shuffled, not one an edge."""

    edges: DataFrame
    cells: tuple[int, ...]
    side: int

    def ahead(self, front: DataFrame, *own: str) -> DataFrame:
        """front (id and more) with a row for each edge from id, and its dst for id; own: columns of the edge. front is sent to each of the
        side cells of its block."""
        more = [c for c in front.columns if c != "id"]
        at = F.slice(F.lit(list(self.cells)), F.pmod(F.xxhash64("id"), F.lit(self.side)).cast("int") * self.side + 1, self.side)
        sent = front.withColumn("cell", F.explode(at)).hint("shuffle_hash")
        return self.edges.join(sent, (sent["cell"] == self.edges["cell"]) & (sent["id"] == self.edges["src"])).select(F.col("dst").alias("id"), *more, *own)


def grid(edges: DataFrame, name: str = "grid", more: tuple[str, ...] = ()) -> Grid:
    """edges (src, dst and more) in about as many cells as tasks(); see Grid. Cells are numbered so that each has a bucket of its own."""
    spark = edges.sparkSession
    path = _folder(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    edges, got = keep_counted(edges.select("src", "dst", *more), "unsorted")
    side = math.ceil(math.sqrt(tasks(spark, got["rows"])))
    n = side * side
    own = spark.range(0, 64 * n, 1, 1).select(F.col("id").cast("int").alias("cell")).groupBy(F.pmod(F.hash("cell"), F.lit(n)).alias("bucket")).agg(F.min("cell").alias("cell"))
    cells = tuple(r[1] for r in sorted(own.collect()))  # a number a cell
    assert len(cells) == n
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    t = edges.select(F.get(F.lit(list(cells)), block("src") * side + block("dst")).alias("cell"), "src", "dst", *more)
    with swept(spark):
        t.repartition(n, "cell").write.bucketBy(n, "cell").sortBy("cell", "src").option("path", path).saveAsTable(table)
    release(edges)
    return Grid(spark.table(table), cells, side)


@contextmanager
def by_cell(spark: SparkSession) -> Iterator[None]:
    """Joins by cell and vertex leave the edges in the buckets of their cells."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    had = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, had)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder in the warehouse, on one machine only, since elsewhere that may be local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_edgeloom_shared"
    return folder.rstrip("/")


def release(*tables: DataFrame | None) -> None:
    """Remove the files of kept tables that nothing reads any more."""
    for t in tables:
        if t is not None:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                if "/edgeloom-" in path:
                    _remove(t.sparkSession, path)


#: Rows that ranked_in_parts() moves at a time, in at most MOST_PARTS parts.
PART, MOST_PARTS = 4_000_000, 8


def ranked_in_parts(df: DataFrame, key: Column) -> DataFrame:
    """ranked() of a table whose rows lie in files already, by a struct that tells all rows apart: it is read as it is, and a range of the
    order after the other is moved, so that only a part of the rows is in shuffle files at once. Bounds of the ranges come from a sample;
    what comes out doesn't depend on them."""
    spark = df.sparkSession
    rows = df.count()
    parts = min(MOST_PARTS, max(1, math.ceil(rows / PART)))
    some = df.select(key.alias("k")).sample(min(1.0, 1000 * parts / max(rows, 1)), 7).orderBy("k").collect() if parts > 1 else []  # about a thousand rows a part
    kind = df.select(key.alias("k")).schema["k"].dataType
    cuts = [F.struct(*map(F.lit, some[len(some) * k // parts]["k"])).cast(kind) for k in range(1, parts)] if some else []
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    log = Log(spark, "ranked")
    for k, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        t = df.withColumn("_k", key)
        t = t if lo is None else t.where(F.col("_k") >= lo)
        t = t if hi is None else t.where(F.col("_k") < hi)
        t = t.repartitionByRange(n, "_k").sortWithinPartitions("_k").drop("_k")
        log.append(t.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.lit(k)))
    return _numbered(log.all(), F.struct("_part", F.shiftright("_at", 33))).drop("_part")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with rank from 1 in a global order and m, the number of rows; the table is kept.

    Rows are cut into ranges of the whole order, so ties in its first column do not meet in one task, and numbered within each; the
    ranges' totals, a row a range, shift the numbers. order must tell all rows apart.
    """
    spark, base = df.sparkSession, keep(df, "unranked")  # read twice: once for the bounds of the ranges
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = keep(base.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    release(base)
    return _numbered(t, F.shiftright("_at", 33))


def _numbered(t: DataFrame, block: Column) -> DataFrame:
    """t with rank and m, from the place _at of each row in its block; blocks follow each other in order."""
    sizes = t.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # n rows
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("m"))
    t = t.withColumn("_b", block).join(F.broadcast(sizes), "_b")
    return t.withColumn("rank", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_b", "_at", "_before")


def _delete(conf: Any, path: str) -> None:
    """Needs no session: the JVM outlives it."""
    try:
        p = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at the end of the process
        pass


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that a computation has made in the shared one."""
    if "/edgeloom-" not in path:
        raise ValueError("not a folder of this package")
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    table = path.rsplit("/", 1)[1].replace("-", "_")
    if spark.catalog.tableExists(table):
        spark.sql(f"drop table {table}")
    _delete(spark.sparkContext._jsc.hadoopConfiguration(), path)
