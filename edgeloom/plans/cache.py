"""Tables that outlive a session, found again by what they were made from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.graph import Graph
from edgeloom.operators import linalg


def fingerprint(table: DataFrame, **parameters: Any) -> str:
    """A name for the rows of a table, in whatever order and parts, and for parameters: sums of two hashes of each row, and their number.
    Equal rows count each. Column names and types belong to it."""
    rows = [F.sum(F.xxhash64(*table.columns, F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    sums = [str(x) for x in table.agg(F.count(F.lit(1)), *rows).first()]
    return hashlib.md5(json.dumps([table.dtypes, sums, parameters], sort_keys=True, default=str).encode()).hexdigest()


class StageCache:
    """Tables under a folder that all executors see. A table is written beside its name and renamed when it is whole, so a lost
    executor or driver leaves nothing that looks like a table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.found: list[str] = []
        self.made: list[str] = []

    def _path(self, path: str) -> tuple[Any, Any]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def table(self, stage: str, source: DataFrame, make: Callable[[], DataFrame], **parameters: Any) -> DataFrame:
        """The stage's table for this source and these parameters: read if it is there, else made and written."""
        name = f"{stage}-{fingerprint(source, **parameters)}"
        path = f"{self.folder}/{name}"
        fs, p = self._path(path)
        if fs.exists(p):
            self.found.append(name)
        else:
            part = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
            make().write.parquet(part)
            if not fs.rename(self._path(part)[1], p):
                fs.delete(self._path(part)[1], True)  # another session was first
            self.made.append(name)
        return self.spark.read.parquet(path)


def resistances(g: Graph, cache: StageCache, k: int | None = None, tolerance: float = 1e-2, seed: int = 7) -> DataFrame:
    """linalg.resistance() of an undirected graph, solved once for its edges and the solver's parameters."""
    edges = g.edges.select("src", "dst", "w")
    return cache.table("resistance", edges, lambda: linalg.resistance(g, k, tolerance, seed=seed), k=k, tolerance=tolerance, seed=seed)


def er_variants(g: Graph, eps: list[float], cache: StageCache, runs: int = 1, **solver: Any) -> DataFrame:
    """linalg.er_sweep() in stages, each kept: resistances, probabilities, samples. What a session before has made is read."""
    r = resistances(g, cache, **solver)
    p = cache.table("probability", r, lambda: linalg.probabilities(r))
    n = g.vertices.count()
    return cache.table("samples", p, lambda: linalg.er_sweep(p, n, eps, runs), n=n, eps=eps, runs=runs)
