"""Edge-list files: readers by suffix, writers, pruned-graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.graph import keep, keep_counted, release, tidied


def numbered_lines(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(file, file_no, split, at, line_no, line): the lines of a file or folder, numbered from 0 within their file (line_no) and over
    all files in order of their names (at). where: a condition on line; lines that fail it are not numbered.

    Files are read in splits, by as many tasks. A split's lines are numbered as they are read; how many lines the splits before it
    have, a row a split, shifts the numbers. The lines are kept once, in the order of reading.
    """
    return _numbered(spark, path, where)[0]


@tidied
def _numbered(spark: SparkSession, path: str, where: Column | None = None) -> tuple[DataFrame, int]:
    """numbered_lines(), and how many there are."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    t, got = keep_counted((t if where is None else t.where(where)).withColumn("_n", F.monotonically_increasing_id()), "lines")
    size = t.groupBy("file", "split").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = lambda w: F.coalesce(F.sum("_lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.withColumns({"_at": before(Window.orderBy("file", "split")), "_in": before(Window.partitionBy("file").orderBy("split")), "file_no": F.dense_rank().over(Window.orderBy("file")) - 1})  # a row a split
    t = t.join(F.broadcast(size), ["file", "split"])  # so the lines stay where they are
    own = F.col("_n") - F.col("_first")
    return t.select("file", "file_no", "split", (F.col("_at") + own).alias("at"), (F.col("_in") + own).alias("line_no"), "line"), got["rows"]


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """numbered_lines() with the last non-null value up to each line of its file. Each split finds its own; what a split begins with
    comes from the splits before, a row a split."""
    t = lines.withColumn("_v", value)
    ends = t.groupBy("file", "split").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line_no"))).alias("_end"))
    ends = ends.select("file", "split", F.last("_end", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("_begin"))
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return t.join(F.broadcast(ends), ["file", "split"]).withColumn(name, F.coalesce(own, "_begin")).drop("_v", "_begin")


def _numbers(spark: SparkSession, path: str, sep: str = " ", weighted: bool = False) -> DataFrame:
    """Rows of ids and weight; lines that start with # and blank ones are skipped, tabs and commas count as spaces."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", "[\\t,]" if sep == " " else f"[\\t{sep}]", " ")).alias("v"))
    t = t.where((F.col("v") != "") & ~F.col("v").startswith("#")).select(F.split("v", " +").alias("x"))
    w = F.coalesce(F.get("x", F.lit(2)).cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    return t.select(F.get("x", F.lit(0)).cast("long").alias("src"), F.get("x", F.lit(1)).cast("long").alias("dst"), w.alias("w"))


def read_el(spark: SparkSession, path: str) -> DataFrame:
    return _numbers(spark, path)


def read_wel(spark: SparkSession, path: str) -> DataFrame:
    return _numbers(spark, path, weighted=True)


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    """DIMACS: lines `a u v w`, ids from 1."""
    x = spark.read.text(path).where(F.col("value").startswith("a ")).select(F.split(F.trim("value"), " +").alias("x"))
    at = lambda i: F.get("x", F.lit(i))
    return x.select((at(1).cast("long") - 1).alias("src"), (at(2).cast("long") - 1).alias("dst"), F.coalesce(at(3).cast("double"), F.lit(1.0)).alias("w"))


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """METIS: header `n m [fmt]` with fmt 0, 1 (edge weights) or 100; line i lists the neighbours of vertex i, ids from 1.

    A line's number is what the format rests on: see numbered_lines(), which reads a long file by many tasks. Comments are no lines.
    """
    t = numbered_lines(spark, path, ~F.col("line").startswith("%"))
    head = t.where("at = 0").first()
    if head is None:
        raise ValueError("a METIS file without a header")
    fmt = head["line"].split()
    code = fmt[2] if len(fmt) > 2 else "0"
    if code not in ("0", "1", "100", "00", "000", "001"):
        raise ValueError(f"unsupported METIS format {code}")
    weighted = code.endswith("1")
    x = t.where("at > 0").select((F.col("at") - 1).cast("long").alias("src"), F.filter(F.split(F.trim("line"), " +"), lambda s: s != "").alias("x"))
    e = x.select("src", F.posexplode("x").alias("i", "v"), "x")
    if weighted:
        return e.where("i % 2 = 0").select("src", (F.col("v").cast("long") - 1).alias("dst"), F.get("x", F.col("i") + 1).cast("double").alias("w"))
    return e.select("src", (F.col("v").cast("long") - 1).alias("dst"), F.lit(1.0).alias("w"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """MatrixMarket coordinate files, square; symmetric ones give both directions, with diagonal entries once."""
    head = spark.read.text(path).where(F.col("value").startswith("%%MatrixMarket")).first()
    kind = head["value"].lower().split() if head else []
    if len(kind) < 5 or kind[2] != "coordinate" or kind[3] not in ("pattern", "real", "double", "integer"):
        raise ValueError("only coordinate matrices of pattern, real, double or integer entries")
    t = spark.read.text(path).where(~F.col("value").startswith("%")).select(F.split(F.trim("value"), " +").alias("x"), F.monotonically_increasing_id().alias("at"))
    first = t.agg(F.min_by("x", "at").alias("x"), F.min("at").alias("at")).first()
    if first["x"][0] != first["x"][1]:
        raise ValueError("the matrix is not square")
    at = lambda i: F.get("x", F.lit(i))
    w = F.lit(1.0) if kind[3] == "pattern" else at(2).cast("double")
    e = t.where(F.col("at") > first["at"]).select((at(0).cast("long") - 1).alias("src"), (at(1).cast("long") - 1).alias("dst"), w.alias("w"))
    return e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")) if kind[4] == "symmetric" else e


READERS = {".el": read_el, ".wel": read_wel, ".gr": read_gr, ".graph": read_metis, ".mtx": read_mtx}


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a file, by its suffix; .parquet and .sg directories are this package's own binary form."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1]
    if suffix in (".parquet", ".sg", ".wsg"):
        return spark.read.parquet(path).select("src", "dst", "w")
    if suffix not in READERS:
        raise ValueError(f"unknown graph suffix {suffix}")
    return READERS[suffix](spark, path)


def read_edge_csv(spark: SparkSession, edge_path: str, weight_path: str | None = None, sep: str = ",") -> DataFrame:
    """Edges from one file and weights from another, line by line; no weight file: weight 1. Blank lines count nowhere.

    Either may be a folder of parts: lines are numbered over all parts in order of their names. More edges than weights: the rest
    weigh 1; more weights than edges: the files don't belong together, which raises.
    """
    if weight_path is None:
        return _numbers(spark, edge_path, sep)
    edges, weights = (_numbered(spark, p, F.trim("line") != "") for p in (edge_path, weight_path))
    x = edges[0].select("at", F.split(F.trim("line"), f" *[{sep}] *| +").alias("x"))
    w = weights[0].select(F.col("at").alias("wat"), F.trim("line").cast("double").alias("w"))
    if weights[1] > edges[1]:
        raise ValueError("more weights than edges")
    both = x.join(w, x["at"] == w["wat"], "left")
    return both.select(F.get("x", F.lit(0)).cast("long").alias("src"), F.get("x", F.lit(1)).cast("long").alias("dst"), F.coalesce("w", F.lit(1.0)).alias("w"))


def write_text(edges: DataFrame, path: str, weighted: bool = False, sep: str = " ", header: bool = False) -> None:
    edges.select(*(["src", "dst", "w"] if weighted else ["src", "dst"])).write.csv(path, sep=sep, header=header)


@tidied
def write_edge_csv(edges: DataFrame, edge_path: str, weight_path: str | None = None, sep: str = ",") -> None:
    """Edge file, and weight file in the same order. An empty path is refused.

    Edges are sorted once, in ranges, and kept; both files are written from scans of that one table, so their parts hold the same rows
    in the same order, parallel edges too.
    """
    if not edge_path or weight_path in ("", "None"):
        raise ValueError("a path is missing")
    base = keep(edges.select("src", "dst", "w"), "unordered")  # read twice: once for the bounds of the ranges
    t = keep(base.repartitionByRange("src", "dst", "w").sortWithinPartitions("src", "dst", "w"), "ordered")
    release(base)
    t.select("src", "dst").write.csv(edge_path, sep=sep)
    if weight_path:
        t.select("w").write.csv(weight_path, sep=sep)


def write_variants(variants: DataFrame, path: str) -> None:
    """Pruned graphs as one table, laid out by algorithm, prune rate and run, so that reading some reads no others."""
    variants.write.partitionBy("algo", "prune_rate", "run").parquet(path)


def read_variants(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    t = spark.read.parquet(path)
    return t if where is None else t.where(where)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, tokens) of a metric log: white-space tokens of each line that is not blank, numbered within its file."""
    t = numbered_lines(spark, path).where(F.trim("line") != "")
    return t.select("file", "line_no", F.split(F.trim("line"), "\\s+").alias("tokens"))


def token(i: int) -> Column:
    """A token as a number; masked values (--) are NaN."""
    x = F.get("tokens", F.lit(i))
    return F.when(x == "--", F.lit(float("nan"))).otherwise(F.expr(f"try_cast(tokens[{i}] as double)"))


def parse_profile(lines: DataFrame) -> DataFrame:
    """(file, line_no, name, edges, memory, seconds) of a profiling log: each ':consumed' line with the edge count last seen above it
    in its file. lines: numbered_lines()."""
    t = carried(lines, F.expr("try_cast(regexp_extract(line, 'edges[: ]+([0-9]+)', 1) as bigint)"), "edges")
    t = t.where(F.col("line").contains(":consumed memory:"))
    number = lambda p: F.expr(f"try_cast(regexp_extract(line, '{p}', 1) as double)")
    return t.select("file", "line_no", F.regexp_extract("line", "^([^:]+):consumed", 1).alias("name"), "edges", number("consumed memory: *([0-9.,]+)").alias("memory"), number("wall time: *([0-9.]+)").alias("seconds"))
