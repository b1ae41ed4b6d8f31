"""What the operators share: shared-folder tables, caches that outlive a task, column checks."""

from __future__ import annotations

import atexit
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is not made of: space and the five ASCII controls from tab to carriage return.
SPACES = "\\x20\\x09-\\x0D"

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    home = sys.modules.setdefault("_edgeloom_process_cache", types.ModuleType("_edgeloom_process_cache"))
    return home.__dict__.setdefault(name, {})


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset (as in tests) one of our own, on one
    machine only, since elsewhere it may be local to the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_edgeloom_shared"
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder's owner clears it then
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    The files go when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/edgeloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/edgeloom-" in path:
            _remove(spark, path)


def holdout(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty string."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


__all__ = ["LOWER", "SPACES", "holdout", "materialize", "process_cache", "release", "shared_folder"]
