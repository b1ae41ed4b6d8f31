"""From documents to packed sequences: language, quality, near duplicates, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of docs, whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import langid, neardup, packing, quality
from edgeloom.llm.common import materialize

#: A document's language counts as known from this share of the soft maximum on.
SURE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or whose language is unsure. Without any labelled document there is no model, and
    only the first of these can be told, so nothing is dropped that has a letter."""
    model = langid.train(docs)
    rows = docs.select(F.struct("*").alias("row"), "text")
    if model is None:
        return rows.where(F.col("text").rlike(r"\p{L}")).select("row.*")
    found = langid.identify(rows, model, "row", "text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select("row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the base rules or the learned list reject."""
    learned = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs.select(F.struct("*").alias("row"), "text"), learned, "row", "text").where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles at a similarity of 0.8: that of the smallest id."""
    return neardup.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", rules),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: The learned stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
