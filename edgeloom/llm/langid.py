"""Language identification with a string kernel.

A text is the set of its byte n-grams of every length up to GRAMS (blended spectrum, presence only), hashed into DIMS places. The
kernel of two texts is the number of places they share over the geometric mean of their own. A Nyström map through a few landmark
texts of each language turns it into a short vector, on which kernel ridge regression is fitted one language against the rest.
Scoring a batch is two matrix products: presence by landmarks, kernels by coefficients.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from edgeloom.llm.common import holdout

GRAMS, BITS = 4, 15
DIMS, BATCH = 1 << BITS, 128
_OTHER = re.compile(r"[\W\d_]+")


def places(text: str) -> np.ndarray:
    """Which of the DIMS places the text's n-grams fill; whatever is no letter counts as one space."""
    data = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode(), np.uint8).astype(np.uint32)
    full = np.zeros(DIMS, bool)
    h = np.zeros(len(data), np.uint32)
    for n in range(GRAMS):
        h = h[: len(data) - n] * np.uint32(0x01000193) + data[n:] + np.uint32(1)
        full[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
        if len(data) <= n + 1:
            break
    return full


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    norms: np.ndarray
    coef: np.ndarray
    bias: np.ndarray

    def margins(self, full: np.ndarray) -> np.ndarray:
        p = full.astype(np.float32)
        k = (p @ self.landmarks.T) / np.sqrt(np.maximum(p.sum(1), 1)[:, None] * self.norms)
        return k @ self.coef + self.bias


def fit(full: np.ndarray, langs: list[str], landmarks: int = 16, ridge: float = 0.1) -> Model | None:
    """full: presence of each text (rows); landmarks: of each language, the first rows."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array(langs)
    marks = np.concatenate([np.flatnonzero(y == x)[:landmarks] for x in names])
    p = full.astype(np.float32)
    size = np.maximum(p.sum(1), 1)
    kernel = lambda a, b: (p[a] @ p[b].T) / np.sqrt(size[a][:, None] * size[b])
    every = np.arange(len(p))
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    ok = value > 1e-6
    root = vector[:, ok] / np.sqrt(value[ok])  # Nyström: kernel to the landmarks times this
    phi = kernel(every, marks) @ root
    t = np.where(y[:, None] == np.array(names), 1.0, -1.0)
    mean, middle = phi.mean(0), t.mean(0)
    w = np.linalg.solve((phi - mean).T @ (phi - mean) + ridge * np.eye(phi.shape[1]), (phi - mean).T @ (t - middle))
    return Model(names, p[marks], size[marks], (root @ w).astype(np.float32), (middle - mean @ w).astype(np.float32))


def train(docs: DataFrame, each: int = 250) -> Model | None:
    """A model of documents with a language whose crc32 of the id is not 2 modulo 4: `each` of every language, in hashed order.

    Every language is learned. Bounded by `each` texts a language, of which only the hashed presence (4 KB) reaches the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (holdout("doc_id", 4) != 2)).select("doc_id", "lang", "text")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("doc_id", "lang").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= each)
    picked = docs.sparkSession.createDataFrame(picked.select("doc_id").distinct().collect(), picked.select("doc_id").schema)
    chosen = rows.join(F.broadcast(picked), "doc_id", "left_semi")  # at most `each` ids a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(places(x)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary()), b.column(2)], ["lang", "bits", "nth"])

    got = chosen.select("lang", "text", F.xxhash64("doc_id").alias("nth")).mapInArrow(run, "lang string, bits binary, nth long").collect()
    got.sort(key=lambda r: (r["lang"], r["nth"], bytes(r["bits"])))
    if not got:
        return None
    full = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(bool)
    return fit(full, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): each whole text's language and its share among the languages, by a soft maximum of margins.

    `und` with score 0 where the text is null or has no letter, or there is no model. Only the text is looked at. Ties go to the
    language that comes first in the alphabet. Rows are independent: no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model and tuple(vars(model).values()))  # bounded: 16 landmarks a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value and Model(*held.value)
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                texts = part.column(1).to_pylist()
                some = [k for k, x in enumerate(texts) if x and m is not None and any(map(str.isalpha, x))]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if some:
                    f = m.margins(np.stack([places(texts[k]) for k in some]))
                    e = np.exp(4 * (f - f.max(1, keepdims=True)))
                    best = f.argmax(1)
                    share = e[np.arange(len(some)), best] / e.sum(1)
                    for k, i, s in zip(some, best.tolist(), share.tolist()):
                        lang[k], score[k] = m.languages[i], min(1.0, max(0.0, s))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    schema = StructType([docs.schema[id_col], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", (holdout("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
