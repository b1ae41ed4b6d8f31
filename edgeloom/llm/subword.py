"""Quality scores from supervised subword embeddings.

A word and its character n-grams (of <word>, with its ends marked) hash to rows of one table of vectors. A word that repeats the one
before it is followed by a token of its own, so pairs of equal words share what they teach. A text's vector is the mean over all of
these of all its words; a soft maximum over a linear map of it gives the chance of each label. Table and map are learned together by
stochastic gradient descent in numpy, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from edgeloom.llm.common import holdout, process_cache

#: Lengths of n-grams; rows of the table for words, and as many for n-grams; length of a vector.
GRAMS, BITS, DIM = (3, 4), 16, 16
#: Labelled documents that the fit looks at, at most.
FIT_DOCS = 2000
EPOCHS, BATCH, RATE = 20, 32, 0.5
#: From this chance on a text is predicted to be good.
GOOD = 0.3
#: Bounds of what a worker holds: words whose vectors are remembered, words that are hashed at once.
WORDS, STRETCH = 200_000, 8192
#: What follows a word that repeats the one before; no word is one.
AGAIN = " "
_P = np.uint32(0x01000193)


def _rows(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, place of their word in words), in order of the words: of each the word itself, then its n-grams."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    begins = np.r_[0, np.cumsum(lengths)[:-1]]
    owner = np.repeat(np.arange(len(words)), lengths)
    powers = np.multiply.accumulate(np.r_[np.uint32(1), np.full(lengths.max() - 1, _P)], dtype=np.uint32)
    ids, own = [_rows(np.add.reduceat(x * powers[np.arange(len(x)) - begins[owner]], begins, dtype=np.uint32))], [np.arange(len(words))]
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(x) - n + 1] * _P + x[n - 1 :]
        if n in GRAMS and len(h):
            inside = owner[: len(h)] == owner[n - 1 :]
            ids.append((1 << BITS) + _rows(h[inside] + np.uint32(n)))
            own.append(owner[: len(h)][inside])
        if len(h) <= 1:
            break
    place = np.concatenate(own)
    order = np.argsort(place, kind="stable")
    return np.concatenate(ids)[order], place[order]


def counted(text: str) -> Counter:
    """How often each token is there."""
    words = text.split()
    c = Counter(words)
    if again := sum(a == b for a, b in zip(words, words[1:])):
        c[AGAIN] = again
    return c


@dataclass
class Model:
    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the sum of its rows, and how many these are."""
        ids, place = features(words)
        if not len(ids):
            return np.zeros((0, DIM), np.float32), np.zeros(0, np.float32)
        first = np.searchsorted(place, np.arange(len(words)))
        return np.add.reduceat(self.table[ids], first), np.diff(np.r_[first, len(ids)]).astype(np.float32)

    def chance(self, mean: np.ndarray) -> np.ndarray:
        """Of each mean vector, the chance of the second label."""
        z = mean @ self.out + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))


def fit(texts: list[dict[str, int]], good: np.ndarray, seed: int = 0, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """texts: their tokens' counts. Plain gradient descent on the mean cross-entropy of batches, at a rate that falls to zero. A row's
    gradient holds its share of the text, so the rate of the table is divided by the mean square of the texts' shares."""
    r = np.random.default_rng(seed)
    m = Model(r.uniform(-1 / DIM, 1 / DIM, (2 << BITS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    if not len(good):
        return m
    rows = []
    for t in texts:
        ids, place = features(list(t))
        weight = np.bincount(ids, np.fromiter(t.values(), float, len(t))[place], 2 << BITS) if len(ids) else np.zeros(2 << BITS)
        own = np.flatnonzero(weight)
        rows.append((own.astype(np.int32), (weight[own] / max(weight.sum(), 1)).astype(np.float32)))
    square = max(float(np.mean([(w * w).sum() for _, w in rows])), 1e-9)
    dealt = r.permutation(len(rows))
    batches = []
    for lo in range(0, len(rows), BATCH):
        own = dealt[lo : lo + BATCH]
        used, at = np.unique(np.concatenate([rows[k][0] for k in own]), return_inverse=True)
        batches.append((own, used, at.astype(np.int32), np.repeat(np.arange(len(own)), [len(rows[k][0]) for k in own]), np.concatenate([rows[k][1] for k in own])))
    want = np.eye(2, dtype=np.float32)[good.astype(int)]
    share = np.maximum(want.mean(0), 1e-3)
    m.bias = np.log(share).astype(np.float32)
    m.out = r.normal(0, 1 / np.sqrt(DIM), (DIM, 2)).astype(np.float32)
    steps, step = epochs * len(batches), 0
    for _ in range(epochs):
        for k in r.permutation(len(batches)):
            own, used, at, row, weight = batches[k]
            x = np.zeros((len(own), len(used)), np.float32)
            x[row, at] = weight
            e = m.table[used]
            mean = x @ e
            z = mean @ m.out + m.bias
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - want[own]) / len(own)
            now = rate * (1 - step / steps)
            down = g @ m.out.T
            m.out -= now * (mean.T @ g)
            m.bias -= now * g.sum(0)
            m.table[used] = e - (now / square) * (x.T @ down)
            step += 1
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_DOCS) -> Model:
    """A model of at most `rows` labelled documents, in hashed order, whose crc32 of the id is not 0 modulo 5.

    Null ids and null labels take no part; of several labels of an id the lowest counts; a document that is there twice counts
    twice; labels without a document count nowhere. Without labels every text has the same score. Only the counts of the words of
    these documents reach the driver.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    labels = labels.select(F.expr(f"try_cast(doc_id as {kind})").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (holdout("doc_id", 5) != 0))
    some = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = {r["doc_id"]: r["quality"] for r in some.collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in picked], docs.select("doc_id").schema)
    chosen = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")  # at most `rows` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [counted(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], ["doc_id", "words", "counts"])

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("words array<string>, counts array<long>").fields])
    got = sorted((r["doc_id"], r["words"], r["counts"]) for r in chosen.mapInArrow(run, schema).collect())
    return fit([dict(zip(w, n)) for _, w, n in got], np.array([picked[k] == 1 for k, _, _ in got], bool))


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted): the chance that each whole text is good, and whether it reaches GOOD.

    Only the text is looked at. A text without words, or null, has the score of no evidence. Rows are independent: no shuffle. The
    table has a fixed size (8 MB).
    """
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.out, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        kept = process_cache(f"subword {hash(m.bias.tobytes() + m.out.tobytes())}")
        if not kept:
            kept.update(at={}, sums=np.zeros((WORDS + 1, DIM), np.float32), sizes=np.zeros(WORDS + 1, np.float32))
        sums, sizes = kept["sums"], kept["sizes"]
        once, alone = (x[0] for x in m.vectors([AGAIN]))

        def places(words: list[str]) -> np.ndarray:
            """Where the words' vectors are kept; at most WORDS words."""
            new = list(dict.fromkeys(w for w in words if w not in kept["at"]))
            if len(kept["at"]) + len(new) > WORDS:
                kept["at"] = {}
                new = list(dict.fromkeys(words))
            at = kept["at"]
            for first in range(0, len(new), STRETCH):
                some = new[first : first + STRETCH]
                k = len(at)
                sums[k : k + len(some)], sizes[k : k + len(some)] = m.vectors(some)
                at.update(zip(some, range(k, k + len(some))))
            return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

        def means(texts: list[str | None]) -> np.ndarray:
            """Whole texts are taken together up to WORDS // 2 words; a longer one is taken by itself, in parts of so many."""
            total, n = np.zeros((len(texts), DIM)), np.zeros(len(texts))
            words, owner = [], []

            def settle() -> None:
                for lo in range(0, len(words), WORDS // 2):
                    where, own = places(words[lo : lo + WORDS // 2]), np.array(owner[lo : lo + WORDS // 2])
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    total[own[first]] += np.add.reduceat(sums[where], first, dtype=np.float64)
                    n[own[first]] += np.add.reduceat(sizes[where], first, dtype=np.float64)
                    same = np.r_[lo > 0 and words[lo - 1] == words[lo] and owner[lo - 1] == owner[lo], (where[1:] == where[:-1]) & (own[1:] == own[:-1])]
                    again = np.bincount(own[same], minlength=len(texts))
                    total[:] += again[:, None] * once.astype(float)
                    n[:] += again * float(alone)
                words.clear(), owner.clear()

            for k, x in enumerate(texts):
                found = (x or "").split()
                if len(words) + len(found) > WORDS // 2:
                    settle()
                words.extend(found)
                owner.extend([k] * len(found))
            settle()
            return total / np.maximum(n, 1)[:, None]

        for b in batches:
            score = m.chance(means(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= GOOD).astype(np.int32), pa.int32())], [id_col, "score", "predicted"])

    schema = StructType([docs.schema[id_col], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op12_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rate(docs, model).select("doc_id", (holdout("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
