"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees a text's words and the probabilities of the categories before it. In
training those probabilities come from models of other folds, so that later models meet errors as they will meet them in use. A
category that is a kind of an earlier one is learned among that one's documents; its probability is the product of both, and it is
told only where the wider one is.
The words that may carry weight and the weights themselves are found on a bounded sample of the labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import materialize

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the fit: words that may carry weight, labelled documents.
VOCABULARY, FIT_DOCS = 2000, 20_000
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: A word's cases of a category must exceed what the category's share would give by this many times the root of its documents:
#: chance words of a large vocabulary don't.
EVIDENCE = 2.0


def tokens(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _word_table(docs: DataFrame, held: dict, many: int) -> DataFrame:
    """(word, n, n_0 ...): documents with the word, and those of each category. docs: (doc_id, text); held: each id's categories.

    Counted within a task first, so what is shuffled are distinct words and not documents.
    """
    send = docs.sparkSession.sparkContext.broadcast(held)  # at most FIT_DOCS ids
    names = ["word", "n", *(f"n_{i}" for i in range(many))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count = send.value, {}

        def out() -> pa.RecordBatch:
            table = np.array(list(count.values()), np.int64).reshape(-1, many + 1)
            return pa.RecordBatch.from_arrays([pa.array(count, pa.string()), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                marks = [1, *map(int, own[key])]
                for w in tokens(text or ""):
                    row = count.get(w)
                    if row is None:
                        count[w] = list(marks)
                    else:
                        for i, m in enumerate(marks):
                            row[i] += m
                if len(count) > HELD:
                    yield out()
                    count.clear()
        yield out()

    parts = docs.mapInArrow(run, ", ".join(["word string", *(f"{n} long" for n in names[1:])]))
    return parts.groupBy("word").agg(*(F.sum(n).alias(n) for n in names[1:]))


def _logistic(x: list[np.ndarray], dense: np.ndarray, y: np.ndarray, size: int, l2: float, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of places and of dense columns, and bias: gradient steps with momentum on the mean loss, rare cases weighted up."""
    rows = np.repeat(np.arange(len(x)), [len(v) for v in x])
    cols = np.concatenate([np.zeros(0, np.int64), *x])
    w, u, b = np.zeros(size), np.zeros(dense.shape[1]), 0.0
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        return w, u, 12.0 if share else -12.0
    weight = np.where(y, 0.5 / share, 0.5 / (1 - share))
    weight /= weight.sum()
    m = [np.zeros(size), np.zeros(len(u)), 0.0]
    v = [np.zeros(size), np.zeros(len(u)), 0.0]
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(y)) + dense @ u + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        for i, g in enumerate((np.bincount(cols, e[rows], size) + l2 * w, dense.T @ e + l2 * u, e.sum())):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            d = 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
            if i == 0:
                w = w - d
            elif i == 1:
                u = u - d
            else:
                b -= float(d)
    return w, u, b


def _chances(x: list[np.ndarray], dense: np.ndarray, model: tuple) -> np.ndarray:
    w, u, b = model
    z = np.array([w[v].sum() for v in x]) + dense[:, : len(u)] @ u + b if len(x) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[tuple[np.ndarray, np.ndarray, float]]
    thresholds: list[float]
    #: For each category the place of the wider one that it is a kind of, or -1.
    parents: list[int]
    #: Recall and precision of each category on out-of-fold probabilities.
    found: list[tuple[float, float]] = field(default_factory=list)

    def places(self, text: str) -> np.ndarray:
        return np.array(sorted(self.vocabulary[w] for w in tokens(text) if w in self.vocabulary), np.int64)

    def predict(self, x: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for model, up in zip(self.models, self.parents):
            own = _chances(x, out, model)
            out = np.column_stack([out, own if up < 0 else own * out[:, up]])
        return out

    def flags(self, p: np.ndarray) -> np.ndarray:
        hit = np.zeros(p.shape, bool)
        for i, (t, up) in enumerate(zip(self.thresholds, self.parents)):
            hit[:, i] = (p[:, i] >= t) & (True if up < 0 else hit[:, up])
        return hit


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], kinds: dict[str, str] | None = None, folds: int = 5, l2: float = 1e-3, chained: bool = True) -> Chain:
    """categories, in the chain's order: a condition on labels each (null: not so). labels: doc_id and what the conditions read. kinds:
    of a category the earlier one that it is a kind of; its condition has to imply that one's.

    The fit takes at most FIT_DOCS labelled ids, in hashed order; only these documents' words are read, and only counts of distinct
    words are shuffled. An id with several labels has a category if one of them says so; one that no document has is ignored;
    repeated documents count each. Null ids take no part. Without labels, or with a category that all or no documents have, that
    category's model is a constant and its threshold 0.5. chained: False leaves the earlier categories out, for comparison. Other columns of docs and labels are not looked at.
    """
    spark = docs.sparkSession
    names = list(categories)
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = labels.select(F.expr(f"try_cast(doc_id as {kind})").alias("doc_id"), *(F.coalesce(c, F.lit(False)).alias(f"is_{i}") for i, c in enumerate(categories.values())))
    marked = marked.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(f"is_{i}").alias(f"is_{i}") for i in range(len(names))))
    picked = {r["doc_id"]: [r[f"is_{i}"] for i in range(len(names))] for r in marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS).collect()}
    ids = spark.createDataFrame([(k,) for k in picked], docs.select("doc_id").schema)
    chosen = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(ids), "doc_id", "left_semi")  # at most FIT_DOCS ids
    by_word = materialize(_word_table(chosen, picked, len(names)), "words")
    total = [max(1, len(picked)), *(sum(v[i] for v in picked.values()) for i in range(len(names)))]
    # how far a word's share of a category stands from the category's share, in standard errors
    worth = F.greatest(*(F.abs(F.col(f"n_{i}") - F.col("n") * (total[i + 1] / total[0])) / F.sqrt(F.col("n")) for i in range(len(names))), F.lit(0.0))
    top = by_word.where(worth > EVIDENCE).orderBy(F.desc(worth), "word").limit(VOCABULARY).collect()
    vocabulary = {r["word"]: i for i, r in enumerate(top)}
    parents = [names.index(kinds[c]) if kinds and c in kinds else -1 for c in names]
    if any(up >= i for i, up in enumerate(parents)):
        raise ValueError("a kind stands before what it is a kind of")
    held = Chain(names, vocabulary, [], [], parents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held.places(x or "").tolist() for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "x"])

    got = sorted(chosen.mapInArrow(run, f"doc_id {kind}, x array<bigint>").collect())
    x = [np.array(r["x"], np.int64) for r in got]
    y = np.array([picked[r["doc_id"]] for r in got], bool).reshape(len(got), len(names))
    fold = np.arange(len(x)) % folds
    chain, before, told = Chain(names, vocabulary, [], [], parents), np.zeros((len(x), 0)), np.zeros((len(x), len(names)), bool)
    for i, up in enumerate(parents):
        out, fed = np.zeros(len(x)), before if chained else before[:, :0]
        among = np.ones(len(x), bool) if up < 0 else y[:, up]
        for k in range(folds):  # probabilities that later models train on come from models that have not seen the row
            a, b = np.flatnonzero((fold != k) & among), np.flatnonzero(fold == k)
            out[b] = _chances([x[j] for j in b], fed[b], _logistic([x[j] for j in a], fed[a], y[a, i], len(vocabulary), l2))
        own = np.flatnonzero(among)
        chain.models.append(_logistic([x[j] for j in own], fed[own], y[own, i], len(vocabulary), l2))
        if up >= 0:
            out *= before[:, up]
        wide = told[:, up] if up >= 0 else np.ones(len(x), bool)
        chain.thresholds.append(_threshold(np.where(wide, out, 0.0), y[:, i]))
        hit = told[:, i] = wide & (out >= chain.thresholds[-1])
        chain.found.append((float(hit[y[:, i]].mean()) if y[:, i].any() else 0.0, float(y[hit, i].mean()) if hit.any() else 0.0))
        before = np.column_stack([before, out])
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 on out-of-fold probabilities is best; 0.5 without cases."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    ends = np.r_[np.diff(p[order]) < 0, True]
    k = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category> double and is_<category> boolean of each category): every whole text's categories.

    A null or empty text has no words, so its probabilities are those of the biases. Repeated rows and null ids give a row each.
    Only the two named columns are read, so others may have any name; an id column called as one of the outcome's is refused. Rows
    are independent: no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(tuple(vars(chain).values()))  # bounded by VOCABULARY
    names = [n for c in chain.categories for n in (f"p_{c}", f"is_{c}")]
    if id_col in names:
        raise ValueError(f"the id column is called {id_col}, as a column of the outcome")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Chain(*held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                p = c.predict([c.places(x or "") for x in part.column(1).to_pylist()])
                hit = c.flags(p)
                cols = [a for i in range(p.shape[1]) for a in (pa.array(p[:, i]), pa.array(hit[:, i]))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"`{n}` {'double' if n[0] == 'p' else 'boolean'}" for n in names)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def label_categories() -> dict[str, Column]:
    """The chain of op5, as far as `labels` can tell apart, whose only fields are `toxic` and `quality`: toxic, and of its kinds toxic junk
    and toxic though well written."""
    toxic = F.col("toxic") == 1
    return {"toxic": toxic, "toxic_junk": toxic & (F.col("quality") == 0), "toxic_fluent": toxic & (F.col("quality") == 1)}


#: What the narrower categories of label_categories() are kinds of.
LABEL_KINDS = {"toxic_junk": "toxic", "toxic_fluent": "toxic"}


def op5_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label_categories(), LABEL_KINDS)
    return classify(docs, chain)
