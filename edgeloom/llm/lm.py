"""Language-model scores of whole texts.

A causal self-attention model over subword ids. A text is its lower-cased words, each encoded with a space in front, and an end.
One attention layer looks back over the block before and its own block up to the token: every token is scored once, in the window
in which it stands in the second half, and windows of many texts are multiplied together under one mask. The output is a soft
maximum over groups of classes, times the class's share of its group after the context, times the id's share of its class. The context
is the id before it in its word, and the same one for the beginnings of all words; what stands further back is left to attention. The
frequent ids have a class each. A group holds classes of similar contexts, so that what attention has seen, the language for one,
tells groups apart.

Words are counted in all training text; how often each id occurs, which ids have a class of their own, and how often each class stands
in each context, follows from these counts. The attention is fitted to all training text too: every task takes gradient steps over its
share, each token once, and the tasks' parameters are averaged by their tokens. So that they average well, all tasks begin at one place:
parameters that the driver has fitted to a sample, which serves for nothing else. The sample grows by the logarithm of the training
documents. A tenth of its texts is kept from the driver's steps, and from the counts while they last; of these steps the parameters that
do best on them are where the tasks begin. What the tasks find depends a little on how the table is split.

Beside it the base score, by add-one smoothed counts of words over all training text. Words with more than N / TOP tokens are at
most TOP and are looked up on the spot; the others are joined by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.bpe import codec
from edgeloom.llm.common import LOWER, holdout, materialize, process_cache

BLOCK, HEAD, INPUTS, CLASSES, GROUPS = 16, 8, 2048, 2048, 64
#: Bounds: words looked up on the spot (about 80 MB in each process at worst), distinct words a task counts before it passes them on,
#: words whose ids a worker remembers, tokens scored at a time.
TOP, HELD, MEMO, TOKENS = 500_000, 500_000, 300_000, 2048
#: Where the fit begins: documents of a corpus of up to FIT_FROM, and how many more with every doubling beyond; tokens of each, steps.
FIT_DOCS, FIT_FROM, FIT_MORE, FIT_TOKENS, STEPS = 2000, 10_000, 500, 2048, 1600
#: The context of the first id of a word.
BEGIN = INPUTS - 1
#: White space that may stand within a word.
_INNER = re.compile(r"[^\S\t-\r ]")


class WordIds(dict):
    """The packed ids of words with a space in front, encoded when they are first asked for."""

    def __init__(self, path: str | None):
        super().__init__()
        c = codec(path)
        self.literal, self.lengths, self.missed, self.extra = c.literal, np.array(c.lengths), 0, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.extra.get(word)
        return self.literal(" " + word.decode()) if ids is None else ids

    def fill(self, texts: list[list[bytes]]) -> None:
        """Have the ids of all words of the texts, encoded together; what memory has no room for is held until the next call."""
        new = list(filterfalse(self.__contains__, set().union(*texts)))
        if not new:
            return
        text = " " + b" ".join(new).decode()
        raw = self.literal(text)
        at = np.searchsorted(np.cumsum(self.lengths[np.frombuffer(raw, "<u4")]), np.cumsum([len(w) + 1 for w in new]))
        if _INNER.search(text):  # the pre-tokenizer may join such words
            each = [self.literal(" " + w.decode()) for w in new]
        else:
            ends = (4 * (at + 1)).tolist()
            each = [raw[i:j] for i, j in zip([0, *ends], ends)]
        found = dict(zip(new, each))
        self.missed += len(new)
        if len(self) + len(new) <= MEMO:
            self.update(found)
            self.extra = {}
        else:  # the first words stay, being the frequent ones, until most of what comes are others
            self.extra = found
            if self.missed > 16 * MEMO:
                self.clear()
                self.missed = 0


def word_ids(path: str | None = None) -> WordIds:
    """The worker's memory of words, kept across its tasks."""
    held = process_cache("word_ids")
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def sequence(tokens: list[bytes], path: str | None = None) -> np.ndarray:
    """Subword ids of the words and the end, whose id is the one after the vocabulary's last."""
    ids = np.frombuffer(b"".join(map(word_ids(path).__getitem__, tokens)), "<u4")
    out = np.empty(len(ids) + 1, np.int64)
    out[:-1], out[-1] = ids, len(codec(path).pieces)
    return out


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """(word binary, c long): counts over all training rows; the empty word is the end, once a text. Combined within tasks, so what
    is shuffled are distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for b in batches:
            for text in b.column(0):
                seen.update(words(text.as_py()))
                seen[b""] += 1
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()

    parts = docs.where(training).select(F.col("text").cast("string")).mapInArrow(run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def id_counts(counts: DataFrame, path: str | None = None) -> np.ndarray:
    """How often each id occurs in all training text, the end last, from the counts of the words."""
    size = len(codec(path).pieces) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, total = word_ids(path), np.zeros(size)
        for b in batches:
            w, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            ids_of.fill([w])
            each = [ids_of[x] for x in w]
            ids = np.frombuffer(b"".join(each), "<u4")
            total += np.bincount(ids, np.repeat(c, [len(x) // 4 for x in each]).astype(float), size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["id", "n"])

    t = counts.select("word", "c")
    got = t.where("word <> X''").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row an id
    out = np.zeros(size, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    out[-1] = t.where("word = X''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return out


def statistics(counts: DataFrame, maps: tuple[np.ndarray, np.ndarray], path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How often each id occurs in all training text, and each class in each context, from the counts of the words. What reaches the
    driver is a row an id and a row a pair, at most INPUTS x CLASSES of these."""
    held = counts.sparkSession.sparkContext.broadcast(maps)
    cells = 1 << 32  # from here on keys are pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, then = held.value
        ids_of, total, pairs = word_ids(path), np.zeros(len(then)), np.zeros(INPUTS * CLASSES)
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column(0).to_pylist()
            ids_of.fill([w])
            end = len(then) - 1
            each = [np.frombuffer(ids_of[x], "<u4").astype(np.int64) if x else np.array([end]) for x in w]
            often = np.repeat(b.column(1).to_numpy().astype(float), [len(x) for x in each])
            y = np.concatenate(each)
            total += np.bincount(y, often, len(total))
            pairs += np.bincount(contexts(np.r_[end, y[:-1]], y, first, path) * CLASSES + then.take(y), often, len(pairs))
        for base, x in ((0, total), (cells, pairs)):
            some = np.flatnonzero(x)
            for lo in range(0, len(some), 1 << 16):
                part = some[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part + base), pa.array(x[part].astype(np.int64))], ["key", "n"])

    got = counts.select("word", "c").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = got["key"].to_numpy(), got["n"].to_numpy()
    total, pairs = np.zeros(len(maps[1]), np.int64), np.zeros(INPUTS * CLASSES)
    total[key[key < cells]] = n[key < cells]
    pairs[key[key >= cells] - cells] = n[key >= cells]
    return total, pairs.reshape(INPUTS, CLASSES)


def contexts(x: np.ndarray, y: np.ndarray, input_of: np.ndarray, path: str | None = None) -> np.ndarray:
    """The context of each id of y, before which x stands: BEGIN where y begins a word, as the ids with a space in front do, or a text's end."""
    held = process_cache("begins")
    if path not in held:
        held[path] = np.array([p[:1] == b" " for p in codec(path).pieces] + [True])
    return np.where(held[path].take(y), BEGIN, input_of.take(x))


# -- the model ------------------------------------------------------------------------------------------------------------


def layout(sequences: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of inputs, their targets (-1: none), and which blocks begin a sequence. A sequence is scored from its start."""
    blocks = np.array([-(-len(y) // BLOCK) for y in sequences])
    x, t = np.full(blocks.sum() * BLOCK, start, np.int64), np.full(blocks.sum() * BLOCK, -1, np.int64)
    begin = np.cumsum(blocks) - blocks
    for y, at in zip(sequences, (begin * BLOCK).tolist()):
        x[at + 1 : at + len(y)] = y[:-1]
        t[at : at + len(y)] = y
    first = np.zeros(blocks.sum(), bool)
    first[begin] = True
    return x.reshape(-1, BLOCK), t.reshape(-1, BLOCK), first


_DISTANCE = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_AHEAD = _DISTANCE < 0


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The input and the class of each id: frequent ids have one each, the others share."""
    n = len(counts)
    order = np.lexsort((np.arange(n), -counts))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    singles = CLASSES * 7 // 8
    rest = np.maximum(counts[order[singles:]], 1).cumsum()
    band = np.minimum((rest * (CLASSES - singles) - 1) // max(1, int(rest[-1])), CLASSES - singles - 1)
    class_of = np.where(rank < singles, rank, 0)
    class_of[order[singles:]] = singles + band
    return np.where(rank < INPUTS * 3 // 4, rank, INPUTS * 3 // 4 + np.arange(n) % (INPUTS // 4 - 1)), class_of


def groups_of(pairs: np.ndarray, share: np.ndarray, seed: int = 0, dims: int = 24, rounds: int = 15) -> np.ndarray:
    """The group of each class: k-means over the leading directions of what stands before a class."""
    g = np.random.default_rng(seed)
    x = np.sqrt(pairs / np.maximum(pairs.sum(0, keepdims=True), 1))
    q = np.linalg.qr(x @ (x.T @ (x @ g.normal(size=(x.shape[1], dims)))))[0]
    f = (q.T @ x).T
    centre = f[g.choice(len(f), GROUPS, replace=False, p=share)]
    near = np.zeros(len(f), np.int64)
    for _ in range(rounds):
        near = ((centre**2).sum(1) - 2 * f @ centre.T).argmin(1)
        for k in range(GROUPS):
            if (own := near == k).any():
                centre[k] = np.average(f[own], axis=0, weights=share[own])
    return np.unique(near, return_inverse=True)[1]


class Attention:
    """Parameters: Q, K, V (input, head), R bias by distance, O (head, group), B (group). T (context, group) is counted."""

    names = ("Q", "K", "V", "R", "O", "B")

    def __init__(self, maps: tuple[np.ndarray, np.ndarray], counts: np.ndarray, pairs: np.ndarray, sample: list[np.ndarray], seed: int = 0, path: str | None = None):
        self.input_of, self.class_of = maps
        self.path = path
        size = np.maximum(np.bincount(self.class_of, counts + 0.5, CLASSES), 0.5)  # of a vocabulary that leaves classes empty
        self.log_share = np.log((counts + 0.5) / size[self.class_of]).astype(np.float32)
        self.group_of = groups_of(pairs, size / size.sum(), seed)
        g = np.random.default_rng(seed)
        self.Q, self.K, self.V = (g.normal(0, 0.1, (INPUTS, HEAD)).astype(np.float32) for _ in range(3))
        self.R = (-0.1 * np.arange(2 * BLOCK)).astype(np.float32)
        self.O, self.B = np.zeros((HEAD, self.group_of.max() + 1), np.float32), np.zeros(self.group_of.max() + 1, np.float32)
        kept = sample[::10] if len(sample) >= 10 else []
        own = np.zeros_like(pairs)
        for y in kept:
            np.add.at(own, (contexts(np.r_[len(self.class_of) - 1, y[:-1]], y, self.input_of, path), self.class_of[y]), 1)
        self.tables(np.maximum(pairs - own, 0))
        self.fit([y for k, y in enumerate(sample) if not kept or k % 10], kept, g)
        self.tables(pairs)

    def tables(self, pairs: np.ndarray, discount: float = 0.5) -> None:
        """Log shares of groups in a context and of classes in their group, by absolute discounting; what is taken off goes to classes
        by the number of contexts that they have."""
        spread = (pairs > 0).sum(0) + 0.5
        low = np.minimum(pairs, discount).sum(1, keepdims=True) + 1
        after = (np.maximum(pairs - discount, 0) + low * (spread / spread.sum())) / (pairs.sum(1, keepdims=True) + 1)
        groups = np.stack([np.bincount(self.group_of, x) for x in after])
        self.T = np.log(groups).astype(np.float32)
        self.within = np.log(after / groups[:, self.group_of]).astype(np.float32)
        self.settle()

    def settle(self) -> None:
        """What scoring needs of the parameters, once they no longer change."""
        self.start = self.T + self.B
        self.scaled = self.Q * np.float32(HEAD**-0.5)
        self.rows, self.odds = np.column_stack([self.scaled, self.K, self.V, np.ones(INPUTS, np.float32)]).astype(self.Q.dtype), np.exp(self.start)
        self.bias = np.where(_AHEAD, np.float32(-1e9), self.R[np.maximum(_DISTANCE, 0)])
        out = (np.abs(self.V).max(0)[:, None] * np.abs(self.O)).sum(0).max() + np.abs(self.B).max()
        seen = (np.abs(self.scaled).max(0) * np.abs(self.K).max(0)).sum() + np.abs(self.R).max()
        self.wide = bool(max(out, seen) > 60)  # else nothing leaves the range of exp

    def blocks(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The layout of sequences in inputs, with the block before each block, and the tokens' contexts."""
        x, t, first = layout(sequences, len(self.class_of) - 1)
        c = contexts(x, np.maximum(t, 0), self.input_of, self.path)
        x = self.input_of.take(x)
        return x, t, first, np.concatenate([x[:1], x[:-1]]), c

    def forward(self, x: np.ndarray, first: np.ndarray, before: np.ndarray, c: np.ndarray) -> tuple:
        """Logits of the groups for each token of blocks x in contexts c; before: the block before each (any if it begins a text)."""
        k, v = (np.concatenate([p.take(before, 0), p.take(x, 0)], 1) for p in (self.K, self.V))
        q = self.scaled.take(x, 0)
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += self.bias
        s[first, :, :BLOCK] = np.float32(-1e9)
        if self.wide:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        total = s.sum(2, keepdims=True)
        o = np.matmul(s, v)
        o /= total
        logits = self.start.take(c.ravel(), 0)
        logits += o.reshape(-1, HEAD) @ self.O
        return logits, k, v, q, s, total, o

    def tokens(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The natural log probability of each token of all sequences, one after the other."""
        x, t, first, before, context = self.blocks(sequences)
        out, step = [], TOKENS // BLOCK
        for lo in range(0, len(x), step):
            at = slice(lo, lo + step)
            own, y = context[at].ravel(), t[at].ravel()
            some = np.maximum(y, 0)
            c = self.class_of.take(some)
            g = self.group_of.take(c)
            place = np.arange(len(y)) * len(self.B) + g
            if self.wide:
                logits = self.forward(x[at], first[at], before[at], context[at])[0]
                logits -= logits.max(1, keepdims=True)
                hit = logits.ravel().take(place)
                total = np.exp(logits).sum(1)
            else:
                logits = self.shift(np.concatenate([before[lo : lo + 1], x[at]]), first[at])
                hit = logits.ravel().take(place) + self.start.ravel().take(own * len(self.B) + g)
                np.exp(logits, out=logits)
                total = np.einsum("ij,ij->i", logits, self.odds.take(own, 0))
            hit += self.within.ravel().take(own * CLASSES + c) + self.log_share.take(some)
            hit -= np.log(total)
            out.append(hit[y >= 0])
        return np.concatenate(out)

    def shift(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What attention adds to the logits of blocks x[1:], each of which looks back over the one before it too. As forward(), with
        one look-up an input: windows are views that overlap, and a column of ones sums the weights."""
        rows = self.rows.take(x.ravel(), 0)
        n, wide, size = len(first), rows.shape[1], rows.itemsize
        w = np.lib.stride_tricks.as_strided(rows, (n, 2 * BLOCK, wide), (BLOCK * wide * size, wide * size, size))
        s = np.matmul(w[:, BLOCK:, :HEAD], w[:, :, HEAD : 2 * HEAD].transpose(0, 2, 1))
        s += self.bias
        s[first, :, :BLOCK] = np.float32(-1e9)
        np.exp(s, out=s)
        o = np.matmul(s, w[:, :, 2 * HEAD :]).reshape(-1, HEAD + 1)
        o[:, :HEAD] /= o[:, HEAD:]
        return o[:, :HEAD] @ self.O

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Each sequence's log10 probability."""
        each = np.array([len(x) for x in sequences])
        return np.add.reduceat(self.tokens(sequences).astype(float), np.cumsum(each) - each) / math.log(10)

    def fit(self, sample: list[np.ndarray], kept: list[np.ndarray], g: np.random.Generator, batch: int = 256, rate: float = 0.01, look: int = 100) -> None:
        """Gradient steps with momentum on the sample; every `look` steps the texts kept from them say whether this was the best."""
        if not sample:
            return
        x, t, first, before, c = self.blocks(sample)
        state, best, at = self.momentum(), -np.inf, None
        for step in range(1, STEPS + 1):
            pick = g.integers(0, len(x), batch)
            self.step(self.gradients(x[pick], t[pick], first[pick], before[pick], c[pick]), state, step, rate * min(1, 2 * (1 - step / (STEPS + 1))))
            if kept and (step % look == 0 or step == STEPS) and (got := float(self.tokens(kept).mean(dtype=float))) > best:
                best, at = got, {n: getattr(self, n).copy() for n in self.names}
        for n, p in (at or {}).items():
            setattr(self, n, p)

    def momentum(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.names}

    def step(self, gradients: dict[str, np.ndarray], state: dict[str, tuple[np.ndarray, np.ndarray]], step: int, rate: float) -> None:
        for n, d in gradients.items():
            p, (m, v) = getattr(self, n), state[n]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.settle()

    def gradients(self, x: np.ndarray, t: np.ndarray, first: np.ndarray, before: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of the blocks' tokens, by each parameter."""
        logits, k, v, q, s, total, o = self.forward(x, first, before, c)
        s = s / total
        y = t.ravel()
        d = np.exp(logits - logits.max(1, keepdims=True))
        d /= d.sum(1, keepdims=True)
        d[np.arange(len(y)), self.group_of[self.class_of[np.maximum(y, 0)]]] -= 1
        d[y < 0] = 0
        d /= max(1, int((y >= 0).sum()))
        out = {n: np.zeros_like(getattr(self, n)) for n in self.names}

        def scatter(name: str, rows: np.ndarray, values: np.ndarray) -> None:
            order = np.argsort(rows, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
            out[name][rows[order][at]] += np.add.reduceat(values[order], at)

        keys = np.concatenate([before, x], 1).ravel()
        out["B"] += d.sum(0)
        out["O"] = o.reshape(-1, HEAD).T @ d
        do = (d @ self.O.T).reshape(o.shape)
        ds = np.matmul(do, v.transpose(0, 2, 1))
        ds = s * (ds - (ds * s).sum(2, keepdims=True))
        scatter("V", keys, np.matmul(s.transpose(0, 2, 1), do).reshape(-1, HEAD))
        np.add.at(out["R"], np.maximum(_DISTANCE, 0).ravel(), np.where(_AHEAD, 0, ds.sum(0)).ravel())
        scatter("Q", x.ravel(), np.matmul(ds, k).reshape(-1, HEAD) * np.float32(HEAD**-0.5))
        scatter("K", keys, np.matmul(ds.transpose(0, 2, 1), q).reshape(-1, HEAD))
        return out


def sample_size(n: int) -> int:
    """Documents that the fit of n training documents looks at: about 4 200 of 220 000, 7 300 of 15 million."""
    return FIT_DOCS + int(FIT_MORE * max(0.0, math.log2(max(n, 1) / FIT_FROM)))


def sample(docs: DataFrame, training: Column, path: str | None = None) -> list[np.ndarray]:
    """Windows of up to FIT_TOKENS ids of sample_size() training documents, in hashed order, where the fit begins. Rows of null id are not sampled; they are counted
    all the same."""
    order = F.xxhash64("doc_id")
    own = docs.where(training & F.col("doc_id").isNotNull()).select("doc_id")
    ids = own.orderBy(order, "doc_id").limit(sample_size(own.count())).distinct().collect()
    chosen = docs.join(F.broadcast(docs.sparkSession.createDataFrame(ids, docs.select("doc_id").schema)), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                y = sequence(words(text), path)
                lo = abs(h) % max(1, len(y) - FIT_TOKENS + 1)
                found.append(y[lo : lo + FIT_TOKENS].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["h", "ids"])

    got = chosen.select(order.alias("h"), F.col("text").cast("string")).mapInArrow(run, "h long, ids binary").collect()
    return [np.frombuffer(bytes(r[1]), "<u4").astype(np.int64) for r in sorted(got, key=lambda r: (r[0], bytes(r[1])))]


def fit_all(docs: DataFrame, training: Column, model: Attention, batch: int = 256, rate: float = 0.002) -> int:
    """Fits the model's parameters to all training text: each task begins with the model's, takes gradient steps over its texts, each
    token once, and the parameters become the mean of the tasks', weighted by tokens. Returns the number of tokens."""
    held = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))
    path = model.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Attention.__new__(Attention)
        m.__dict__.update(held.value)
        for n in m.names:
            setattr(m, n, getattr(m, n).copy())
        state, g, step, seen = m.momentum(), np.random.default_rng(TaskContext.get().partitionId()), 0, 0
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, size = [], 0
                while lo < b.num_rows and size < 24 * TOKENS:
                    texts.append(words(b.column(0)[lo].as_py()))
                    size += len(texts[-1]) + 1
                    lo += 1
                word_ids(path).fill(texts)
                x, t, first, before, c = m.blocks([sequence(w, path) for w in texts])
                order = g.permutation(len(x))
                for pick in np.array_split(order, max(1, round(len(x) / batch))):
                    step += 1
                    m.step(m.gradients(x[pick], t[pick], first[pick], before[pick], c[pick]), state, step, rate * min(1, step / 50) / math.sqrt(1 + step / 1000))
                seen += int((t >= 0).sum())
        if seen:
            p = np.concatenate([getattr(m, n).ravel() for n in m.names]).astype(float) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(p))), pa.array(np.r_[seen, p])], ["at", "x"])

    got = docs.where(training).select("text").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # a row a parameter
    x = got["x"].to_numpy()[np.argsort(got["at"].to_numpy())]
    if not len(x):
        return 0
    lo = 1
    for n in model.names:
        p = getattr(model, n)
        setattr(model, n, (x[lo : lo + p.size] / x[0]).reshape(p.shape).astype(p.dtype))
        lo += p.size
    model.settle()
    return int(x[0])


def score(docs: DataFrame, held_out: Column, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows not held out.

    A null or empty text is the end alone. Rows with repeated or null ids are scored each by itself. Without training rows all
    counts are 0, the base score is that of an empty vocabulary, and the model is the untrained one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    training = ~F.col("held_out")
    some = sample(docs, training, path)
    counts = materialize(word_counts(docs, training), "words")
    maps = classes(id_counts(counts, path))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = {bytes(w): math.log10(c + 1) for w, c in counts.where(F.col("c") > n // TOP).collect()}  # fewer than TOP words have so many
    model = Attention(maps, *statistics(counts, maps, path), some, path=path)
    fit_all(docs, training, model)
    held = spark.sparkContext.broadcast((top, {k: x for k, x in vars(model).items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = held.value
        m = Attention.__new__(Attention)
        m.__dict__.update(state)
        uid, known_log, ids_of = TaskContext.get().partitionId() << 33, known.get, word_ids(path)
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                hi, rows, texts, size = lo, [], [], 0
                while hi < b.num_rows and size < 24 * TOKENS:
                    texts.append(words(b.column(1)[hi].as_py()))
                    size += len(texts[-1])
                    hi += 1
                ids_of.fill(texts)
                seqs = [sequence(w, path) for w in texts]
                for w in texts:
                    w.append(b"")
                    logs = list(map(known_log, w))
                    rare = Counter([x for x, v in zip(w, logs) if v is None])
                    seen = math.fsum([v for v in logs if v is not None] if rare else logs)
                    rows.append((uid, len(w), len(w) - rare.total(), seen, list(rare), list(rare.values())))
                    uid += 1
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), *(pa.array(x, k) for x, k in zip(cols, kinds)), pa.array(m.log10(seqs))],
                    ["doc_id", "held_out", "uid", "n_tokens", "n_top", "s_top", "rare", "tf", "score"],
                )
                lo = hi

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, uid long, n_tokens long, n_top long, s_top double, rare array<binary>, tf array<int>, score double"
    done = materialize(docs.select("doc_id", "text", "held_out").mapInArrow(run, schema), "scores")
    rare = done.select("uid", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.tf").alias("k"))
    rare = rare.join(counts.where(F.col("c") <= n // TOP), "word").groupBy("uid").agg(F.sum("k").alias("n_rare"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("s_rare"))
    each = math.log10(n + 1 * (v + 1))
    return done.join(rare, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("s_top") + F.coalesce("s_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        "score",
    )


def op6_causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, holdout("doc_id", 7) == 2)
