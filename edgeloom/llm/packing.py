"""Best-fit packing of token sequences under several capacities.

Items and bins are vectors: tokens, documents (one for each item) and attention cost (the square of an item's tokens). Items of
equal length are equal vectors, and there are at most `tokens` lengths, so the packing is decided on the histogram of lengths,
which is bounded whatever the size of the corpus. Bins of equal residual form one class with a count. Best-fit decreasing then
works on classes: for each length, largest first, the class is chosen in which the item fits under every capacity and whose
weighted dot product with the item is largest, or whose weighted residual norm after placing is smallest. The plan is a small
table of intervals; each item takes its place by its rank among the items of its length, which is found without ever putting
one length in one task: ranks are counted within hashed blocks and shifted by the blocks' running totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.bpe import codec
from edgeloom.llm.common import materialize

#: Items of one length in one block, about; the number of blocks follows the number of items.
BLOCK = 500
#: Intervals of the plan up to which it is broadcast.
INTERVALS = 200_000


@dataclass(frozen=True)
class Capacity:
    """What a bin holds at most. None: as much as the tokens allow. by: "norm" or "dot"; weights: of tokens, documents, cost."""

    tokens: int = 1024
    docs: int | None = None
    cost: int | None = None
    by: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def full(self) -> tuple[int, int, int]:
        t = self.tokens
        return t, min(t, self.docs or t), min(t * t, self.cost or t * t)


def plan(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, lo, hi, first bin, offset, items a bin): item number r in [lo, hi) of a length goes to bin
    first + (r - lo) // items, at offset + (r - lo) % items * length.

    counts: items by length, each in 1..tokens and within the cost capacity alone.
    """
    full = np.array(cap.full, dtype=np.int64)
    scale = np.asarray(cap.weights) / np.maximum(full, 1) ** 2
    classes: dict[tuple[int, int, int], list[list[int]]] = {}
    out, bins = [], 0

    def shrink(r: np.ndarray) -> tuple[int, int, int]:
        # a residual that the tokens left can't use up is as good as that bound: it keeps the classes few
        t = int(r[0])
        return t, min(t, int(r[1])), min(t * t, int(r[2]))

    def put(residual: np.ndarray, start: int, n: int) -> None:
        key = shrink(residual)
        if min(key) > 0:
            classes.setdefault(key, []).append([start, n])

    for length in sorted(counts, reverse=True):
        item, left, lo = np.array([length, 1, length * length], dtype=np.int64), counts[length], 0
        if (item > full).any():
            raise ValueError(f"an item of {length} tokens fits in no bin of {cap}")
        while left:
            best, score = None, None
            if classes:
                keys = list(classes)
                r = np.array(keys, dtype=np.int64)
                ok = np.flatnonzero((r >= item).all(1))
                if len(ok):
                    after = r[ok] - item
                    value = -(r[ok] * item * scale).sum(1) if cap.by == "dot" else (after.astype(float) ** 2 * scale).sum(1)
                    score = np.lexsort((r[ok][:, 0], value))[0]
                    best = keys[ok[score]]
            if best is None:
                start, room, residual, offset = bins, left, full, 0
            else:
                start, room = classes[best][-1]
                residual, offset = np.array(best, dtype=np.int64), cap.tokens - best[0]
            m = int((residual // item).min())
            used = min(room, left // m)
            if used:
                out.append((length, lo, lo + used * m, start, offset, m))
                taken, each = used, m
            else:
                out.append((length, lo, lo + left, start, offset, left))
                taken, each = 1, left
            lo, left = lo + taken * each, left - taken * each
            if best is None:
                bins += taken
            else:
                classes[best].pop()
                if not classes[best]:
                    del classes[best]
                if room > taken:
                    put(residual, start + taken, room - taken)
            put(residual - each * item, start, taken)
    return out


def pack(items: DataFrame, keys: list[str], length_col: str = "length", cap: Capacity | None = None) -> DataFrame:
    """items with sequence_id and offset: each item's bin and its place there, gapless from 0.

    items should be a written table (see common.materialize), since it is read several times. keys: columns that order items of
    equal length. Items of null length or of less than one token are left out; an item that fits in no empty bin is an error.
    Repeated rows are items of their own. An empty table gives an empty result. Columns named _block, _rank and the like are
    the operator's own: an input with such a name, or with sequence_id or offset, is refused.
    """
    cap = cap or Capacity()
    own = {"_block", "_rank", "_before", "_lo", "_hi", "_bin", "_at", "_each", "_length", "_key", "_stretch", "sequence_id", "offset"}
    if clash := own & {c.lower() for c in items.columns}:
        raise ValueError(f"columns of these names are the operator's own: {sorted(clash)}")
    spark = items.sparkSession
    items = items.where(F.col(length_col) >= 1)
    counts = {int(r[0]): r[1] for r in items.groupBy(length_col).count().collect()}  # at most cap.tokens rows, else plan() refuses
    rows = plan(counts, cap)
    blocks = 1 + max(counts.values(), default=0) // BLOCK
    placed = items.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    sizes = placed.groupBy(F.col(length_col).alias("_length"), F.col("_block").alias("_b")).count()
    before = Window.partitionBy("_length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(length_col, "_block").orderBy(*keys)
    placed = placed.withColumn("_rank", F.row_number().over(within) - 1)
    placed = placed.join(sizes, (placed[length_col] == sizes["_length"]) & (placed["_block"] == sizes["_b"])).drop("_length", "_b")
    table = spark.createDataFrame(rows or [], "_length long, _lo long, _hi long, _bin long, _at long, _each long")
    if len(rows) < INTERVALS:  # a few intervals a length as a rule, a row of 48 bytes each
        table = F.broadcast(table.withColumn("_key", F.lit(0).cast("long")))
        key = F.lit(0).cast("long")
    else:  # an interval stands under each stretch of ranks that it touches, so a frequent length is no one key
        table = table.withColumn("_key", F.explode(F.expr(f"sequence(_lo div {BLOCK}, (_hi - 1) div {BLOCK})")))
        key = F.floor(F.col("_rank") / BLOCK)
    placed = placed.withColumn("_rank", F.col("_before") + F.col("_rank")).withColumn("_stretch", key)
    placed = placed.join(table, (placed[length_col] == table["_length"]) & (F.col("_stretch") == F.col("_key")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    return placed.select(
        *items.columns,
        (F.col("_bin") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(nth, F.col("_each")) * F.col("_length")).cast("long").alias("offset"),
    )


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every whole text as ids and the end id, cut where it has more than `tokens`.

    Only the first piece of a cut document is shorter. A null text counts as empty: one piece, the end id alone. Null ids,
    repeated rows and other columns need no care. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = codec(path), int(end_id).to_bytes(4, "little")
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                at, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = c.encode(text or "") + end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % tokens + 1, n + 1, tokens)]
                    for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        at.append(k)
                        piece.append(i)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[4 * s : 4 * e]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, cap: Capacity | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents; see pieces() and pack()."""
    cap = cap or Capacity()
    cut = materialize(pieces(docs, tokens=cap.tokens, path=path), "pieces")
    return pack(cut, ["doc_id", "piece", "ids_crc32"], "length", cap)


def op2_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
