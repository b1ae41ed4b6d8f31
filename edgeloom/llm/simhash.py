"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint has eight bytes. Two that differ in at most d bits differ in at most d bytes, so they share at least 8 - d bytes
at their positions. The index posts each distinct fingerprint under its positional bytes, taken 8 - d at a time: a pair that
reaches that count meets in at least one posting list, and a pair that doesn't never meets, so lists stay as short as the data
allow. Within a list the shared positional bytes of each pair are tallied, pairs that reach the guaranteed minimum are retained
and verified by their differing bits.

Only distinct fingerprints are posted, so exact copies cost nothing. A list gives a star for each of its linked sets instead of
all their pairs. A list longer than LIST is linked without comparing pairs: two of its members differ in at most d bits exactly if
some value is within d/2 bits of both; sorting these values links the members.

A list longer than LONG, as skewed bytes make them, is dealt out: its members share 8 - d bytes, so a pair differs in at most d of the
2d half bytes of the others and shares d of them. It is posted again under these, taken d at a time, and what is still longer than
LONG is grouped by the values within d/2 bits. No task holds more than LONG members of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from edgeloom.llm.common import LOWER, materialize
from edgeloom.llm.components import components

LIST, LONG, ROWS = 512, 8192, 1 << 15


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle's UTF-8 bytes, repeats included; a shorter text is one shingle, one without words none."""
    import xxhash

    w = text.encode().translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    runs = zip(*(w[i:] for i in range(words))) if len(w) > words else [w]
    return np.array([xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if it is in more than half the hashes."""
    count = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), ROWS):
        bits = np.unpackbits(hashes[lo : lo + ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # as many as a byte can count
            count += bits[at : at + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long): each whole text's SimHash; a null text or one without words has 0. Rows are independent: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                fp = np.array([fingerprint_of(shingle_hashes(x or "", words)) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    schema = StructType([docs.schema[id_col], StructField("fp", LongType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _byte(p: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))


def _bytes(places: tuple[int, ...]) -> Column:
    packed = F.lit(0).cast("long")
    for i, p in enumerate(places):
        packed = packed.bitwiseOR(F.shiftleft(_byte(p), 8 * i))
    return packed


def _keys(shared: int) -> list[tuple[Column, Column]]:
    """Of each set of places: the bytes there as a key, and the other bytes."""
    sets = list(combinations(range(8), shared))
    rest = [tuple(p for p in range(8) if p not in places) for places in sets]
    return [(_bytes(places).bitwiseOR(F.lit(j << 8 * shared)), _bytes(others)) for j, (places, others) in enumerate(zip(sets, rest))]


def _half_keys(bits: int) -> Column:
    """Of (key, rest): the keys of the half bytes of rest, taken `bits` at a time."""
    half = lambda p: F.shiftrightunsigned("rest", 4 * p).bitwiseAND(F.lit(15))
    return F.array(*(F.xxhash64("key", F.lit(j), *(half(p) for p in places)) for j, places in enumerate(combinations(range(2 * bits), bits))))


def _values_near(bits: int) -> Column:
    """Of rest: all values that differ from it in at most half of `bits` bits."""
    flips = [0] + [sum(1 << i for i in c) for r in range(1, bits // 2 + 1) for c in combinations(range(8 * bits), r)]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in flips)), lambda m: F.col("rest").bitwiseXOR(m))


def _low(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node connected to each of n nodes by the edges a, b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _short_list(fp: np.ndarray, bits: int) -> np.ndarray:
    own = fp.view(np.uint8).reshape(-1, 8)
    tally = (own[:, None, :] == own[None, :, :]).sum(2)  # positional bytes that each pair shares
    a, b = np.nonzero(np.triu(tally >= 8 - bits, 1))
    near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return _low(len(fp), a[near], b[near])


def _long_list(fp: np.ndarray, bits: int, room: int = 1 << 22) -> np.ndarray:
    differ = [p for p in range(8) if len(np.unique(fp.view(np.uint8).reshape(-1, 8)[:, p])) > 1]
    places = [np.uint64(1 << (8 * p + i)) for p in differ for i in range(8)]
    masks = [np.uint64(0), *(sum(c) if len(c) > 1 else c[0] for r in range(1, bits // 2 + 1) for c in combinations(places, r))]
    label, idx = np.arange(len(fp)), np.arange(len(fp))
    parts = np.uint64(-(-len(masks) * len(fp) // room))
    for k in range(int(parts)):
        values, owners = [], []
        for m in masks:
            v = fp ^ np.uint64(m)
            mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % parts == k
            values.append(v[mine])
            owners.append(idx[mine])
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        same = v[1:] == v[:-1]
        a, b = label[o[1:][same]], label[o[:-1][same]]
        label = _low(len(fp), a, b)[label]
    return label


def links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all pairs that differ in at most `bits` bits.

    prints: (fp long), distinct. bits: 2 or 4.
    """
    if bits not in (2, 4):
        raise ValueError("bits must be 2 or 4")
    keys = _keys(8 - bits)
    posted = prints.select("fp", F.explode(F.array(*(k for k, _ in keys))).alias("key"))
    light, heavy = _deal(posted)
    found = _in_lists(light, bits)
    if heavy is None:
        return found
    both = prints.select("fp", F.explode(F.array(*(F.struct(k.alias("key"), r.alias("rest")) for k, r in keys))).alias("x")).select("fp", "x.*")
    both = materialize(both.join(heavy, "key", "left_semi"), "long")
    light, heavy = _deal(both.select("fp", F.explode(_half_keys(bits)).alias("key")))
    found = found.unionByName(_in_lists(light, bits))
    if heavy is None:
        return found
    again = both.select("fp", "key", "rest", F.explode(_half_keys(bits)).alias("half")).join(heavy.withColumnRenamed("key", "half"), "half", "left_semi")
    near = again.select("fp", "key", "rest").distinct().select("fp", "key", F.explode(_values_near(bits)).alias("value"))
    near = near.groupBy("key", "value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))  # as many as there are values near one
    return found.unionByName(near.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b").distinct())


def _deal(posted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Postings (fp, key) of lists of up to LONG, and (key) of the others, if any."""
    heavy = materialize(posted.groupBy("key").count().where(F.col("count") > LONG).select("key"), "heavy")
    if not heavy.limit(1).count():
        return posted, None
    return posted.join(heavy, "key", "left_anti").select("fp", "key"), heavy


def _in_lists(posted: DataFrame, bits: int) -> DataFrame:
    """(a, b): links within each list of (fp, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low = _short_list(fp, bits) if len(fp) <= LIST else _long_list(fp, bits)
            far = np.flatnonzero(low != np.arange(len(fp)))
            return fp[far], fp[low[far]]

        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in _with_end(batches):
            if b is not None:
                key = np.r_[key, b.column(0).to_numpy()]
                fp = np.r_[fp, b.column(1).to_numpy().view(np.uint64)]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(key)] if len(key) else starts
            if b is not None and len(starts):  # the last list may go on in the next batch
                keep, starts, ends = starts[-1], starts[:-1], ends[:-1]
            else:
                keep = len(key)
            many = ends - starts > 1
            found = [of(fp[s:e]) for s, e in zip(starts[many].tolist(), ends[many].tolist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found)], ["a", "b"])
            key, fp = key[keep:], fp[keep:]

    dealt = posted.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def groups(prints: DataFrame, id_col: str = "doc_id", bits: int = 4) -> DataFrame:
    """(id, fp, component): each row's smallest id reachable over links of at most `bits` differing bits, its own included.

    prints: (id, fp), best a written table, since it is read several times. Repeated rows and null ids keep their rows; a null
    id is never a component's smallest unless there is no other. Empty in, empty out.
    """
    first = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    first = materialize(first, "distinct")
    low = components(links(first.select("fp"), bits))
    root = first.join(low, first["fp"] == low["id"], "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("first").alias("component"))
    found = root.join(least, "root").select(F.col("fp").alias("_fp"), "component")
    return prints.join(found, prints["fp"] == found["_fp"]).select(id_col, "fp", "component")


def op9_byte_position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "prints")
    return groups(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

