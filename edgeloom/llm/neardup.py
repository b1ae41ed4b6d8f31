"""Near duplicates at a stated similarity: a SimHash index and MinHash bands find candidates, the exact Jaccard similarity of
shingle sets confirms.

Texts with the same set of shingles are one node. Candidates come from two places. The byte-position index (simhash.links) gives the
nodes whose SimHashes differ in few bits: the close copies, all of them. It can't reach texts at the stated similarity, since
at 0.8 about ten of 64 bits differ; so a node also has `many` bands. A band's key comes from the least values of BAND hash functions over
the node's shingles, of its own for each band. Two sets of Jaccard similarity J have the same key in a band with probability
J^BAND, independently from band to band, so they meet with 1 - (1 - J^BAND)^many: at the stated similarity RECALL at least,
whatever the number of texts. Sets without common shingles do not meet, so lists are as long as groups of similar texts.

Every edge is a pair whose similarity was computed. All members of a list are first compared with one of them, the first in an
order that is the same for all lists, so a group of copies has few such texts; rounds with other members follow as long as they
connect more. Members that this connects need no more. The others are compared, within tasks, with all members of their lists that
they are not yet connected to, each pair in the first list that it meets in; only links come out. That gives the components of all
pairs that meet and reach the similarity. Pairs whose sizes rule the similarity out are not compared. Long lists are dealt out in
blocks of PART by PART members at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from edgeloom.llm import simhash
from edgeloom.llm.common import materialize, release
from edgeloom.llm.components import components
from edgeloom.llm.simhash import shingle_hashes

RECALL, BAND = 0.999, 5
#: Members of a list in one part; bytes kept of a shingle's hash in packed sets.
PART, KEPT = 1024, 6
#: In full at once if each member of the lists that are left would be compared with so many others or fewer.
FEW = 8
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def bands(similarity: float) -> int:
    """How many bands a pair at the similarity needs to meet with probability RECALL."""
    return max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-(similarity**BAND)))) if similarity < 1 else 1


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", words))


def band_keys(s: np.ndarray, many: int) -> np.ndarray:
    """The key of each band of a set of shingles; an empty set has none."""
    if not len(s):
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(0).integers(0, 1 << 64, BAND * many, np.uint64) | np.uint64(1)
    low = np.full(len(factors), np.iinfo(np.uint64).max)
    for lo in range(0, len(s), 512):
        x = s[lo : lo + 512, None] * factors
        x ^= x >> np.uint64(32)
        x *= _MIX[0]
        np.minimum(low, x.min(0), out=low)
    key = np.arange(many, dtype=np.uint64)
    for v in low.reshape(BAND, many):
        key = (key ^ v) * _MIX[1]
        key ^= key >> np.uint64(29)
    return key


def sketches(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, s0 long, s1 long, fp long, size long, bands array<long>) of docs (key, text): a digest of the shingle set, the SimHash of
    the shingles, how many the set has, and the bands' keys. Rows are independent: no shuffle."""
    many = bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                own, fp, size, keys = [], [], [], []
                for text in part.column(1):
                    h = shingle_hashes(text.as_py() or "", words)
                    s = np.unique(h)
                    own.append(xxhash.xxh3_128_digest(s.tobytes()))
                    fp.append(simhash.fingerprint_of(h))
                    size.append(len(s))
                    keys.append(band_keys(s, many).view(np.int64))
                own = np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)
                cols = [*(pa.array(np.ascontiguousarray(c)) for c in own.T), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["key", "s0", "s1", "fp", "size", "bands"])

    schema = StructType([docs.schema["key"], *(StructField(n, LongType()) for n in ("s0", "s1", "fp", "size")), StructField("bands", ArrayType(LongType()))])
    return docs.select("key", F.col("text").cast("string")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, set, bands) of docs (node long, text, bands): the sorted hashes of the shingles, packed in KEPT bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [packed(shingle_set(t.as_py(), words)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary()), part.column(2)], ["node", "set", "bands"])

    return docs.select("node", F.col("text").cast("string"), "bands").mapInArrow(run, "node long, set binary, bands array<long>")


def packed(s: np.ndarray) -> bytes:
    """The leading KEPT bytes of sorted hashes. Two different shingles of a pair of n each are taken for equal with a chance of
    n * n / 2^48: one in a billion at 500 shingles, which is what exact means here."""
    return np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes()


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two packed sets have this Jaccard similarity at least; two empty ones have."""
    raw = np.frombuffer(b"".join([a, b]), np.uint8).reshape(-1, KEPT)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    z = np.zeros((len(raw), 8), np.uint8)
    z[:, :KEPT] = raw
    z = z.view(">u8").ravel().astype(np.uint64)
    z.sort(kind="stable")
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return both >= similarity * (len(z) - both) - 1e-9


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have this similarity at least. sets: (node, set).

    pairs: (hub, node, parts): a hub may have very many nodes, so its set is copied to `parts` parts, among which they are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([alike(x.as_buffer(), y.as_buffer(), similarity) for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    parts = pairs.groupBy("hub").agg(F.max("parts").alias("most"))
    hubs = parts.join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)).alias("part"), F.col("most").alias("_most"), F.col("set").alias("hub_set"))
    own = pairs.join(parts, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("most")).alias("part"))
    both = own.join(sets, "node").join(hubs, ["hub", "part"])
    return both.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), "hub_set", "set").mapInArrow(run, "a long, b long")


def _sizes_allow(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-9)


def similar(posted: DataFrame, close: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(id, label): the components of all candidate pairs that have the similarity.

    posted: (key, node, size), a written table of the lists of two nodes and more; close: (hub, node), candidates besides these; sets:
    (node, set, bands) of all their nodes, written. Rounds of comparing lists with one member leave few nodes that are still apart from
    the others of a list; these are compared with all members that they are not connected to, so the rounds change the work alone.
    """
    spark, asked, label, before = posted.sparkSession, [], None, math.inf
    pairs = materialize(_not_yet(_stars(posted, similarity).unionByName(close.withColumn("parts", F.lit(1).cast("long"))), asked), "pairs")
    while True:
        label = _joined(label, materialize(confirmed(pairs, sets.select("node", "set"), similarity), "confirmed"))
        asked.append(pairs)
        member = materialize(posted.join(label, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label")), "members")
        each = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        main = each.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
        main = materialize(main.where("most < n").select("key", "main", "most", "n"), "main")
        work, rows = main.agg(F.coalesce(F.sum(F.expr("(n - most) * n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        left = member.join(main, "key")
        if work <= FEW * rows or work > 0.8 * before:  # few enough, or not to be had with single members
            label = _joined(label, materialize(_in_full(left, sets, similarity), "confirmed"))
            break
        before = work
        pairs = materialize(_not_yet(_stars(left.where("label = main"), similarity, left.where("label <> main"), len(asked)), asked), "pairs")
        for t in (member, main):
            release(spark, t)
    for t in (member, main, *asked):
        release(spark, t)
    return label.withColumnRenamed("node", "id")


def _joined(label: DataFrame | None, new: DataFrame) -> DataFrame:
    """(node, label) after more edges (a, b)."""
    links = new if label is None else new.unionByName(label.select(F.col("node").alias("a"), F.col("label").alias("b")))
    out = components(links).select(F.col("id").alias("node"), "label")
    for t in (new, *([] if label is None else [label])):
        release(out.sparkSession, t)
    return out


def _stars(members: DataFrame, similarity: float, others: DataFrame | None = None, salt: int = 0) -> DataFrame:
    """(hub, node, parts): a member of each list against the others (default: the members). Without a salt the member is the first in
    an order of all nodes, else it is another one in each list."""
    order = F.xxhash64("key", F.lit(salt), "node") if salt else F.xxhash64("node")
    lists = members.groupBy("key").agg(F.min_by(F.struct("node", "size"), order).alias("h"), F.count(F.lit(1)).alias("n"))
    lists = lists.select("key", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size"), F.ceil(F.col("n") / PART).alias("parts"))
    others = members if others is None else others
    return others.select("key", "node", "size").join(lists, "key").where((F.col("node") != F.col("hub")) & _sizes_allow("size", "hub_size", similarity)).select("hub", "node", "parts")


def _in_full(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): in each list of (key, node, size, label, main, most, n), the links of those outside its main component to others that they
    are not connected to. Blocks of up to PART by PART are compared within a task; only links come out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: pa.Table) -> pa.RecordBatch | None:
            guest, node, label, main, size = (t.column(c).to_numpy() for c in ("guest", "node", "label", "main", "size"))
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            packed, key = t.column("set").combine_chunks(), t.column("key")[0].as_py()
            g, m = np.flatnonzero(guest), np.flatnonzero(~guest)
            a, b = [], []
            for i in g.tolist():
                ok = m[(label[m] != label[i]) & ((label[m] == main[m]) | (node[i] < node[m])) & (np.minimum(size[m], size[i]) >= similarity * np.maximum(size[m], size[i]) - 1e-9)]
                same = bands[ok] == bands[i]
                ok = ok[bands[i][same.argmax(1)] == key]  # the first list that the pair meets in
                own = packed[i].as_buffer() if len(ok) else None
                for j in ok.tolist():
                    if alike(own, packed[j].as_buffer(), similarity):
                        a.append(node[i])
                        b.append(node[j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

        held = None
        for batch in simhash._with_end(batches):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                held = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            if held is None or not held.num_rows:
                continue
            at = np.stack([held.column(c).to_numpy() for c in ("key", "gp", "mp")])
            starts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(0)]).tolist()
            ends = [*starts[1:], held.num_rows]
            whole = len(starts) if batch is None else len(starts) - 1  # the last block may go on
            for s, e in zip(starts[:whole], ends[:whole]):
                if (found := links(held.slice(s, e - s))) is not None:
                    yield found
            held = held.slice(starts[whole]) if whole < len(starts) else None

    parts = lambda n: F.ceil(n / PART).cast("long")
    dealt = lambda n: F.pmod(F.xxhash64("node"), parts(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    names = ["key", "node", "size", "label", "main"]
    guests, total = F.col("n") - F.col("most"), F.col("n")
    first = left.where("label <> main").select(*names, F.lit(True).alias("guest"), dealt(guests).alias("gp"), every(total).alias("mp"))
    second = left.select(*names, F.lit(False).alias("guest"), every(guests).alias("gp"), dealt(total).alias("mp"))
    rows = first.unionByName(second).join(sets, "node").select("key", "gp", "mp", "guest", "node", "size", "label", "main", "bands", "set")
    return rows.repartition("key", "gp", "mp").sortWithinPartitions("key", "gp", "mp").mapInArrow(run, "a long, b long")


def _not_yet(pairs: DataFrame, asked: list[DataFrame]) -> DataFrame:
    """Each pair once, without those that have been compared, whichever way round."""
    pairs = pairs.groupBy("hub", "node").agg(F.max("parts").alias("parts"))
    for t in asked:
        both = t.select("hub", "node").unionByName(t.select(F.col("node").alias("hub"), F.col("hub").alias("node")))
        pairs = pairs.join(both, ["hub", "node"], "left_anti")
    return pairs


def close_prints(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """(hub, node): of nodes (node, fp), those of one SimHash with the first of them, and firsts that the byte-position index links."""
    first = materialize(nodes.groupBy("fp").agg(F.min_by("node", F.xxhash64("node")).alias("hub")), "distinct")
    same = nodes.join(first, "fp").where("node <> hub").select("hub", "node")
    a, b = (first.select(F.col("fp").alias(x), F.col("hub").alias(y)) for x, y in (("a", "hub"), ("b", "node")))
    return same.unionByName(simhash.links(first.select("fp"), bits).join(a, "a").join(b, "b").select("hub", "node"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each component of texts linked by exact similarity one row stays, that of the smallest
    (doc_id, text hash).

    All columns stay as they are; they may have any names. Of rows equal in id and text one stays. Null, empty and wordless texts
    have the same empty set and are one component; a text of fewer words than a shingle is one shingle. A null id comes before all
    others. Empty in, empty out.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()).alias("h")).alias("key")
    every = materialize(sketches(docs.select(key, "text"), words, similarity), "sketches")
    nodes = every.groupBy("s0", "s1").agg(F.min("key").alias("first"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "first", "fp", "size", "bands"), "nodes")  # written, so a node's number stays
    posted = nodes.select("node", "size", F.explode("bands").alias("key"))
    posted = materialize(posted.join(posted.groupBy("key").count().where("count > 1").select("key"), "key"), "posted")
    close = materialize(close_prints(nodes.select("node", "fp")), "close")
    met = posted.select("node").unionByName(close.select(F.explode(F.array("hub", "node")).alias("node"))).distinct()
    met = nodes.join(met, "node", "left_semi").select("node", "bands", F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    same = F.col("key.doc_id").eqNullSafe(F.col("_id")) & (F.col("key.h") == F.col("_h"))
    texts = docs.select(key, "text").join(met.hint("shuffle_hash"), same).select("node", "text", "bands")  # no texts are held
    repeats = bool(every.groupBy("key").count().where("count > 1").limit(1).count())
    release(docs.sparkSession, every)
    sets = shingle_sets(texts, words)
    sets = materialize(sets.dropDuplicates(["node"]) if repeats else sets, "sets")
    low = similar(posted, close, sets, similarity)
    for t in (posted, close, sets):
        release(docs.sparkSession, t)
    rooted = nodes.join(low, nodes["node"] == low["id"], "left").select("first", F.coalesce("label", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("key")).select(F.col("key.doc_id").alias("_id"), F.col("key.h").alias("_h"))
    rows = docs.select(F.struct("*").alias("row"), key)
    rows = rows.join(kept.hint("shuffle_hash"), same, "left_semi")
    return (rows.dropDuplicates(["key"]) if repeats else rows).select("row.*")
