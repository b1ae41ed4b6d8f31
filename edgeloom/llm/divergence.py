"""How far the sources of a language are from each other and from the language, by the terms that they use.

Tasks count terms in byte tries, whose leaves hold a counter for each source and the number of documents. A trie's traversal is in
UTF-8 order; the traversals are dealt out by prefix range, so a task merges those of its range by adding equal neighbours, and holds
one term at a time. Merged terms stream into the sums over pairs of sources and into the ranks of terms. All arithmetic is on whole
numbers.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import materialize

#: A term must be in so many documents of its language.
DOCUMENTS = 10
#: Ranks of terms that are reported; shares are in parts of UNIT.
TOP, UNIT = 10, 1_000_000_000
#: Bounds on what a task holds: entries counted before they go into the trie, leaves of the trie before it is passed on.
HELD, LEAVES = 300_000, 400_000
#: Tails that a node of a trie keeps together before it is split by their first byte.
TAILS = 256
#: Sources in a block, terms in a part: a task of the pair sums has one part of the terms of two blocks.
BLOCK, PART = 64, 20_000
#: Letters, lower-cased, and all bytes above ASCII; the rest parts terms.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DOCS = -1


class Trie:
    """A byte trie with path compression: a node is split into its bytes only when it has more than TAILS tails.

    A leaf is a dictionary: counter by key, with the number of documents at the key _DOCS.
    """

    def __init__(self) -> None:
        self.root: list = [None, {}]  # inner nodes: the leaf that ends here, and children by byte; others: tails to leaves
        self.leaves = 0

    def leaf(self, term: bytes) -> dict:
        """The term's leaf, a new one if there is none."""
        node, up, i = self.root, None, 0
        while type(node) is list:
            if i == len(term):
                if node[0] is None:
                    node[0] = {}
                    self.leaves += 1
                return node[0]
            up, node = node, node[1].get(term[i])
            i += 1
        if node is None:
            node = up[1][term[i - 1]] = {}
        tail = term[i:]
        leaf = node.get(tail)
        if leaf is None:
            leaf = node[tail] = {}
            self.leaves += 1
            if len(node) > TAILS:
                up[1][term[i - 1]] = self._split(node)
        return leaf

    def add(self, counts: dict[int, dict[bytes, int]]) -> None:
        """Add counts of terms to the counters of their leaves, by key; a leaf is looked for once."""
        at: dict[bytes, dict] = {}
        for key, own in counts.items():
            for term, n in own.items():
                leaf = at.get(term)
                if leaf is None:
                    leaf = at[term] = self.leaf(term)
                leaf[key] = leaf.get(key, 0) + n

    @staticmethod
    def _split(node: dict[bytes, dict]) -> list:
        inner: list = [node.pop(b"", None), {}]
        for tail, leaf in node.items():
            inner[1].setdefault(tail[0], {})[tail[1:]] = leaf
        return inner

    def walk(self) -> Iterator[tuple[bytes, dict]]:
        """Terms and leaves in byte order."""
        stack: list = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            if type(node) is list:
                if node[0] is not None:
                    yield path, node[0]
                stack.extend((path + bytes([b]), node[1][b]) for b in sorted(node[1], reverse=True))
            else:
                for tail in sorted(node):
                    yield path + tail, node[tail]


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) to rows of tries: (lang, term, docs, sources, counts)."""
    tries: dict[str, Trie] = {}
    names: dict[str, int] = {}
    held: dict[str, dict[int, Counter]] = {}

    def settle() -> None:
        for lang, counts in held.items():
            tries.setdefault(lang, Trie()).add(counts)
        held.clear()

    def out() -> Iterator[pa.RecordBatch]:
        settle()
        known = pa.array(list(names), pa.string())
        for lang in sorted(tries):
            term, docs, ends, keys, counts = [], [], [0], [], []

            def batch() -> pa.RecordBatch:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (known.take(pa.array(keys, pa.int64())), pa.array(counts, pa.int64()))]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array([lang] * len(term), pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), *lists], ["lang", "term", "docs", "sources", "counts"])  # noqa: B023

            for t, leaf in tries[lang].walk():
                docs.append(leaf.pop(_DOCS))
                term.append(t)
                keys.extend(leaf)
                counts.extend(leaf.values())
                ends.append(len(keys))
                if len(term) == 10_000:
                    yield batch()
                    term, docs, ends, keys, counts = [], [], [0], [], []
            yield batch()
        tries.clear()
        names.clear()

    gc.disable()  # nothing here has cycles, and the collector would walk the tries again and again; the worker's next task sets it anew
    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            found = terms(text)
            own = held.get(lang)
            if own is None:
                own = held[lang] = defaultdict(Counter)
            own[names.setdefault(source, len(names))].update(found)
            own[_DOCS].update(set(found))
            if sum(len(c) for x in held.values() for c in x.values()) > HELD:
                settle()
                if sum(t.leaves for t in tries.values()) > LEAVES:
                    yield from out()
    yield from out()
    gc.enable()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tries in order of (lang, term): terms in enough documents, with all their counters. Only the rows of the term that
    may go on in the next batch are held."""
    rest = None
    names = ["lang", "term", "sources", "counts"]

    def merged(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        first = np.flatnonzero(starts)
        docs = np.add.reduceat(t["docs"].to_numpy(), first)
        run = np.cumsum(starts) - 1
        ok = docs >= DOCUMENTS
        rows = np.flatnonzero(ok[run])
        new = np.cumsum(ok) - 1
        some, at = t.take(pa.array(rows)).combine_chunks(), pa.array(first[ok])
        lists = some["sources"].chunk(0) if len(rows) else pa.array([], pa.list_(pa.string()))
        flat = lists.flatten().dictionary_encode()
        counts = some["counts"].chunk(0).flatten().to_numpy() if len(rows) else np.zeros(0, np.int64)
        wide = max(1, len(flat.dictionary))
        key = np.repeat(new[run[rows]], pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)) * wide + flat.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        sums = np.add.reduceat(counts, begins) if len(begins) else counts
        key = key[begins]
        ends = pa.array(np.searchsorted(key // wide, np.arange(int(ok.sum()) + 1)), pa.int32())
        both = [pa.ListArray.from_arrays(ends, flat.dictionary.take(pa.array(key % wide))), pa.ListArray.from_arrays(ends, pa.array(sums, pa.int64()))]
        return pa.RecordBatch.from_arrays([t["lang"].take(at).combine_chunks().cast(pa.string()), t["term"].take(at).combine_chunks(), *both], names)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        starts = np.ones(t.num_rows, bool)
        for i in ("lang", "term"):
            x = t[i].combine_chunks()
            differs = pc.not_equal(x.slice(1), x.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts[1:] = differs if i == "lang" else starts[1:] | differs
        cut = int(np.flatnonzero(starts)[-1])
        if cut:
            yield merged(t.slice(0, cut), starts[:cut])
        rest = t.slice(cut)
        if rest.num_rows > 64:  # a term of very many tries: add up what is there
            flat = Counter()
            for s, n in zip(rest["sources"].to_pylist(), rest["counts"].to_pylist()):
                for k, v in zip(s, n):
                    flat[k] += v
            rest = pa.table([rest["lang"].slice(0, 1), rest["term"].slice(0, 1), pa.array([pc.sum(rest["docs"]).as_py()], pa.int64()), pa.array([list(flat)], pa.list_(pa.string())), pa.array([list(flat.values())], pa.list_(pa.int64()))], schema=rest.schema)
    if rest is not None:
        yield merged(rest, np.r_[True, np.zeros(rest.num_rows - 1, bool)])


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, sources, counts): each term in at least DOCUMENTS documents of its language, with its count in every source that
    has it. A null lang, source or text is empty; a repeated row counts again. The table is kept in the shared folder."""
    rows = docs.select(_blank("lang").alias("lang"), _blank("source").alias("source"), _blank("text").cast("binary").alias("text"))
    tries = materialize(rows.mapInArrow(_count, "lang string, term string, docs long, sources array<string>, counts array<long>"), "tries")
    ranges = tries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return materialize(ranges.mapInArrow(_merge, "lang string, term string, sources array<string>, counts array<long>"), "terms")


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNIT (n + 2) / (total + 2 kinds)), exactly."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.call_function("div", wide, (total + 2 * kinds).cast("decimal(19,0)")) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(x: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """_share() of an array of counts (terms by sources): long division by thousands, so nothing overflows."""
    d = np.maximum(total + 2 * kinds, 1)
    r = x + 2
    p = r // d
    for _ in range(3):
        r = (r - r // d * d) * 1000
        p = p * 1000 + r // d
    return p + 1


def _pair_sums(key: tuple, rows: pa.Table, info: pa.Table) -> pa.Table:
    """The part's share of the distances between the sources of two blocks, as if the terms that neither has were in none of the parts
    but the first."""
    lang, lo, hi, part = (k.as_py() for k in key)
    i = info.to_pylist()[0]
    kinds, same = i["kinds"], lo == hi
    sides = [([s["source"] for s in i[x]], np.array([s["total"] for s in i[x]], np.int64)) for x in ("a", "b")]
    sums = np.zeros((len(sides[0][0]), len(sides[1][0])), np.int64)
    none = [shares(np.zeros(len(s[1]), np.int64), s[1], kinds) for s in sides]
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    seen = 0
    if rows.num_rows:
        term = rows["term"].combine_chunks().dictionary_encode()
        seen, at = len(term.dictionary), term.indices.to_numpy(zero_copy_only=False)
        block = rows["block"].to_numpy()
        cells = rows["cells"].combine_chunks()
        each = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
        slot, n = (cells.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
        where, whose = np.repeat(at, each), np.repeat(block, each)
        p = []
        for b, side in ((lo, sides[0]), (hi, sides[1])):
            x = np.zeros((seen, len(side[0])), np.int64)
            own = whose == b
            x[where[own], slot[own]] = n[own]
            p.append(shares(x, side[1], kinds))
        for k in range(len(sides[0][0])):
            sums[k] = apart(p[0][:, k : k + 1], p[1]).sum(0)
    sums += ((kinds if part == 0 else 0) - seen) * apart(none[0][:, None], none[1][None, :])
    a, b = np.triu_indices(len(sums), 1) if same else (x.ravel() for x in np.indices(sums.shape))
    columns = [[lang] * len(a), [sides[0][0][k] for k in a], [sides[1][0][k] for k in b], sums[a, b]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group of documents of one language and source, its distances from the
    language's other sources (part pair, all ranks), and the terms it has more of than the language (part term, ranks to TOP).

    Terms are those of kept_terms(). A group's share of a term is p = 1 + floor(UNIT (count + 2) / (N + 2 V)), N its count of kept
    terms, V how many there are; the language has shares q in the same way. Distances are floor((p - q)^2 / (p + q)). Ranks go by
    value downwards, then item in UTF-8 order. Nulls are empty strings, and so a language or a source of their own; repeated rows
    count again; groups without terms take part; a language without kept terms has distances 0. No documents: no rows.

    Terms are dealt out in parts of about PART, sources in blocks of BLOCK, so a group's size bounds no task's memory.
    """
    kept = kept_terms(docs)
    cells = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("all"), F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "all", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    size = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = docs.select(_blank("lang").alias("lang"), _blank("source").alias("source")).distinct().withColumn("nth", nth)
    groups = groups.join(size, ["lang", "source"], "left").join(kinds, "lang", "left")
    whole = lambda c: F.sum(c).over(Window.partitionBy("lang"))
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kinds")), (F.col("nth") / BLOCK).cast("int").alias("block"), (F.col("nth") % BLOCK).alias("slot"))
    groups = materialize(groups.withColumns({"lang_total": whole("total"), "blocks": (F.max("block").over(Window.partitionBy("lang")) + 1)}), "groups")

    parts = (F.col("kinds") / PART).cast("int") + 1
    full = cells.join(groups, ["lang", "source"])
    deal = full.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("slot", "n")).alias("cells"), F.first("blocks").alias("blocks"), F.first("kinds").alias("kinds"))
    deal = deal.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    deal = deal.select("lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.pmod(F.xxhash64("term"), parts).cast("int").alias("part"), "term", "block", "cells")
    blocks = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "source", "total"))).alias("s"), F.first("kinds").alias("kinds"))
    a, b = (blocks.select("lang", F.col("block").alias(x), F.col("s").alias(y), *([] if y == "b" else ["kinds"])) for x, y in (("lo", "a"), ("hi", "b")))
    info = a.join(b, "lang").where("lo <= hi").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    key = ["lang", "lo", "hi", "part"]
    sums = deal.groupBy(*key).cogroup(info.groupBy(*key)).applyInArrow(_pair_sums, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = sums.select("lang", "value", F.explode(both).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    p, q = _share(F.col("n"), F.col("total"), F.col("kinds")), _share(F.col("all"), F.col("lang_total"), F.col("kinds"))
    own = full.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(own.withColumn("rank", rank).where(F.col("rank") <= TOP))


def op11_radix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as (select lang, term, count(*) n from w group by 1, 2 having count(distinct id) >= 10),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) n from w group by 1, 2, 3),
v as (select lang, count(*) v, sum(n) total from kept group by 1),
x as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, k.n as all_n from g join kept k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select x.lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by x.lang, source) + 2 * v) p,
    1 + (1000000000::hugeint * (all_n + 2)) // (total + 2 * v) q from x join v on v.lang = x.lang),
pairs as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) s from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
r as (select a.lang, a.source, 'pair' part, b.source item, coalesce(s, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item) as rank from r
qualify part = 'pair' or rank <= 10
"""
