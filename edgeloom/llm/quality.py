"""Quality rules: statistics of whole texts in SQL functions, and a learned decision list over them.

Sequential covering on labelled rows: a conjunction of thresholds is grown by information gain on one part of the rows, pruned on
the other, kept if it is precise on both; the rows it covers are put aside and the next is grown. The list becomes one ordered
conditional expression. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import SPACES

WINDOW = 5
#: Statistics that the rules may look at.
FEATURES = ["n_words", "word_length", "symbol_share", "dup_lines", "repeat_share", "upper_share", "mark_share", "letter_share", "distinct_share"]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the FEATURES) of each whole text.

    n_repeat_words: words that stand in some window of five words found twice or more in the text, each word once. A null or empty
    text has no words, zero everywhere, and fails the base rules. Windows and lines are compared by their 64-bit hashes. Rows are
    independent: no shuffle, whatever a text's length.
    """
    t = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    count = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    t = t.select(
        id_col,
        "t",
        F.transform(F.filter(F.split("t", f"[{SPACES}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("w"),
        F.transform(F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACES}]")), lambda x: F.xxhash64(x)).alias("lines"),
    )
    t = t.select(
        id_col,
        F.size("w").cast("long").alias("n_words"),
        count(f"[^{SPACES}]").cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\p{L}").alias("n_letters"),
        count(r"[!?]").alias("n_marks"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.when(F.size("w") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("w", 1, F.size("w") - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(F.get("w", i + k) for k in range(1, WINDOW))))).alias("g"),
    )
    t = t.withColumn("again", F.size("g") > F.size(F.array_distinct("g")))
    t = t.withColumn("g", F.when(F.col("again"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("g", lambda x, k: F.coalesce(F.get("g", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("g", k + 1)["h"] == x["h"], F.lit(False)))
    t = t.withColumn("at", F.when(F.col("again"), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    gaps = F.transform("at", lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("at", k - 1))))
    repeated = F.when(F.col("again"), F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))
    t = t.withColumn("n_repeat_words", repeated)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    found = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_upper", "n_letters").alias("upper_share"),
        share("n_marks", "n_words").alias("mark_share"),
        share("n_letters", "word_chars").alias("letter_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )
    # a generator keeps filters on the statistics above it: pushed down, they would repeat the array expressions within lambdas
    return t.select(id_col, F.explode(F.array(found)).alias("s")).select(id_col, "s.*")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.mask(table)
    return out


def learn(table: dict[str, np.ndarray], bad: np.ndarray, split: np.ndarray, precision: float = 0.95, least: int = 5, rules: int = 16, conditions: int = 4, cuts: int = 64) -> list[Rule]:
    """Ordered rules for bad rows. split: rows to grow on; the others prune. A rule stays if its Laplace-corrected precision on
    all rows left, and its precision on the pruning rows, reach `precision`, and it covers at least `least` bad rows."""
    out: list[Rule] = []
    left = np.ones(len(bad), bool)
    thresholds = {f: np.unique(np.quantile(x, np.linspace(0, 1, cuts + 1)[1:-1])) if len(x) else x for f, x in table.items()}
    while len(out) < rules and (bad & left & split).any():
        inside, rule = left & split, ()
        while len(rule) < conditions:
            p, n = int((bad & inside).sum()), int((~bad & inside).sum())
            if not p or not n:
                break
            old, best = np.log2(p / (p + n)), (0.0, None)
            for f, cutting in thresholds.items():
                for above in (True, False):
                    x = table[f][inside]
                    y = bad[inside]
                    order = np.sort(x), np.sort(x[y])
                    for k, (all_below, bad_below) in enumerate(zip(np.searchsorted(order[0], cutting, "right"), np.searchsorted(order[1], cutting, "right"))):
                        total, good = (len(x) - all_below, p - bad_below) if above else (all_below, bad_below)
                        if good >= least and (gain := good * (np.log2(good / total) - old)) > best[0] + 1e-12:
                            best = gain, Condition(f, above, float(cutting[k]))
            if best[1] is None:
                break
            rule = (*rule, best[1])
            inside = inside & best[1].mask(table)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            m = _covered(r, table, len(bad)) & left & ~split
            p, n = int((bad & m).sum()), int((~bad & m).sum())
            return ((p - n) / (p + n) if p + n else -1.0), -len(r)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        m = _covered(rule, table, len(bad)) & left
        p, n = int((bad & m).sum()), int((~bad & m).sum())
        q, r = int((bad & m & ~split).sum()), int((~bad & m & ~split).sum())
        if p < least or (p + 1) / (p + n + 2) < precision * (1 - 1 / (p + 2)) or q < precision * (q + r):
            break
        out.append(rule)
        left &= ~m
    return out


def expression(rules: list[Rule]) -> Column:
    """Whether the list keeps a row: the first rule that holds rejects it."""
    kept = None
    for rule in rules:
        c = rule[0].column()
        for more in rule[1:]:
            c = c & more.column()
        kept = F.when(c, F.lit(False)) if kept is None else kept.when(c, F.lit(False))
    return F.lit(True) if kept is None else kept.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> list[Rule]:
    """Rules for quality 0, from at most `rows` labelled documents, in hashed order, that pass the base rules.

    Null ids and null labels take no part; of several labels of an id the lowest counts; a document that is there twice counts
    twice; labels without a document count nowhere. Other columns are not looked at. Among equally good conditions the first
    feature and the lowest threshold are taken. Without labels, or without bad rows, there are no rules.
    """
    h, kind = F.xxhash64("doc_id"), docs.schema["doc_id"].dataType.simpleString()
    labels = labels.select(F.expr(f"try_cast(doc_id as {kind})").alias("doc_id"), "quality")
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(h, "doc_id").limit(rows)
    picked = {r["doc_id"]: r["quality"] for r in some.collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in picked], docs.select("doc_id").schema)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # at most `rows` ids
    got = statistics(chosen).where(~F.col("base_failed")).select("doc_id", *FEATURES).collect()
    got.sort(key=lambda r: tuple(r))
    bad = np.array([picked[r["doc_id"]] == 0 for r in got], bool)
    table = {f: np.array([r[f] for r in got], float) for f in FEATURES}
    split = np.random.default_rng(0).random(len(got)) < 2 / 3
    return learn(table, bad, split)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """statistics() and kept: false where the base rules or the list reject the text. Null and repeated rows as in statistics()."""
    return statistics(docs, id_col, text_col).withColumn("kept", ~F.col("base_failed") & expression(rules))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
