"""Quality rules: learned decision lists over text statistics, applied as one Spark conditional.

``text_statistics`` computes the statistics of whole texts with built-in functions only.
``learn`` grows rules by sequential covering from labelled statistics: each rule is a
conjunction of thresholds that is grown by information gain on two thirds of the labelled
rows and pruned on the rest. ``verdict`` turns the ordered rules into a CASE expression.

Defined results: a null text counts as empty; texts with no word fail the base check; rows
with equal ids are judged one by one, and teach as one; labels that are null, or name no document, are left
out; with no usable labels the list is empty and the base check alone decides. Other columns
of the inputs, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import BLANK_CLASS, BLANKS, let, table

#: Labelled rows that a list is learned from at most: those with the least hashes of their ids.
MAX_LABELLED = 8192
#: What a rule may look at.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share")

#: The verdict is learned, which SQL can't express; ``base_counts`` has SQL.
ORACLE_SQL = None

BASE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
k AS (SELECT r, count(DISTINCT i + j) AS n FROM m, (VALUES (0), (1), (2)) v(j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(k.n, 0) > 50 * len(w) AS base_failed
FROM s LEFT JOIN k USING (r)
"""


def _repeated_positions(grams: Column) -> Column:
    """Sorted start positions of the windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(s: Column) -> Column:
        same = lambda i, k: F.get(s, i + k)["h"] == F.get(s, i)["h"]
        every = F.transform(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: F.when(F.coalesce(same(i, -1), F.lit(False)) | F.coalesce(same(i, 1), F.lit(False)), F.get(s, i)["i"]),
        )
        return F.sort_array(F.array_compact(every))

    return let(pairs, flagged)


def _covered(grams: Column) -> Column:
    """Words that lie in a repeated three-word window."""
    def length(starts: Column) -> Column:
        spans = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, b: a + b)

    return let(_repeated_positions(grams), length)


def _counts(whole: Column) -> Column:
    """The base counts of a text and what the shares need, as one struct."""
    trimmed = F.trim(whole, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_CLASS + "+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))

    def grams(w: Column) -> Column:
        window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, window).otherwise(F.array().cast("array<bigint>"))

    def repeated(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(g))

    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(grams(w), repeated).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        without(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        without("[A-Z]").alias("upper"),
        without("[!?]").alias("bang"),
    )


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The statistics of every whole text: ``keep`` columns, the base counts (long) and FEATURES.

    The counts leave a generator, which later filters are not pushed through: they are made
    once a row, whatever is asked of them.
    """
    counted = docs.select(*keep, F.explode(F.array(_counts(F.coalesce(F.col("text"), F.lit(""))))).alias("_s"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counted.select(
        *keep,
        F.col("_s.w.n_words").alias("n_words"),
        F.col("_s.w.word_chars").alias("word_chars"),
        F.col("_s.n_symbols").alias("n_symbols"),
        F.col("_s.l.n_dup_lines").alias("n_dup_lines"),
        F.col("_s.w.n_repeat_words").alias("n_repeat_words"),
        share("_s.w.word_chars", "_s.w.n_words").alias("mean_word"),
        share("_s.n_symbols", "_s.w.n_words").alias("symbol_share"),
        share("_s.l.n_dup_lines", "_s.l.lines").alias("dup_line_share"),
        share("_s.w.n_repeat_words", "_s.w.n_words").alias("repeat_share"),
        share("_s.upper", "_s.w.word_chars").alias("upper_share"),
        share("_s.bang", "_s.w.n_words").alias("bang_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column >= self.threshold if self.above else column < self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _matches(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest information gain on the rows still covered."""
    p0, n0 = bad.sum(), (~bad).sum()
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for k, name in enumerate(FEATURES):
        order = np.argsort(x[:, k], kind="stable")
        values, hits = x[order, k], np.cumsum(bad[order])
        cut = np.flatnonzero(values[1:] > values[:-1])
        if not len(cut):
            continue
        middle = (values[cut] + values[cut + 1]) / 2
        below_p, below_n = hits[cut], cut + 1 - hits[cut]
        for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), Condition(name, above, float(middle[at])))
    return best


def learn_rules(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 2) -> list[Rule]:
    """Sequential covering: ordered rules that pick bad rows out.

    prune marks the rows that are held back from growing and decide how far a rule is cut.
    """
    rules: list[Rule] = []
    live = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules and (bad & live & ~prune).sum() >= min_covered:
        inside = live & ~prune
        rule: Rule = ()
        while len(rule) < max_conditions and (~bad & inside).any():
            _, condition = _best_condition(x[inside], bad[inside])
            if condition is None:
                break
            rule += (condition,)
            inside = inside & condition.holds(x)

        def worth(r: Rule) -> float:
            hit = _matches(r, x) & live & prune
            p, n = (bad & hit).sum(), (~bad & hit).sum()
            return float((p - n) / (p + n)) if p + n else -1.0

        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        if not cuts:
            break
        rule = max(cuts, key=lambda r: (worth(r), len(r)))  # ties: the narrower, which spares more clean rows
        hit = _matches(rule, x) & live
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        if p < min_covered or p / (p + n) < min_precision:
            break
        rules.append(rule)
        live &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list of the labelled documents, of at most ``max_labelled`` of them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    picked = known.groupBy("doc_id").agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    stats = text_statistics(joined, "doc_id", "_quality").groupBy("doc_id", "_quality")
    # rows that share a labelled id count once, by the least statistics
    rows = stats.agg(F.min(F.struct(*FEATURES)).alias("_f")).select("doc_id", "_quality", "_f.*").collect()
    if not rows:
        return []
    rows.sort(key=lambda r: tuple(r))
    x = np.array([[r[f] for f in FEATURES] for r in rows], dtype=float)
    bad = np.array([r["_quality"] == 0 for r in rows])
    return learn_rules(x, bad, np.arange(len(x)) % 3 == 2)


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule picks out: an ordered conditional, first match wins."""
    out: Column | None = None
    for rule in rules:
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """Statistics, base check and verdict of every document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = text_statistics(docs, *keep).withColumn("base_failed", failed)
    return stats.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base check of every document, without the learned rules."""
    judged = judge(table(spark, sf_dir, "documents"), [], "doc_id")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    judged = judge(docs, rules, "doc_id")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
