"""Quality rules: text statistics and a learned decision list, in Spark expressions alone.

Statistics are built-in functions over the words and lines of a text. The list is learned by sequential covering on a bounded sample of labelled rows: a rule is a conjunction of thresholds, grown by the gain of information on one part of the sample and pruned on the other, rows that it covers are taken away, and the next rule is learned from the rest, until the next would not be precise enough. It becomes one ordered conditional expression.

Defined results: a null or blank text has no words and fails the base rule; extra columns do not matter; without usable labels the list is empty and the base rule decides alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, sample_of

#: Labelled rows the list is learned from, at most: those with the least hash of their key.
FIT_ROWS = 8000
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
#: Thresholds tried per statistic, conditions in a rule, rules in the list; a rule must be right on so much of what it covers and cover so many rows.
CUTS, CONDITIONS, RULES, PRECISION, SUPPORT = 24, 4, 12, 0.9, 5


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text."""

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))))

    def among(order: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(order, k)["h"] == e["h"], F.lit(False))
        found = F.filter(order, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return bind(F.sort_array(F.transform(found, lambda e: e["i"])), covered)

    def of(hashes: Column) -> Column:
        unlike = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unlike, F.lit(0)).otherwise(bind(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), among))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(bind(windows, of))


def kept_chars(text: Column, pattern: str) -> Column:
    """Characters of a class; pattern: runs of the others."""
    return F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the base statistics, and the ratios that rules are learned from."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    found = docs.select(
        *keep,
        bind(words_of(whole), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"))).alias("w"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        kept_chars(whole, r"[^#*$%&|<>]+").alias("n_symbols"),
        kept_chars(whole, r"[^\p{Lu}]+").alias("n_upper"),
        kept_chars(whole, r"[^\p{N}]+").alias("n_digits"),
        kept_chars(whole, r"[^\p{P}]+").alias("n_marks"),
    )
    counts = {n: F.col(c).cast("long") for n, c in {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words"}.items()}
    by = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return found.select(
        *keep,
        *(c.alias(n) for n, c in counts.items()),
        by("n_symbols", "w.n_words").alias("r_symbols"),
        by("l.n_dup_lines", "l.n_lines").alias("r_dup_lines"),
        by("w.n_repeat_words", "w.n_words").alias("r_repeat"),
        by("w.n_distinct", "w.n_words").alias("r_distinct"),
        by("w.word_chars", "w.n_words").alias("r_word_length"),
        by("n_upper", "w.word_chars").alias("r_upper"),
        by("n_digits", "w.word_chars").alias("r_digits"),
        by("n_marks", "w.n_words").alias("r_marks"),
        by("w.n_words", "l.n_lines").alias("r_line_words"),
        F.col("w.n_words").cast("double").alias("r_words"),
    )


RATIOS = ("r_symbols", "r_dup_lines", "r_repeat", "r_distinct", "r_word_length", "r_upper", "r_digits", "r_marks", "r_line_words", "r_words")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        at = x[:, RATIOS.index(self.name)]
        return at > self.cut if self.above else at <= self.cut

    def column(self) -> Column:
        return F.col(self.name) > F.lit(self.cut) if self.above else F.col(self.name) <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def right(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[int, int]:
    on = holds(rule, x)
    return int((on & bad).sum()), int((on & ~bad).sum())


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Conditions by the largest gain: rows of the class kept, times the bits that each of them gains."""
    rule: Rule = ()
    on = np.ones(len(x), bool)
    while len(rule) < CONDITIONS and (p0 := int((on & bad).sum())) and (n0 := int((on & ~bad).sum())):
        before, best = math.log2(p0 / (p0 + n0)), (0.0, None, None)
        for j, name in enumerate(RATIOS):
            own = x[on, j]
            levels = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower"))
            poor = np.quantile(x[on & bad, j], np.linspace(0, 1, CUTS // 2), method="lower")
            for cut in np.unique(np.concatenate([levels, poor])):
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    now = on & c.holds(x)
                    p = int((now & bad).sum())
                    if p >= SUPPORT and (gain := p * (math.log2(p / int(now.sum())) - before)) > best[0] + 1e-9:
                        best = gain, c, now
        if best[1] is None:
            break
        rule, on = (*rule, best[1]), best[2]
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest head of the rule with the best share of right less wrong."""
    worth = lambda r: (lambda p, n: ((p - n) / (p + n) if p + n else -1.0, -len(r)))(*right(r, x, bad))
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Ordered rules for the bad class; what none of them covers is good. Every third row prunes."""
    out: list[Rule] = []
    fold = np.arange(len(x)) % 3 == 2
    while len(out) < RULES and bad.sum() >= SUPPORT:
        rule = prune(grow(x[~fold], bad[~fold]), x[fold], bad[fold])
        p, n = right(rule, x, bad) if rule else (0, 0)
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        out.append(rule)
        rest = ~holds(rule, x)
        x, bad, fold = x[rest], bad[rest], fold[rest]
    return out


def decision_list(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(i)) if out is None else out.when(both, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """docs: doc_id and text; labels: doc_id and quality (1 good, 0 bad)."""
    chosen = sample_of(labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality"), rows, "doc_id", "quality")
    found = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), keep=("doc_id", "quality"))
    one = F.min(F.struct("quality", "n_words", "n_repeat_words", *RATIOS))  # where an id repeats
    sample = found.groupBy("doc_id").agg(one.alias("x")).select("doc_id", "x.*").orderBy("doc_id").collect()  # rows at most
    if not sample:
        return []
    x = np.array([[r[n] for n in RATIOS] for r in sample], float)
    bad = np.array([r["quality"] == 0 for r in sample])
    failed = np.array([base_fails(r["n_words"], r["n_repeat_words"]) for r in sample])
    return learn(x[~failed], bad[~failed])


def base_fails(n_words, n_repeat_words):
    """For numbers and for columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, the base statistics, base_failed, rule (of the list, 0 for none) and kept."""
    found = statistics(docs, text, keep).withColumn("base_failed", base_fails(F.col("n_words"), F.col("n_repeat_words"))).withColumn("rule", decision_list(rules))
    return found.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
