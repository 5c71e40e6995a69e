"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule fits.

Everything on the rows is a built-in expression. The trees are grown by second-order boosting over quantile bins on a bounded sample of labelled URLs (those that a rule decides) and become nested conditional expressions. Suffix statistics are smoothed shares of blocked URLs among all labelled ones, by a hash of the host's last label or last two labels into BUCKETS, a table of fixed size.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the trees; an empty table gives no rows; without labelled URLs of both kinds the trees are empty and allow.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, sample_of

#: The rules of the registered query: (verdict, rule). A rule is a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs the trees are grown from, at most: those with the least hash.
FIT_ROWS, BUCKETS = 10_000, 1024
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 16, 3, 24, 0.3, 1.0, 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "has_fragment", "suffix_1", "suffix_2")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = lambda c: F.transform(F.array(share(c)), lambda p: -p * F.log2(p))[0]
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a + F.when(F.length(c) > 0, bits(c)).otherwise(0.0))).otherwise(F.lit(0.0))


def lexical(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, label (1 block, 0 allow, null without a rule), the features but for the suffix shares, and the suffixes' buckets."""
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host, path = host_and_path(F.col(url).cast("string"))
    base = pages.select(F.col(key), whole.alias("u"), host.alias("host"), path.alias("path")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    query = F.regexp_extract("u", r"\?([^#]*)", 1)
    count = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))
    bucket = lambda k: F.pmod(F.xxhash64(F.substring_index("host", ".", -k)), F.lit(BUCKETS)).cast("int")
    found = {
        "length": F.length("u"),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "host_depth": count("host", "."),
        "digit_ratio": F.length(F.regexp_replace("u", "[^0-9]+", "")) / F.greatest(F.length("u"), F.lit(1)),
        "entropy": entropy(F.col("u")),
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "n_hyphens": count("host", "-"),
        "has_fragment": F.col("u").contains("#").cast("int"),
    }
    return base.select(key, "host", "path", F.col("found.rule").alias("rule"), (F.col("found.verdict") == "block").cast("int").alias("label"), *(c.cast("double").alias(n) for n, c in found.items()), bucket(1).alias("b1"), bucket(2).alias("b2"))


def with_suffixes(rows: DataFrame) -> DataFrame:
    """Adds suffix_1 and suffix_2, the shares of blocked among labelled URLs of the suffix, drawn to one half by one of each."""
    for k in (1, 2):
        share = rows.where("label is not null").groupBy(f"b{k}").agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias(f"suffix_{k}"))
        rows = rows.join(F.broadcast(share), f"b{k}", "left")  # BUCKETS rows at most
    return rows.fillna(0.5, ["suffix_1", "suffix_2"])


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.margin(x), self.high.margin(x))

    def column(self) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(F.col(FEATURES[self.feature]) <= F.lit(self.cut), self.low.column()).otherwise(self.high.column())


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int) -> Node:
    """A tree by the largest gain of the second-order loss."""
    node = Node(float(-RATE * g.sum() / (h.sum() + RIDGE)))
    if not depth or len(g) < 2 * LEAST:
        return node
    worth = lambda a, b: a * a / (b + RIDGE)
    best, total = 1e-6, worth(g.sum(), h.sum())
    for j, levels in enumerate(cuts):
        if not len(levels):
            continue
        at = np.searchsorted(levels, x[:, j])  # bin k: at most levels[k]
        n, gs, hs = (np.cumsum(np.bincount(at, w, len(levels) + 1))[:-1] for w in (None, g, h))
        gain = np.where((n >= LEAST) & (len(g) - n >= LEAST), worth(gs, hs) + worth(g.sum() - gs, h.sum() - hs) - total, 0)
        if (k := int(gain.argmax())) >= 0 and gain[k] > best + 1e-9:
            best, node.feature, node.cut = float(gain[k]), j, float(levels[k])
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low, node.high = (grow(x[m], g[m], h[m], cuts, depth - 1) for m in (low, ~low))
    return node


@dataclass
class Boosted:
    bias: float
    trees: list[Node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((t.margin(x) for t in self.trees), np.zeros(len(x)))

    def column(self) -> Column:
        out = F.lit(self.bias)
        for t in self.trees:
            out = out + t.column()
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Log-odds that a URL is blocked."""
    if not len(y) or not 0 < y.sum() < len(y):
        return Boosted(-1.0, [])
    model = Boosted(math.log(y.mean() / (1 - y.mean())), [])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[:-1], method="lower")) for c in x.T]
    margin = model.margin(x)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x, p - y, p * (1 - p), cuts, DEPTH)
        model.trees.append(tree)
        margin = margin + tree.margin(x)
    return model


def fit(rows: DataFrame, most: int = FIT_ROWS, key: str = "page_id") -> Boosted:
    """rows: the result of with_suffixes()."""
    sample = sample_of(rows.where("label is not null").select(F.xxhash64(col(key), "host", "path").alias("k"), "label", *FEATURES), most, "k", *FEATURES).collect()
    x = np.array([[r[n] for n in FEATURES] for r in sample], float).reshape(-1, len(FEATURES))
    return boost(x, np.array([r["label"] for r in sample], float))


def judge(pages: DataFrame, rules=RULES, most: int = FIT_ROWS, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, and score, the trees' probability that it should be blocked."""
    rows = with_suffixes(lexical(pages, rules, key, url))
    score = 1 / (1 + F.exp(-fit(rows, most, key).column()))
    verdict = F.when(F.col("label").isNotNull(), F.when(F.col("label") == 1, "block").otherwise("allow")).otherwise(F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.withColumn("score", score).select(key, "host", "path", "rule", verdict.alias("verdict"), "score")
