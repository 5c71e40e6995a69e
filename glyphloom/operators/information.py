"""Entropy, mutual information and divergences, from counts.

Every function takes pre-aggregated counts, so what is shuffled is cells, not occurrences, and frequent symbols do not skew the plan. Marginals are aggregates joined back by their key, not windows over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double(name: str) -> Column:
    return F.col(name).cast("double")


def entropy(counts: DataFrame, *strata: str) -> DataFrame:
    """counts: strata, n. Bits: log2(N) - sum(n log2 n) / N; a row for each stratum."""
    n = double("n")
    return counts.groupBy(*strata).agg(F.sum(n).alias("total"), (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"))


def mutual_information(cells: DataFrame, *strata: str) -> DataFrame:
    """cells: strata, a, b, n. strata, total and mi in bits; 0 where there is nothing."""
    by = list(strata)
    rows = cells.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    columns = cells.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = cells.join(rows, [*by, "a"]).join(columns, [*by, "b"])
    joined = joined.join(totals, by) if by else joined.crossJoin(totals)  # one row
    piece = double("n") / double("total") * F.log2(double("n") * double("total") / (double("na") * double("nb")))
    return joined.groupBy(*by).agg(F.max("total").alias("total"), F.sum(piece).alias("mi"))


def conditional_information(cells: DataFrame, *strata: str, outer: tuple[str, ...] = ()) -> DataFrame:
    """The mean of mi over strata (besides the outer ones), weighted by their totals."""
    mi = mutual_information(cells, *outer, *strata)
    return mi.groupBy(*outer).agg(F.sum("total").cast("long").alias("total"), (F.sum(double("total") * F.col("mi")) / F.sum(double("total"))).alias("cmi"))


def information_by_bin(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """cells: a, b, n; bins: a, bin. The pieces of the mutual information by the bin of a; they add up to the whole."""
    rows, columns, totals = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb")), cells.agg(F.sum("n").alias("total"))
    joined = cells.join(rows, "a").join(columns, "b").crossJoin(totals).join(bins, "a")
    piece = double("n") / double("total") * F.log2(double("n") * double("total") / (double("na") * double("nb")))
    return joined.groupBy("bin").agg(F.sum("n").alias("pairs"), F.sum(piece).alias("mi"))


def cosine(vectors: DataFrame, item: str = "item", feature: str = "feature", value: str = "value") -> DataFrame:
    """Sparse vectors as (item, feature, value): one row for each two items a < b that share a feature."""
    norms = vectors.groupBy(item).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    left = vectors.select(F.col(item).alias("a"), feature, F.col(value).alias("va"))
    right = vectors.select(F.col(item).alias("b"), feature, F.col(value).alias("vb"))
    dot = left.join(right, feature).where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    return dot.join(norms.withColumnsRenamed({item: "a", "norm": "na"}), "a").join(norms.withColumnsRenamed({item: "b", "norm": "nb"}), "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def jensen_shannon(shares: DataFrame, item: str = "item", feature: str = "feature", p: str = "p") -> DataFrame:
    """Distributions as (item, feature, p > 0). a < b that share a feature, and their divergence in bits: 1 plus, over shared features, what p, q and their mean differ by."""
    left = shares.select(F.col(item).alias("a"), feature, F.col(p).alias("p"))
    right = shares.select(F.col(item).alias("b"), feature, F.col(p).alias("q"))
    x, y = F.col("p"), F.col("q")
    piece = 0.5 * (x * F.log2(2 * x / (x + y)) + y * F.log2(2 * y / (x + y))) - 0.5 * (x + y)
    return left.join(right, feature).where("a < b").groupBy("a", "b").agg((1.0 + F.sum(piece)).alias("js"))


def ppmi(cells: DataFrame, least: int = 1) -> DataFrame:
    """cells: a, b, n. Positive pointwise mutual information (natural log) of the cells with n >= least."""
    rows, columns, totals = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb")), cells.agg(F.sum("n").alias("total"))
    value = F.log(double("n") * double("total") / (double("na") * double("nb")))
    return cells.where(F.col("n") >= least).join(rows, "a").join(columns, "b").crossJoin(totals).select("a", "b", "n", value.alias("ppmi")).where("ppmi > 0")
