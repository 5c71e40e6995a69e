"""Measures of predictions, rankings, clusterings and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Adds rank, from 1, ties sharing their mean: values are counted first, so the window runs over distinct values."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    below = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(*keys, value, (below + (F.col("__c") + 1) / 2).alias("rank"))
    return rows.join(ranks, [*keys, value])


def roc_auc(rows: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """keys, positives, negatives, auc: the chance that a positive ranks above a negative, ties counting half; null without both."""
    cells = rows.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = cells.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    return won.groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.try_divide(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mean precision at the distinct scores, weighted by the positives found there."""
    cells = rows.groupBy(score).agg(F.sum(label).alias("p"), F.count("*").alias("c"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.select("p", F.sum("p").over(w).alias("tp"), F.sum("c").over(w).alias("found"))
    return run.agg((F.sum(F.col("p") * F.col("tp") / F.col("found")) / F.sum("p")).alias("average_precision"))


def losses(p: Column, label: Column) -> tuple[Column, Column]:
    """log2 loss with a floor, and the Brier loss."""
    right = F.greatest(F.when(label == 1, p).otherwise(1 - p), F.lit(1e-12))
    return -F.log2(right), (p - label) * (p - label)


def pair_scores(rows: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Pair precision, recall and F1, and the adjusted Rand index, from the contingency counts."""
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    cells = rows.groupBy(truth, cluster).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(pairs(F.col("n")).alias("both"), F.sum("n").alias("total"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(pairs(F.col("m")).alias(name))
    joined = both.crossJoin(side(truth, "in_truth")).crossJoin(side(cluster, "in_cluster"))  # one row each
    b, t, c = F.col("both"), F.col("in_truth"), F.col("in_cluster")
    chance = t * c / (F.col("total") * (F.col("total") - 1) / 2)
    return joined.select((b / c).alias("precision"), (b / t).alias("recall"), (2 * b / (t + c)).alias("f1"), ((b - chance) / ((t + c) / 2 - chance)).alias("ari"))


def cosine_column(x: Column, y: Column) -> Column:
    """Cosine of two arrays of numbers."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))
