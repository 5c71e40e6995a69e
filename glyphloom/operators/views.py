"""Canonical views of the tables: lines, tokens, glyphs, symbol streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, pos from 0, w: the words of each text in order."""
    return docs.select(*keys, F.posexplode(T.words(F.col(text))).alias("pos", "w"))


def beside(docs: DataFrame, keys: tuple[str, ...], text: str = "text", **offsets: int) -> DataFrame:
    """keys, pos from 0, w, and for each name the word that many places on (before, if below 0) in the same text, or null. Shifted arrays of a text are laid side by side, so no word is dealt out or sorted to meet its neighbour."""
    shift = lambda k: F.expr(f"slice(ws, {k + 1}, size(ws))") if k > 0 else F.expr(f"concat(array_repeat(cast(null as string), {-k}), ws)")
    rows = docs.select(*keys, T.words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    both = F.arrays_zip(F.col("ws").alias("w"), *(shift(k).alias(n) for n, k in offsets.items()))
    return rows.select(*keys, F.posexplode(both).alias("pos", "x")).select(*keys, "pos", "x.w", *(f"x.{n}" for n in offsets)).where("w is not null")


def lines(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, line from 0, ws: the words of each line; lines without words are left out but keep their number."""
    rows = docs.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line", "__line"))
    return rows.withColumn("ws", T.words(F.col("__line"))).drop("__line").where(F.size("ws") > 0)


def line_tokens(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, line, pos, n (words in the line), w."""
    return lines(docs, keys, text).select(*keys, "line", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "w"))


def types(tok: DataFrame, *keys: str) -> DataFrame:
    """keys, w, n: how often each word occurs."""
    return tok.groupBy(*keys, "w").agg(F.count("*").alias("n"))


def within(*keys: str):
    return Window.partitionBy(*keys).orderBy("pos")


def adjacent(tok: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, pos, w, nxt: each word with the next of its sequence."""
    return tok.withColumn("nxt", F.lead("w").over(within(*keys))).where("nxt is not null")


def pair_counts(pairs: DataFrame, a: str, b: str, *strata: str) -> DataFrame:
    """strata, a, b, n."""
    return pairs.groupBy(*strata, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
