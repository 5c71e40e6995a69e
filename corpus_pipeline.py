"""A corpus pipeline: quality rules, toxicity, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the columns of docs. 

Defined results, for every stage: a null or empty text counts as empty, which the quality rules reject and the other stages keep; rows that repeat are judged alike; where several rows have one doc_id, the n-gram join keeps all of them or none, by whether any of them is the least of its group, and rows without a doc_id take no part in it and stay; an empty table gives an empty table; further columns, whatever their names, go through unchanged, but for n_chars, which the suffix dedup counts anew.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.llm import dedup, jaccard, packing, quality, toxicity
from glyphloom.llm.common import col, lean, release, schema_of, settle, small_batches, table


def fields(names: list[str]) -> list[Column]:
    return [F.col("__row")[name].alias(name) for name in names]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("__row"), F.col("text").alias("__text"))
    return quality.judge(rows, rules, ("__row",), "__text").where("kept").select(*fields(docs.columns))


def toxicity_grammar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    small_batches(spark)
    return docs.where(toxicity.score_column(model, F.col("text")) < toxicity.SCORE_AT)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id stays."""
    found = jaccard.similar_documents(docs)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    numbered = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*map(col, docs.columns))
    return numbered.unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long repeated strings go; what is left of a character that was cut goes too. All documents stay, with what text they have left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__"), *map(col, others)).alias("__row"))
    found = dedup.without_repeats(rows, keep_columns=("__row",), with_text=True)

    def decoded(batches):
        import pyarrow as pa

        for b in batches:
            text = [x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), b.column(2)], ["doc_id", "text", "__row"])

    rows = found.select("doc_id", F.col("kept").alias("text"), "__row")
    texts = rows.mapInArrow(lean(decoded), schema_of(rows, "doc_id", text=T.StringType(), __row=rows.schema["__row"].dataType))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return texts.select(*(new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences, as few as the rule of sums of squares finds."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_grammar),
    ("n-gram Jaccard join", ngram_join),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Learned lists, components of similar texts and suffix order are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
