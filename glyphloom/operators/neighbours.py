"""Nearest vectors of stated queries, exactly: blocks of queries meet blocks of vectors, each pair of blocks in one task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a block of queries and of a block of vectors at most, about, and the vectors multiplied at once.
QUERIES, VECTORS, TILE = 4096, 16384, 1024


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of numbers as rows, and which are null; those are zeros."""
    x = column.combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    none = x.is_null().to_numpy(zero_copy_only=False)
    flat = x.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(x), len(flat) // max(1, int((~none).sum()))))
    out[~none] = flat.reshape(-1, out.shape[1]) if out.shape[1] else 0.0
    return out, none


def best_of_block(query: np.ndarray, x: np.ndarray, x_none: np.ndarray, ids: np.ndarray, y: np.ndarray, y_none: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and of y, and the cosine in millionths, of the k best of each query: not a number before all, what is unknown behind all, ties by id. ids ascend."""
    rows, columns, scores = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
    least = np.full(len(x), -np.inf)
    full = np.zeros(len(x), bool)
    nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    for at in range(0, len(y), TILE):
        own = slice(at, at + TILE)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.rint(x @ y[own].T / np.sqrt(nx[:, None] * ny[None, own]) * 1e6)
        score[np.isnan(score)] = np.inf
        score[x_none] = -np.inf
        score[:, y_none[own]] = -np.inf
        better = (score > least[:, None]) | ~full[:, None]  # a tie with what is there has the larger id
        better &= query[:, None] != ids[None, own]
        r, c = np.nonzero(better)
        rows, columns, scores = np.concatenate([rows, r]), np.concatenate([columns, c + at]), np.concatenate([scores, score[r, c]])
        order = np.lexsort((columns, -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, columns, scores = rows[kept], columns[kept], scores[kept]
        full = np.bincount(rows, minlength=len(x)) == k
        last = np.searchsorted(rows, np.arange(len(x)), "right") - 1
        least[full] = scores[last[full]]
    return rows, columns, scores


def nearest(vectors: DataFrame, queries: DataFrame, k: int, most: tuple[int, int] = (QUERIES, VECTORS)) -> DataFrame:
    """vectors, queries: vec_id, embedding, label. query, query_label, vec_id, label, cosine to six digits and rank of the k nearest other vectors of each query, by id on ties.

    The work is that of all pairs; a task holds a block of either side, and what leaves it is k rows for each query.
    """
    many = max(1, math.ceil(queries.count() / most[0])), max(1, math.ceil(vectors.count() / most[1]))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    rows = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("vec_id", "embedding", "label")]  # noqa: E731  both sides may be one table
    left = queries.where("vec_id is not null").select(part(many[0]).alias("p"), every(many[1]).alias("q"), *rows("x"))
    right = vectors.where("vec_id is not null").select(every(many[0]).alias("p"), part(many[1]).alias("q"), *rows("y"))
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    names = ("query", "query_label", "vec_id", "label", "cosine")
    empty = pa.schema([pa.field(n, t) for n, t in zip(names, [*(to_arrow_type(vectors.schema[c].dataType) for c in ("vec_id", "label", "vec_id", "label")), pa.float64()])]).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return empty
        b = b.sort_by("y_vec_id")
        (x, x_none), (y, y_none) = matrix(a["x_embedding"]), matrix(b["y_embedding"])
        if x_none.all() or y_none.all():
            x, y = np.zeros((len(x), 1)), np.zeros((len(y), 1))
        r, c, scores = best_of_block(a["x_vec_id"].to_numpy(), x, x_none, b["y_vec_id"].to_numpy(), y, y_none, k)
        cosine = pa.array(np.where(np.isposinf(scores), np.nan, scores / 1e6), mask=np.isneginf(scores))
        return pa.table({"query": a["x_vec_id"].take(r), "query_label": a["x_label"].take(r), "vec_id": b["y_vec_id"].take(c), "label": b["y_label"].take(c), "cosine": cosine})

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, f"query {kinds[0]}, query_label {kinds[1]}, vec_id {kinds[0]}, label {kinds[1]}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
