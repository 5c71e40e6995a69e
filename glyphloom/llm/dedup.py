"""Suffix-array dedup: removes every byte that a string of WINDOW bytes covers which also starts anywhere else.

Every window is found by its anchor (anchors.py), so equal windows meet wherever they are: contexts, runs of neighbouring windows with one anchor, are dealt out by the anchor's hash. Contexts that are equal byte for byte are one, and what has copies is repeated whole; copies are counted before anything is dealt. Anchors that unlike contexts share become shards: one text of each context is laid end to end, a suffix array is built by induced sorting (suffixes.py), and common prefixes of WINDOW bytes between neighbours tell the windows that start twice. A context's result goes to all its copies.

An anchor that more than MOST unlike contexts share is taken out of the shards: the windows of its contexts are counted by a hash each, in partial sums, which is exact for any number of them.

Defined results: a null text counts as empty, nothing is removed from texts shorter than WINDOW; equal rows are copies of one another; bytes, not characters, are removed, and what is kept is joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import MOST as BUFFER
from .anchors import WINDOW, contexts
from .common import col, lean, release, schema_of, settle, small_batches
from .suffixes import repeated_windows

#: Bytes of text taken in at once, bytes of a shard about, and unlike contexts of one anchor in a shard at most.
TAKE, SHARD, MOST = 1 << 20, 3 << 20, 8192


def row_key(key: str, text: str) -> Column:
    """Rows with the same id and text have the same key, and the same result."""
    return F.xxhash64(col(key), col(text))


def buffers(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Numbers of texts, where in them each piece begins, the pieces end to end, and their ends. Texts too long for a buffer come in pieces that share WINDOW - 1 bytes."""
    rows, at, held, size = [], [], [], 0
    step = BUFFER // 2
    for i, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        for a in range(0, max(1, len(text) - WINDOW + 1), step):
            piece = text if len(text) <= step + WINDOW - 1 else text[a : a + step + WINDOW - 1]
            if held and size + len(piece) > max(TAKE, len(piece)):
                yield rows, at, b"".join(held), np.cumsum([len(x) for x in held])
                rows, at, held, size = [], [], [], 0
            rows.append(i)
            at.append(a)
            held.append(piece)
            size += len(piece)
    if held:
        yield rows, at, b"".join(held), np.cumsum([len(x) for x in held])


def members(texts: DataFrame) -> DataFrame:
    """texts: key, t (binary). gram, context (hashes), key, first and last: the windows of the text that start there, and the bytes they cover, are the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for rows, at, whole, ends in buffers(b.column(1).to_pylist()):
                _, grams, first, last = contexts(np.frombuffer(whole, np.uint8), ends)
                starts = np.concatenate([[0], ends[:-1]])
                i = np.searchsorted(ends, first, "right")
                shift = np.array(at)[i] - starts[i]
                digest = xxhash.xxh3_64_intdigest
                context = np.fromiter((digest(whole[x : y + WINDOW]) for x, y in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(context.view(np.int64)), pa.array(keys[np.array(rows)[i]]), pa.array(first + shift), pa.array(last + shift)], ["gram", "context", "key", "first", "last"])

    return texts.mapInArrow(lean(run), "gram long, context long, key long, first long, last long")


def cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, context, copies, unlike and bytes of the contexts wanted. wanted: key, first, last with those."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "context", "copies", "unlike", "first", "last")).alias("own"))
    joined = texts.join(lists, "key").select("t", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1)
            n = pa.compute.list_value_length(own).to_numpy()
            flat = own.flatten()
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            texts_of = b.column(0).to_pylist()
            parts = [texts_of[i][x : y + WINDOW] for i, x, y in zip(np.repeat(np.arange(len(n)), n).tolist(), first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("gram", "context", "copies", "unlike")), pa.array(parts, pa.binary())], ["gram", "context", "copies", "unlike", "bytes"])

    return joined.mapInArrow(lean(run), "gram long, context long, copies long, unlike long, bytes binary")


def runs(starts: np.ndarray) -> list[dict[str, int]]:
    """Ascending window starts as spans of bytes [a, b); windows that overlap or touch make one span."""
    if not len(starts):
        return []
    gap = np.nonzero(np.diff(starts) > WINDOW)[0]
    return [{"a": int(a), "b": int(b) + WINDOW} for a, b in zip(starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])])]


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def sorted_shards(parts: DataFrame) -> DataFrame:
    """gram, context, spans of contexts without copies whose windows start in another context of the shard too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, end = 0, 0

        def shard() -> pa.RecordBatch:
            found = [(g, c, runs(w)) for (g, c, n, _), w in zip(held, repeated_windows([x[3] for x in held], WINDOW)) if n == 1 and len(w)]
            g, c, s = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(s, SPANS)], ["gram", "context", "spans"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("gram", "context", "copies", "bytes"))):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield shard()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield shard()

    dealt = parts.select("gram", "context", "copies", "bytes").repartition("gram").sortWithinPartitions("gram", "context")
    return dealt.mapInArrow(lean(run), "gram long, context long, spans array<struct<a:long,b:long>>")


def counted_windows(parts: DataFrame) -> DataFrame:
    """The same for anchors of very many contexts, by counting the hash of every window."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, c, n, x in zip(*(b.column(i).to_pylist() for i in ("gram", "context", "copies", "bytes"))):
                m = len(x) - WINDOW + 1
                h = np.fromiter((xxhash.xxh3_64_intdigest(x[i : i + WINDOW]) for i in range(m)), np.uint64, m).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, g)), pa.array(np.full(m, c)), pa.array(np.full(m, n)), pa.array(np.arange(m)), pa.array(h)], ["gram", "context", "copies", "at", "h"])

    rows = settle(parts.mapInArrow(hashes, "gram long, context long, copies long, at long, h long"))
    often = rows.groupBy("gram", "h").agg(F.count("*").alias("n")).where("n > 1").select("gram", "h")
    found = rows.where("copies = 1").join(often, ["gram", "h"], "left_semi").groupBy("gram", "context").agg(F.transform(F.collect_list("at"), lambda x: F.struct(x.alias("a"), (x + WINDOW).alias("b"))).alias("spans"))
    return found


def repeats(texts: DataFrame) -> DataFrame:
    """texts: key, t. key and spans (array of [a, b), in any order, overlapping) of texts with bytes to be removed."""
    small_batches(texts.sparkSession)
    all_of = settle(members(texts))
    classes = settle(all_of.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("key", "first", "last")).alias("at")).select("gram", "context", "copies", "at.key", "at.first", "at.last"))
    shared = classes.groupBy("gram").agg(F.count("*").alias("unlike")).where("unlike > 1")
    parts = settle(cut_out(texts, classes.join(shared, "gram")))
    whole = classes.where("copies > 1").select("gram", "context", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("last") - F.col("first") + WINDOW).alias("b"))).alias("spans"))
    found = settle(sorted_shards(parts.where(f"unlike <= {MOST}")))
    spans = whole.union(found)
    if not parts.where(f"unlike > {MOST}").isEmpty():
        spans = spans.union(settle(counted_windows(parts.where(f"unlike > {MOST}"))))
    release(parts)
    moved = all_of.join(spans, ["gram", "context"]).select("key", F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b"))).alias("spans"))
    out = settle(moved.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    release(all_of, classes, found)
    return out


def keep(text: bytes, spans) -> tuple[bytes, int, int]:
    """The bytes outside the spans, and how many bytes and maximal runs go."""
    out, at, gone, count = [], 0, 0, 0
    low = high = -1
    for a, b in [*sorted(spans), (len(text) + 1, len(text) + 1)]:
        if a <= high:
            high = max(high, b)
            continue
        if high > low:
            out.append(text[at:low])
            at, gone, count = high, gone + high - low, count + 1
        low, high = a, b
    out.append(text[at:])
    return b"".join(out), gone, count


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_columns: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """key and keep_columns of every row, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if asked for."""
    bytes_of = F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(row_key(key, text).alias("key"), bytes_of.alias("t"))
    spans = repeats(texts)
    small_batches(docs.sparkSession)
    names = [key, *keep_columns]
    rows = docs.select(F.struct(*map(col, names)).alias("row"), row_key(key, text).alias("key"), bytes_of.alias("t"))
    joined = rows.join(spans, "key", "left").select("t", "spans", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1)
            n = np.nan_to_num(pa.compute.list_value_length(own).to_numpy(zero_copy_only=False).astype(float)).astype(int).tolist()
            flat = own.flatten()
            pairs = iter(zip(flat.field("a").to_pylist(), flat.field("b").to_pylist()))
            rows = []
            for t, k in zip(b.column(0).to_pylist(), n):
                left, gone, count = keep(t, [next(pairs) for _ in range(k)])
                rows.append((len(t), gone, count, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            cols = list(zip(*rows)) if rows else [()] * (4 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *(pa.array(c, k) for c, k in zip(cols, kinds))], [*b.schema.names[2:], *["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)]])

    more = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()} | ({"kept": T.BinaryType()} if with_text else {})
    return joined.mapInArrow(lean(run), schema_of(joined, "row", **more)).select(*(F.col("row")[c].alias(c) for c in names), *more)
