"""Sharding by best-fit-decreasing bin packing.

Groups (equal texts) are indivisible; sorted by size, each enters the open bin with the least remaining capacity that still holds it, found in a balanced search tree, and a new bin is opened only if none does. Groups of one size are alike, and the bin that takes one of them is the best for the next while that still fits, so the packing goes by runs of equal sizes: it is made from the histogram of group sizes. As d different sizes need d * d / 2 bytes at least, the histogram has no more entries than the root of twice the bytes. The plan says which ranks among the groups of a size go to which bin; groups find their bin by their rank, which is counted in chunks, so that no size, however frequent, meets in one task.

With a fixed number of shards, the capacity is the least (to one part in PRECISION) for which the packing needs no more bins than shards; a group larger than an even share gets a shard of its own first.

Defined results: a null text counts as empty (size 1, CRC 0) and belongs to the group of empty texts; equal rows each get a slot; groups of equal size are told apart by the hash of their text; an empty table gives no rows; a group larger than a fixed capacity is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, lean, settle

PRECISION = 1 << 20
#: Slots and ranks are counted within so many chunks of a shard or size, so that none meets in one task.
CHUNKS = 512


class Tree:
    """A balanced search tree (a treap whose priorities are a hash of the key) of (remaining, bin)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def split(t: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Those below the key, the others."""
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = Tree.split(t[3], key)
            return t, right
        left, t[2] = Tree.split(t[2], key)
        return left, t

    @staticmethod
    def join(a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Tree.join(a[3], b)
            return a
        b[2] = Tree.join(a, b[2])
        return b

    def add(self, key: tuple) -> None:
        low, high = self.split(self.root, key)
        self.root = self.join(self.join(low, [key, hash((key, 0x9E3779B9)), None, None]), high)

    def take_least(self, size: int) -> tuple | None:
        """Remove and return the least key with remaining >= size."""
        low, high = self.split(self.root, (size, -1))
        found = None
        if high is not None:
            above, t = None, high
            while t[2] is not None:
                above, t = t, t[2]
            found = t[0]
            if above is None:
                high = t[3]
            else:
                above[2] = t[3]
        self.root = self.join(low, high)
        return found


Run = tuple[int, int, int]  # size, number of groups, bin


def best_fit_decreasing(sizes: dict[int, int], capacity: int, most: int | None = None) -> list[Run] | None:
    """sizes: how many groups there are of each. Runs of groups, by falling size, and the bin that takes them; None if a group is too large or more than `most` bins are needed."""
    tree, bins, out = Tree(), 0, []
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        if size > capacity:
            return None
        while left:
            remaining, at = tree.take_least(size) or (capacity, bins)
            if at == bins:
                bins += 1
                if most is not None and bins > most:
                    return None
            n = min(left, remaining // size)
            out.append((size, n, at))
            left -= n
            tree.add((remaining - n * size, at))
    return out


def even_bins(sizes: dict[int, int], n: int) -> list[Run]:
    """Bins 0 to n - 1, as full as one another as indivisible groups allow."""
    out, rest, left, first = [], dict(sizes), sum(s * k for s, k in sizes.items()), 0
    while rest and n - first > 1 and (size := max(rest)) * (n - first) > left:
        out.append((size, 1, first))
        left -= size
        first += 1
        rest[size] -= 1
        if not rest[size]:
            del rest[size]
    low = max([-(-left // (n - first)), *rest])
    high, step = low, max(1, left // PRECISION)
    grown = step
    while (found := best_fit_decreasing(rest, high, n - first)) is None:
        low, high, grown = high, high + grown, 2 * grown
    while high - low > step:
        middle = (low + high) // 2
        if (better := best_fit_decreasing(rest, middle, n - first)) is None:
            low = middle
        else:
            high, found = middle, better
    return out + [(size, k, first + b) for size, k, b in found]


def ranked(rows: DataFrame, part: str, order: list[str], chunk) -> DataFrame:
    """rows with place, their number from 0 on among those of the same part, counted in chunks."""
    own = rows.withColumn("chunk", chunk)
    counts = own.groupBy(part, "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(part).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(part, "chunk").orderBy(*order)) - 1
    joined = own.withColumn("rank", rank).join(counts.select(part, "chunk", before.alias("before")), [part, "chunk"])
    return joined.withColumn("place", F.col("before") + F.col("rank")).drop("chunk", "rank", "before")


def placed_groups(groups: DataFrame, runs: list[Run]) -> DataFrame:
    """group_hash and shard. groups: group_hash and bytes."""
    plan = np.array(sorted(runs, key=lambda r: r[0]), np.int64).reshape(-1, 3)  # runs of one size stay in order
    size, n, shards = plan[:, 0], plan[:, 1], plan[:, 2].astype(np.int32)
    new = np.ones(len(size), bool)
    new[1:] = size[1:] != size[:-1]
    start = np.cumsum(n) - n
    sizes, begin = size[new], start[new]  # groups before those of each size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = begin[np.searchsorted(sizes, b.column("bytes").to_numpy())]
            at = np.searchsorted(start, before + b.column("place").to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([b.column("group_hash"), pa.array(shards[at])], ["group_hash", "shard"])

    numbered = ranked(groups, "bytes", ["group_hash"], F.pmod("group_hash", F.lit(CHUNKS)))
    return numbered.mapInArrow(lean(find), "group_hash long, shard int")


def shard(docs: DataFrame, n_shards: int | None = 8, capacity: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row: n_shards even shards, or as few shards of that capacity as the packing needs (then no group may be larger)."""
    whole = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = settle(docs.select(col(key).alias("key"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("group_hash")))
    groups = settle(rows.groupBy("group_hash").agg(F.sum("size").alias("bytes")))
    sizes = {r["bytes"]: r["n"] for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()}  # the root of twice the bytes at most
    runs = even_bins(sizes, n_shards) if capacity is None else best_fit_decreasing(sizes, capacity)
    if runs is None:
        raise ValueError("a group is larger than the capacity")
    placed = rows.join(placed_groups(groups, runs), "group_hash")
    out = ranked(placed, "shard", ["key", "text_crc32"], F.pmod(F.xxhash64(F.col("key").cast("string"), "group_hash"), F.lit(CHUNKS)))
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", F.col("place").cast("long").alias("slot"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    return shard(docs, n_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
