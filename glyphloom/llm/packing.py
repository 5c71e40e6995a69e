"""Best-fit packing by sums of squares.

Documents become pieces of at most capacity tokens. Long ones come first; a piece goes to the open gap where the sum over all gaps of the squared number of open bins with that gap becomes smallest, and to a new bin where none fits. That rule looks at nothing but how many bins are open per gap, and pieces of one length are alike, so the whole plan is made from the histogram of lengths, which has capacity entries whatever the corpus is. The plan says, for each length, which ranks go to which run of sequences, at which offset; pieces find their place by their rank among those of their length. Ranks are counted within the task that made the pieces and shifted by running totals of tasks, so no length, however frequent, meets in one task.

Defined results: a null text counts as empty; an empty text is one piece, the separator alone; equal rows are packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import col, give_back, kept, schema_of, settle, small_batches

#: The change that stands for a gap without bins.
NEVER = np.iinfo(np.int64).max
#: Fixed value: the pattern that parts text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Ids of a byte-level vocabulary as little-endian bytes, four a token.

    The merges run in tiktoken, which takes the same vocabulary as ranks and is the faster library; a text whose white space is too much for its pattern goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        ranks = {bytes(map(byte.get, t)): i for t, i in spec["model"]["vocab"].items() if i not in added}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {content: np.asarray([i], "<u4").tobytes() for i, content in added.items()}
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.apart and any(s in text for s in self.special):
            return b"".join([self.special.get(x) or self.span(x) for x in self.apart.split(text)])
        return self.span(text)

    def span(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except Exception:  # the pattern's backtracking has a limit, text may hold lone surrogates
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every text: key, piece, start, length, ids_crc32, ids if asked for, and task and task_rank, the rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, task, seen = kept(ByteBpe, path), np.asarray([separator], "<u4").tobytes(), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = bpe.encode(t) + end
                for i, (at, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + n)]
                    rows.append((k, i, at, n, zlib.crc32(part), task, seen[n], *([np.frombuffer(part, "<u4").tolist()] if with_ids else [])))
                    seen[n] += 1
            cols = [*zip(*rows)] if rows else [()] * (7 + with_ids)
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["k", "piece", "start", "length", "ids_crc32", "task", "task_rank", "ids"][: len(cols)])
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(col(key).alias("k"), col(text).cast("string").alias("t"))
    whole, long = T.IntegerType(), T.LongType()
    more = {"piece": whole, "start": long, "length": long, "ids_crc32": long, "task": whole, "task_rank": long} | ({"ids": T.ArrayType(long)} if with_ids else {})
    return rows.mapInArrow(run, schema_of(rows, "k", **more)).withColumnRenamed("k", key)


def level_choices(bins: np.ndarray, s: int, left: int, capacity: int) -> np.ndarray:
    """How many of `left` pieces of length s go to each open gap, placed one by one where the sum of squares becomes smallest, in the least gap where choices are level; `left` is less than the gaps can take.

    A piece changes two gaps that lie s apart, so gaps of one remainder are a chain that no other chain touches: row j, column r stands for gap j * s + r. The chains go up level by level together, and where four levels repeat the last four, all repetitions until a gap runs empty or another comes in are taken at once. Only what is left in the last level is placed piece by piece. Counts are those of single steps throughout.
    """
    high = -(-capacity // s)
    open_bins = np.zeros(high * s, np.int64)
    open_bins[1:capacity] = bins[1:capacity]  # full bins do not count, nor do those yet to be opened
    open_bins = open_bins.reshape(high, s)
    taken = np.zeros_like(open_bins)

    def changes() -> np.ndarray:
        out = np.full_like(open_bins, NEVER)
        out[1:] = 2 * (open_bins[:-1] - open_bins[1:]) + 2
        out[1, 0] = 1 - 2 * open_bins[1, 0]
        return out

    def move(rows: np.ndarray, columns: np.ndarray) -> None:
        taken[rows, columns] += 1
        open_bins[rows, columns] -= 1
        open_bins[rows - 1, columns] += 1
        open_bins[0, 0] = 0

    def up_to(level: int, most: int) -> int:
        """Every choice that is no worse than the level; how many were taken, or so far if they are more than most."""
        n = 0
        while n <= most:
            change = np.where(open_bins > 0, changes(), NEVER)
            best = change.argmin(0)
            columns = np.nonzero(change[best, every] <= level)[0]
            if not len(columns):
                break
            move(best[columns], columns)
            n += len(columns)
        return n

    every = np.arange(s)
    while left:
        change = np.where(open_bins > 0, changes(), NEVER)
        level = int(change.min())
        if np.count_nonzero(change.min(0) <= level) >= left:
            break
        before = open_bins.copy(), taken.copy(), changes()
        n = up_to(level + 3, left)
        if n > left:
            open_bins, taken = before[0].copy(), before[1].copy()
            n = up_to(level, left)
            if n > left:
                open_bins, taken = before[0], before[1]
                break
            left -= n
            continue
        left -= n
        own, now, gain = taken - before[1], changes(), open_bins - before[0]
        some = own > 0
        if (now[some] == before[2][some] + 4).all() and (np.minimum(before[0], open_bins)[some] > own[some]).all():
            again = left // n
            falling = some & (gain < 0)
            if falling.any():
                again = min(again, int(((open_bins - own - 1)[falling] // -gain[falling]).min()))
            others = ~some & (open_bins > 0)
            others[0] = False
            if others.any():
                again = min(again, int(((now - level - 4)[others] // ((before[2] - now)[others] + 4)).min()))
            if again > 0:
                open_bins += again * gain
                taken += again * own
                left -= again * n
    chains = [[int(x) for x in open_bins[:, r]] for r in range(s)] if left else []

    def best_of(r: int) -> tuple[int, int, int]:
        x = chains[r]
        return min(((2 * (x[j - 1] - x[j]) + 2 if r or j > 1 else 1 - 2 * x[1], j * s + r, r) for j in range(1, high) if x[j]), default=(NEVER, 0, r))

    heap = [best_of(r) for r in range(len(chains))]
    heapq.heapify(heap)
    for _ in range(left):
        _, g, r = heap[0]
        j = g // s
        chains[r][j] -= 1
        chains[r][j - 1] += g > s
        taken[j, r] += 1
        heapq.heapreplace(heap, best_of(r))
    return taken.ravel()[:capacity]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset): so many pieces of that length, from that rank on, go to as many sequences from that one on, at that offset.

    Placing a piece of length s into gap g takes a bin from g and gives one to g - s; the sum of squares changes by 2 * (bins[g - s] - bins[g]) + 2, or by 1 - 2 * bins[g] if the bin becomes full. The pieces of a length are counted by the gap they go to as if placed one by one, then leave the gaps from the greatest on. Once no gap takes one, a new bin takes all that it can hold of those left, then the next.
    """
    bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # runs of [first sequence, number] by gap
    rows, sequences = [], 0
    gaps = np.arange(capacity)
    for s in sorted(histogram, reverse=True):
        left, rank = histogram[s], 0
        room = bins[:capacity] * (gaps // s)
        if left < room.sum():
            taken = level_choices(bins, s, left, capacity)
        else:
            taken = np.zeros(capacity, np.int64)
            for g in range(capacity - 1, s - 1, -1):  # all that can be held
                taken[g] = bins[g] + (taken[g + s] if g + s < capacity else 0)
        left -= int(taken.sum())
        for g in np.nonzero(taken)[0][::-1].tolist():
            n = int(taken[g])
            bins[g] -= n
            bins[g - s] += n if g > s else 0
            while n:
                run = stacks[g][-1]
                m = min(n, run[1])
                rows.append((s, rank, m, run[0], capacity - g))
                if g > s:
                    stacks[g - s].append([run[0], m])
                run[0] += m
                run[1] -= m
                if not run[1]:
                    stacks[g].pop()
                rank += m
                n -= m
        each = capacity // s
        for n, m in ((left // each, each), (1, left % each)):  # bins, pieces in each
            if n and m:
                for k in range(m):
                    rows.append((s, rank, n, sequences, k * s))
                    rank += n
                if m * s < capacity:
                    bins[capacity - m * s] += n
                    stacks[capacity - m * s].append([sequences, n])
                sequences += n
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(made: DataFrame, capacity: int = 2048) -> DataFrame:
    """made: the settled result of pieces(). Adds sequence_id and offset; sequences are gapless from offset 0."""
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    bits = 44
    starts = rows[:, 0] << bits | rows[:, 1]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = made.join(counts.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("place", F.shiftleft("length", bits).bitwiseOR(F.col("before") + F.col("task_rank"))).drop("task", "task_rank", "before")
    schema = schema_of(placed, *(f for f in placed.columns if f != "place"), sequence_id=T.LongType(), offset=T.LongType())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("place").to_numpy()
            i = np.searchsorted(starts, at, "right") - 1
            keep = [n for n in b.schema.names if n != "place"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(rows[i, 3] + at - starts[i]), pa.array(rows[i, 4])], [*keep, "sequence_id", "offset"])

    return placed.mapInArrow(find, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, **kwargs) -> DataFrame:
    made = settle(pieces(docs, path, capacity, **kwargs))
    return pack(made, capacity)
