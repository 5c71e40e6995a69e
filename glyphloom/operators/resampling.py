"""Permutation nulls and bootstraps whose chance is a hash: the same rows give the same result in every engine and on every cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import pages as P
from .information import mutual_information


def replicates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "rep")


def hash_order(rep, *parts):
    return F.md5(F.concat_ws("|", *(c.cast("string") for c in (rep, *parts))))


def permuted_cells(pairs: DataFrame, n: int, strata: tuple[str, ...], pos: str = "pos", paged: bool = True) -> DataFrame:
    """pairs: strata, pos, a, b. rep, strata, a, b, n with the b's of each stratum in the order of a hash.

    paged: a stratum, such as a page, fits in a row; its pairs are gathered once and each replicate sorts them there, so nothing but the cells is shuffled again. Otherwise strata of any size are ordered by windows, which spill.
    """
    keys = ["rep", *strata]
    reps = F.explode(F.sequence(F.lit(1), F.lit(n)))
    if paged:
        rows = pairs.groupBy(*strata).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), "a", "b"))).alias("own"))
        rows = rows.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism).withColumn("rep", reps)  # few bytes, much work
        drawn = F.sort_array(F.transform("own", lambda x: F.struct(hash_order(F.col("rep"), *(F.col(s) for s in strata), x["pos"]).alias("h"), x["pos"].alias("pos"), x["b"].alias("b"))))
        both = F.zip_with("own", drawn, lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b")))
        return rows.select(*keys, F.explode(both).alias("p")).groupBy(*keys, "p.a", "p.b").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(pos)))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(F.col("rep"), *(F.col(s) for s in strata), F.col(pos)), F.col(pos)))
    rows = pairs.withColumn("rep", reps).select(*keys, pos, "a", "b")
    left = rows.select(*keys, "a", place.alias("k"))
    right = rows.select(*keys, "b", order.alias("k"))
    return left.join(right, [*keys, "k"]).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


def permutation_test(pairs: DataFrame, n: int, strata: tuple[str, ...]) -> DataFrame:
    """The information between a and b over all rows, its mean and deviation when the b's are permuted within strata, the excess, and p = (1 + replicates at least as high) / (1 + n)."""
    observed = mutual_information(pairs.groupBy("a", "b").agg(F.count("*").alias("n"))).select(F.col("total").cast("long").alias("pairs"), F.col("mi").alias("observed"))
    nulls = mutual_information(permuted_cells(pairs, n, strata).groupBy("rep", "a", "b").agg(F.sum("n").alias("n")), "rep")
    joined = nulls.crossJoin(observed)  # one row
    return joined.groupBy("pairs", "observed").agg(F.avg("mi").alias("null_mean"), F.stddev_samp("mi").alias("null_sd"), ((1 + F.sum(F.when(F.col("mi") >= F.col("observed") - 1e-12, 1).otherwise(0))) / (1 + F.count("*"))).alias("p")).withColumn("excess", F.col("observed") - F.col("null_mean"))


#: Letters permuted in one array, about.
DRAWN = 1 << 22
#: The same, where arrays are counted together.
COUNTED = 1 << 20


def paged_permutations(pairs: DataFrame, n: int, page: str, pos: str = "pos") -> DataFrame:
    """pairs: page, pos, a, b (letters a to z). rep, a, b, n: the b's of each page in n random orders, rep 0 as they are.

    A page's random numbers come from its key alone, so the result does not depend on where it is computed. A page fits in a row; its orders are drawn in whole arrays and nothing but sums of cells leaves a task.
    """
    code = lambda c: (F.ascii(c) - 97).cast("byte")
    rows = pairs.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), code("a").alias("a"), code("b").alias("b")))).alias("own"))
    rows = rows.select(F.xxhash64(page).alias("seed"), F.transform("own", lambda x: x["a"]).alias("a"), F.transform("own", lambda x: x["b"]).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n + 1, 676), np.int64)
        for batch in batches:
            for seed, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x, y = (v.values.to_numpy().astype(np.int16) for v in (a, b))
                sums[0] += np.bincount(x * 26 + y, minlength=676)
                rng, step = np.random.Generator(np.random.Philox(key=seed % (1 << 64))), max(1, DRAWN // len(x))
                for at in range(0, n, step):
                    k = min(step, n - at)
                    cells = rng.permuted(np.tile(y, (k, 1)), axis=1) + x * 26 + 676 * np.arange(k, dtype=np.int32)[:, None]
                    sums[at + 1 : at + 1 + k] += np.bincount(cells.ravel(), minlength=676 * k).reshape(k, 676)
        rep, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int32)), pa.array((cell // 26).astype(np.int32)), pa.array((cell % 26).astype(np.int32)), pa.array(sums[rep, cell])], ["rep", "a", "b", "n"])

    drawn = rows.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "rep int, a int, b int, n long")  # few bytes, much work
    return drawn.groupBy("rep", "a", "b").agg(F.sum("n").alias("n"))


def paged_permutation_test(pairs: DataFrame, n: int, page: str) -> DataFrame:
    """permutation_test() by paged_permutations()."""
    mi = mutual_information(paged_permutations(pairs, n, page), "rep")
    observed = mi.where("rep = 0").select(F.col("total").cast("long").alias("pairs"), F.col("mi").alias("observed"))
    high = F.sum(F.when(F.col("mi") >= F.col("observed") - 1e-12, 1).otherwise(0))
    out = mi.where("rep > 0").crossJoin(observed).groupBy("pairs", "observed").agg(F.avg("mi").alias("null_mean"), F.stddev_samp("mi").alias("null_sd"), ((1 + high) / (1 + F.count("*"))).alias("p"))  # one row
    return out.withColumn("excess", F.col("observed") - F.col("null_mean"))


def information_by_replicate(cells: DataFrame) -> DataFrame:
    """cells: rep, a, b, n, in parts. rep, total and mi in bits. Sums over windows of a replicate's few cells: what made the cells is run once, where joins with their margins would run it for each."""
    w = lambda *c: F.sum("n").over(Window.partitionBy("rep", *c)).cast("double")
    rows = cells.groupBy("rep", "a", "b").agg(F.sum("n").alias("n")).select("rep", "n", w().alias("total"), w("a").alias("na"), w("b").alias("nb"))
    return rows.groupBy("rep").agg(F.max("total").alias("total"), F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))


def tested(mi: DataFrame) -> DataFrame:
    """mi: rep, total, mi; rep 0 is as it is. The observed information, the mean and deviation of the others, the excess, and p = (1 + replicates at least as high) / (1 + their number)."""
    own = lambda c: F.max(F.when(F.col("rep") == 0, F.col(c))).over(Window.partitionBy(F.lit(0)))  # noqa: E731  a row for each replicate
    high = F.sum(F.when(F.col("mi") >= F.col("observed") - 1e-12, 1).otherwise(0))
    rows = mi.select("rep", "mi", own("total").cast("long").alias("pairs"), own("mi").alias("observed")).where("rep > 0")
    out = rows.groupBy("pairs", "observed").agg(F.avg("mi").alias("null_mean"), F.stddev_samp("mi").alias("null_sd"), ((1 + high) / (1 + F.count("*"))).alias("p"))
    return out.withColumn("excess", F.col("observed") - F.col("null_mean"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Pages in as many parts as keep all cores busy: few bytes, much work."""
    P.short_batches(rows.sparkSession)
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def cells_of(sums: np.ndarray) -> pa.RecordBatch:
    """sums: replicates x 676. rep, a, b, n of what is not 0."""
    rep, cell = np.nonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int32)), pa.array((cell // 26).astype(np.int32)), pa.array((cell % 26).astype(np.int32)), pa.array(sums[rep, cell])], ["rep", "a", "b", "n"])


CELLS = "rep int, a int, b int, n long"


def hashed_orders(found: list[tuple[bytes, np.ndarray, np.ndarray]], n: int) -> Iterator[np.ndarray]:
    """found: a page's key, places and letters. For each page its letters in the orders of the MD5 of rep|key|place, for rep from 1 to n, a row each."""
    messages, lengths = zip(*(P.numbered_messages([b"%d|%s|" % (r, key) for r in range(1, n + 1)], place) for key, place, _ in found))
    hashes, at = P.md5(np.concatenate(messages), np.concatenate(lengths)), 0
    for _, place, letters in found:
        own = n * len(place)
        yield P.in_hash_order(hashes[at : at + own].reshape(n, -1, 2), letters, place)
        at += own


def edge_test_by_hash(docs: DataFrame, n: int, page: str = "doc_id", text: str = "text") -> DataFrame:
    """The information between the edges of neighbouring words over all pages, against orders of the next words' first letters within each page by a hash of replicate, page and place.

    A page is one row; its hashes are made in whole arrays where it is, and nothing but sums of cells leaves a task. Pages without a key count as they are, not in the replicates: SQL joins none of them.
    """
    rows = dealt(docs.select(F.col(page).cast("string").alias("page"), F.lower(text).alias("text")), "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n + 1, 676), np.int64)
        base = 676 * np.arange(n)[:, None]
        for batch in batches:
            a, b, at = P.edge_letters(batch.column(1))
            a = a.astype(np.int64) * 26
            sums[0] += np.bincount(a + b, minlength=676)
            known = [(key.encode(), x, y) for key, x, y in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()) if key is not None and x < y]
            for some in P.gathered(known, lambda k: n * (k[2] - k[1]), P.LANES):
                drawn = hashed_orders([(key, np.arange(y - x), b[x:y]) for key, x, y in some], n)
                cells = np.concatenate([(d + a[x:y] + base).ravel() for (_, x, y), d in zip(some, drawn)])
                sums[1:] += np.bincount(cells, minlength=676 * n).reshape(n, 676)
        yield cells_of(sums)

    return tested(information_by_replicate(rows.mapInArrow(run, CELLS)))


def edge_permutations(docs: DataFrame, n: int, page: str = "doc_id", text: str = "text") -> DataFrame:
    """rep, a, b, n, in parts to be summed: the edges of neighbouring words (0 to 25) with the next words' first letters of each page in n random orders, rep 0 as they are.

    A page's random numbers come from its key alone, so the result does not depend on where it is computed. A page is one row; its orders are drawn in whole arrays and nothing but sums of cells leaves a task.
    """
    rows = dealt(docs.select(F.xxhash64(page).alias("seed"), F.lower(text).alias("text")), "seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n + 1, 676), np.int64)
        flat, held, size = sums[1:].reshape(-1), [], 0
        for batch in batches:
            a, b, at = P.edge_letters(batch.column(1))
            x = a.astype(np.int64) * 26
            sums[0] += np.bincount(x + b, minlength=676)
            for seed, low, high in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if low == high:
                    continue
                rng, step = np.random.Generator(np.random.PCG64(seed % (1 << 64))), max(1, COUNTED // (high - low))
                for first in range(0, n, step):
                    k = min(step, n - first)
                    held.append((P.orders(rng, b[low:high], k) + (x[low:high] + 676 * np.arange(first, first + k)[:, None])).ravel())
                    size += len(held[-1])
                    if size >= COUNTED:
                        flat += np.bincount(np.concatenate(held), minlength=len(flat))
                        held, size = [], 0
        if held:
            flat += np.bincount(np.concatenate(held), minlength=len(flat))
        yield cells_of(sums)

    return rows.mapInArrow(run, CELLS)


def edge_test(docs: DataFrame, n: int, page: str = "doc_id") -> DataFrame:
    """The same with random orders."""
    return tested(information_by_replicate(edge_permutations(docs, n, page)))


def n_log(n: np.ndarray) -> np.ndarray:
    return n * np.log2(np.maximum(n, 1))


def conditional_edge_test(turns: DataFrame, n: int, page: str = "conv_id", line: str = "turn", text: str = "text") -> DataFrame:
    """The information between the edges of neighbouring words of a line given the page, weighted by the pages' pairs, against orders within each page by a hash of replicate, page and place (line * 100000 + the word's place).

    A page's lines are gathered once; its hashes, cells and informations are made there, and a sum for each replicate leaves a task. Margins do not change with the order, so a replicate's information is that of its cells. Pages without a key are in no stratum.
    """
    own = F.sort_array(F.collect_list(F.struct(F.col(line).cast("long").alias("line"), F.lower(text).alias("text"))))
    pages = turns.where(F.col(page).isNotNull() & F.col(text).isNotNull()).groupBy(page).agg(own.alias("own"))
    rows = dealt(pages.select(F.col(page).cast("string").alias("page"), F.col("own.line").alias("lines"), F.col("own.text").alias("texts")), "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, np.zeros(n + 1)
        for batch in batches:
            lines, texts = batch.column(1), batch.column(2)
            a, b, at = P.edge_letters(texts.flatten())
            size = np.diff(at)
            place = np.repeat(lines.flatten().to_numpy(zero_copy_only=False).astype(np.int64) * 100000, size) + np.arange(len(a)) - np.repeat(at[:-1], size)
            ends = at[np.concatenate([[0], np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))])].tolist()
            known = [(key.encode(), x, y) for key, x, y in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:]) if x < y]
            for some in P.gathered(known, lambda k: n * (k[2] - k[1]), P.LANES):
                order = [x + np.argsort(place[x:y], kind="stable") for _, x, y in some]
                drawn = hashed_orders([(key, place[o], b[o]) for (key, _, _), o in zip(some, order)], n)
                for o, d in zip(order, drawn):
                    x = a[o].astype(np.int64) * 26
                    cells = np.concatenate([(x + b[o])[None], x + d]) + 676 * np.arange(n + 1)[:, None]
                    counts = np.bincount(cells.ravel(), minlength=676 * (n + 1)).reshape(n + 1, 676)
                    margins = n_log(counts[0].reshape(26, 26).sum(1)).sum() + n_log(counts[0].reshape(26, 26).sum(0)).sum() - n_log(np.array(len(o)))
                    sums += n_log(counts).sum(1) - margins
                    total += len(o)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.full(n + 1, total, np.int64)), pa.array(sums)], ["rep", "total", "s"])

    mi = rows.mapInArrow(run, "rep int, total long, s double").groupBy("rep").agg(F.sum("total").alias("total"), F.sum("s").alias("s"))
    return tested(mi.select("rep", "total", F.try_divide("s", "total").alias("mi")).where("total > 0"))


def cluster_bootstrap(sums: DataFrame, n: int, cluster: str, total: str = "s", count: str = "c") -> DataFrame:
    """sums: one row a cluster with its sum and count. The ratio of sums, and the 2.5 and 97.5 percentiles when each cluster is drawn a Poisson number of times, by a hash: resampling without gathering clusters anywhere."""
    u = T.hash_uniform(F.col("rep"), F.col(cluster))
    # Cumulative probabilities of a Poisson number with mean 1.
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    times = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("times", times)
    reps = drawn.groupBy("rep").agg((F.sum(F.col("times") * F.col(total)) / F.sum(F.col("times") * F.col(count))).alias("ratio"))
    point = sums.agg((F.sum(total) / F.sum(count)).alias("estimate"), F.count("*").alias("clusters"))
    return reps.agg(F.percentile("ratio", F.lit(0.025)).alias("low"), F.percentile("ratio", F.lit(0.975)).alias("high")).crossJoin(point)
