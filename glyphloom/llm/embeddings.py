"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are the words of a structured random code: after a random rotation, the dimensions are parted into blocks, each block has a few random unit vectors, and a direction joins one of each. A vector is list-decoded to all directions whose inner product with it is at least a threshold: partial sums that can no longer reach it are cut off. The threshold is set from the number of vectors so that a direction holds about BUCKET of them, and at most half of all. Directions of one code share their blocks' vectors, so a pair's hits come in clumps; how often a pair at the wanted cosine shares no direction of a code is therefore measured on TRIALS planted pairs, and codes, which are rotated independently, are added until the product of their misses is MISS at most.

Vectors that share a direction are joined and then verified. What goes to a direction is a sketch of a byte for each dimension with the length of what rounding took away, which bounds the cosine from above; of the pairs whose bound reaches the wanted cosine, no more leave a task than join its vectors. Vectors joined in this way are a cluster. A cluster's vectors meet in blocks of BLOCK, block against block in a task of its own, so that each two are compared once, by cosine in double precision, and none meets whole in one task. What leaves a task is a count of links and a pointer to the least vector found for each vector, not pairs. So exact vectors are copied once for each block of their cluster, sketches once for each direction and each block of vectors there, and a link is found if any chain of such pairs joins its ends.

Equal vectors are one class. Defined results: a vector that is null, zero, empty or holds a null or a component that isn't finite links with nothing; vectors of different lengths do not link; rows that repeat an id are copies of one another if equal, and the id's links are counted over them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, lean, release, settle, whole_groups
from .components import components, counted
from .jaccard import Forest

#: A code has a CODES-th of the directions that would do if their hits were independent; pairs on which a code's misses are measured; vectors compared in one product.
BUCKET, BLOCK, PARTS, CODES, MISS, SEED, TRIALS, TILE = 400, 8192, 2, 24, 1e-4, 20, 4000, 1024


#: Groups of more than a block are told to all tasks if there are so many at most.
SENT = 1 << 18


def tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def both(t: float, rho: float) -> float:
    """The chance that the second of two normal numbers with correlation rho is above t, given that the first is."""
    xs = np.linspace(t, t + 8, 4001)
    above = np.array([tail((t - rho * x) / math.sqrt(1 - rho * rho)) for x in xs])
    weight = np.exp(-(xs * xs - t * t) / 2)
    return float((above * weight).sum() / weight.sum())


def directions(n: int, dim: int, cosine: float) -> tuple[float, int, int]:
    """Threshold in standard deviations, parts, and words of each part's code."""
    share = min(0.5, BUCKET / max(n, 1))
    low, high = 0.0, 40.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > share else (low, middle)
    low = min(low, 0.6 * math.sqrt(dim))  # in few dimensions no vector may come nearer
    share = tail(low)
    parts = max(1, min(PARTS, dim))
    wanted = -math.log(MISS) / max(both(low, cosine), 1e-6) / share / CODES  # directions of one code
    return low, parts, max(2, math.ceil(wanted ** (1 / parts)))


def planted(rng: np.random.Generator, k: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """k random pairs of unit vectors with exactly this cosine; equal vectors in one dimension."""
    x = rng.standard_normal((k, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    z = rng.standard_normal((k, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * z


class CapCode:
    """Independent codes; direction k + number of codes * its number within the code is one of code k."""

    def __init__(self, n: int, dim: int, cosine: float):
        self.t, self.parts, self.size = directions(n, dim, cosine)
        self.least = self.t / math.sqrt(dim)
        rng = np.random.default_rng([SEED, dim])
        edges = np.linspace(0, dim, self.parts + 1).astype(int)
        self.spans = [slice(a, b) for a, b in zip(edges, edges[1:])]
        self.words: list[list[np.ndarray]] = []  # by code and part: a column for each word, turned back
        missed = 1.0
        while missed > MISS:
            turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            code = []
            for s in self.spans:
                w = rng.standard_normal((self.size, s.stop - s.start))
                code.append(turn[:, s] @ (w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt((s.stop - s.start) / dim)).T)
            self.words.append(code)
            (i, p), (j, q) = (self.of_code(v, code) for v in planted(rng, TRIALS, dim, cosine))
            total = self.size**self.parts
            shared = np.unique(np.intersect1d(i * total + p, j * total + q, assume_unique=True) // total)
            missed *= (TRIALS - len(shared) + 1) / (TRIALS + 1)

    def of_code(self, x: np.ndarray, code: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the code's directions that they have."""
        scores = [x @ w for w in code]
        rest = np.cumsum([s.max(1) for s in scores][::-1], axis=0)[::-1]
        rows, sums, ids = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for p, s in enumerate(scores):
            bound = self.least - (rest[p + 1][rows] if p + 1 < self.parts else np.zeros(len(rows)))
            grid = sums[:, None] + s[rows]
            a, b = np.nonzero(grid >= bound[:, None])
            rows, sums, ids = rows[a], grid[a, b], ids[a] * self.size + b
        return rows, ids

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The directions of each unit vector, ascending."""
        found = [self.of_code(x, code) for code in self.words]
        rows = np.concatenate([r for r, _ in found])
        ids = np.concatenate([i * len(self.words) + k for k, (_, i) in enumerate(found)])
        order = np.lexsort((ids, rows))
        return np.split(ids[order], np.searchsorted(rows[order], np.arange(1, len(x))))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(x: np.ndarray) -> list[bytes]:
    """Of unit vectors: the step and the length of what rounding takes away, as four bytes each, and the rounded components, a byte each."""
    step = np.maximum(np.abs(x).max(1), 1e-30) / 127
    rounded = np.rint(x / step[:, None]).astype(np.int8)
    step = step.astype("<f4")
    lost = np.linalg.norm(x - rounded * step.astype(float)[:, None], axis=1) + 1e-6
    lost = lost.astype("<f4")
    return [step[i].tobytes() + lost[i].tobytes() + rounded[i].tobytes() for i in range(len(x))]


def alike(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of sketches (rows of bytes) may reach the cosine."""

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        step, lost = (np.ascontiguousarray(x[:, a : a + 4]).view("<f4").ravel().astype(float) for a in (0, 4))
        return x[:, 8:].view(np.int8).astype(np.float32 if x.shape[1] < 1000 else float), step, lost  # products of bytes are whole numbers that either holds exactly

    (x, s, r), (y, t, q) = parts(left), parts(right)
    return (x @ y.T) * s[:, None] * t >= cosine - (r[:, None] + q + r[:, None] * q) - 1e-9


def joined_in_blocks(dealt: DataFrame, cosine: float) -> DataFrame:
    """Pairs a, b that may link, no more than join the vectors of a block. dealt: direction, a, b, own, rep and sketch, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "direction", "a", "b"):
            direction, a, b, own, rep = (t.column(c).to_numpy() for c in ("direction", "a", "b", "own", "rep"))
            whole = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
            new = np.ones(len(rep), bool)
            new[1:] = (direction[1:] != direction[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            start = np.nonzero(new)[0].tolist()
            found: list[tuple[int, int]] = []
            for lo, hi in zip(start, [*start[1:], len(rep)]):
                mine = own[lo:hi]
                left, right = (np.nonzero(mine == k[lo])[0] for k in (a, b))
                forest = Forest(np.arange(hi - lo))
                for i in range(0, len(left), TILE):
                    for j in range(0, len(right), TILE):
                        if forest.left == 1:
                            break
                        rows, others = left[i : i + TILE], right[j : j + TILE]
                        near = alike(whole[lo + rows], whole[lo + others], cosine)
                        near &= rows[:, None] != others
                        for k in np.nonzero(near.any(1))[0].tolist():
                            forest.link(int(rows[k]), forest.apart(int(rows[k]), others[near[k]]))
                found += [(x + lo, y + lo) for x, y in forest.pairs]
            if found:
                both = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(rep[both[:, 0]]), pa.array(rep[both[:, 1]])], ["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def compare(left: dict, right: dict | None, cosine: float) -> list[tuple[int, int, int]]:
    """(id, links, least id reached) of two blocks of vectors, or of one block with itself. Blocks: id, copies, x (unit vectors)."""
    other = left if right is None else right
    ids = left["id"] if right is None else np.concatenate([left["id"], right["id"]])
    shift = 0 if right is None else len(left["id"])
    links = np.zeros(len(ids), np.int64)
    forest = Forest(np.arange(len(ids)))
    for i in range(0, len(left["id"]), TILE):
        for j in range(0, len(other["id"]), TILE):
            near = left["x"][i : i + TILE] @ other["x"][j : j + TILE].T >= cosine
            if right is None and i == j:
                np.fill_diagonal(near, False)
            links[i : i + near.shape[0]] += near @ other["copies"][j : j + near.shape[1]]
            if right is not None:
                links[shift + j : shift + j + near.shape[1]] += left["copies"][i : i + near.shape[0]] @ near
            if forest.left > 1:
                for k in np.nonzero(near.any(1))[0].tolist():
                    forest.link(i + k, forest.apart(i + k, np.nonzero(near[k])[0] + j + shift))
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, forest.labels, ids)
    touched = np.nonzero(links)[0]
    return [(int(ids[i]), int(links[i]), int(least[forest.labels[i]])) for i in touched]


def near_duplicates(rows: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    element = rows.schema[vector].dataType.elementType
    exact = "array<float>" if element.simpleString() == "float" else "array<double>"
    v = col(vector).cast(exact)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fine = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False)) & col(key).isNotNull()
    plus = F.transform(v, lambda x: x + F.lit(0.0)).cast(exact)  # no negative zeros
    base = rows.select(col(key).alias("id"), F.when(fine, plus).alias("v"))
    hashed = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")))  # 128 bits
    base = base.withColumn("class", hashed)
    classes = settle(base.where("class is not null").groupBy("class").agg(F.min(F.struct("id", "v")).alias("x"), F.count("*").alias("copies")).select("class", F.col("x.id").alias("rep"), "copies", F.col("x.v").alias("v")))
    edges, counts = None, None
    for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect():  # a row for each length of vectors
        found = links(classes.where(F.size("v") == r["dim"]).select("rep", "copies", "v"), CapCode(r["n"], r["dim"], cosine), cosine)
        e, c = found.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")), found.select("id", "links")
        edges, counts = (e, c) if edges is None else (edges.union(e), counts.union(c))
    if edges is None:
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    reps = classes.select("class", "rep", "copies").join(counts.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep"), "rep", "left").join(components(edges).withColumnRenamed("id", "rep"), "rep", "left")
    known = reps.select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = base.select("id", "class").join(known, "class", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def in_blocks(rows: DataFrame, group: str, *what: str) -> DataFrame:
    """The rows of each group in blocks, block against block in a task of its own."""
    many, n = counted(rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(group, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), F.lit(True))
    many = F.broadcast(many) if n <= SENT else many  # else Spark shuffles both sides
    placed = rows.join(many, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("long"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    keys = [group, "a", "b"]
    return dealt.select(group, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", *what).repartition(*keys).sortWithinPartitions(*keys)


def links(classes: DataFrame, code: CapCode, cosine: float) -> DataFrame:
    """id, links, least of vectors that link, in parts: links are to be summed."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = unit(matrix(b.column("v")))
                lists = code.decode(x)
                take = np.repeat(np.arange(b.num_rows), [len(y) for y in lists])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), b.column("rep").take(pa.array(take)), pa.array(sketches(x), pa.binary()).take(pa.array(take))], ["direction", "rep", "sketch"])

    placed = settle(classes.mapInArrow(lean(decode), "direction long, rep long, sketch binary"))
    near = settle(joined_in_blocks(in_blocks(placed, "direction", "sketch"), cosine).distinct())
    release(placed)
    clusters = settle(components(near).select(F.col("id").alias("rep"), F.col("component_id").alias("cluster")))
    exact = in_blocks(classes.join(clusters, "rep"), "cluster", "copies", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cluster", "a", "b"):
            cluster, a, b, own, rep, copies = (t.column(c).to_numpy() for c in ("cluster", "a", "b", "own", "rep", "copies"))
            x = unit(matrix(t.column("v").combine_chunks()))
            new = np.ones(len(rep), bool)
            new[1:] = (cluster[1:] != cluster[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            start = np.nonzero(new)[0].tolist()
            found = []
            for lo, hi in zip(start, [*start[1:], len(rep)]):
                part = lambda m: {"id": rep[lo:hi][m], "copies": copies[lo:hi][m], "x": x[lo:hi][m]}  # noqa: B023, E731
                mine = own[lo:hi]
                found += compare(part(mine == a[lo]), None if a[lo] == b[lo] else part(mine == b[lo]), cosine)
            if found:
                ids, n, least = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, n, least)], ["id", "links", "least"])

    found = settle(exact.mapInArrow(lean(run), "id long, links long, least long"))
    release(near, clusters)
    return found
