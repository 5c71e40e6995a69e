"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct word n-grams, as 64-bit hashes. Equal sets are one class from the start. The grams of a set are ordered rare first: by how often the frequent grams occur, then by hash; any order gives the same links, a good one gives few candidates. Two sets whose similarity reaches the threshold share a gram among the first n - ceil(threshold * n) + 1 of each, so only those are dealt out, with the set's size and the gram's place.

Sets that meet at a gram are candidates if their sizes (length filter) and what is left behind the gram (positional filter) allow the overlap. Candidates are cut down by how many grams each set has in slots of the hash, which bounds the overlap (suffix filter; a pair that is left has it again with finer slots for long sets, which do not go with every entry), and verified once a pair on the sets themselves, which meet in stars: the set with more pairs goes to one task for each STAR of them, the others come to it.

Only components are wanted, so a group of m near copies isn't expanded to its pairs. First each set is compared with the one before it and the first one at each gram, in order of size. Then sets of different components so far are looked at, at the grams where such meet, in blocks: what leaves a block are the entries that the filters let through to another, then its candidate pairs, if they are no more than DENSE for each entry; these are verified pair by pair. Of a block with more, no more leave than join its entries. What is joined in this way is a cluster; a cluster's sets meet in blocks, each once, all its pairs are judged there, and what leaves a block are as many links as join components. So rows of pairs grow with the entries, never with the square of a group.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer words than n has one gram, all its words; equal rows are one class; the threshold is exact, 100 * intersection >= percent * union in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BACK, LETTERS, ODD, powers
from .common import lean, release, settle, small_batches, whole_groups
from .components import components

N, PERCENT = 5, 75
#: Frequent grams known to every task, at most; grams are counted exactly within runs of so many, and reported from so many on.
FREQUENT, COUNT_RUN, REPORT = 1 << 19, 1 << 21, 3
#: Sets of one gram in a block, and grams of a block of sets, two of which meet in a task; slots of the suffix filter at least, and grams in one of them on average at most.
BLOCK, GRAMS, SLOTS, PER_SLOT = 2048, 1 << 20, 256, 4
#: Groups of so many entries are looked through together; blocks with more candidate pairs than this for each entry are dense.
FEW, DENSE = 64, 8
#: Words of a sieve of ids.
SIEVE = 1 << 17
#: Sets that are compared with one other set in a task, about.
STAR = 64
#: A gram counted more often than this is dealt to several tasks.
HOT = 4096
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(31))


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text taken in at once, about.
TAKE = 1 << 20


def gram_sets(texts: list[str | None], n: int = N) -> Iterator[np.ndarray]:
    """The distinct grams of each text, ascending. Words are hashed by differences of prefix sums over the bytes of many texts at once; bytes.lower() changes A to Z alone."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode().lower())
        size += len(held[-1]) + 1
        if size > TAKE:
            yield from grams_of(held, n)
            held, size = [], 0
    if held:
        yield from grams_of(held, n)


def grams_of(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    buffer = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    length = 1 << max(16, (len(buffer) - 1).bit_length())
    blank = BLANK[buffer]
    turn = np.nonzero(blank[1:] != blank[:-1])[0]  # a word reaches from behind one turn to the next
    start, last = turn[::2] + 1, turn[1::2]
    sums = np.cumsum(LETTERS[buffer] * powers(int(ODD), length)[: len(buffer)])
    words = mix((sums[last] - sums[start - 1]) * powers(int(BACK), length)[start])
    grams = words[: max(0, len(words) - n + 1)]
    for k in range(1, n if len(grams) else 1):
        grams = grams * ODD + words[k : len(words) - n + 1 + k]
        grams ^= grams >> np.uint64(29)
    grams = mix(grams)
    edges = np.concatenate([[0], np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        else:
            yield mix(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], np.uint64)) if b > a else np.zeros(0, np.uint64)


def gram_set(text: str | None, n: int = N) -> np.ndarray:
    return next(gram_sets([text], n))


def class_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def needed(a, b, percent: int = PERCENT):
    """The least overlap of sets of these sizes: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def classes_and_counts(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: id, class (null without words), size, slots and fine slots; kind 1: a gram that is frequent in a run of grams, and its count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        names = ["kind", "id", "class", "size", "slots", "fine"]

        def report() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            some = counts >= REPORT
            k = int(some.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(signed(grams[some])), pa.array(counts[some].astype(np.int64)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names)

        for b in batches:
            classes, sizes, parts, fine = [], [], [], []
            for grams in gram_sets(b.column(1).to_pylist(), n):
                c = class_of(grams) if len(grams) else None
                classes.append(c)
                sizes.append(len(grams))
                parts.append(slots(grams) if len(grams) else None)
                fine.append(slots(grams, True) if len(grams) else None)
                if c is not None and c not in seen:
                    seen.add(c)
                    held.append(grams)
                    total += len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary()), pa.array(fine, pa.binary())], names)
            if total >= COUNT_RUN:
                yield report()
                held, total = [], 0
        yield report()

    return docs.mapInArrow(lean(run), "kind int, id long, class long, size long, slots binary, fine binary")


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, ascending, and their counts; FREQUENT at most."""
    summed = settle(counts.groupBy("class").agg(F.sum("size").alias("n")))
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r["l"], r["k"]) for r in summed.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect()), reverse=True)  # 512 rows at most
    cut, total = None, 0
    for l, k in levels:
        total += k
        if total > FREQUENT:
            break
        cut = l
    rows = summed.where(level >= cut).select("class", "n").toArrow() if cut is not None else pa.table({"class": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    release(summed)
    grams, n = rows.column("class").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def rare_first(grams: np.ndarray, known: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first grams in the order of the join, and their counts where known, else 0."""
    if not len(known):
        return grams[:length], np.zeros(min(length, len(grams)), np.int64)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    often = np.where(known[at] == grams, counts[at], 0)
    rare = grams[often == 0]
    if len(rare) >= length:
        return rare[:length], np.zeros(length, np.int64)
    rest = np.nonzero(often)[0]
    rest = rest[np.argsort(often[rest], kind="stable")][: length - len(rare)]
    return np.concatenate([rare, grams[rest]]), np.concatenate([np.zeros(len(rare), np.int64), often[rest]])


def prefixes(docs: DataFrame, known: np.ndarray, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """gram, class, and at: size << 36 | place << 8 | salt; the salt is above 0 for the grams that are dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            grams, classes, ats = [], [], []
            for g in gram_sets(b.column(1).to_pylist(), n):
                if not len(g) or (c := class_of(g)) in seen:
                    continue
                seen.add(c)
                first, often = rare_first(g, known, counts, prefix_length(len(g), percent))
                shares = np.minimum(often // HOT + 1, 255)
                salts = np.where(shares > 1, 1 + c % shares, 0)
                grams.append(first)
                classes.append(np.full(len(first), c, np.int64))
                ats.append(len(g) << 36 | np.arange(len(first), dtype=np.int64) << 8 | salts)
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(grams))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(ats))], ["gram", "class", "at"])

    return docs.mapInArrow(lean(run), "gram long, class long, at long")


def fits(size_a, left_a, size_b, left_b, percent: int):
    """Length and positional filters. left: grams from this one on."""
    least = needed(size_a, size_b, percent)
    return (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)) & (np.minimum(left_a, left_b) >= least)


def meetings(entries: DataFrame, percent: int) -> DataFrame:
    """Of the entries, those whose gram more than one class has, and all of the grams dealt to several tasks, as the other classes may be in another one; with the class before and the first class at the gram where the filters let them through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before (gram, class, at), whether it has been given out, and its gram's first (class, at)
        for b in batches:
            g, c, a = (b.column(i).to_numpy() for i in range(3))
            if last is not None:
                g, c, a = (np.concatenate([[x], y]) for x, y in zip(last[0], (g, c, a)))
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            g, c, a = g[fresh], c[fresh], a[fresh]
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            pivot_c, pivot_a = c[start], a[start]
            if last is not None and last[2] is not None:
                same = start == 0
                pivot_c, pivot_a = np.where(same, last[2][0], pivot_c), np.where(same, last[2][1], pivot_a)
            more = np.zeros(len(g), bool)
            more[:-1] = ~new[1:]
            several = ~new | more | (a & 255 > 0)
            if last is not None and last[1]:
                several[0] = True  # its gram has more than one class, as is known
            given = last is not None and last[1]
            size, left = a >> 36, (a >> 36) - (a >> 8 & ((1 << 28) - 1))
            before = np.arange(len(g)) - 1
            chain = ~new
            chain[chain] = fits(size[chain], left[chain], size[before[chain]], left[before[chain]], percent)
            p_size, p_left = pivot_a >> 36, (pivot_a >> 36) - (pivot_a >> 8 & ((1 << 28) - 1))
            star = ~new & (pivot_c != c[before])
            star[star] = fits(size[star], left[star], p_size[star], p_left[star], percent)
            out = several.copy()
            if given:
                out[0] = False
            k = np.nonzero(out)[0]
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(g[k]), pa.array(c[k]), pa.array(a[k]), pa.array(c[before[k]], mask=~chain[k]), pa.array(pivot_c[k], mask=~star[k])], ["gram", "class", "at", "before", "pivot"])
            if len(g):
                i = len(g) - 1
                last = ((g[i], c[i], a[i]), bool(several[i]), (pivot_c[i], pivot_a[i]))

    dealt = entries.repartition("gram", F.col("at").bitwiseAND(F.lit(255))).sortWithinPartitions("gram", F.shiftright("at", 36), "class")
    return dealt.mapInArrow(lean(run), "gram long, class long, at long, before long, pivot long")


def dealt_out(rows: DataFrame, group: str, weight, most: int, *what: str) -> DataFrame:
    """The rows of each group in blocks, so that rows of different components meet in a task, and no group whole. rows: group, class, component and what.

    Rows of a group's largest component are its main ones, the others the rest; only the rest has to meet everything. Blocks of the rest are numbered first, and each task (a, b) gets two blocks, the first of the rest. So main rows are copied once for each block of the rest, and a group of one component is left out. weight: what a row counts against `most` in a block.
    """
    per = rows.groupBy(group, "component").agg(F.sum(weight).alias("n"))
    of = per.groupBy(group).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    parts = lambda n: F.ceil(n / most).cast("int")
    of = of.select(group, F.col("top.component").alias("main"), parts(F.col("n") - F.col("top.n")).alias("q"), parts(F.col("top.n")).alias("p"))
    is_main = F.col("component") == F.col("main")
    own = F.when(is_main, F.col("q") + F.pmod("class", F.col("p"))).otherwise(F.pmod("class", F.col("q"))).cast("int")
    meets = F.when(is_main, F.col("q") - 1).otherwise(F.col("q") + F.col("p") - 1)
    placed = rows.join(of, group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), meets)))
    keys = [group, "a", "b"]
    return in_tasks(placed.select(group, F.least("own", "other").cast("long").alias("a"), F.greatest("own", "other").cast("long").alias("b"), F.col("own").cast("long").alias("own"), "class", "component", *what), *keys)


def in_tasks(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def met_across(dealt: DataFrame, percent: int) -> DataFrame:
    """Of the entries dealt out, those that the length and positional filters let through to an entry of another component."""
    names = ["gram", "a", "b", "own", "class", "component", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, *names[:3]):
            g, a, b, own, c, of, at = (t.column(n).to_numpy() for n in names)
            size = at >> 36
            left = size - (at >> 8 & ((1 << 28) - 1))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            start = np.nonzero(new)[0]
            group = np.cumsum(new)
            count = np.diff(np.append(start, len(g)))
            through = np.zeros(len(g), bool)

            def look(i: np.ndarray, j: np.ndarray) -> None:
                ok = (of[i] != of[j]) & ((a[i] == b[i]) | (own[i] != own[j])) & fits(size[i], left[i], size[j], left[j], percent)
                through[i[ok]] = True
                through[j[ok]] = True

            few = np.nonzero(np.repeat(count <= FEW, count))[0]
            for d in range(1, int(count[count <= FEW].max(initial=1))):  # all small groups at once, by distance
                i = few[: len(few) - d]
                j = few[d:]
                same = group[i] == group[j]
                look(i[same], j[same])
            for k in np.nonzero(count > FEW)[0].tolist():
                rows = np.arange(start[k], start[k] + count[k])
                for i in rows if a[rows[0]] == b[rows[0]] else rows[own[rows] == a[rows[0]]]:
                    look(np.full(len(rows), i), rows)
            if through.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[through]) for x in (g, a, b, own, c, of, at)], names)

    return dealt.select(*names).mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


class Forest:
    """Labels that are merged, how many are left, and which pairs merged them."""

    def __init__(self, labels: np.ndarray):
        unlike, self.labels = np.unique(labels, return_inverse=True)
        self.left = len(unlike)
        self.pairs: list[tuple[int, int]] = []

    def apart(self, i: int, among: np.ndarray) -> np.ndarray:
        return among[self.labels[among] != self.labels[i]]

    def link(self, i: int, found: np.ndarray) -> None:
        """found: some of those apart from i."""
        if len(found):
            old, at = np.unique(self.labels[found], return_index=True)
            self.pairs += [(i, j) for j in found[at].tolist()]
            self.labels[np.isin(self.labels, old)] = self.labels[i]
            self.left -= len(old)


def edges_of(pairs: list[tuple[int, int]], classes: np.ndarray) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(classes[both[:, 0]]), pa.array(classes[both[:, 1]])], ["a", "b"])


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: pairs a, b of entries whose slots allow the overlap too, and whether their block is dense. rows: the result of met_across() with slots, in tasks.

    A block with more than DENSE such pairs for each of its entries is dense; of it, no more pairs are given than join its entries. Of the others all are.
    """
    names = ["gram", "a", "b", "own", "class", "component", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, *names[:3]):
            g, a, b, own, c, of, at = (t.column(n).to_numpy() for n in names)
            part = Slots(t.column("slots").to_pylist())
            size = at >> 36
            left = size - (at >> 8 & ((1 << 28) - 1))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            found: list[tuple[int, int]] = []
            dense: list[bool] = []
            start = np.nonzero(new)[0].tolist()
            for lo, hi in zip(start, [*start[1:], len(g)]):
                apart = a[lo] != b[lo]
                rows = np.arange(lo, hi)
                others = rows[own[rows] == b[lo]] if apart else rows
                pairs: list[tuple[int, int]] = []
                forest = Forest(np.arange(hi - lo))
                for i in (rows[own[rows] == a[lo]] if apart else rows).tolist():
                    j = others if apart else others[i - lo + 1 :]
                    if many := len(pairs) > DENSE * (hi - lo):
                        if forest.left == 1:
                            break
                        j = forest.apart(i - lo, j - lo) + lo
                    j = j[of[j] != of[i]]
                    j = j[fits(size[i], left[i], size[j], left[j], percent)]
                    if not len(j):
                        continue
                    j = j[part.allow(i, j, needed(size[i], size[j], percent))]
                    if not many:
                        pairs += [(i, x) for x in j.tolist()]
                    forest.link(i - lo, forest.apart(i - lo, j - lo))
                many = len(pairs) > DENSE * (hi - lo)
                found += [(x + lo, y + lo) for x, y in forest.pairs] if many else pairs
                dense += [many] * (len(found) - len(dense))
            if found:
                both = edges_of(found, c)
                yield pa.RecordBatch.from_arrays([*both.columns, pa.array(dense, pa.bool_())], ["a", "b", "dense"])

    return rows.mapInArrow(lean(run), "a long, b long, dense boolean")


def links_in_clusters(dealt: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of classes whose sets reach the threshold, no more than join the components that they join. dealt: cluster, a, b, own, class, component, grams, in tasks.

    A class is compared with all others of its two blocks at once, through the list of classes of each gram; classes of the commonest component are compared from the other side alone.
    """
    names = ["cluster", "a", "b", "own", "class", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, *names[:3]):
            cluster, a, b, own, c, of = (t.column(n).to_numpy() for n in names)
            new = np.ones(len(c), bool)
            new[1:] = (cluster[1:] != cluster[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            start = np.nonzero(new)[0].tolist()
            found: list[tuple[int, int]] = []
            for lo, hi in zip(start, [*start[1:], len(c)]):
                sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").slice(lo, hi - lo).to_pylist()]
                sizes = np.array([len(x) for x in sets])
                grams, at = np.unique(np.concatenate(sets), return_inverse=True)
                owner = np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(at, kind="stable")
                having = owner[order]
                edge = np.searchsorted(at[order], np.arange(len(grams) + 1))
                begin = np.cumsum(sizes) - sizes
                forest = Forest(of[lo:hi])
                commonest = np.bincount(forest.labels).argmax()
                mine = own[lo:hi]
                for i in np.nonzero(mine == a[lo] if a[lo] != b[lo] else forest.labels != commonest)[0].tolist():
                    if forest.left == 1:
                        break
                    own_grams = at[begin[i] : begin[i] + sizes[i]]
                    n = edge[own_grams + 1] - edge[own_grams]
                    places = np.repeat(edge[own_grams] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    shared = np.bincount(having[places], minlength=len(sets))
                    j = forest.apart(i, np.nonzero(100 * shared >= percent * (sizes + sizes[i] - shared))[0])
                    forest.link(i, j)
                found += [(x + lo, y + lo) for x, y in forest.pairs]
            if found:
                yield edges_of(found, c)

    return dealt.mapInArrow(lean(run), "a long, b long")


def slots(grams: np.ndarray, fine: bool = False) -> bytes:
    """How many grams fall in each slot; 255 stands for so many or more. SLOTS slots, if fine doubled until PER_SLOT grams or fewer come to one: with more, chance alone lets long sets through."""
    bits = max(SLOTS.bit_length() - 1, (-(-len(grams) // PER_SLOT) - 1).bit_length() if fine else 0)
    return np.minimum(np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


class Slots:
    """The slots of many sets, by their number."""

    def __init__(self, parts: list[bytes]):
        self.count = np.array([len(x) for x in parts], np.int64)
        self.at = np.zeros(len(parts), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for m in np.unique(self.count).tolist():
            rows = np.nonzero(self.count == m)[0]
            self.at[rows] = np.arange(len(rows))
            self.of[m] = np.frombuffer(b"".join(parts[i] for i in rows.tolist()), np.uint8).reshape(-1, m)

    def allow(self, i: np.ndarray | int, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether sets i (or set i) and j may share so many grams. Where the numbers of slots differ, those of the longer set are joined."""
        out = np.zeros(len(j), bool)
        m, k = np.broadcast_to(self.count[i], len(j)), self.count[j]
        for a, b in {*zip(m.tolist(), k.tolist())}:
            some = np.nonzero((m == a) & (k == b))[0]
            for rows in np.array_split(some, -(-len(some) * max(a, b) // TAKE)):
                x = self.of[a][self.at[i]][None] if np.ndim(i) == 0 else self.of[a][self.at[i[rows]]]
                y = self.of[b][self.at[j[rows]]]
                full = (x == 255).any(1) & (y == 255).any(1)
                if a != b:
                    x, y = (z.reshape(len(z), min(a, b), -1).sum(2, dtype=np.int64) for z in (x, y))
                out[rows] = full | (np.minimum(x, y).sum(1, dtype=np.int64) >= least[rows])
        return out


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """class and grams (binary) of the documents given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(gram_sets(b.column(1).to_pylist(), n))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], ["class", "grams"])

    return docs.mapInArrow(lean(run), "class long, grams binary")


def attach(pairs: DataFrame, of: DataFrame, *what: str) -> DataFrame:
    """pairs a, b with what each of them has in `of` (by class), as x_ and y_ columns."""
    side = lambda c, p: of.select(F.col("class").alias(c), *(F.col(w).alias(f"{p}_{w}") for w in what))
    return pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b").select("a", "b", *(f"{p}_{w}" for w in what for p in "xy"))


def kept_pairs(rows: DataFrame, test) -> DataFrame:
    """a, b of the rows for which test(x, y, ...) of the other columns holds; test gets lists and gives a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = test(*(c.to_pylist() for c in b.columns[2:])) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return rows.mapInArrow(lean(run), "a long, b long")


def bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: the pairs whose fine slots allow the overlap."""

    def test(x: list[bytes], y: list[bytes], n: list[int], m: list[int]) -> np.ndarray:
        at = np.arange(len(x))
        return Slots([*x, *y]).allow(at, at + len(x), needed(np.array(n), np.array(m), percent))

    return kept_pairs(attach(pairs, reps, "fine", "size"), test)


def sieved(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts without most of those that have none of the ids: by SIEVE words of 64 bits, which every task gets, so that the others are not dealt out."""
    word, bit = f"shiftright(xxhash64(id), 6) & {SIEVE - 1}L", "shiftleft(1L, cast(xxhash64(id) & 63 as int))"
    words = ids.selectExpr(f"{word} AS word", f"{bit} AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return texts.withColumn("word", F.expr(word)).join(F.broadcast(words), "word").where(f"bits & {bit} <> 0").drop("word", "bits")


def sets_in_stars(pairs: DataFrame, reps: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """hub, part, place, class and grams of the sets of the pairs, in tasks: of each pair, the class with more pairs is the hub, and the others come to it, STAR to a part; place 0 is the hub's own set. A set leaves the task that makes it once for each part it belongs to."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    degree = both.groupBy("class").agg(F.count("*").alias("n"))
    of = lambda c: degree.select(F.col("class").alias(c), F.struct("n", "class").alias(f"{c}_n"))
    ends = pairs.join(of("a"), "a").join(of("b"), "b").select(F.greatest("a_n", "b_n").alias("hub"), F.least("a_n", "b_n").alias("other"))
    rays = ends.select(F.col("hub.class").alias("hub"), F.pmod(F.xxhash64("other.class"), F.ceil(F.col("hub.n") / STAR)).alias("part"), F.col("other.class").alias("class"))
    roles = rays.select("hub", "part", F.lit(1).cast("long").alias("place"), "class").union(rays.select("hub", "part", F.lit(0).cast("long").alias("place"), F.col("hub").alias("class")).distinct())
    own = settle(roles.join(reps.select("class", F.col("rep").alias("id")), "class").groupBy("id").agg(F.collect_list(F.struct("hub", "part", "place", "class")).alias("own")))
    names = ["hub", "part", "place", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])], [*names, "grams"])

        for b in batches:
            for g, roles in zip(gram_sets(b.column(0).to_pylist(), n), b.column(1).to_pylist()):
                c = class_of(g) if len(g) else None  # another row may have the id of the class
                data = g.tobytes()
                for r in roles:
                    if r["class"] == c:
                        rows.append((*(r[x] for x in names), data))
                        size += len(data)
                        if size >= TAKE:
                            yield made()
                            rows, size = [], 0
        if rows:
            yield made()

    small_batches(texts.sparkSession)
    sets = sieved(texts, own).join(own.hint("merge"), "id").select("t", "own").mapInArrow(lean(run), "hub long, part long, place long, class long, grams binary")  # one way at every size
    return sets.repartition("hub", "part").sortWithinPartitions("hub", "part", "place")


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold. Of a star, a task holds the hub's set alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, hub = None, np.zeros(0, np.uint64)
        for b in batches:
            found: list[tuple[int, int]] = []
            for h, place, c, grams in zip(*(b.column(x).to_pylist() for x in ("hub", "place", "class")), b.column("grams")):
                own = np.frombuffer(grams.as_buffer(), np.uint64)
                if not place:
                    of, hub = h, own.copy()
                elif of == h:
                    u, v = (own, hub) if len(own) < len(hub) else (hub, own)
                    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                    o = int((v[at] == u).sum())
                    if 100 * o >= percent * (len(u) + len(v) - o):
                        found.append((min(h, c), max(h, c)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return sets_in_stars(pairs, reps, texts, n).mapInArrow(lean(run), "a long, b long")


def similar_documents(docs: DataFrame, n: int = N, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every row.

    Sets are made of candidates alone, twice: of the pairs along each gram, and of the clusters of candidates between the components that those give.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    small_batches(spark)
    first = settle(classes_and_counts(texts, n))
    known, counts = frequent(first.where("kind = 1"))
    rows = first.where("kind = 0").select("id", "class", "size")
    reps = settle(first.where("kind = 0 and class is not null").groupBy("class").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("slots").alias("slots"), F.first("fine").alias("fine")))

    met = settle(meetings(prefixes(texts, known, counts, n, percent), percent))
    release()
    pairs = lambda c: met.where(f"{c} is not null").select(F.least("class", c).alias("a"), F.greatest("class", c).alias("b"))

    def sets_for(classes: DataFrame) -> DataFrame:
        ids = classes.join(reps, "class").select(F.col("rep").alias("id")).distinct()
        small_batches(spark)
        return settle(sets_of(sieved(texts, ids).join(ids.hint("merge"), "id").select("id", "t"), n))  # one way at every size

    near = settle(bounded(pairs("before").union(pairs("pivot")).distinct(), reps, percent))
    links = settle(verified(near, reps, texts, n, percent))
    release(near)
    of = settle(components(links))
    with_component = lambda x: x.join(of.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component_id", "class")).drop("component_id")
    through = settle(met_across(dealt_out(with_component(met.select("gram", "class", "at")), "gram", F.lit(1), BLOCK, "at"), percent))
    release(met)
    keys = ["gram", "a", "b"]
    maybe = settle(candidates(in_tasks(through.join(reps.select("class", "slots").hint("merge"), "class").select(*keys, "own", "class", "component", "at", "slots"), *keys), percent))
    release(through)
    ordered = maybe.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dense")
    if not maybe.isEmpty():
        few = settle(bounded(ordered.where("not dense").select("a", "b").distinct(), reps, percent))
        links = settle(links.union(verified(few, reps, texts, n, percent)))
        release(few)
        of = settle(components(links))
    many = settle(ordered.where("dense").select("a", "b").distinct())
    if not many.isEmpty():
        clusters = settle(with_component(components(many).select(F.col("id").alias("class"), F.col("component_id").alias("cluster"))))
        sets = sets_for(clusters.select("class"))
        weighed = clusters.join(sets, "class").withColumn("weight", F.greatest(F.octet_length("grams") / 8, F.lit(GRAMS // 4096)))
        links = settle(links.union(links_in_clusters(dealt_out(weighed, "cluster", F.col("weight"), GRAMS, "grams"), percent)))
        release(clusters, sets)
        of = settle(components(links))

    joined = reps.select("class", "rep").join(of.withColumnRenamed("id", "class"), "class", "left").withColumn("component_id", F.coalesce("component_id", "class"))
    least = joined.groupBy("component_id").agg(F.min("rep").alias("least"))
    known_of = settle(joined.join(least, "component_id").select("class", "least"))
    release(reps, maybe, many, links)
    return rows.join(known_of, "class", "left").select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
