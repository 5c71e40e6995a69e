"""Sequence models: alignment, segmentation, aligners by expectation-maximisation, beams and annealing.

Each runs over independent groups (a pair of texts, a distinct word, a restart), so groups are what is distributed; within one, the recurrences are numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = -1.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def align(a: Sequence[str], b: Sequence[str], same: float = 1.0, other: float = -1.0, gap: float = GAP) -> tuple[float, list[tuple[int, int]]]:
    """The best global alignment: its score, and the places that are paired. On ties a pair goes before a gap in b, that before one in a."""
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1))
    score[:, 0], score[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[v] for v in a], int), np.array([codes[v] for v in b], int)
    ramp = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.empty(m + 1)
        best[0] = score[i, 0]
        best[1:] = np.maximum(score[i - 1, :-1] + np.where(y == x[i - 1], same, other), score[i - 1, 1:] + gap)
        score[i] = np.maximum.accumulate(best - ramp) + ramp  # gaps along the row
    pairs, i, j = [], n, m
    while i and j:
        if math.isclose(score[i, j], score[i - 1, j - 1] + (same if x[i - 1] == y[j - 1] else other)):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif math.isclose(score[i, j], score[i - 1, j] + gap):
            i -= 1
        else:
            j -= 1
    return float(score[n, m]), pairs[::-1]


def align_rows(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, score, matched, length: the alignment of two arrays of strings in each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, x, y in zip(f["k"], f["a"], f["b"]):
                s, pairs = align(list(x), list(y))
                out.append((k, s, sum(x[i] == y[j] for i, j in pairs), max(len(x), len(y))))
            yield pd.DataFrame(out, columns=["k", "score", "matched", "length"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(run, f"k {kind}, score double, matched long, length long").withColumnRenamed("k", key)


def segment(word: str, cost: dict[str, float], whole: float, longest: int, penalty: float = 2.0) -> list[str]:
    """The cheapest parting of a word into known pieces, each piece after the first at a penalty; a word that none fits stays whole."""
    best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            c = cost.get(word[i:j], whole if j - i == len(word) else math.inf)
            total = best[i][0] + c + (penalty if i else 0.0)
            if total < best[j][0]:
                best[j] = total, i
    out, j = [], len(word)
    while j:
        i = best[j][1]
        out.append(word[i:j])
        j = i
    return out[::-1]


def segment_types(types: DataFrame, share: float = 1e-5, least: int = 20) -> DataFrame:
    """types: w, n. w, n, parts: distinct words parted by the costs of the pieces, words that make up this share of all at least (of which there are 1 / share at most)."""
    total = float(types.agg(F.sum("n")).first()[0] or 1.0)
    known = types.where((F.col("n") >= max(least, share * total)) & (F.length("w") >= 2)).collect()
    cost = {r["w"]: -math.log2(r["n"] / total) for r in known}
    longest = max(map(len, cost), default=1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [segment(w, cost, cost.get(w, math.log2(total) + 8.0), longest) for w in f["w"]]
            yield pd.DataFrame({"w": f["w"], "n": f["n"], "parts": parts})

    return types.mapInPandas(run, "w string, n long, parts array<string>")


def aligner_step(pairs: list[tuple[str, str]], table: dict[str, dict[str, float]], most: int = 2) -> tuple[dict[str, dict[str, float]], float]:
    """One round of a monotone aligner: each sign of a source word makes 0 to `most` letters of the target. Returns new probabilities and the log likelihood."""
    counts, total = aligner_sums(pairs, table, most)
    return {s: {u: v / sum(c.values()) for u, v in c.items()} for s, c in counts.items()}, total


def aligner_sums(pairs: list[tuple[str, str]], table: dict[str, dict[str, float]], most: int) -> tuple[dict[str, dict[str, float]], float]:
    """Expected counts by sign and letters, and the log likelihood."""
    counts: dict[str, dict[str, float]] = {}
    total = 0.0
    for s, t in pairs:
        n, m = len(s), len(t)
        ahead, behind = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1))
        ahead[0, 0] = behind[n, m] = 1.0
        for i in range(n):
            own = table[s[i]]
            for j in range(m + 1):
                if ahead[i, j]:
                    for k in range(min(most, m - j) + 1):
                        ahead[i + 1, j + k] += ahead[i, j] * own.get(t[j : j + k], 1e-9)
        for i in range(n - 1, -1, -1):
            own = table[s[i]]
            for j in range(m + 1):
                behind[i, j] = sum(own.get(t[j : j + k], 1e-9) * behind[i + 1, j + k] for k in range(min(most, m - j) + 1))
        z = ahead[n, m]
        if z <= 0:
            continue
        total += math.log(z)
        for i in range(n):
            own, c = table[s[i]], counts.setdefault(s[i], {})
            for j in range(m + 1):
                for k in range(min(most, m - j) + 1):
                    u = t[j : j + k]
                    if (p := ahead[i, j] * own.get(u, 1e-9) * behind[i + 1, j + k] / z) > 1e-12:
                        c[u] = c.get(u, 0.0) + p
    return counts, total


def learn_aligner_rows(rows: DataFrame, rounds: int = 15, most: int = 2) -> dict[str, str]:
    """The same from rows s, t, n of any number: counts are made where the rows are, the table (signs by strings of letters) is all that is collected and sent."""
    signs = [r[0] for r in rows.select(F.explode(F.split("s", ""))).distinct().collect() if r[0]]
    letters = [r[0] for r in rows.select(F.explode(F.split("t", ""))).distinct().collect() if r[0]]
    if most > 2:
        raise ValueError("a sign makes two letters at most")
    seen = ["", *sorted(letters), *sorted(a + b for a in letters for b in letters)] if most > 1 else ["", *sorted(letters)]
    table = {s: {u: 1.0 / len(seen) / (4 if u == "" else 1) for u in seen} for s in sorted(signs)}
    for _ in range(rounds):

        def count(frames: Iterator[pd.DataFrame], now=table) -> Iterator[pd.DataFrame]:
            sums = np.zeros((len(now), len(seen)))
            for f in frames:
                sums += aligner_table(f["s"].tolist(), f["t"].tolist(), f["n"].to_numpy(float), now, seen, most)
            names = sorted(now)
            yield pd.DataFrame([(names[i], seen[j], sums[i, j]) for i, j in zip(*np.nonzero(sums))], columns=["sign", "u", "v"])

        counts: dict[str, dict[str, float]] = {}
        for r in rows.mapInPandas(count, "sign string, u string, v double").groupBy("sign", "u").agg(F.sum("v").alias("v")).collect():
            counts.setdefault(r["sign"], {})[r["u"]] = r["v"]
        table = {s: {u: v / sum(c.values()) for u, v in c.items()} for s, c in counts.items()}
    return {s: max(sorted(u), key=lambda v: (round(u[v], 9), -len(v))) for s, u in table.items()}


def aligner_table(s: list[str], t: list[str], n: np.ndarray, table: dict[str, dict[str, float]], seen: list[str], most: int) -> np.ndarray:
    """aligner_sums() of many pairs, each n times, as signs (sorted) by `seen`: pairs of like lengths go through the recurrences together."""
    signs, letters = sorted(table), sorted(u for u in seen if len(u) == 1)
    place = {u: i for i, u in enumerate(seen)}
    p = np.array([[table[x].get(u, 1e-9) for u in seen] for x in signs]).reshape(len(signs), len(seen))
    one = np.array([place[u] for u in letters], np.int64)
    two = np.array([[place.get(u + v, 0) for v in letters] for u in letters], np.int64).reshape(len(letters), len(letters))
    code, letter = {x: i for i, x in enumerate(signs)}, {u: i for i, u in enumerate(letters)}
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(s, t)):
        groups.setdefault((len(x), len(y)), []).append(i)
    out = np.zeros(len(signs) * len(seen))
    for (a, b), own in groups.items():
        for at in range(0, len(own), 4096):
            some = own[at : at + 4096]
            x = np.array([[code[c] for c in s[i]] for i in some], np.int64).reshape(len(some), a)
            y = np.array([[letter[c] for c in t[i]] for i in some], np.int64).reshape(len(some), b)

            def unit(j: int, k: int) -> np.ndarray:
                return np.full(len(some), place[""]) if k == 0 else one[y[:, j]] if k == 1 else two[y[:, j], y[:, j + 1]]

            steps = [(j, k) for j in range(b + 1) for k in range(min(most, b - j) + 1)]
            ahead, behind = np.zeros((a + 1, b + 1, len(some))), np.zeros((a + 1, b + 1, len(some)))
            ahead[0, 0] = behind[a, b] = 1.0
            cells = {(j, k): unit(j, k) for j, k in steps}
            for i in range(a):
                for j, k in steps:
                    ahead[i + 1, j + k] += ahead[i, j] * p[x[:, i], cells[j, k]]
            for i in range(a - 1, -1, -1):
                for j, k in steps:
                    behind[i, j] += p[x[:, i], cells[j, k]] * behind[i + 1, j + k]
            z = ahead[a, b]
            share = np.divide(1.0, z, out=np.zeros(len(some)), where=z > 0)
            weight = n[some]
            for i in range(a):
                for j, k in steps:
                    v = ahead[i, j] * p[x[:, i], cells[j, k]] * behind[i + 1, j + k] * share
                    out += np.bincount(x[:, i] * len(seen) + cells[j, k], np.where(v > 1e-12, v * weight, 0.0), len(out))
    return out.reshape(len(signs), len(seen))


def aligner_counts(s: str, t: str, table: dict[str, dict[str, float]], most: int) -> dict[tuple[str, str], float]:
    """Expected counts of (sign, letters) over all monotone alignments of one pair."""
    new, _ = aligner_sums([(s, t)], table, most)
    return {(sign, u): v for sign, c in new.items() for u, v in c.items()}


def learn_aligner(pairs: list[tuple[str, str]], rounds: int = 15, most: int = 2) -> dict[str, str]:
    """The likeliest letters of each sign."""
    signs = sorted({c for s, _ in pairs for c in s})
    seen = sorted({t[j : j + k] for _, t in pairs for k in range(1, most + 1) for j in range(len(t) - k + 1)} | {""})
    table = {s: {u: 1.0 / len(seen) / (4 if u == "" else 1) for u in seen} for s in signs}
    for _ in range(rounds):
        table, _ = aligner_step(pairs, table, most)
    return {s: max(sorted(u), key=lambda v: (u[v], -len(v))) for s, u in table.items()}


def product_model(counts: np.ndarray, classes: int = 1, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A mixture of products of row and column distributions, by EM from a fixed start. Returns weights, rows, columns and the log2 likelihood."""
    n, m = counts.shape
    rng = np.random.default_rng(0)
    weight, rows, columns = np.full(classes, 1 / classes), rng.dirichlet(np.ones(n), classes), rng.dirichlet(np.ones(m), classes)
    for _ in range(rounds):
        joint = weight[:, None, None] * rows[:, :, None] * columns[:, None, :]
        share = counts * joint / np.maximum(joint.sum(0), 1e-300)
        weight = share.sum((1, 2)) / counts.sum()
        rows = share.sum(2) / np.maximum(share.sum((1, 2))[:, None], 1e-300)
        columns = share.sum(1) / np.maximum(share.sum((1, 2))[:, None], 1e-300)
    joint = (weight[:, None, None] * rows[:, :, None] * columns[:, None, :]).sum(0)
    return weight, rows, columns, float((counts * np.log2(np.maximum(joint, 1e-300))).sum())


def bigram_costs(counts: dict[str, int]) -> np.ndarray:
    """Bits of a letter after another, with half a count added. counts: by two letters."""
    table = np.full((26, 26), 0.5)
    for g, n in counts.items():
        table[ord(g[0]) - 97, ord(g[1]) - 97] += n
    return -np.log2(table / table.sum(1, keepdims=True))


def cost_of(text: np.ndarray, key: np.ndarray, costs: np.ndarray) -> float:
    plain = key[text]
    return float(costs[plain[:-1], plain[1:]].sum())


def anneal(pairs: np.ndarray, costs: np.ndarray, seed: int, evaluations: int = 3000, hot: float = 20.0, cold: float = 0.2) -> tuple[float, np.ndarray]:
    """Search of a substitution key by exchanges, with a falling temperature; one restart. pairs: how often each two signs follow one another, so an evaluation costs 676 steps however long the text; temperatures are for 200 pairs and grow with them."""
    rng = np.random.default_rng(seed)
    scale = pairs.sum() / 200
    value = lambda k: float((pairs * costs[np.ix_(k, k)]).sum())
    key = rng.permutation(26)
    now = value(key)
    best, best_key = now, key.copy()
    for t in range(evaluations):
        i, j = rng.integers(0, 26, 2)
        key[[i, j]] = key[[j, i]]
        new = value(key)
        heat = scale * hot * (cold / hot) ** (t / evaluations)
        if new <= now or rng.random() < math.exp((now - new) / heat):
            now = new
            if now < best - 1e-9:
                best, best_key = now, key.copy()
        else:
            key[[i, j]] = key[[j, i]]
    return best, best_key


def beam_decode(text: Sequence[int], choices: dict[int, list[tuple[int, float]]], costs: np.ndarray, width: int = 20) -> tuple[float, list[int]]:
    """The cheapest reading of codes that stand for several letters each, kept to `width` beginnings: cost of the letters and of the choices."""
    beam: list[tuple[float, list[int]]] = [(0.0, [])]
    for code in text:
        new = [(c + w + (costs[p[-1], letter] if p else 0.0), [*p, letter]) for c, p in beam for letter, w in choices[code]]
        beam = sorted(new)[:width]
    return beam[0]


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Clusters of average linkage below a distance; numbered by first member."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, member, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    while alive.sum() > 1:
        i, j = divmod(int(d.argmin()), n)
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]
