"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as smaller (S) or larger (L) than the next. Leftmost-smaller (LMS) substrings are sorted by one induction from buckets, named, and the string of their names is sorted in turn: by names of neighbouring names, twice as many at each level, until names are all different or reach DEPTH letters. A second induction from the sorted LMS suffixes gives the array. Induction goes bucket by bucket; what a bucket induces is dealt to later buckets by a stable sort of letters, so the work is linear and done in array operations.

The order is exact on the first DEPTH letters; suffixes that agree on so many stand together in any order. That is all that common prefixes of DEPTH and more need.
"""

from __future__ import annotations

import numpy as np

DEPTH = 400


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last letter, the only 0, counts as S."""
    edge = np.nonzero(t[1:] != t[:-1])[0]  # ends of runs of one letter
    lengths = np.diff(np.concatenate([[-1], edge, [len(t) - 1]]))
    kinds = np.concatenate([t[edge] < t[edge + 1], [True]])
    return np.repeat(kinds, lengths)


def deal(parts: list[list[np.ndarray]], items: np.ndarray, letters: np.ndarray) -> None:
    """Append items to the lists of their letters, in order."""
    order = np.argsort(letters, kind="stable")
    items, letters = items[order], letters[order]
    ends = np.nonzero(letters[1:] != letters[:-1])[0] + 1
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(items)]):
        parts[letters[a]].append(items[a:b])


def join(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def induce(t: np.ndarray, s: np.ndarray, lms: list[np.ndarray], sigma: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By letter: the L suffixes in order, and the S suffixes in falling order. lms: LMS suffixes by letter, in order."""
    large: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    small: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def pull(items: np.ndarray, kind: bool, own: int, into: list[list[np.ndarray]]) -> np.ndarray:
        """Deal the predecessors of that kind; return those that stay in the bucket."""
        before = items[items > 0] - 1
        before = before[s[before] == kind]
        if not len(before):
            return before
        letters = t[before]
        stay = letters == own
        if stay.any():
            go = ~stay
            if go.any():
                deal(into, before[go], letters[go])
            return before[stay]
        deal(into, before, letters)
        return before[:0]

    for c in range(sigma):
        now = join(large[c])
        got = [now]
        while len(now):
            now = pull(now, False, c, large)
            got.append(now)
        large[c] = [join(got)]
        if len(lms[c]):
            pull(lms[c], False, c, large)
    for c in range(sigma - 1, -1, -1):
        now = join(small[c])
        got = [now]
        while len(now):
            now = pull(now, True, c, small)
            got.append(now)
        small[c] = [join(got)]
        if len(large[c][0]):
            pull(large[c][0][::-1], True, c, small)
    small[0] = [np.array([len(t) - 1], np.int32)]
    return [x[0] for x in large], [x[0] for x in small]


def by_letter(t: np.ndarray, items: np.ndarray, sigma: int) -> list[np.ndarray]:
    """Items in their order, by letter."""
    letters = t[items]
    order = np.argsort(letters, kind="stable")
    cuts = np.searchsorted(letters[order], np.arange(sigma + 1))
    return [items[order[a:b]] for a, b in zip(cuts, cuts[1:])]


def names_of(t: np.ndarray, sorted_lms: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ascending numbers for sorted LMS substrings; equal ones (on DEPTH letters) get equal numbers. length: with both ends."""
    a, b = sorted_lms[:-1].astype(np.int64), sorted_lms[1:].astype(np.int64)
    same = length[:-1] == length[1:]
    todo = np.nonzero(same)[0]
    k = 0
    while len(todo) and k < DEPTH:
        todo = todo[length[todo] > k]
        unlike = t[a[todo] + k] != t[b[todo] + k]
        same[todo[unlike]] = False
        todo = todo[~unlike]
        k += 1
    return np.concatenate([[0], np.cumsum(~same)])


def sort_names(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names. at: where each name's substring begins."""
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    while not ((ordered[1:] != ordered[:-1]).all() or reach >= n or (at[reach:] - at[:-reach]).min() >= DEPTH):
        key = names * np.int64(n + 1)
        key[:-reach] += names[reach:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        names = np.empty(n, np.int64)
        names[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        reach *= 2
    return order


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """t: letters below sigma; the last is 0 and no other is."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    s = smaller(t)
    lms = np.nonzero(s[1:] & ~s[:-1])[0].astype(np.int32) + 1
    ends = np.append(lms[1:], lms[-1])
    _, small = induce(t, s, by_letter(t, lms, sigma), sigma)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    rising = np.concatenate([x[::-1] for x in small])
    rising = rising[is_lms[rising]]
    number = np.zeros(len(t), np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    length = (ends - lms + 1)[number[rising]]
    names = np.empty(len(lms), np.int64)
    names[number[rising]] = names_of(t, rising, length)
    order = sort_names(names, lms.astype(np.int64))
    large, small = induce(t, s, by_letter(t, lms[order], sigma), sigma)
    return np.concatenate([x for c in range(sigma) for x in (large[c], small[c][::-1])])


def long_prefixes(raw: np.ndarray, order: np.ndarray, valid: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places, of the valid ones, whose first `depth` letters begin at another valid place too.

    Common prefixes are computed in the order of the text (permuted): where the neighbour in the suffix array moves on with the place, the common prefix is one less than that of the place before, so only the head of such a run is compared, eight letters at a time, and again behind each letter that differs. Letters from a valid place on must be valid for `depth` letters.
    """
    order = order[valid[order]]
    repeated = np.zeros(len(raw), bool)
    if len(order) < 2:
        return repeated
    near = np.full(len(raw), -1, np.int64)
    near[order[1:]] = order[:-1]
    at = np.nonzero(near >= 0)[0]
    to = near[at]
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1] + 1)
    first = np.nonzero(head)[0]
    run = np.diff(np.append(first, len(at)))
    words = np.concatenate([raw, np.zeros(16, np.uint8)])
    words = np.ndarray((len(raw) + 8,), "<u8", words.tobytes(), 0, (1,))
    plcp = np.empty(len(at), np.int64)
    while len(first):  # heads; behind a letter that differs, a run has a new one
        most = run - 1 + depth
        common = most.copy()
        todo, k = np.arange(len(first)), 0
        while len(todo):
            unlike = words[at[first[todo]] + k] ^ words[to[first[todo]] + k]
            hit = unlike != 0
            if hit.any():
                x = unlike[hit]
                bit = np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int64)
                common[todo[hit]] = np.minimum(most[todo[hit]], k + bit // 8)
                todo = todo[~hit]
            k += 8
            todo = todo[most[todo] > k]
        done = np.minimum(run, common + 1)
        step = np.arange(done.sum()) - np.repeat(np.cumsum(done) - done, done)
        plcp[np.repeat(first, done) + step] = np.repeat(common, done) - step
        left = run > done
        first, run = (first + done)[left], (run - done)[left]
    good = plcp >= depth
    repeated[at[good]] = True
    repeated[to[good]] = True
    return repeated


def repeated_windows(texts: list[bytes], depth: int = DEPTH) -> list[np.ndarray]:
    """For each text, the starts of its windows of `depth` bytes that start elsewhere in these texts too."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    t = np.empty(len(raw) + 1, np.uint16)
    t[:-1] = raw
    t[:-1] += 2
    t[ends] = 1
    t[-1] = 0
    used = np.zeros(258, bool)
    used[t] = True
    dense = (np.cumsum(used) - 1).astype(np.uint16)
    order = suffix_array(dense[t], int(used.sum()))
    valid = np.zeros(len(raw) + 1, np.int32)
    enough = ends - starts >= depth
    np.add.at(valid, starts[enough], 1)
    np.add.at(valid, ends[enough] - depth + 1, -1)
    valid = np.cumsum(valid) > 0
    found = np.nonzero(long_prefixes(raw, order, valid, depth))[0]
    cuts = np.searchsorted(found, starts)
    return [found[a:b] - s for a, b, s in zip(cuts, [*cuts[1:], len(found)], starts)]
