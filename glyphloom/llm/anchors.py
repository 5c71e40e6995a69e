"""Places in byte strings that equal long substrings have in common.

Every window of WINDOW bytes has an anchor: the gram of GRAM bytes in it with the least hash, the leftmost of equals. Equal windows have equal anchors at equal places, so whoever looks for equal windows need only look among windows of the same anchor gram. Neighbouring windows mostly share their anchor; a run of them, with the bytes it covers, is a context.
"""

from __future__ import annotations

import functools

import numpy as np

from .common import FORGET

WINDOW, GRAM = 400, 128
#: Bits for a place in a buffer; buffers hold fewer bytes. Longer strings are cut into buffers that overlap by WINDOW - 1.
PLACE = 22
MOST = (1 << PLACE) - 1
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BACK = np.uint64(pow(int(ODD), -1, 1 << 64))
LETTERS = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)


@functools.lru_cache(2)
def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


FORGET.append(powers.cache_clear)


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on: differences of prefix sums of a polynomial, shifted back."""
    n = len(buffer) - GRAM + 1
    size = 1 << max(16, (len(buffer) - 1).bit_length())
    sums = LETTERS[buffer]
    sums *= powers(int(ODD), size)[: len(buffer)]
    np.cumsum(sums, out=sums)
    out = sums[GRAM - 1 :].copy()
    out[1:] -= sums[: n - 1]
    out *= powers(int(BACK), size)[:n]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i."""
    n = len(x)
    whole = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    whole[:n] = x
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of strings laid end to end in a buffer (ends: where each ends): the anchor's place, its gram's hash, and the first and last start of each run of windows that share it. Windows do not cross strings."""
    nothing = np.zeros(0, np.int64)
    if len(buffer) < WINDOW:
        return nothing, np.zeros(0, np.uint64), nothing, nothing
    hashes = gram_hashes(buffer)
    keys = hashes >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding_least(keys, WINDOW - GRAM + 1) & np.uint64(MOST)).astype(np.int64)
    ok = np.zeros(len(place) + 1, np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    fits = ends - starts >= WINDOW
    np.add.at(ok, starts[fits], 1)
    np.add.at(ok, ends[fits] - WINDOW + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = ok.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    last = ok.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~ok[1:]
    first, final = np.nonzero(new)[0], np.nonzero(last)[0]
    at = place[first]
    return at, hashes[at], first, final
