"""Pages as numpy arrays: the letters of a whole Arrow batch at once, random orders drawn in arrays, and MD5 of many short messages at once."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Messages hashed at once, about: few calls, and the arrays stay in the cache.
LANES = 1 << 14
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 4294967296.0)) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Arrow batches of whole texts stay small, whatever their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts and where each begins, with the end; nulls are empty."""
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: the bytes, the first and the last byte of each word (a run of a to z), and where each text's words begin, with the end."""
    data, at = spans(texts)
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = (data - np.uint8(97)) < 26
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a word does not go on in the next text
    begins = np.flatnonzero(letter[1:-1] & (~letter[:-2] | edge[:-1]))
    ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | edge[1:]))
    return data, begins, ends, np.searchsorted(begins, at)


def edge_letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's neighbouring words: the last letter of one and the first of the next (0 to 25), and where each text's pairs begin, with the end."""
    data, begins, ends, words = word_spans(texts)
    follows = np.ones(max(0, len(begins) - 1), bool)
    inner = words[(words > 0) & (words < len(begins))]
    follows[inner - 1] = False
    last, first = data[ends[:-1]][follows] - np.uint8(97), data[begins[1:]][follows] - np.uint8(97)
    pairs = np.concatenate([[0], np.cumsum(np.maximum(np.diff(words) - 1, 0))])
    return last, first, pairs


def orders(rng: np.random.Generator, letters: np.ndarray, k: int) -> np.ndarray:
    """k random orders of the letters (below 32), a row each: random numbers are sorted with the letters in their low bits; rows where two numbers are the same are drawn again."""
    kind = np.uint32 if len(letters) <= 2048 else np.uint64
    keys = rng.integers(0, np.iinfo(kind).max, (k, len(letters)), kind, endpoint=True)
    keys &= ~kind(31)
    keys |= letters.astype(kind)
    keys.sort(axis=1)
    again = ((keys[:, 1:] ^ keys[:, :-1]) < 32).any(axis=1)
    out = (keys & kind(31)).view(np.int32 if kind is np.uint32 else np.int64)
    if again.any():
        out[again] = orders(rng, letters, int(again.sum()))
    return out


def md5_words(m: list[np.ndarray | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The four words of the MD5 of n messages of one block each; m: its 16 words, None where all are zero."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, SINES[i], out=f)
        if m[g] is not None:
            np.add(f, m[g], out=f)
        s = SHIFTS[i // 16][i % 4]
        np.left_shift(f, np.uint32(s), out=t)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return tuple(x + np.uint32(s) for x, s in zip((a, b, c, d), START))  # type: ignore[return-value]


def md5(messages: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """messages: rows of 56 bytes, 0x80 behind the message of `lengths` bytes (55 at most), zeros behind that. Rows of two numbers that are in the order of the hexadecimal MD5: its first and its last eight bytes."""
    out = np.empty((len(messages), 2), np.uint64)
    for at in range(0, len(messages), LANES):
        rows, bits = messages[at : at + LANES], (lengths[at : at + LANES] * 8).astype(np.uint32)
        used = int(bits.max()) // 32 + 1
        block = np.ascontiguousarray(rows.view("<u4")[:, :used].T)
        words = md5_words([*block, *[None] * (14 - used), bits, None], len(rows))
        w = [x.byteswap().astype(np.uint64) for x in words]
        out[at : at + LANES, 0], out[at : at + LANES, 1] = w[0] << np.uint64(32) | w[1], w[2] << np.uint64(32) | w[3]
    return out


def decimals(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as rows of digits, from the left, and how many digits each has."""
    size = np.ones(len(numbers), np.int64)
    top = int(numbers.max(initial=0))
    width = len(str(top))
    for k in range(1, width):
        size += numbers >= 10**k
    digits = np.zeros((len(numbers), width), np.uint8)
    for k in range(1, width + 1):
        own = size >= k
        digits[own, (size - k)[own]] = 48 + numbers[own] // 10 ** (k - 1) % 10
    return digits, size


def numbered_messages(heads: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each head and each of the numbers, the head with the number in decimals behind it, as md5() takes it: heads first."""
    if numbers.min(initial=0) < 0:
        return packed([h + b"%d" % x for h in heads for x in numbers.tolist()])
    digits, size = decimals(numbers)
    out = np.zeros((len(heads), len(numbers), 56), np.uint8)
    length = np.empty((len(heads), len(numbers)), np.int64)
    sizes = [(s, np.flatnonzero(size == s)) for s in np.unique(size).tolist()]
    for r, head in enumerate(heads):
        h = len(head)
        if h + digits.shape[1] > 55:
            raise ValueError("a message is longer than 55 bytes")
        out[r, :, :h] = np.frombuffer(head, np.uint8)
        length[r] = h + size
        for s, own in sizes:
            own = slice(own[0], own[-1] + 1) if own[-1] - own[0] + 1 == len(own) else own
            out[r, own, h : h + s] = digits[own, :s]
            out[r, own, h + s] = 0x80
    return out.reshape(-1, 56), length.ravel()


def packed(messages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Messages as md5() takes them."""
    length = np.array([len(m) for m in messages], np.int64)
    if length.max(initial=0) > 55:
        raise ValueError("a message is longer than 55 bytes")
    return np.frombuffer(b"".join((m + b"\x80").ljust(56, b"\0") for m in messages), np.uint8).reshape(-1, 56), length


def headed(head: bytes, messages: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed messages with the same head before each."""
    h = len(head)
    if lengths.max(initial=0) + h > 55:
        raise ValueError("a message is longer than 55 bytes")
    out = np.empty_like(messages)
    out[:, :h] = np.frombuffer(head, np.uint8)
    out[:, h:] = messages[:, : 56 - h]
    return out, lengths + h


def in_hash_order(hashes: np.ndarray, letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """hashes: replicates x places x 2, of md5(). The letters (below 32) of each replicate in the order of its hashes, ties by place."""
    keys = hashes[:, :, 0] & ~np.uint64(31) | letters.astype(np.uint64)
    keys.sort(axis=1)
    tied = ((keys[:, 1:] ^ keys[:, :-1]) < 32).any(axis=1)  # the letter took the place of the lowest bits
    out = (keys & np.uint64(31)).astype(np.int64)
    for r in np.flatnonzero(tied):
        out[r] = letters[np.lexsort((place, hashes[r, :, 1], hashes[r, :, 0]))]
    return out


def gathered(items: Iterable[tuple], weight, least: int) -> Iterator[list[tuple]]:
    """The items in lists, each of which weighs `least` or more, but for the last."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += weight(x)
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held
