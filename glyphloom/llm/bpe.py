"""Byte-pair encoding with a contiguous rank array, and decoding.

A word is held as two contiguous arrays: the ids of its parts (part i reaches from boundary i to boundary i + 1) and the ranks of the merges of neighbouring parts. The least rank is looked for by a scan, its boundary is deleted, and the two neighbouring ranks are looked up anew. Words are short, so the scan beats any queue; words of more than SHORT parts, where scans would cost their square, use a heap over a linked list with the same order of merges.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; special tokens in a text become their ids, as the vocabulary file says.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col, give_back, kept, schema_of, small_batches

#: From so many parts on, a heap replaces the scan.
SHORT = 200
#: Words kept ready in a worker; longer ones than KEEP_CHARS are not kept.
KEEP, KEEP_CHARS = 300_000, 48
#: Unicode's white space, by which words are parted.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Bits of an id, and the value of no merge.
SHIFT, NONE = 20, 1 << 60
LOW = (1 << SHIFT) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def pair(a: int, b: int) -> int:
    """One number for two neighbouring ids."""
    return a << SHIFT | b


def merge(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the parts of one word by ascending rank, leftmost first. merges: from pair(a, b) to rank << SHIFT | new id, so that ranks are compared and the new id is at hand."""
    if len(ids) > SHORT:
        return merge_long(ids, merges)
    get = merges.get
    ranks = [get(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:])]
    while ranks and (least := min(ranks)) != NONE:
        i = ranks.index(least)
        ids[i] = new = least & LOW
        del ids[i + 1], ranks[i]  # the boundary between them goes
        if i:
            ranks[i - 1] = get(ids[i - 1] << SHIFT | new, NONE)
        if i < len(ranks):
            ranks[i] = get(new << SHIFT | ids[i + 1], NONE)
    return ids


def merge_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    n = len(ids)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    queue = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get(pair(ids[i], ids[i + 1]), NONE)) != NONE]
    heapq.heapify(queue)
    while queue:
        m, i, a, b = heapq.heappop(queue)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of them has gone into another part
        ids[i], ids[j] = m & LOW, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (m := merges.get(pair(ids[left], ids[after[left]]), NONE)) != NONE:
                heapq.heappush(queue, (m, left, ids[left], ids[after[left]]))
    return [x for x in ids if x >= 0]


class WordBpe:
    """A vocabulary of words with an end mark, lower case, white space dropped: encodes texts and decodes ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merges = {pair(vocab[a], vocab[b]): rank << SHIFT | vocab[a + b] for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"])}
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.apart = re.compile(f"[{SPACE}]+")
        self.known: dict[str, tuple[str, int, str]] = {}
        self.known_words: dict[str, list[int]] = {}

    def parts(self, chunk: str) -> list[str]:
        """Words and special tokens of a text without white space."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha() and not chunk[-1].isalnum():
                return [chunk[:-1].lower(), chunk[-1]]
        out = []
        for part in self.parts_at.split(chunk) if self.parts_at else [chunk]:
            if part in self.special:
                out.append(part)
                continue
            part = unicodedata.normalize("NFC", part)
            out += self.words.findall("".join(map(str.lower, part)) if "Σ" in part else part.lower())  # no final sigma
        return out

    def of_word(self, word: str) -> tuple[list[int], str, str]:
        """Ids of a word or special token, in decimal, and decoded."""
        if (x := self.known_words.get(word)) is None:
            if word in self.special:
                ids = [self.special[word]]
            else:
                inner, raw = self.inner, word.encode()
                ids = [inner[b] for b in raw]
                ids[-1] = self.last[raw[-1]]
                ids = merge(ids, self.merges)
            x = ids, " ".join(map(str, ids)), self.decode(ids)
            if len(word) <= KEEP_CHARS:
                if len(self.known_words) >= KEEP:
                    self.known_words.clear()
                self.known_words[word] = x
        return x

    def chunks(self, text: str) -> list[str]:
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text  # white space to str.split alone
        return [x for x in self.apart.split(text) if x] if odd else text.split()

    def encode(self, text: str | None) -> list[int]:
        return [i for chunk in self.chunks(text or "") for word in self.parts(chunk) for i in self.of_word(word)[0]]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: its tokens, joined by one blank."""
        return " ".join([self.token[i] for i in ids])

    def of_chunk(self, chunk: str) -> tuple[str, str]:
        words = [self.of_word(w) for w in self.parts(chunk)]
        return " ".join([w[1] for w in words]), " ".join([w[2] for w in words])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text; repeated words are encoded and decoded once."""
        known, found = self.known, []
        for chunk in self.chunks(text or ""):
            if (x := known.get(chunk)) is None:
                x = self.of_chunk(chunk)
                if len(chunk) <= KEEP_CHARS:
                    if len(known) >= KEEP:
                        known.clear()
                    known[chunk] = x
            if x[0]:
                found.append(x)
        ids, back = " ".join([x[0] for x in found]).encode(), " ".join([x[1] for x in found]).encode()
        return ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>) and decoded (string) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(WordBpe, path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["k", "ids", "decoded"])
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(col(key).alias("k"), col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, schema_of(rows, "k", ids=T.ArrayType(T.IntegerType()), decoded=T.StringType())).withColumnRenamed("k", key)


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every text, as encode_texts would give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(WordBpe, path)
        for b in batches:
            n, ids, back = zip(*(bpe.digest(t) for t in b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(col(key).alias("k"), col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, schema_of(rows, "k", n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType())).withColumnRenamed("k", key)
