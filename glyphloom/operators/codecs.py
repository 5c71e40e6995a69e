"""Reversible codes of text, as Column expressions; where a code chooses, a hash of the place chooses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def substitution_key(seed: str) -> str:
    """A permutation of the letters, by the MD5 of seed and letter."""
    import hashlib

    return "".join(sorted(LETTERS, key=lambda c: (hashlib.md5(f"{seed}|{c}".encode()).hexdigest(), c)))


def substitute(text: Column, key: str) -> Column:
    return F.translate(text, LETTERS, key)


def restore(text: Column, key: str) -> Column:
    return F.translate(text, key, LETTERS)


def homophones(tok: DataFrame, choices: int = 3) -> DataFrame:
    """doc_id, pos, i, code: each letter as itself and a digit below `choices` that the place's hash picks."""
    letters = tok.select("doc_id", "pos", F.posexplode(F.split("w", "")).alias("i", "c")).where("c <> ''")
    digit = F.floor(T.hash_uniform(F.col("doc_id"), F.col("pos"), F.col("i")) * choices).cast("int")
    return letters.select("doc_id", "pos", "i", F.concat("c", digit.cast("string")).alias("code"))


def nomenclator(tok: DataFrame, words: DataFrame) -> DataFrame:
    """Words of the list (w, code) become their codes, others their letters with a mark."""
    return tok.join(F.broadcast(words), "w", "left").select(*[c for c in tok.columns if c != "w"], F.coalesce("code", F.concat(F.lit("."), F.col("w"))).alias("code"))


def page_tables(tok: DataFrame, tables: int = 3) -> DataFrame:
    """Coupled tables: a page's state is the running sum of its lines' choices, modulo their number; letters move by the state."""
    line = F.floor(F.col("pos") / 10)
    choice = F.floor(T.hash_uniform(F.col("doc_id"), F.col("line")) * tables).cast("int")
    rows = tok.withColumn("line", line.cast("long")).withColumn("first", (F.col("pos") % 10 == 0).cast("int"))
    state = F.sum(F.col("first") * choice).over(Window.partitionBy("doc_id").orderBy("pos")) % tables
    moved = F.when(state == 0, F.col("w"))
    rows = rows.withColumn("state", state.cast("int"))
    for k in range(1, tables):
        moved = F.when(F.col("state") == k, T.caesar(F.col("w"), k)) if k == 1 else moved.when(F.col("state") == k, T.caesar(F.col("w"), k))
    return rows.select("doc_id", "pos", "w", "state", moved.otherwise(F.col("w")).alias("code"))


def phases(tok: DataFrame, period: int = 3) -> DataFrame:
    """A clock of lines of ten words, set back at each page."""
    return tok.withColumn("phase", (F.floor(F.col("pos") / 10) % period).cast("int"))


def contract(word: Column) -> Column:
    """Abbreviations: the first of these that fits, a beginning or an end, gives way to a sign."""
    # Beginnings, ends and their signs.
    rules = (("con", "", "9"), ("per", "", "p"), ("", "rum", "4"), ("", "que", "3"), ("", "us", "9"))
    out = None
    for begin, end, sign in rules:
        fits = word.startswith(begin) & (F.length(word) > len(begin)) if begin else word.endswith(end) & (F.length(word) > len(end))
        to = F.concat(F.lit(sign), F.substring(word, F.lit(len(begin) + 1), F.length(word))) if begin else F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(sign))
        out = F.when(fits, to) if out is None else out.when(fits, to)
    return out.otherwise(word)


def trie_decode(text: str, codes: dict[str, str]) -> list[str]:
    """The units of a text in a prefix-free code."""
    out, at = [], 0
    while at < len(text):
        end = next((e for e in range(at + 1, len(text) + 1) if text[at:e] in codes), None)
        if end is None:
            raise ValueError(f"no code at {at}")
        out.append(codes[text[at:end]])
        at = end
    return out


def readings(text: str, codes: dict[str, list[str]], most: int = 10_000) -> list[str]:
    """All readings of a text in a code that may be ambiguous."""
    done: dict[int, list[str]] = {len(text): [""]}
    for at in range(len(text) - 1, -1, -1):
        done[at] = [u + rest for c, us in codes.items() if text.startswith(c, at) for u in us for rest in done[at + len(c)]][:most]
    return done[0]
