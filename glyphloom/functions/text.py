"""Column functions over words and glyphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyphs written with several letters, longest first; every other letter is a glyph.
COMPOUNDS = ("cth", "ckh", "cph", "cfh", "ch", "sh")
GLYPH = "|".join((*COMPOUNDS, "."))
VOWELS = "aeiou"


def words(text: Column) -> Column:
    """Runs of a to z of the lower-cased text."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def glyphs(word: Column) -> Column:
    """Glyphs of a word, compounds first, from the left."""
    return F.regexp_extract_all(word, F.lit(GLYPH), F.lit(0))


def first_glyph(word: Column) -> Column:
    return F.get(glyphs(word), F.lit(0))


def last_glyph(word: Column) -> Column:
    return F.element_at(glyphs(word), -1)


def stem(word: Column) -> Column:
    """A word without its last glyph."""
    return F.substring(word, F.lit(1), F.length(word) - F.length(last_glyph(word)))


def stem_family(word: Column) -> Column:
    """A word without an initial q or o, with runs of e and of i written once."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^q?o?", ""), "e+", "e"), "i+", "i")


def cuts(word: Column) -> Column:
    """Places 1 to length - 1 where a word can be cut; empty for words of one letter."""
    return F.when(F.length(word) > 1, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))


def caesar(text: Column, shift: int) -> Column:
    """Letters a to z moved by shift."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, letters, letters[shift % 26 :] + letters[: shift % 26])


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by |: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_fold(key: Column, folds: int) -> Column:
    return F.floor(hash_uniform(key) * folds).cast("int")


def clamp_probability(p: Column, floor: float = 1e-12) -> Column:
    return F.greatest(p, F.lit(floor))
