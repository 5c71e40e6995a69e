"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns words into classes (insult, threat, target, negation, report, quotation mark, end of clause, other). Three more pass the classes on and mark what they have seen: one whether a negation stands just before, one whether the clause is reported speech or a quotation, one whether a target stands near. Their composition is computed once, as a table over the product of their states; running it over a clause gives matches, each an insult or a threat that is negated or not, reported or not, aimed or not. A text's score is a logistic function of how many matches of each kind it has.

Insults are learned: words and stems (beginnings of words with several endings) that labelled toxic texts have and others have not. Weights are learned as well. Both come from a bounded sample of labelled rows; equal texts count once there.

Defined results: null and empty texts have no matches and get the score of texts without any; equal texts get equal scores; without labelled rows of both kinds the prior weights stay.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, lean, sample_of, schema_of, settle, small_batches

#: Labelled rows learned from, at most: those with the least hash of their key. Entries of the lexicon, at most.
FIT_ROWS, LEXICON = 20_000, 1000
#: A term must be in this share of the families of toxic texts and in so many of them at least; texts that aren't toxic may have it so often for each toxic one; stems have so many letters and endings.
SHARE, LEAST, STRAY, STEMS, ENDINGS = 0.02, 4, 0.02, (4, 7), 3
#: Texts whose word sets are at least so similar are near copies, one family; similarity is the share of equal least hashes among so many, looked at where a band of so many is equal.
ALIKE, HASHES, BAND = 0.7, 128, 4
#: Words over which a negation and a target reach.
REACH_NOT, REACH_AIM = 3, 4
SCORE_AT = 0.3

# Function words of the grammar in English, German, French and Spanish.
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
NEGATIONS = "not no never nor neither isn't aren't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún tampoco".split()
REPORTS = "said says say told wrote writes quoted claimed called sagte sagt schrieb zitiert dit disait écrit cité dijo dice escribió citó".split()
THREATS = "kill murder hurt destroy töten umbringen vernichten tuer détruire frapper matar destruir golpear".split()

OTHER, INSULT, THREAT, TARGET, NOT, REPORT, QUOTE, END = range(8)
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.,;:!?\n\"“”„«»]")
CLOSING, QUOTES = frozenset(".,;:!?\n"), frozenset('"“”„«»')
KEEP = 300_000


@dataclass(frozen=True)
class Transducer:
    """start; step(state, class) -> (state, mark): the mark is laid on an insult or threat that is read."""

    start: tuple
    step: object


def negation() -> Transducer:
    def step(state: tuple, c: int) -> tuple[tuple, int]:
        (left,) = state
        if c == NOT:
            return (REACH_NOT,), 0
        if c == END:
            return (0,), 0
        return (max(0, left - 1),), int(left > 0)

    return Transducer((0,), step)


def reported() -> Transducer:
    def step(state: tuple, c: int) -> tuple[tuple, int]:
        said, quoted = state
        if c == REPORT:
            return (1, quoted), 0
        if c == QUOTE:
            return (said, 1 - quoted), 0
        if c == END:
            return (0, quoted), 0
        return state, int(said or quoted)

    return Transducer((0, 0), step)


def aimed() -> Transducer:
    def step(state: tuple, c: int) -> tuple[tuple, int]:
        (left,) = state
        if c == TARGET:
            return (REACH_AIM,), 0
        if c == END:
            return (0,), 0
        return (max(0, left - 1),), int(left > 0)

    return Transducer((0,), step)


def compose(*parts: Transducer) -> list[list[tuple[int, int]]]:
    """The product of transducers that read the same classes: table[state][class] = (state, output); output 0 for none, else 1 + the number of the match kind. State 0 is the start."""
    start = tuple(p.start for p in parts)
    number, table, todo = {start: 0}, [], [start]
    while len(table) < len(todo):
        state, row = todo[len(table)], []
        for c in range(8):
            steps = [p.step(s, c) for p, s in zip(parts, state)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            kind = sum(m << i for i, (_, m) in enumerate(steps))
            row.append((number[after], 1 + kind + ((c == THREAT) << len(parts)) if c in (INSULT, THREAT) else 0))
        table.append(row)
    return table


GRAMMAR = compose(negation(), reported(), aimed())
#: Kinds of matches: bits negated, reported, aimed, threat.
KINDS = 16


@dataclass
class Lexicon:
    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    known: dict[str, int] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "known": {}}

    def of_word(self, word: str) -> int:
        if word in self.words or any(word[:k] in self.stems for k in range(STEMS[0], min(STEMS[1], len(word)) + 1)):
            return INSULT
        return FIXED.get(word, OTHER)

    def of_chunk(self, chunk: str) -> int:
        """1 if what stands between blanks holds an insult or a threat."""
        hit = int(any(self.of_word(w) in (INSULT, THREAT) for w in TOKEN.findall(chunk.lower())))
        if len(chunk) <= 48:
            if len(self.known) >= KEEP:
                self.known.clear()
            self.known[chunk] = hit
        return hit

    def matches(self, text: str | None) -> list[int]:
        """How many matches of each kind a text has."""
        counts, known = [0] * KINDS, self.known
        for chunk in (text or "").split():
            hit = known.get(chunk)
            if self.of_chunk(chunk) if hit is None else hit:
                break
        else:
            return counts
        state = 0
        for token in TOKEN.findall(text.lower()):
            c = END if token in CLOSING else QUOTE if token in QUOTES else self.of_word(token)
            state, out = GRAMMAR[state][c]
            if out:
                counts[out - 1] += 1
        return counts


FIXED = dict(itertools.chain(zip(TARGETS, itertools.repeat(TARGET)), zip(NEGATIONS, itertools.repeat(NOT)), zip(REPORTS, itertools.repeat(REPORT)), zip(THREATS, itertools.repeat(THREAT))))


@dataclass
class Model:
    """Log-odds of a text: bias + sum of weights times log(1 + matches of the kind)."""

    lexicon: Lexicon
    bias: float = -3.0
    weights: tuple[float, ...] = tuple(1.0 if k & 3 else 2.5 for k in range(KINDS))

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + np.log1p(counts) @ np.array(self.weights))))


def words_of(text: str | None) -> set[str]:
    return {w for w in TOKEN.findall((text or "").lower()) if len(w) > 2}


def turns() -> np.ndarray:
    return np.random.default_rng(HASHES).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(words: set[str], odd: np.ndarray) -> np.ndarray:
    """The least of each hash over the words."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    x = h[:, None] * odd
    x = (x ^ (x >> np.uint64(32))) * odd[::-1]
    return (x ^ (x >> np.uint64(29))).min(0) if len(h) else np.zeros(HASHES, np.uint64)


def families(sketches: np.ndarray) -> np.ndarray:
    """The family of each text, by its first one: near copies, and what is linked by near copies."""
    root = list(range(len(sketches)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, HASHES, BAND):
        met: dict[bytes, list[int]] = {}
        for i, x in enumerate(sketches):
            apart = met.setdefault(x[at : at + BAND].tobytes(), [])
            near = [apart[k] for k in np.nonzero((sketches[apart] == x).mean(1) >= ALIKE)[0]] if apart else []
            for j in near:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if not near:
                apart.append(i)
    return np.array([find(i) for i in range(len(root))], np.int64)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """sample: text, toxic (1 or 0). Near copies count once, for a word and for the share it must reach."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = turns()
        for b in batches:
            texts = b.column(0).to_pylist()
            keys = [xxhash.xxh3_64_intdigest(t or "") >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(1), pa.array([sketch(words_of(t), odd).tobytes() for t in texts], pa.binary())], ["key", "toxic", "sketch"])

    drawn = sample.select("text", F.col("toxic").cast("long")).mapInArrow(lean(draw), "key long, toxic long, sketch binary").orderBy("key", "toxic").collect()  # FIT_ROWS at most
    of_row = families(np.frombuffer(b"".join(r["sketch"] for r in drawn), np.uint64).reshape(-1, HASHES))
    family_of = {r["key"]: int(f) for r, f in zip(drawn, of_row)}
    n = len({int(f) for r, f in zip(drawn, of_row) if r["toxic"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = list(words_of(text))
                family = family_of[xxhash.xxh3_64_intdigest(text or "") >> 1]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.int64()), pa.array([family] * len(words), pa.int64())], ["word", "toxic", "family"])

    least = max(LEAST, SHARE * n)
    words = sample.select("text", F.col("toxic").cast("long")).mapInArrow(lean(run), "word string, toxic long, family long").groupBy("word", "family").agg(F.max("toxic").alias("bad"), (1 - F.min("toxic")).alias("good")).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    some = words.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1])), lambda k: F.when(k <= F.length("word"), F.substring("word", F.lit(1), k))))).where("stem is not null")
    stems = some.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum(F.expr("if(bad > 0, 1, 0)")).alias("endings"))
    firm = f"bad >= {least} and good <= {STRAY} * bad"
    found = stems.where(f"{firm} and endings >= {ENDINGS}").select(F.col("stem").alias("term"), F.lit(True).alias("is_stem"), "bad").unionByName(words.where(firm).select(F.col("word").alias("term"), F.lit(False).alias("is_stem"), "bad"))
    terms = found.orderBy(F.desc("bad"), "term").limit(LEXICON).collect()
    chosen: set[str] = set()
    for s in sorted((r["term"] for r in terms if r["is_stem"]), key=len):
        if not any(s[:k] in chosen for k in range(STEMS[0], len(s))):
            chosen.add(s)
    return Lexicon(frozenset(r["term"] for r in terms if not r["is_stem"] and not any(r["term"][:k] in chosen for k in range(STEMS[0], len(r["term"]) + 1))), frozenset(chosen))


def learn_weights(lexicon: Lexicon, counts: np.ndarray, toxic: np.ndarray) -> Model:
    """Logistic regression towards the prior weights, by Newton's steps; weights stay at 0 or above, so that no match makes a text less toxic."""
    model = Model(lexicon)
    if not (0 < toxic.sum() < len(toxic)):
        return model
    x = np.column_stack([np.ones(len(counts)), np.log1p(counts)])
    prior = np.array([model.bias, *model.weights])
    keep = np.diag([0.01] + [1.0] * KINDS)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (toxic - p) - keep @ (w - prior))
        w = w + step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-9:
            break
    return Model(lexicon, float(w[0]), tuple(map(float, w[1:])))


def count_matches(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """keep and matches (array<int> by kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lexicon.matches(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.list_(pa.int32()))], [*b.schema.names[1:], "matches"])

    small_batches(docs.sparkSession)
    rows = docs.select(col(text).cast("string").alias("__text"), *map(col, keep))
    return rows.mapInArrow(lean(run), schema_of(rows, *keep, matches=T.ArrayType(T.IntegerType())))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Held-out rows are not looked at."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    chosen = sample_of(own.select("doc_id", "toxic"), rows, "doc_id", "toxic")
    joined = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = joined.groupBy("doc_id").agg(F.max(F.struct("toxic", "text")).alias("x")).select("doc_id", "x.*")  # where an id repeats
    kept = settle(once.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")))
    lexicon = learn_lexicon(kept.select("text", "toxic"))
    found = count_matches(kept, lexicon, ["doc_id", "toxic"]).orderBy("doc_id").collect()
    if not found:
        return Model(lexicon)
    return learn_weights(lexicon, np.array([r["matches"] for r in found], float), np.array([r["toxic"] for r in found], float))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", at: float = SCORE_AT) -> DataFrame:
    """keep, score, predicted and n_matches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([model.lexicon.matches(t) for t in b.column(0).to_pylist()], float).reshape(-1, KINDS)
            s = model.score(found)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s, pa.float64()), pa.array((s >= at).astype(np.int32)), pa.array(found.sum(1).astype(np.int64))], [*b.schema.names[1:], "score", "predicted", "n_matches"])

    small_batches(docs.sparkSession)
    rows = docs.select(col(text).cast("string").alias("__text"), *map(col, keep))
    return rows.mapInArrow(lean(run), schema_of(rows, *keep, score=T.DoubleType(), predicted=T.IntegerType(), n_matches=T.LongType()))


def score_column(model: Model, text):
    """The score as a column, for rows whose other columns stay where they are."""
    import pandas as pd

    def of(texts):
        return pd.Series(model.score(np.array([model.lexicon.matches(t) for t in texts], float).reshape(-1, KINDS)))

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "double")(text.cast("string"))
