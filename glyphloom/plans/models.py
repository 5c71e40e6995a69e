"""Codecs, sources, streams, sequence models and search as queries."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import codecs as C
from ..operators import sequences as S
from ..operators import views as V
from ..sources import markup
from ..sources.sinks import shared_folder
from ..streaming import events as E
from .profiles import toks
from .registry import TOK, UNIFORM, query

KEY = C.substitution_key("key")


@query(f"SELECT item_id, translate(lower(text), '{C.LETTERS}', '{KEY}') AS cipher, lower(text) AS plain FROM benchmark")
def substitution_roundtrip(spark, d):
    b = V.read(spark, d, "benchmark").select("item_id", C.substitute(F.lower("text"), KEY).alias("cipher"))
    return b.select("item_id", "cipher", C.restore(F.col("cipher"), KEY).alias("plain"))


@query(f"""WITH {TOK}, l AS (SELECT doc_id, pos, CAST(i AS INTEGER) - 1 AS i, substr(w, CAST(i AS INTEGER), 1) AS c FROM (SELECT doc_id, pos, w, unnest(range(1, length(w) + 1)) AS i FROM tok)), k AS (SELECT c || CAST(CAST(floor({UNIFORM.format("concat_ws('|', doc_id, pos, i)")} * 3) AS INTEGER) AS VARCHAR) AS code FROM l) SELECT code, count(*) AS n FROM k GROUP BY code""")
def homophone_counts(spark, d):
    return C.homophones(toks(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, f AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM (SELECT w, count(*) AS n FROM tok GROUP BY w) ORDER BY n DESC, w LIMIT 50), c AS (SELECT coalesce('N' || CAST(f.r AS VARCHAR), '.' || tok.w) AS code FROM tok LEFT JOIN f ON f.w = tok.w) SELECT code, count(*) AS n FROM c GROUP BY code""")
def nomenclator_counts(spark, d):
    tok = toks(spark, d)
    top = V.types(tok).orderBy(F.desc("n"), "w").limit(50)  # a list of fifty
    rows = spark.createDataFrame([(r["w"], f"N{i}") for i, r in enumerate(top.collect(), 1)] or [], "w string, code string")
    return C.nomenclator(tok, rows).groupBy("code").agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, l AS (SELECT doc_id, pos, w, CASE WHEN pos % 10 = 0 THEN CAST(floor({UNIFORM.format("concat_ws('|', doc_id, pos // 10)")} * 3) AS INTEGER) ELSE 0 END AS c FROM tok), s AS (SELECT doc_id, pos, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY pos) % 3 AS INTEGER) AS state FROM l) SELECT state, count(*) AS n FROM s GROUP BY state""")
def coupled_page_states(spark, d):
    return C.page_tables(toks(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w), c AS (SELECT n, CASE WHEN starts_with(w, 'con') AND length(w) > 3 THEN '9' || substr(w, 4) WHEN starts_with(w, 'per') AND length(w) > 3 THEN 'p' || substr(w, 4) WHEN ends_with(w, 'rum') AND length(w) > 3 THEN substr(w, 1, length(w) - 3) || '4' WHEN ends_with(w, 'que') AND length(w) > 3 THEN substr(w, 1, length(w) - 3) || '3' WHEN ends_with(w, 'us') AND length(w) > 2 THEN substr(w, 1, length(w) - 2) || '9' ELSE w END AS code FROM ty) SELECT code, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY code""")
def abbreviation_counts(spark, d):
    return V.types(toks(spark, d)).groupBy(C.contract(F.col("w")).alias("code")).agg(F.sum("n").alias("n"))


@query(f"""WITH {TOK} SELECT CAST((pos // 10) % 3 AS INTEGER) AS phase, left(w, 1) AS initial, count(*) AS n FROM tok GROUP BY ALL""")
def line_clock_phases(spark, d):
    return C.phases(toks(spark, d)).groupBy("phase", F.expr("left(w, 1)").alias("initial")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, d):
    out = E.run_to_end(E.tumbling(E.event_stream(spark, f"{d}/events.parquet")), shared_folder(spark), "start", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT date_trunc('hour', ts) - h * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM events, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS h) GROUP BY ALL")
def stream_sliding_counts(spark, d):
    out = E.run_to_end(E.sliding(E.event_stream(spark, f"{d}/events.parquet")), shared_folder(spark), "start", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    e = V.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


SHIFTS = """fl AS (SELECT substr(w, i, 1) AS c, sum(n) AS n FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM (SELECT w, count(*) AS n FROM tok GROUP BY w)) GROUP BY 1), cost AS (SELECT c, -log2(n / CAST((SELECT sum(n) FROM fl) AS DOUBLE)) AS bits FROM fl),
bl AS (SELECT substr(t, i, 1) AS c, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM benchmark)) GROUP BY 1),
att AS (SELECT s, sum(bl.n * coalesce(cost.bits, 30)) AS loss FROM bl CROSS JOIN (SELECT CAST(unnest(range(26)) AS INTEGER) AS s) LEFT JOIN cost ON cost.c = chr(97 + (ascii(bl.c) - 97 + s) % 26) GROUP BY s)"""


class Shifts:
    """Proposes the shifts 0 to 25 in order."""

    def __init__(self) -> None:
        self.next = 0

    def propose(self, n: int) -> list[str]:
        first, self.next = self.next, min(26, self.next + n)
        return [str(k) for k in range(first, self.next)]

    def observe(self, losses: list[tuple[str, float]]) -> None:
        pass

    def snapshot(self) -> dict:
        return {"next": self.next}

    def restore(self, snapshot: dict) -> None:
        self.next = snapshot["next"]


def shift_losses(spark, d):
    """Candidates' losses: bits of all passages' letters, moved by the shift, under the documents' letter frequencies."""
    ty = V.types(toks(spark, d))
    fl = ty.select("n", F.explode(F.split("w", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    cost = fl.crossJoin(fl.agg(F.sum("n").cast("double").alias("total"))).select("c", (-F.log2(F.col("n") / F.col("total"))).alias("bits"))  # one row
    letters = V.read(spark, d, "benchmark").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "")).alias("b")).where("b <> ''").groupBy("b").agg(F.count("*").alias("n"))

    def evaluate(rows):
        moved = rows.crossJoin(F.broadcast(letters)).withColumn("c", F.char(97 + (F.ascii("b") - 97 + F.col("candidate_id").cast("int")) % 26))  # 26 letters
        return moved.join(F.broadcast(cost), "c", "left").groupBy("sequence", "candidate_id").agg(F.sum(F.col("n") * F.coalesce("bits", F.lit(30.0))).alias("loss"))

    return evaluate


def searched(spark, d) -> E.Registry:
    """A registry with one search over shifts, left off after two batches and taken up again."""
    registry = E.Registry(spark, f"{shared_folder(spark)}/lab-{uuid.uuid4().hex}")
    run = registry.register("shift", {"alphabet": C.LETTERS})
    evaluate = shift_losses(spark, d)
    E.run_search(registry, run, Shifts(), evaluate, 100, batch=7, pause_after=2)
    E.run_search(registry, run, Shifts(), evaluate, 100, batch=7)
    return registry


@query(f"WITH {TOK}, {SHIFTS} SELECT CAST(s AS BIGINT) AS sequence, CAST(s // 7 AS BIGINT) AS batch, CAST(s AS VARCHAR) AS candidate_id, round(loss, 4) AS loss FROM att")
def runner_attempts(spark, d):
    """The attempts of a search that was left off and taken up again: as of one that never stopped."""
    return searched(spark, d).attempts().select("sequence", "batch", "candidate_id", F.round("loss", 4).alias("loss"))


@query(f"WITH {TOK}, {SHIFTS} SELECT CAST(s AS VARCHAR) AS candidate_id, round(loss, 4) AS loss FROM att ORDER BY att.loss, candidate_id LIMIT 5")
def runner_retained(spark, d):
    return E.retained(searched(spark, d).attempts(), 5, 4).where("kept = 'top'").select("candidate_id", F.round("loss", 4).alias("loss"))


@query("SELECT 'shift' AS family, 4 AS batches, 'exhausted' AS stop_reason, count(*) AS shifts FROM (SELECT unnest(range(26)) FROM region WHERE r_regionkey = 0)")
def runner_states(spark, d):
    """How the search ended, by the registry's runs, specifications, states and attempts."""
    r = searched(spark, d)
    last = r.states().groupBy("run_id").agg(F.max_by("stop_reason", "at").alias("stop_reason"))
    own = r.attempts().groupBy("run_id").agg(F.countDistinct("batch").cast("int").alias("batches"), F.count("*").alias("shifts"))
    return r.list().join(last, "run_id").join(own, "run_id").select("family", "batches", "stop_reason", "shifts")


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type")
def event_props(spark, d):
    return V.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"))


@query()
def html_paragraph_tokens(spark, d):
    p = markup.html_paragraphs(V.read(spark, d, "pages"))
    return p.select("page_id", "paragraph", F.size(T.words(F.col("text"))).alias("n_words"), F.length("text").alias("n_chars"))


@query()
def syllable_counts(spark, d):
    """Words parted so that the last consonant before a vowel opens a syllable."""
    ty = V.types(toks(spark, d))
    return ty.select("n", F.explode(syllables(F.col("w"))).alias("syllable")).groupBy("syllable").agg(F.sum("n").alias("n"))


def syllables(word):
    return F.split(word, "(?<=[aeiou][^aeiou]{0,40})(?=[^aeiou][aeiou])|(?<=[aeiou])(?=[aeiou])")


@query()
def nw_alignment(spark, d):
    """Each passage's words against themselves without every seventh."""
    b = V.read(spark, d, "benchmark").select("item_id", T.words(F.col("text")).alias("a"))
    return S.align_rows(b.withColumn("b", F.filter("a", lambda x, i: i % 7 != 3)), "item_id", "a", "b")


@query()
def viterbi_segments(spark, d):
    found = S.segment_types(V.types(toks(spark, d)))
    return found.groupBy(F.size("parts").alias("pieces")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


@query()
def em_aligner(spark, d):
    """Signs of a substitution with one sign of two letters, learned back from all distinct words with their frequencies."""
    rows = V.types(toks(spark, d)).select(F.translate(F.replace("w", F.lit("th"), F.lit("9")), C.LETTERS, KEY).alias("s"), F.col("w").alias("t"), "n")
    path = f"{shared_folder(spark)}/types-{uuid.uuid4().hex}"  # every round reads the types, not the documents
    rows.repartition(4 * spark.sparkContext.defaultParallelism).write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    return spark.createDataFrame(sorted(S.learn_aligner_rows(rows, 4).items()), "sign string, letters string")


def letter_pairs(spark, d):
    from .profiles import bigrams

    two = bigrams(spark, d).where("length(a) = 1 and length(b) = 1").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # 26 * 26 at most
    return S.bigram_costs({r["a"] + r["b"]: r["n"] for r in two})


@query()
def annealing_search(spark, d):
    """Restarts of a key search over all passages, one group each; a search sees how often each two signs follow one another."""
    costs = letter_pairs(spark, d)
    t = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), C.LETTERS, KEY)
    texts = V.read(spark, d, "benchmark").select(t.alias("t")).where("length(t) > 1")
    twos = texts.select(F.explode(F.expr("transform(sequence(1, length(t) - 1), i -> substring(t, i, 2))")).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()  # 26 * 26 at most
    cipher = np.zeros((26, 26), np.int64)
    for r in twos:
        cipher[ord(r["p"][0]) - 97, ord(r["p"][1]) - 97] = r["n"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        loss, key = S.anneal(cipher, costs, int(f["restart"].iloc[0]))
        return pd.DataFrame({"restart": f["restart"].iloc[:1], "loss": [loss], "key": ["".join(C.LETTERS[k] for k in key)]})

    return spark.range(8).withColumnRenamed("id", "restart").groupBy("restart").applyInPandas(run, "restart long, loss double, key string")


@query()
def beam_decode(spark, d):
    """Codes that stand for two letters each, read by the cheapest letters."""
    costs = letter_pairs(spark, d)
    b = V.read(spark, d, "benchmark").select("item_id", F.array_join(T.words(F.col("text")), "").alias("t"))

    def run(frames):
        choices = {c: [(c, 0.0), (c + 13, 0.0)] for c in range(13)}
        for f in frames:
            out = []
            for k, t in zip(f["item_id"], f["t"]):
                plain = [ord(c) - 97 for c in t]
                cost, got = S.beam_decode([p % 13 for p in plain], choices, costs) if plain else (0.0, [])
                out.append((k, cost, float(np.mean([x == y for x, y in zip(plain, got)])) if plain else 0.0))
            yield pd.DataFrame(out, columns=["item_id", "cost", "accuracy"])

    return b.mapInPandas(run, "item_id long, cost double, accuracy double")


@query()
def product_model_fit(spark, d):
    """First by last letters of words: bits of one product and of a mixture of two."""
    cells = toks(spark, d).groupBy(F.expr("left(w, 1)").alias("a"), F.expr("right(w, 1)").alias("b")).agg(F.count("*").alias("n")).collect()  # 26 * 26 at most
    table = np.zeros((26, 26))
    for r in cells:
        table[ord(r["a"]) - 97, ord(r["b"]) - 97] = r["n"]
    return spark.createDataFrame([(k, float(S.product_model(table, k)[3])) for k in (1, 2)], "classes int, bits double")


@query()
def average_linkage_labels(spark, d):
    """Clusters of the label centroids by average linkage of cosine distance: as many points as labels."""
    e = V.read(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    rows = sorted((r["label"], r["x"]) for r in e.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("x")).collect())
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = S.average_linkage(1 - x @ x.T, 0.9)
    return spark.createDataFrame([(int(l), int(c)) for (l, _), c in zip(rows, found)], "label int, cluster int")
