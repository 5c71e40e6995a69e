"""Boundary observations, their models, and the coupling of neighbouring words.

A boundary joins the last glyph of a word (its terminal), the first of the next (the initial) and a kind: ordinary within a line, uncertain where one of the words has one letter, line between a line and the next of the same hand, paragraph between hands. Words of one glyph have no stem and give no boundary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import information as I
from ..operators import pages as P
from ..operators import resampling as R
from ..operators import views as V
from .controls import md5_of
from .profiles import toks, turn_tokens
from .registry import GLYPHS, TOK, TURN, UNIFORM, mi_sql, query

LAST = "({0})[len({0})]".format(GLYPHS.format("w"))
FIRST = f"({GLYPHS.format('nxt')})[1]"
OBS = f"""lns AS (SELECT conv_id, role, turn, ws, lead(ws[1]) OVER q AS nw, lead(turn) OVER q AS nt, lead(role) OVER q AS nr FROM turns WHERE len(ws) > 0 WINDOW q AS (PARTITION BY conv_id ORDER BY turn)),
pr AS (SELECT conv_id, role, turn, pos, n, w, nxt, CASE WHEN length(w) < 2 OR length(nxt) < 2 THEN 'uncertain' ELSE 'ordinary' END AS kind FROM (SELECT *, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok) WHERE nxt IS NOT NULL
 UNION ALL SELECT conv_id, role, turn, len(ws) - 1, len(ws), ws[len(ws)], nw, CASE WHEN nr = role THEN 'line' ELSE 'paragraph' END FROM lns WHERE nt = turn + 1),
obs AS (SELECT conv_id, role, turn, pos, kind, {LAST} AS terminal, substr(w, 1, length(w) - length({LAST})) AS stem, {FIRST} AS initial, pos / CAST(greatest(1, n - 1) AS DOUBLE) AS place FROM pr WHERE len({GLYPHS.format('w')}) >= 2)"""


def observations(spark, d) -> DataFrame:
    """conv_id, role, turn, pos, kind, stem, terminal, initial and place (from 0 to 1) of every boundary."""
    turns = V.read(spark, d, "conversations").select("conv_id", "role", "turn", T.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    inner = turn_tokens(spark, d).withColumn("nxt", F.lead("w").over(V.within("conv_id", "turn"))).where("nxt is not null")
    short = (F.length("w") < 2) | (F.length("nxt") < 2)
    inner = inner.select("conv_id", "role", "turn", "pos", "n", "w", "nxt", F.when(short, "uncertain").otherwise("ordinary").alias("kind"))
    q = Window.partitionBy("conv_id").orderBy("turn")
    ends = turns.select("conv_id", "role", "turn", (F.size("ws") - 1).alias("pos"), F.size("ws").alias("n"), F.element_at("ws", -1).alias("w"), F.lead(F.get("ws", F.lit(0))).over(q).alias("nxt"), F.lead("turn").over(q).alias("nt"), F.lead("role").over(q).alias("nr"))
    ends = ends.where("nt = turn + 1").withColumn("kind", F.when(F.col("nr") == F.col("role"), "line").otherwise("paragraph")).drop("nt", "nr")
    rows = inner.unionByName(ends).where(F.size(T.glyphs(F.col("w"))) >= 2)
    return rows.select("conv_id", "role", "turn", "pos", "kind", T.stem(F.col("w")).alias("stem"), T.last_glyph(F.col("w")).alias("terminal"), T.first_glyph(F.col("nxt")).alias("initial"), (F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1)).alias("place"))


@query(f"WITH {TURN}, {OBS} SELECT conv_id, role, turn, CAST(pos AS INTEGER) AS pos, kind, stem, terminal, initial, round(place, 9) AS place FROM obs")
def boundary_observations(spark, d):
    return observations(spark, d).withColumn("place", F.round("place", 9))


@query(f"WITH {TURN}, {OBS} SELECT kind, terminal, count(*) AS n, count(DISTINCT stem) AS stems, count(DISTINCT initial) AS initials, round(avg(place), 8) AS place FROM obs GROUP BY kind, terminal")
def boundary_kinds(spark, d):
    return observations(spark, d).groupBy("kind", "terminal").agg(F.count("*").alias("n"), F.countDistinct("stem").alias("stems"), F.countDistinct("initial").alias("initials"), F.round(F.avg("place"), 8).alias("place"))


@query(f"""WITH {TURN}, x AS (SELECT conv_id, turn, pos, w, CASE WHEN length(w) >= 2 AND length(lead(w) OVER q) >= 2 THEN lead(pos) OVER q END AS nxt, lead(pos) OVER q AS old FROM ttok WINDOW q AS (PARTITION BY conv_id, turn ORDER BY pos)) SELECT conv_id, turn, count(*) AS words, count(nxt) AS neighbours, count(old) AS successors FROM x GROUP BY ALL""")
def neighbours_and_successors(spark, d):
    """By line: words, those with a next word, and those where both are readable."""
    q = V.within("conv_id", "turn")
    nxt = F.lead("w").over(q)
    rows = turn_tokens(spark, d).select("conv_id", "turn", nxt.isNotNull().alias("old"), ((F.length("w") >= 2) & (F.length(nxt) >= 2)).alias("new"))
    flag = lambda c: F.count(F.when(F.col(c), 1))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), flag("new").alias("neighbours"), flag("old").alias("successors"))


@query(f"WITH {TURN}, {OBS} SELECT stem, initial, " + ", ".join(f"CAST(sum(CASE WHEN terminal = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {t}" for t in "nlrst") + " FROM obs GROUP BY stem, initial HAVING count(*) >= 3")
def stem_initial_model(spark, d):
    """How often each stem ends in n, l, r, s and t before each initial."""
    ends = [F.sum(F.when(F.col("terminal") == t, 1).otherwise(0)).alias(t) for t in "nlrst"]
    return observations(spark, d).groupBy("stem", "initial").agg(F.count("*").alias("c"), *ends).where("c >= 3").drop("c")


TEST = UNIFORM.format("CAST(conv_id AS VARCHAR)") + " < 0.3"
EVAL = f"""o AS (SELECT *, {TEST} AS test FROM obs WHERE terminal IN ('n', 's', 't')), tr AS (SELECT stem, initial, terminal, count(*) AS n FROM o WHERE NOT test GROUP BY ALL),
s1 AS (SELECT stem, terminal, sum(n) AS n FROM tr GROUP BY ALL), b1 AS (SELECT stem, sum(n) AS support, max_by(terminal, n * 10 + CASE terminal WHEN 'n' THEN 2 WHEN 's' THEN 1 ELSE 0 END) AS best FROM s1 GROUP BY stem), b2 AS (SELECT stem, initial, sum(n) AS support, max_by(terminal, n * 10 + CASE terminal WHEN 'n' THEN 2 WHEN 's' THEN 1 ELSE 0 END) AS best FROM tr GROUP BY stem, initial),
ev AS (SELECT o.conv_id, o.kind, o.terminal, b1.best AS by_stem, b1.support AS stem_support, b2.best AS by_both, b2.support AS both_support FROM o LEFT JOIN b1 USING (stem) LEFT JOIN b2 USING (stem, initial) WHERE test)"""


def evaluated(spark, d) -> DataFrame:
    """Held-out boundaries with the majority terminal of their stem, and of stem and initial, among the others: two left joins. Ties go to n, then s, then t."""
    o = observations(spark, d).where(F.col("terminal").isin("n", "s", "t")).withColumn("test", T.hash_uniform(F.col("conv_id")) < 0.3)
    train = o.where("not test").groupBy("stem", "initial", "terminal").agg(F.count("*").alias("n"))
    order = F.when(F.col("terminal") == "n", 2).when(F.col("terminal") == "s", 1).otherwise(0)

    def majority(cells, name, *keys):
        return cells.groupBy(*keys).agg(F.sum("n").alias(f"{name}_support"), F.max_by("terminal", F.col("n") * 10 + order).alias(f"by_{name}"))

    stems = majority(train.groupBy("stem", "terminal").agg(F.sum("n").alias("n")), "stem", "stem")
    return o.where("test").join(stems, "stem", "left").join(majority(train, "both", "stem", "initial"), ["stem", "initial"], "left")


@query(f"""WITH {TURN}, {OBS}, {EVAL} SELECT kind, count(*) AS n, count(by_stem) AS with_stem, count(by_both) AS with_both, CAST(sum(CASE WHEN by_stem = terminal THEN 1 ELSE 0 END) AS BIGINT) AS stem_right, CAST(sum(CASE WHEN by_both = terminal THEN 1 ELSE 0 END) AS BIGINT) AS both_right,
CAST(sum(CASE WHEN by_both IS NOT NULL AND by_stem = terminal THEN 1 ELSE 0 END) AS BIGINT) AS stem_right_joint FROM ev GROUP BY kind""")
def boundary_accuracy(spark, d):
    """Accuracies of two models of held-out boundaries, each over what it knows and over what both know."""
    right = lambda c, when=None: F.sum(F.when((F.col(c) == F.col("terminal")) & (F.lit(True) if when is None else when), 1).otherwise(0))
    return evaluated(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count("by_stem").alias("with_stem"), F.count("by_both").alias("with_both"), right("by_stem").alias("stem_right"), right("by_both").alias("both_right"), right("by_stem", F.col("by_both").isNotNull()).alias("stem_right_joint"))


@query(f"""WITH {TURN}, {OBS}, {EVAL} SELECT CAST(least(both_support, 8) AS BIGINT) AS support, count(*) AS n, round(avg(CASE WHEN by_both = terminal THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM ev WHERE by_both IS NOT NULL GROUP BY 1""")
def accuracy_by_support(spark, d):
    rows = evaluated(spark, d).where("by_both is not null")
    return rows.groupBy(F.least("both_support", F.lit(8)).cast("long").alias("support")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("by_both") == F.col("terminal"), 1.0).otherwise(0.0)), 9).alias("accuracy"))


PRED = f"""o AS (SELECT conv_id, stem, initial, terminal, CAST(floor({UNIFORM.format('CAST(conv_id AS VARCHAR)')} * 5) AS INTEGER) AS fold FROM obs WHERE terminal IN ('n', 's', 't')), c AS (SELECT stem, terminal, fold, count(*) AS n FROM o GROUP BY ALL), ci AS (SELECT stem, initial, terminal, fold, count(*) AS n FROM o GROUP BY ALL), t0 AS (SELECT terminal, fold, count(*) AS n FROM o GROUP BY ALL),
m0 AS (SELECT f.fold, t.terminal, CAST(sum(t.n) AS DOUBLE) / max(f.rest) AS p FROM (SELECT fold, (SELECT count(*) FROM o) - count(*) AS rest FROM o GROUP BY fold) f JOIN t0 t ON t.fold <> f.fold GROUP BY ALL),
k1 AS (SELECT o.*, (SELECT coalesce(sum(n), 0) FROM c WHERE c.stem = o.stem AND c.fold <> o.fold) AS s1, (SELECT coalesce(sum(n), 0) FROM c WHERE c.stem = o.stem AND c.fold <> o.fold AND c.terminal = o.terminal) AS h1, (SELECT coalesce(sum(n), 0) FROM ci WHERE ci.stem = o.stem AND ci.initial = o.initial AND ci.fold <> o.fold) AS s2, (SELECT coalesce(sum(n), 0) FROM ci WHERE ci.stem = o.stem AND ci.initial = o.initial AND ci.fold <> o.fold AND ci.terminal = o.terminal) AS h2 FROM o),
pr2 AS (SELECT k1.conv_id, k1.stem, k1.fold, (h1 + 2 * m0.p) / (s1 + 2) AS p0, (h2 + 2 * ((h1 + 2 * m0.p) / (s1 + 2))) / (s2 + 2) AS p1 FROM k1 JOIN m0 USING (fold, terminal))"""


def predictions(spark, d) -> DataFrame:
    """conv_id, stem, fold, p0 and p1: the chance of the terminal that is there by its stem, and by stem and initial, from the other folds' counts, each backed off to the next simpler one. Counts without a fold are totals less its own."""
    o = observations(spark, d).where(F.col("terminal").isin("n", "s", "t")).withColumn("fold", T.hash_fold(F.col("conv_id"), 5))
    cells = o.groupBy("stem", "initial", "terminal", "fold").agg(F.count("*").alias("n"))

    def others(keys, name):
        """Counts outside each row's own fold, by keys and fold."""
        own = cells.groupBy(*keys, "fold").agg(F.sum("n").alias("own"))
        total = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
        return (own.join(total, keys) if keys else own.crossJoin(total)).select(*keys, "fold", (F.col("total") - F.col("own")).alias(name))

    rows = o.select("conv_id", "stem", "initial", "terminal", "fold")
    for keys, name in ((["terminal"], "h0"), ([], "s0"), (["stem", "terminal"], "h1"), (["stem"], "s1"), (["stem", "initial", "terminal"], "h2"), (["stem", "initial"], "s2")):
        rows = rows.join(others(keys, name), [*keys, "fold"])
    p = F.col("h0") / F.col("s0")
    p0 = (F.col("h1") + 2 * p) / (F.col("s1") + 2)
    return rows.select("conv_id", "stem", "fold", p0.alias("p0"), ((F.col("h2") + 2 * p0) / (F.col("s2") + 2)).alias("p1"))


@query(f"""WITH {TURN}, {OBS}, {PRED} SELECT fold, count(*) AS n, count(DISTINCT conv_id) AS pages, count(DISTINCT stem) AS stems, round(avg(-log2(greatest(p0, 1e-12))), 7) AS loss_base, round(avg(-log2(greatest(p1, 1e-12))), 7) AS loss_full, round(avg(log2(greatest(p1, 1e-12)) - log2(greatest(p0, 1e-12))), 7) AS gain_bits, round(avg((1 - p1) * (1 - p1)), 7) AS brier FROM pr2 GROUP BY fold""")
def prediction_gain_by_fold(spark, d):
    bits = lambda c: -F.log2(F.greatest(F.col(c), F.lit(1e-12)))
    return predictions(spark, d).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("pages"), F.countDistinct("stem").alias("stems"), F.round(F.avg(bits("p0")), 7).alias("loss_base"), F.round(F.avg(bits("p1")), 7).alias("loss_full"), F.round(F.avg(bits("p0") - bits("p1")), 7).alias("gain_bits"), F.round(F.avg((1 - F.col("p1")) * (1 - F.col("p1"))), 7).alias("brier"))


@query(f"""WITH {TURN}, {OBS} SELECT page_fold, stem_fold, count(*) AS n, CAST(sum(CASE WHEN page_fold = stem_fold THEN 1 ELSE 0 END) AS BIGINT) AS held FROM (SELECT CAST(floor({UNIFORM.format('CAST(conv_id AS VARCHAR)')} * 5) AS INTEGER) AS page_fold, CAST(floor({UNIFORM.format('stem')} * 5) AS INTEGER) AS stem_fold FROM obs) GROUP BY ALL""")
def crossed_folds(spark, d):
    """Boundaries by the fold of their page and the fold of their stem: a model is tested where both are its own, and learned where neither is."""
    rows = observations(spark, d).select(T.hash_fold(F.col("conv_id"), 5).alias("page_fold"), T.hash_fold(F.col("stem"), 5).alias("stem_fold"))
    return rows.groupBy("page_fold", "stem_fold").agg(F.count("*").alias("n"), F.sum((F.col("page_fold") == F.col("stem_fold")).cast("int")).alias("held"))


@query(f"""WITH {TURN}, {OBS}, f AS (SELECT kind, role, initial, place, {GLYPHS.format('stem')} AS g FROM obs), x AS (SELECT unnest([('length', CAST(least(len(g), 12) AS VARCHAR)), ('prefix1', g[1]), ('suffix1', g[len(g)]), ('suffix2', concat_ws('|', CASE WHEN len(g) > 1 THEN g[len(g) - 1] END, g[len(g)])), ('hand', role), ('kind', kind), ('initial', initial), ('last_initial', g[len(g)] || '/' || initial)]) AS p FROM f)
SELECT p[1] AS feature, p[2] AS value, count(*) AS n FROM x GROUP BY ALL""")
def boundary_features(spark, d):
    """The sparse categorical features of boundaries, and how often each value is there."""
    rows = boundary_feature_rows(spark, d)
    names = ("length", "prefix1", "suffix1", "suffix2", "hand", "kind", "initial", "last_initial")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names)))
    return rows.select(pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"))


def boundary_feature_rows(spark, d) -> DataFrame:
    g = T.glyphs(F.col("stem"))
    last = F.element_at(g, -1)
    suffix = F.concat_ws("|", F.when(F.size(g) > 1, F.element_at(g, -2)), last)
    return observations(spark, d).select("conv_id", "terminal", "place", F.least(F.size(g), F.lit(12)).cast("string").alias("length"), F.get(g, F.lit(0)).alias("prefix1"), last.alias("suffix1"), suffix.alias("suffix2"), F.col("role").alias("hand"), "kind", "initial", F.concat(last, F.lit("/"), "initial").alias("last_initial"))


@query()
def boundary_logistic(spark, d):
    """Multinomial logistic regression of the terminal on the features, crossed by folds of pages; log2 loss and accuracy of the held-out fold beside those of the majority. Iterative: no SQL."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher, StringIndexer
    from pyspark.ml.functions import vector_to_array

    rows = boundary_feature_rows(spark, d).where(F.col("terminal").isin("n", "s", "t")).withColumn("test", T.hash_uniform(F.col("conv_id")) < 0.2)
    names = ["length", "prefix1", "suffix1", "suffix2", "hand", "kind", "initial", "last_initial", "place"]
    steps = [StringIndexer(inputCol="terminal", outputCol="label", stringOrderType="alphabetAsc"), FeatureHasher(inputCols=names, outputCol="features", numFeatures=1 << 14), LogisticRegression(family="multinomial", regParam=0.001, maxIter=60)]
    model = Pipeline(stages=steps).fit(rows.where("not test"))
    p = F.element_at(vector_to_array("probability"), F.col("label").cast("int") + 1)
    scored = model.transform(rows.where("test")).select((F.col("prediction") == F.col("label")).cast("double").alias("hit"), (-F.log2(F.greatest(p, F.lit(1e-12)))).alias("bits"))
    share = rows.where("not test").groupBy("terminal").agg(F.count("*").alias("n"))
    base = rows.where("test").join(share.crossJoin(share.agg(F.sum("n").alias("all"))), "terminal").agg(F.avg(-F.log2(F.col("n") / F.col("all"))).alias("bits_base"))
    return scored.agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("bits").alias("bits")).crossJoin(base)  # one row each


# Coupling: whether which of two words of one stem occurs depends on the words beside them, beyond the glyphs that touch.

TOPK = 30
REPS = 99
REC = f"""tp AS (SELECT w FROM (SELECT w, count(*) AS n FROM tok GROUP BY w) ORDER BY n DESC, w LIMIT {TOPK}), cx AS (SELECT doc_id, pos, w, lag(w) OVER q AS lw, lead(w) OVER q AS rw FROM tok WINDOW q AS (PARTITION BY doc_id ORDER BY pos)),
rc AS (SELECT doc_id, pos, w, coalesce(right(lw, 1), '^') || '|' || coalesce(left(rw, 1), '$') AS z, CASE WHEN lw IS NULL THEN '^' WHEN lw IN (SELECT w FROM tp) THEN lw ELSE '*' END AS xl, CASE WHEN rw IS NULL THEN '$' WHEN rw IN (SELECT w FROM tp) THEN rw ELSE '*' END AS xr FROM cx),
fr AS (SELECT w, left(w, length(w) - 1) AS stem, count(*) AS n FROM tok WHERE length(w) >= 2 GROUP BY ALL HAVING count(*) >= 20), prs AS (SELECT a.w AS a, b.w AS b, a.stem || '.' AS pair FROM fr a JOIN fr b ON a.stem = b.stem AND a.w < b.w)"""


def records(spark, d) -> DataFrame:
    """doc_id, pos, w, z (the glyphs that touch it), xl and xr (the words beside it, if they are among the most frequent)."""
    tok = toks(spark, d)
    top = V.types(tok).orderBy(F.desc("n"), "w").limit(TOPK).agg(F.collect_list("w").alias("top"))  # TOPK words
    rows = V.beside(V.read(spark, d, "documents"), ("doc_id",), lw=-1, rw=1).crossJoin(F.broadcast(top))  # one row
    side = lambda c, end: F.when(F.col(c).isNull(), end).when(F.array_contains("top", F.col(c)), F.col(c)).otherwise("*")
    z = F.concat(F.coalesce(F.expr("right(lw, 1)"), F.lit("^")), F.lit("|"), F.coalesce(F.expr("left(rw, 1)"), F.lit("$")))
    return rows.select("doc_id", "pos", "w", z.alias("z"), side("lw", "^").alias("xl"), side("rw", "$").alias("xr"))


def stem_pairs(spark, d) -> DataFrame:
    """a < b: frequent words that differ in their last letter alone."""
    f = V.types(toks(spark, d).where("length(w) >= 2")).where("n >= 20").select("w", F.expr("left(w, length(w) - 1)").alias("stem"))
    return f.withColumnRenamed("w", "a").join(f.withColumnRenamed("w", "b"), "stem").where("a < b").select("a", "b")


def members(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, t (which of the two it is) and the row, for every row of either word of a pair; a word is in few pairs, as its stem has at most 26 endings."""
    return rows.join(member_words(pairs), "w")


def member_words(pairs: DataFrame) -> DataFrame:
    """a, b, w, t: either word of each pair."""
    return pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("w"), F.lit(0).alias("t")), F.struct(F.col("b").alias("w"), F.lit(1).alias("t")))).alias("x")).select("a", "b", "x.w", "x.t")


def residual(cells: DataFrame, *keys: str) -> DataFrame:
    """cells: keys, z, side, t, x, n. keys and s = I(t; xl | z) + I(t; xr | z)."""
    own = [*keys, "z", "side"]
    n = F.col("n").cast("double")
    w = lambda *c: F.sum(n).over(Window.partitionBy(*own, *c))
    return cells.withColumn("piece", n * F.log2(n * w() / (w("t") * w("x")))).groupBy(*keys).agg((2 * F.sum("piece") / F.sum(n)).alias("s"))


def coupling(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows: of records(). a, b and the residual information of each pair. Words are counted before they meet their pairs, so what is joined is cells, not occurrences."""
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("xl").alias("x")), F.struct(F.lit("r").alias("side"), F.col("xr").alias("x"))))
    cells = rows.select("w", "z", sides.alias("s")).groupBy("w", "z", "s.side", "s.x").agg(F.count("*").alias("n"))
    return residual(members(cells, pairs), "a", "b")


#: Replicates that one task draws for a stratum.
DRAWS = 33


def drawn_coupling(rows: DataFrame, pairs: DataFrame, reps: int) -> DataFrame:
    """a, b, rep (0: as it is) and s, with t permuted within a, b and z by a hash in the other replicates. pairs: few, so they are sent to all.

    A stratum's occurrences are gathered once for every DRAWS replicates, by numbers alone; their hashes and cells are made there in arrays, and what leaves a task is a sum for each replicate.
    """
    P.short_batches(rows.sparkSession)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((reps + DRAWS - 1) // DRAWS - 1)))
    own = rows.join(F.broadcast(member_words(pairs)), "w").select("a", "b", "z", "t", F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("page"), "pos", "xl", "xr").withColumn("block", blocks)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("page", "ascending"), ("pos", "ascending")])
        a, b, block = (table[c][0].as_py() for c in ("a", "b", "block"))
        t = table["t"].to_numpy().astype(np.int64)
        x, kinds = [], []
        for c in ("xl", "xr"):
            found = table[c].combine_chunks().dictionary_encode()
            found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
            x.append(found.indices.to_numpy().astype(np.int64))
            kinds.append(len(found.dictionary))
        keys = [f"{k}|{p}" if k is not None else str(p) for k, p in zip(table["doc_id"].to_pylist(), table["pos"].to_pylist())]
        tails, sizes = P.packed([k.encode() for k in keys])
        place = np.arange(len(t))
        margin = lambda codes, size: R.n_log(np.bincount(codes, minlength=size)).sum()
        fixed = sum(margin(v, k) for v, k in zip(x, kinds)) + 2 * margin(t, 2) - 2 * R.n_log(np.array(len(t)))
        low = block * DRAWS + 1
        wanted = list(range(low, min(reps, low + DRAWS - 1) + 1))
        step = max(1, P.LANES // len(t))  # replicates of a small stratum are hashed together
        out: list[tuple[int, float, int]] = []

        def add(rep: int, u: np.ndarray) -> None:
            piece = sum(R.n_log(np.bincount(v * 2 + u, minlength=2 * k)).sum() for v, k in zip(x, kinds)) - fixed
            out.append((rep, float(piece), 2 * len(t)))

        if block == 0:
            add(0, t)
        for at in range(0, len(wanted), step):
            some = wanted[at : at + step]
            heads = [f"{rep}|{a}|{b}|".encode() for rep in some]
            parts = [P.headed(h, tails[i : i + P.LANES], sizes[i : i + P.LANES]) for h in heads for i in range(0, len(tails), P.LANES)] if step > 1 else None
            if parts:
                hashes = P.md5(np.concatenate([m for m, _ in parts]), np.concatenate([l for _, l in parts]))
            else:
                hashes = np.concatenate([P.md5(*P.headed(heads[0], tails[i : i + P.LANES], sizes[i : i + P.LANES])) for i in range(0, len(tails), P.LANES)])
            for rep, u in zip(some, P.in_hash_order(hashes.reshape(len(some), -1, 2), t, place)):
                add(rep, u)
        rep, piece, n = zip(*out)
        return pa.table({"a": [a] * len(out), "b": [b] * len(out), "rep": pa.array(rep, pa.int32()), "piece": pa.array(piece), "n": pa.array(n, pa.int64())})

    return own.groupBy("a", "b", "z", "block").applyInArrow(run, "a string, b string, rep int, piece double, n long").groupBy("a", "b", "rep").agg((2 * F.sum("piece") / F.sum("n")).alias("s"))


CPL = """m AS (SELECT a, b, CASE WHEN w = a THEN 0 ELSE 1 END AS t, z, xl, xr, doc_id, pos FROM {prs} JOIN rc ON rc.w = a OR rc.w = b),
bs AS (SELECT m.*, rep FROM m, (SELECT unnest(range({reps} + 1)) AS rep)), l AS (SELECT *, row_number() OVER (PARTITION BY a, b, rep, z ORDER BY doc_id, pos) AS k FROM bs), r AS (SELECT a, b, rep, z, t AS u, row_number() OVER (PARTITION BY a, b, rep, z ORDER BY CASE WHEN rep = 0 THEN '' ELSE md5(concat_ws('|', rep, a, b, doc_id, pos)) END, doc_id, pos) AS k FROM bs),
d AS (SELECT l.a, l.b, l.rep, l.z, u AS t, side, CASE WHEN side = 'l' THEN xl ELSE xr END AS x FROM l JOIN r USING (a, b, rep, z, k), (SELECT unnest(['l', 'r']) AS side)), c AS (SELECT a, b, rep, z, side, t, x, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY ALL),
sc AS (SELECT a, b, rep, 2 * sum(n * log2(n * nz / (nt * nx))) / sum(n) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY a, b, rep, z, side) AS nz, sum(n) OVER (PARTITION BY a, b, rep, z, side, t) AS nt, sum(n) OVER (PARTITION BY a, b, rep, z, side, x) AS nx FROM c) GROUP BY ALL)"""


@query(f"WITH {TOK}, {REC}, {CPL.format(prs='prs', reps=0)} SELECT a, b, round(s, 7) AS s FROM sc")
def stem_pair_information(spark, d):
    """The residual information of every pair of frequent words of one stem."""
    return coupling(records(spark, d), stem_pairs(spark, d)).select("a", "b", F.round("s", 7).alias("s"))


TOP_PAIRS = "(SELECT prs.a, prs.b FROM prs JOIN fr f ON f.w = prs.a JOIN fr g ON g.w = prs.b ORDER BY least(f.n, g.n) DESC, prs.a, prs.b LIMIT 3)"


def top_pairs(spark, d) -> DataFrame:
    n = V.types(toks(spark, d))
    p = stem_pairs(spark, d).join(n.select(F.col("w").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b")
    return p.orderBy(F.desc(F.least("na", "nb")), "a", "b").limit(3).select("a", "b")  # a top-k report


@query(f"""WITH {TOK}, {REC}, {CPL.format(prs=TOP_PAIRS, reps=REPS)}, o AS (SELECT a, b, s FROM sc WHERE rep = 0) SELECT a, b, round(max(o.s), 7) AS observed, round(avg(sc.s), 7) AS null_mean, round(max(o.s) - avg(sc.s), 7) AS excess, round((1 + sum(CASE WHEN sc.s >= o.s - 1e-12 THEN 1 ELSE 0 END)) / CAST(1 + count(*) AS DOUBLE), 7) AS p FROM sc JOIN o USING (a, b) WHERE rep > 0 GROUP BY a, b""")
def residual_coupling_test(spark, d):
    """The pairs of one stem with the most occurrences: their residual information against permutations within the glyphs that touch."""
    s = drawn_coupling(records(spark, d), top_pairs(spark, d), REPS)
    o = s.where("rep = 0").select("a", "b", F.col("s").alias("o"))
    high = F.sum(F.when(F.col("s") >= F.col("o") - 1e-12, 1).otherwise(0))
    out = s.where("rep > 0").join(o, ["a", "b"]).groupBy("a", "b").agg(F.max("o").alias("observed"), F.avg("s").alias("null_mean"), ((1 + high) / (1 + F.count("*"))).alias("p"))
    return out.select("a", "b", *(F.round(c, 7).alias(n) for n, c in (("observed", F.col("observed")), ("null_mean", F.col("null_mean")), ("excess", F.col("observed") - F.col("null_mean")), ("p", F.col("p")))))


NAIVE = """m AS (SELECT prs.a, prs.b, CASE WHEN rc.w = prs.a THEN 0 ELSE 1 END AS t, right(z, 1) AS x FROM prs JOIN rc ON rc.w = prs.a OR rc.w = prs.b), c AS (SELECT a, b, t, x, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY ALL)
SELECT a, b, CAST(sum(n) AS BIGINT) AS n, round(sum(n * log2(n * na / (nt * nx))) / sum(n), 7) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY a, b) AS na, sum(n) OVER (PARTITION BY a, b, t) AS nt, sum(n) OVER (PARTITION BY a, b, x) AS nx FROM c) GROUP BY a, b"""


@query(f"WITH {TOK}, {REC}, {NAIVE}")
def naive_pair_information(spark, d):
    """Information between which of a pair occurs and the next initial, whatever touches."""
    own = records(spark, d).groupBy("w", F.expr("right(z, 1)").alias("x")).agg(F.count("*").alias("n"))
    mi = I.mutual_information(members(own, stem_pairs(spark, d)).select(F.concat_ws("|", "a", "b").alias("pair"), F.col("t").alias("a"), F.col("x").alias("b"), "n"), "pair")
    p = F.split("pair", r"\|")
    return mi.select(p[0].alias("a"), p[1].alias("b"), F.col("total").cast("long").alias("n"), F.round("mi", 7).alias("mi"))


REFS = f"""f2 AS (SELECT w, stem, right(w, 1) AS fin, n FROM fr), cand AS (SELECT p.a, p.b, x.w AS x FROM {TOP_PAIRS} p JOIN f2 fa ON fa.w = p.a JOIN f2 x ON x.fin = fa.fin AND x.n BETWEEN 0.8 * fa.n AND 1.25 * fa.n AND x.stem <> fa.stem), cany AS (SELECT p.a, p.b, x.w AS y FROM {TOP_PAIRS} p JOIN f2 fb ON fb.w = p.b JOIN f2 x ON x.fin = fb.fin AND x.n BETWEEN 0.8 * fb.n AND 1.25 * fb.n AND x.stem <> fb.stem),
rf AS (SELECT a, b, x, y, row_number() OVER (PARTITION BY a, b ORDER BY md5(concat_ws('|', a, b, x, y))) AS r FROM cand JOIN cany USING (a, b) WHERE x <> y AND left(x, length(x) - 1) <> left(y, length(y) - 1))"""


@query(f"WITH {TOK}, {REC}, {REFS} SELECT a, b, x, y FROM rf WHERE r <= 20")
def matched_reference_pairs(spark, d):
    """For the most frequent pairs of one stem, 20 pairs of words of other stems, matched in frequency and last letter and drawn by a hash."""
    f = V.types(toks(spark, d).where("length(w) >= 2")).where("n >= 20").select("w", "n", F.expr("left(w, length(w) - 1)").alias("stem"), F.expr("right(w, 1)").alias("fin"))
    pairs = top_pairs(spark, d)

    def like(member: str, to: str) -> DataFrame:
        own = pairs.join(f.select(F.col("w").alias(member), F.col("n").alias("m"), F.col("stem").alias("own"), "fin"), member)
        return own.join(f, "fin").where("n >= 0.8 * m and n <= 1.25 * m and stem <> own").select("a", "b", F.col("w").alias(to), F.col("stem").alias(f"stem_{to}"))

    both = like("a", "x").join(like("b", "y"), ["a", "b"]).where("x <> y and stem_x <> stem_y")
    r = F.row_number().over(Window.partitionBy("a", "b").orderBy(md5_of(*(F.col(c) for c in "abxy"))))
    return both.withColumn("r", r).where("r <= 20").select("a", "b", "x", "y")  # the feature: n references a pair


@query(f"""WITH {TOK}, {REC}, {REFS}, rr AS (SELECT * FROM rf WHERE r <= 20), al AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM rr UNION SELECT a, b FROM {TOP_PAIRS} q), {CPL.format(prs='al', reps=0)}, j AS (SELECT rr.a, rr.b, s1.s AS own, s2.s AS ref FROM rr JOIN sc s1 ON s1.a = rr.a AND s1.b = rr.b JOIN sc s2 ON s2.a = least(x, y) AND s2.b = greatest(x, y))
SELECT a, b, round(max(own), 7) AS s, count(*) AS n_ref, round(100.0 * avg(CASE WHEN ref <= own + 1e-12 THEN 1.0 ELSE 0.0 END), 7) AS percentile, CASE WHEN 100.0 * avg(CASE WHEN ref <= own + 1e-12 THEN 1.0 ELSE 0.0 END) <= 25 THEN 'coupled_compatible' WHEN 100.0 * avg(CASE WHEN ref <= own + 1e-12 THEN 1.0 ELSE 0.0 END) >= 50 THEN 'distinct_like' ELSE 'undetermined' END AS category FROM j GROUP BY a, b""")
def pair_percentiles(spark, d):
    """Where a pair's residual information stands among its matched references, and the category that follows."""
    refs = matched_reference_pairs(spark, d)
    own = top_pairs(spark, d)
    ordered = refs.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    every = ordered.select(F.col("x").alias("a"), F.col("y").alias("b")).union(own).distinct()
    s = coupling(records(spark, d), every)
    joined = ordered.join(s.withColumnRenamed("s", "own"), ["a", "b"]).join(s.withColumnsRenamed({"a": "x", "b": "y", "s": "ref"}), ["x", "y"])
    share = 100.0 * F.avg(F.when(F.col("ref") <= F.col("own") + 1e-12, 1.0).otherwise(0.0))
    out = joined.groupBy("a", "b").agg(F.round(F.max("own"), 7).alias("s"), F.count("*").alias("n_ref"), share.alias("share"))
    category = F.when(F.col("share") <= 25, "coupled_compatible").when(F.col("share") >= 50, "distinct_like").otherwise("undetermined")
    return out.select("a", "b", "s", "n_ref", F.round("share", 7).alias("percentile"), category.alias("category"))


PAGEC = """pc AS (SELECT p.a, p.b, rc.doc_id % 10 AS pg, CASE WHEN rc.w = p.a THEN 0 ELSE 1 END AS t, right(z, 1) AS x, left(z, 1) AS l FROM prs p JOIN rc ON rc.w = p.a OR rc.w = p.b), cell AS (SELECT a || '|' || b || '|' || pg AS s, t AS a, x AS b, count(*) AS n FROM pc GROUP BY ALL), c2 AS (SELECT split_part(s, '|', 1) || '|' || split_part(s, '|', 2) AS s, a, b, sum(n) AS n FROM cell GROUP BY ALL)"""


@query(f"""WITH {TOK}, {REC}, {PAGEC}, x AS ({mi_sql('cell', 's')}), y AS ({mi_sql('c2', 's')}) SELECT (SELECT CAST(sum(total) AS BIGINT) FROM x) AS n, (SELECT round(sum(total * mi) / sum(total), 7) FROM x) AS given_page, (SELECT round(sum(total * mi) / sum(total), 7) FROM y) AS without_page""")
def page_confound(spark, d):
    """Information between a pair's member and the next initial, given the stem, and given stem and group of pages."""
    own = records(spark, d).groupBy("w", (F.col("doc_id") % 10).alias("pg"), F.expr("right(z, 1)").alias("x")).agg(F.count("*").alias("n"))
    cells = members(own, stem_pairs(spark, d)).select(F.concat_ws("|", "a", "b").alias("pair"), "pg", F.col("t").alias("a"), F.col("x").alias("b"), "n")
    inner = I.conditional_information(cells, "pair", "pg").select(F.col("total").alias("n"), F.round("cmi", 7).alias("given_page"))
    outer = I.conditional_information(cells.groupBy("pair", "a", "b").agg(F.sum("n").alias("n")), "pair").select(F.round("cmi", 7).alias("without_page"))
    return inner.crossJoin(outer)  # one row each
