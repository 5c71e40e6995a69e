"""Profiles: frequencies, glyphs, positions, boundaries, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import information as I
from ..operators import views as V
from .registry import GLYPHS, LINE, TOK, TURN, query


def toks(spark, d, *keys):
    return V.tokens(V.read(spark, d, "documents"), ("doc_id", *keys))


@query(f"WITH {TOK} SELECT w, count(*) AS n FROM tok GROUP BY w")
def token_frequencies(spark, d):
    return V.types(toks(spark, d))


@query(f"WITH {TOK}, ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w) SELECT CAST(length(w) AS BIGINT) AS len, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_tokens FROM ty GROUP BY 1")
def type_length_profile(spark, d):
    return V.types(toks(spark, d)).groupBy(F.length("w").cast("long").alias("len")).agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"))


@query(f"""WITH {TOK}, ty AS (SELECT lang, w, count(*) AS n FROM tok GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM ty),
adj AS (SELECT lang, avg(CASE WHEN w = nxt THEN 1.0 ELSE 0.0 END) AS repeats FROM (SELECT lang, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL GROUP BY lang)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_types, round(count(*) / CAST(sum(n) AS DOUBLE), 9) AS ttr, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 9) AS hapax_share, round(sum(CASE WHEN k <= 10 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS top10_share, round(max(repeats), 9) AS adjacent_repeat FROM r JOIN adj USING (lang) GROUP BY lang""")
def ttr_hapax_top10(spark, d):
    tok = toks(spark, d, "lang")
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    repeats = V.adjacent(tok).groupBy("lang").agg(F.avg(F.when(F.col("w") == F.col("nxt"), 1.0).otherwise(0.0)).alias("repeats"))
    ranked = V.types(tok, "lang").withColumn("k", k)
    n = F.sum("n")
    out = ranked.groupBy("lang").agg(n.alias("n_tokens"), F.count("*").alias("n_types"), F.round(F.count("*") / n, 9).alias("ttr"), F.round(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), 9).alias("hapax_share"), F.round(F.sum(F.when(F.col("k") <= 10, F.col("n")).otherwise(0)) / n, 9).alias("top10_share"))
    return out.join(repeats, "lang").select("*", F.round("repeats", 9).alias("adjacent_repeat")).drop("repeats")


BIGRAMS = f"""big AS (SELECT lang, g[i] AS a, g[i + 1] AS b, sum(n) AS n FROM (SELECT lang, n, g, unnest(range(1, len(g))) AS i FROM (SELECT lang, w, count(*) AS n, {GLYPHS.format('w')} AS g FROM tok GROUP BY lang, w)) GROUP BY ALL)"""


def bigrams(spark, d):
    ty = V.types(toks(spark, d, "lang"), "lang").withColumn("g", T.glyphs(F.col("w"))).where(F.size("g") > 1)
    pairs = ty.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("g") - 2), lambda i: F.struct(F.get("g", i).alias("a"), F.get("g", i + 1).alias("b")))).alias("p"))
    return pairs.groupBy("lang", "p.a", "p.b").agg(F.sum("n").alias("n"))


@query(f"WITH {TOK}, {BIGRAMS} SELECT lang, a, b, CAST(n AS BIGINT) AS n FROM big")
def glyph_bigrams(spark, d):
    return bigrams(spark, d)


@query(f"""WITH {TOK}, {BIGRAMS}, h2 AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, CAST(n AS DOUBLE) AS n FROM big) GROUP BY lang),
h1 AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT lang, a, CAST(sum(n) AS DOUBLE) AS n FROM big GROUP BY ALL) GROUP BY lang)
SELECT lang, round(h2.h - h1.h, 8) AS conditional_entropy, round(h1.h, 8) AS entropy FROM h2 JOIN h1 USING (lang)""")
def glyph_conditional_entropy(spark, d):
    big = bigrams(spark, d)
    two = I.entropy(big, "lang").select("lang", F.col("entropy").alias("h2"))
    one = I.entropy(big.groupBy("lang", "a").agg(F.sum("n").alias("n")), "lang").select("lang", F.col("entropy").alias("h1"))
    return two.join(one, "lang").select("lang", F.round(F.col("h2") - F.col("h1"), 8).alias("conditional_entropy"), F.round("h1", 8).alias("entropy"))


SHAPE = f"shp AS (SELECT lang, n, g[len(g)] AS last, CASE WHEN len(g) > 1 THEN g[len(g) - 1] END AS second, len(g) AS k FROM (SELECT lang, w, count(*) AS n, {GLYPHS.format('w')} AS g FROM tok GROUP BY lang, w))"


@query(f"""WITH {TOK}, {SHAPE}, l AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS k FROM (SELECT lang, last, CAST(sum(n) AS DOUBLE) AS n FROM shp GROUP BY ALL) GROUP BY lang),
s AS (SELECT lang, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS k FROM (SELECT lang, second, CAST(sum(n) AS DOUBLE) AS n FROM shp WHERE second IS NOT NULL GROUP BY ALL) GROUP BY lang),
m AS (SELECT lang, sum(n * k) / CAST(sum(n) AS DOUBLE) AS mean_glyphs FROM shp GROUP BY lang)
SELECT lang, round(l.h, 8) AS h_last, l.k AS d_last, round(s.h, 8) AS h_second, s.k AS d_second, round(mean_glyphs, 8) AS mean_glyphs FROM l JOIN s USING (lang) JOIN m USING (lang)""")
def shape_diagnostics(spark, d):
    shape = V.types(toks(spark, d, "lang"), "lang").withColumn("g", T.glyphs(F.col("w"))).select("lang", "n", F.element_at("g", -1).alias("last"), F.when(F.size("g") > 1, F.element_at("g", -2)).alias("second"), F.size("g").alias("k"))

    def side(c):
        cells = shape.where(F.col(c).isNotNull()).groupBy("lang", c).agg(F.sum("n").alias("n"))
        return I.entropy(cells, "lang").join(cells.groupBy("lang").agg(F.count("*").alias(f"d_{c}")), "lang").select("lang", F.round("entropy", 8).alias(f"h_{c}"), f"d_{c}")

    mean = shape.groupBy("lang").agg(F.round(F.sum(F.col("n") * F.col("k")) / F.sum("n"), 8).alias("mean_glyphs"))
    return side("last").join(side("second"), "lang").join(mean, "lang")


@query(f"""WITH {TURN} SELECT w, count(*) AS n, CAST(sum(CASE WHEN pos > 0 AND pos < n - 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_internal, CAST(sum(CASE WHEN pos = n - 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_last, round(avg(CASE WHEN pos = n - 1 THEN 1.0 ELSE 0.0 END), 9) AS last_rate FROM ttok GROUP BY w HAVING count(*) >= 20""")
def line_position_stats(spark, d):
    t = turn_tokens(spark, d)
    inner, last = (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1), F.col("pos") == F.col("n") - 1
    flag = lambda c: F.when(c, 1).otherwise(0)
    return t.groupBy("w").agg(F.count("*").alias("c"), F.sum(flag(inner)).alias("n_internal"), F.sum(flag(last)).alias("n_last"), F.round(F.avg(flag(last).cast("double")), 9).alias("last_rate")).where("c >= 20").withColumnRenamed("c", "n")


def turn_tokens(spark, d):
    turns = V.read(spark, d, "conversations").select("conv_id", "role", "turn", T.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    return turns.select("conv_id", "role", "turn", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "w"))


@query(f"""WITH {TURN}, p AS (SELECT {GLYPHS.format('w')} AS g, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok)
SELECT g[len(g)] AS terminal, ({GLYPHS.format('nxt')})[1] AS initial, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY ALL""")
def terminal_records_within(spark, d):
    nxt = V.adjacent(turn_tokens(spark, d), ("conv_id", "turn"))
    return nxt.groupBy(T.last_glyph(F.col("w")).alias("terminal"), T.first_glyph(F.col("nxt")).alias("initial")).agg(F.count("*").alias("n"))


@query(f"""WITH {TURN}, e AS (SELECT conv_id, turn, ws[len(ws)] AS w, lead(ws[1]) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM turns WHERE len(ws) > 0), p AS (SELECT {GLYPHS.format('w')} AS g, nxt FROM e WHERE nxt IS NOT NULL)
SELECT g[len(g)] AS terminal, ({GLYPHS.format('nxt')})[1] AS initial, count(*) AS n FROM p GROUP BY ALL""")
def terminal_records_across(spark, d):
    turns = V.read(spark, d, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    ends = turns.select(F.element_at("ws", -1).alias("w"), F.lead(F.get("ws", F.lit(0))).over(Window.partitionBy("conv_id").orderBy("turn")).alias("nxt")).where("nxt is not null")
    return ends.groupBy(T.last_glyph(F.col("w")).alias("terminal"), T.first_glyph(F.col("nxt")).alias("initial")).agg(F.count("*").alias("n"))


STEMS = f"""st AS (SELECT substr(w, 1, length(w) - length(e)) AS stem, e, nxt FROM (SELECT w, g[len(g)] AS e, nxt FROM (SELECT w, {GLYPHS.format('w')} AS g, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok)) WHERE e IN ('n', 'l', 'r')),
mod AS (SELECT stem, CAST(sum(CASE WHEN e = 'n' THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN e = 'l' THEN 1 ELSE 0 END) AS BIGINT) AS l, CAST(sum(CASE WHEN e = 'r' THEN 1 ELSE 0 END) AS BIGINT) AS r FROM st WHERE stem <> '' GROUP BY stem)"""


def boundary_model(tok):
    """stem and how often it ends in n, l and r: an aggregate with pivoted columns."""
    ends = tok.select(T.stem(F.col("w")).alias("stem"), T.last_glyph(F.col("w")).alias("e")).where(F.col("e").isin("n", "l", "r") & (F.col("stem") != ""))
    return ends.groupBy("stem").pivot("e", ["n", "l", "r"]).count().fillna(0)


@query(f"WITH {TOK}, {STEMS} SELECT stem, n, l, r FROM mod WHERE n + l + r >= 5")
def boundary_model_pivot(spark, d):
    return boundary_model(toks(spark, d)).where("n + l + r >= 5")


@query(f"WITH {TOK}, {STEMS} SELECT stem, CASE WHEN n >= l AND n >= r THEN 'n' WHEN l >= r THEN 'l' ELSE 'r' END AS terminal, n + l + r AS support FROM mod WHERE n + l + r >= 5")
def majority_terminal(spark, d):
    best = F.when((F.col("n") >= F.col("l")) & (F.col("n") >= F.col("r")), "n").when(F.col("l") >= F.col("r"), "l").otherwise("r")
    return boundary_model(toks(spark, d)).where("n + l + r >= 5").select("stem", best.alias("terminal"), (F.col("n") + F.col("l") + F.col("r")).alias("support"))


TYPES = "ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w)"
CUTS = f"""{TYPES}, cut AS (SELECT w, n, k, substr(w, 1, k) AS x, substr(w, k + 1) AS y FROM (SELECT w, n, CAST(unnest(range(1, length(w))) AS BIGINT) AS k FROM ty)),
both_ AS (SELECT c.w, c.n, c.k, c.x, c.y, a.n AS nx, b.n AS ny FROM cut c JOIN ty a ON a.w = c.x JOIN ty b ON b.w = c.y WHERE a.n >= 20 AND b.n >= 20)"""


def cut_types(ty, least: int = 20):
    """Every cut of a type into two types that each occur `least` times: w, n, k, x, y, nx, ny. Only the frequent halves are joined, each by its own key."""
    often = ty.where(F.col("n") >= least)
    rows = ty.select("w", "n", F.explode(T.cuts(F.col("w"))).alias("k")).select("w", "n", F.col("k").cast("long").alias("k"), F.expr("substring(w, 1, k)").alias("x"), F.expr("substring(w, k + 1)").alias("y"))
    return rows.join(often.select(F.col("w").alias("x"), F.col("n").alias("nx")), "x").join(often.select(F.col("w").alias("y"), F.col("n").alias("ny")), "y")


@query(f"""WITH {TOK}, {CUTS} SELECT w, n, k, x, y FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY least(nx, ny) DESC, k) AS r FROM both_ WHERE n < 20) WHERE r = 1""")
def hidden_boundaries(spark, d):
    r = F.row_number().over(Window.partitionBy("w").orderBy(F.desc(F.least("nx", "ny")), "k"))
    return cut_types(V.types(toks(spark, d))).where("n < 20").withColumn("r", r).where("r = 1").select("w", "n", "k", "x", "y")


@query(f"""WITH {TOK}, {CUTS}, t AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM ty)
SELECT w, k, n, round(ln(nx / total) + ln(ny / total) - ln(n / total), 6) AS llr FROM both_, t WHERE n >= 2""")
def candidate_splits_llr(spark, d):
    ty = V.types(toks(spark, d))
    total = ty.agg(F.sum("n").cast("double").alias("total"))
    x = lambda c: F.log(F.col(c) / F.col("total"))
    return cut_types(ty).where("n >= 2").crossJoin(total).select("w", "k", "n", F.round(x("nx") + x("ny") - x("n"), 6).alias("llr"))


@query(f"""WITH {TOK}, {TYPES}, cut AS (SELECT w, substr(w, k, 1) AS before, substr(w, k + 1) AS y FROM (SELECT w, CAST(unnest(range(1, length(w))) AS BIGINT) AS k FROM ty WHERE n >= 2))
SELECT CASE WHEN before IN ('n', 'l', 'r', 'm') THEN 'nlrm' ELSE 'other' END AS kind, count(*) AS cuts, count(b.w) AS hits, round(count(b.w) / CAST(count(*) AS DOUBLE), 9) AS rate FROM cut LEFT JOIN (SELECT w FROM ty WHERE n >= 20) b ON b.w = cut.y GROUP BY 1""")
def cut_position_rates(spark, d):
    ty = V.types(toks(spark, d))
    rows = ty.where("n >= 2").select("w", F.explode(T.cuts(F.col("w"))).alias("k")).selectExpr("substring(w, k, 1) AS before", "substring(w, k + 1) AS y")
    hit = rows.join(ty.where("n >= 20").select(F.col("w").alias("y"), F.lit(1).alias("hit")), "y", "left")
    kind = F.when(F.col("before").isin("n", "l", "r", "m"), "nlrm").otherwise("other")
    return hit.groupBy(kind.alias("kind")).agg(F.count("*").alias("cuts"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 9).alias("rate"))


@query(f"""WITH {TOK}, {CUTS} SELECT CAST(length(ty.w) AS BIGINT) AS len, count(*) AS rare_types, count(d.w) AS decomposable, round(count(d.w) / CAST(count(*) AS DOUBLE), 9) AS share FROM ty LEFT JOIN (SELECT DISTINCT w FROM both_) d USING (w) WHERE ty.n = 1 AND length(ty.w) >= 4 GROUP BY 1""")
def rare_decomposition(spark, d):
    ty = V.types(toks(spark, d))
    found = cut_types(ty).select("w", F.lit(1).alias("d")).distinct()
    return ty.where("n = 1 and length(w) >= 4").join(found, "w", "left").groupBy(F.length("w").cast("long").alias("len")).agg(F.count("*").alias("rare_types"), F.count("d").alias("decomposable"), F.round(F.count("d") / F.count("*"), 9).alias("share"))


@query(f"""WITH {TOK}, {CUTS}, adj AS (SELECT w, nxt, count(*) AS c FROM (SELECT w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL GROUP BY ALL)
SELECT count(*) AS splits, count(f.c) AS forward, count(r.c) AS backward, CAST(sum(CASE WHEN f.c IS NOT NULL AND r.c IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS forward_only, CAST(sum(CASE WHEN f.c IS NULL AND r.c IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS backward_only FROM both_ LEFT JOIN adj f ON f.w = x AND f.nxt = y LEFT JOIN adj r ON r.w = y AND r.nxt = x""")
def spaced_alternations(spark, d):
    tok = toks(spark, d)
    adj = V.beside(V.read(spark, d, "documents"), (), nxt=1).where("nxt is not null").groupBy("w", "nxt").agg(F.count("*").alias("c"))
    side = lambda a, b, n: adj.select(F.col("w").alias(a), F.col("nxt").alias(b), F.col("c").alias(n))
    rows = cut_types(V.types(tok)).join(side("x", "y", "f"), ["x", "y"], "left").join(side("y", "x", "r"), ["x", "y"], "left")
    only = lambda a, b: F.sum(F.when(F.col(a).isNotNull() & F.col(b).isNull(), 1).otherwise(0))
    return rows.agg(F.count("*").alias("splits"), F.count("f").alias("forward"), F.count("r").alias("backward"), only("f", "r").alias("forward_only"), only("r", "f").alias("backward_only"))


LATTICE = """pre AS (SELECT DISTINCT {k} substr(w, 1, 2) AS p, substr(w, 3) AS rest FROM {t} WHERE length(w) >= 5)
SELECT {ka} a.p AS p1, b.p AS p2, count(*) AS shared FROM pre a JOIN pre b ON a.rest = b.rest AND a.p < b.p {on} GROUP BY ALL HAVING count(*) >= {m}"""


def lattice(types, least: int, *keys: str):
    """Pairs of two-letter beginnings by how many remainders they share; remainders of one beginning are dropped before the join, and pairs of a remainder are made by one aggregated list of distinct beginnings, at most 26 * 26 long."""
    rows = types.where("length(w) >= 5").select(*keys, F.substring("w", 1, 2).alias("p"), F.expr("substring(w, 3)").alias("rest")).distinct()
    lists = rows.groupBy(*keys, "rest").agg(F.sort_array(F.collect_list("p")).alias("ps")).where(F.size("ps") > 1)
    pairs = lists.select(*keys, "ps", F.posexplode("ps").alias("i", "p1")).select(*keys, "p1", F.explode(F.expr("slice(ps, i + 2, size(ps))")).alias("p2"))
    return pairs.groupBy(*keys, "p1", "p2").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


@query(f"WITH {TOK}, {TYPES}, " + LATTICE.format(k="", ka="", t="ty", on="", m=3))
def prefix_lattice(spark, d):
    return lattice(V.types(toks(spark, d)), 3)


@query(f"WITH {TOK}, win AS (SELECT doc_id, pos // 500 AS win, w, count(*) OVER (PARTITION BY doc_id, pos // 500) AS size FROM tok), f AS (SELECT doc_id, win, w FROM win WHERE size = 500), " + LATTICE.format(k="doc_id, win,", ka="a.doc_id, a.win,", t="f", on="AND a.doc_id = b.doc_id AND a.win = b.win", m=3))
def lattice_windows(spark, d):
    """Tumbling windows of 500 words; the last, shorter one of a text is left out."""
    tok = toks(spark, d).withColumn("win", F.floor(F.col("pos") / 500).cast("long"))
    full = tok.groupBy("doc_id", "win").agg(F.count("*").alias("size"), F.collect_set("w").alias("ws")).where("size = 500").select("doc_id", "win", F.explode("ws").alias("w"))
    return lattice(full, 3, "doc_id", "win")


@query(f"""WITH {LINE}, e AS (SELECT w, pos = n - 1 AS last FROM ltok), s AS (SELECT substr(w, 1, length(w) - 1) AS stem, right(w, 1) AS e, last FROM e WHERE length(w) > 2)
SELECT e, count(*) AS n, CAST(sum(CASE WHEN last THEN 1 ELSE 0 END) AS BIGINT) AS n_last, round(avg(CASE WHEN last THEN 1.0 ELSE 0.0 END), 9) AS last_rate FROM s WHERE stem IN (SELECT stem FROM s GROUP BY stem HAVING count(DISTINCT e) >= 3) GROUP BY e""")
def line_final_rate_siblings(spark, d):
    """Rates at line ends by last letter, over stems with three endings or more."""
    t = V.line_tokens(V.read(spark, d, "documents")).where("length(w) > 2").select(F.expr("substring(w, 1, length(w) - 1)").alias("stem"), F.expr("right(w, 1)").alias("e"), (F.col("pos") == F.col("n") - 1).alias("last"))
    cells = t.groupBy("stem", "e").agg(F.count("*").alias("n"), F.sum(F.col("last").cast("int")).alias("n_last"))
    many = cells.groupBy("stem").agg(F.count("*").alias("k")).where("k >= 3").select("stem")
    return cells.join(many, "stem", "left_semi").groupBy("e").agg(F.sum("n").alias("n"), F.sum("n_last").alias("n_last")).withColumn("last_rate", F.round(F.col("n_last") / F.col("n"), 9))


@query(f"""WITH {LINE}, st AS (SELECT substr(w, 1, length(w) - 1) AS stem, right(w, 1) AS e, count(*) AS n FROM ltok WHERE length(w) > 1 GROUP BY ALL), ty AS (SELECT w, count(*) AS n FROM ltok GROUP BY w)
SELECT e, CAST(sum(st.n) AS BIGINT) AS tokens, count(*) AS stems, round(avg(CASE WHEN ty.w IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS attested, round(avg(CASE WHEN ty.n >= 20 THEN 1.0 ELSE 0.0 END), 9) AS common FROM st LEFT JOIN ty ON ty.w = st.stem GROUP BY e HAVING sum(st.n) >= 20""")
def ending_table(spark, d):
    ty = V.types(V.line_tokens(V.read(spark, d, "documents")))
    st = ty.where("length(w) > 1").select(F.expr("substring(w, 1, length(w) - 1)").alias("stem"), F.expr("right(w, 1)").alias("e"), "n").join(ty.select(F.col("w").alias("stem"), F.col("n").alias("m")), "stem", "left")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return st.groupBy("e").agg(F.sum("n").alias("tokens"), F.count("*").alias("stems"), share(F.col("m").isNotNull()).alias("attested"), share(F.col("m") >= 20).alias("common")).where("tokens >= 20")


@query(f"""WITH {LINE}, f AS (SELECT doc_id, w FROM ltok WHERE pos = 0), c AS (SELECT w, count(*) AS n FROM f GROUP BY w) SELECT lang, count(*) AS lines, round(avg(CASE WHEN c.n = 1 THEN 1.0 ELSE 0.0 END), 9) AS unique_share FROM ltok JOIN c USING (w) WHERE pos = 0 GROUP BY lang""")
def first_token_uniqueness(spark, d):
    first = V.line_tokens(V.read(spark, d, "documents"), ("doc_id", "lang")).where("pos = 0").groupBy("lang", "w").agg(F.count("*").alias("k"))
    often = first.groupBy("w").agg(F.sum("k").alias("n"))
    return first.join(often, "w").groupBy("lang").agg(F.sum("k").alias("lines"), F.round(F.sum(F.when(F.col("n") == 1, F.col("k")).otherwise(0)) / F.sum("k"), 9).alias("unique_share"))


@query(f"""WITH {TOK}, {TYPES} SELECT regexp_replace(regexp_replace(regexp_replace(w, '^q?o?', ''), 'e+', 'e', 'g'), 'i+', 'i', 'g') AS family, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_tokens FROM ty GROUP BY 1""")
def stem_families(spark, d):
    return V.types(toks(spark, d)).groupBy(T.stem_family(F.col("w")).alias("family")).agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"))
