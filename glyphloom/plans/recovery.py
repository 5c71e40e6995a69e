"""Forms, units, codebooks and the recovery of joined words: claims re-computed, each from counts that leave out what is tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import information as I
from ..operators import views as V
from .controls import md5_of
from .profiles import cut_types, lattice, toks, turn_tokens
from .registry import GLYPHS, TOK, TURN, UNIFORM, query

TYPES = "ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w)"
SAME = "list_sum(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: CASE WHEN {0}(a, i) = {0}(b, i) THEN 1 ELSE 0 END))"


@query(f"""WITH {TOK}, {TYPES}, f AS (SELECT w, n, left(w, length(w) - 1) AS stem FROM ty WHERE n >= 20 AND length(w) >= 3), p AS (SELECT x.w AS a, y.w AS b, x.n AS na, y.n AS nb FROM f x JOIN f y ON x.stem = y.stem AND x.w < y.w)
SELECT a, b, CAST({SAME.format('left')} AS INTEGER) AS common_prefix, CAST({SAME.format('right')} AS INTEGER) AS common_suffix, CAST(levenshtein(a, b) AS INTEGER) AS distance, round(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 8) AS similarity, left(a, 1) = left(b, 1) AS same_first, round(abs(ln(CAST(na AS DOUBLE) / nb)), 8) AS frequency_gap FROM p""")
def form_features(spark, d):
    """How alike two words of a stem are in form and frequency."""
    f = V.types(toks(spark, d)).where("n >= 20 and length(w) >= 3").withColumn("stem", F.expr("left(w, length(w) - 1)"))
    side = lambda c: f.select("stem", F.col("w").alias(c), F.col("n").alias(f"n{c}"))
    p = side("a").join(side("b"), "stem").where("a < b")
    same = lambda end: F.expr(f"cast(aggregate(transform(sequence(1, least(length(a), length(b))), i -> if({end}(a, i) = {end}(b, i), 1, 0)), 0, (s, x) -> s + x) as int)")
    e = F.levenshtein("a", "b")
    return p.select("a", "b", same("left").alias("common_prefix"), same("right").alias("common_suffix"), e.alias("distance"), F.round(1 - e / F.greatest(F.length("a"), F.length("b")), 8).alias("similarity"), F.expr("left(a, 1) = left(b, 1)").alias("same_first"), F.round(F.abs(F.log(F.col("na") / F.col("nb"))), 8).alias("frequency_gap"))


@query(f"""WITH {TOK}, ty AS (SELECT lang, w, count(*) AS n FROM tok GROUP BY ALL), u AS (SELECT lang, 'letter' AS kind, unnest(string_split(w, '')) AS u, n FROM ty UNION ALL SELECT lang, 'pair', unnest(regexp_extract_all(w, '..?')), n FROM ty UNION ALL SELECT lang, 'glyph', unnest({GLYPHS.format('w')}), n FROM ty UNION ALL SELECT lang, 'word', w, n FROM ty), c AS (SELECT lang, kind, u, CAST(sum(n) AS DOUBLE) AS n FROM u WHERE u <> '' GROUP BY ALL)
SELECT lang, kind, count(*) AS units, CAST(sum(n) AS BIGINT) AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 8) AS entropy FROM c GROUP BY lang, kind""")
def unit_streams(spark, d):
    """Units of four kinds: how many, how often, and their entropy."""
    ty = V.types(toks(spark, d, "lang"), "lang")
    kinds = {"letter": F.filter(F.split("w", ""), lambda x: x != ""), "pair": F.regexp_extract_all("w", F.lit("..?"), F.lit(0)), "glyph": T.glyphs(F.col("w")), "word": F.array("w")}
    rows = ty.select("lang", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), u.alias("us")) for k, u in kinds.items()))).alias("x")).select("lang", "n", "x.kind", F.explode("x.us").alias("u"))
    cells = rows.groupBy("lang", "kind", "u").agg(F.sum("n").alias("n"))
    many = cells.groupBy("lang", "kind").agg(F.count("*").alias("units"))
    return I.entropy(cells, "lang", "kind").join(many, ["lang", "kind"]).select("lang", "kind", "units", F.col("total").cast("long").alias("total"), F.round("entropy", 8).alias("entropy"))


@query(f"""WITH {TOK}, k AS (SELECT lang, left(w, 1) AS c, count(*) AS n FROM tok GROUP BY ALL) SELECT lang, count(*) AS entries, round(sum(log2(1 + n)) + count(*) * log2(26), 7) AS bits FROM k GROUP BY lang""")
def key_description_length(spark, d):
    """Bits to write down a key that gives each initial a number of codes."""
    k = toks(spark, d, "lang").groupBy("lang", F.expr("left(w, 1)").alias("c")).agg(F.count("*").alias("n"))
    return k.groupBy("lang").agg(F.count("*").alias("entries"), F.round(F.sum(F.log2(1 + F.col("n"))) + F.count("*") * F.log2(F.lit(26.0)), 7).alias("bits"))


@query(f"""WITH {TOK}, {TYPES}, b AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM benchmark)), h AS (SELECT b.item_id, b.pos, ty.w IS NOT NULL AS hit FROM b LEFT JOIN ty ON ty.w = b.w AND ty.n >= 5),
i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY pos) AS island FROM h), r AS (SELECT item_id, island, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS run, count(*) AS n FROM i GROUP BY ALL)
SELECT item_id, CAST(sum(n) AS BIGINT) AS words, CAST(sum(run) AS BIGINT) AS hits, CAST(max(run) AS BIGINT) AS longest_run FROM r GROUP BY item_id""")
def word_hits(spark, d):
    """Words of each passage that the documents have five times or more, and the longest run of them."""
    known = V.types(toks(spark, d)).where("n >= 5").select("w", F.lit(1).alias("hit"))
    b = V.tokens(V.read(spark, d, "benchmark"), ("item_id",)).join(known, "w", "left")
    island = F.sum(F.when(F.col("hit") == 1, 0).otherwise(1)).over(Window.partitionBy("item_id").orderBy("pos"))
    r = b.withColumn("island", island).groupBy("item_id", "island").agg(F.count("hit").alias("run"), F.count("*").alias("n"))
    return r.groupBy("item_id").agg(F.sum("n").alias("words"), F.sum("run").alias("hits"), F.max("run").alias("longest_run"))


def nested(function: str, pairs, inner: str = "w") -> str:
    for a, b in pairs:
        inner = f"{function}({inner}, '{a}', '{b}')"
    return inner


SIGNS = tuple(zip(T.COMPOUNDS, "123456"))


@query(f"WITH {TOK}, {TYPES}, c AS (SELECT w, {nested('replace', SIGNS)} AS code FROM ty) SELECT CAST(length(w) - length(code) AS INTEGER) AS saved, count(*) AS types, CAST(sum(CASE WHEN {nested('replace', [(b, a) for a, b in SIGNS], 'code')} = w THEN 1 ELSE 0 END) AS BIGINT) AS restored FROM c GROUP BY 1")
def compound_codes(spark, d):
    """Glyphs of several letters written as one sign and back."""
    c = V.types(toks(spark, d)).select("w", F.expr(nested("replace", SIGNS)).alias("code")).withColumn("back", F.expr(nested("replace", [(b, a) for a, b in SIGNS], "code")))
    return c.groupBy((F.length("w") - F.length("code")).alias("saved")).agg(F.count("*").alias("types"), F.sum((F.col("back") == F.col("w")).cast("int")).alias("restored"))


@query(f"""WITH {TOK}, {TYPES}, f AS (SELECT w, n, regexp_replace(regexp_replace(regexp_replace(w, '^q?o?', ''), 'e+', 'e', 'g'), 'i+', 'i', 'g') AS family FROM ty) SELECT f.w, CASE WHEN t.n >= f.n THEN f.family ELSE f.w END AS form FROM f LEFT JOIN ty t ON t.w = f.family WHERE f.w <> f.family""")
def normalised_types(spark, d):
    """Words whose family's form is another word: that form, if it is there and not rarer, else as they are."""
    ty = V.types(toks(spark, d))
    f = ty.withColumn("family", T.stem_family(F.col("w"))).where("w <> family")
    return f.join(ty.select(F.col("w").alias("family"), F.col("n").alias("m")), "family", "left").select("w", F.when(F.col("m") >= F.col("n"), F.col("family")).otherwise(F.col("w")).alias("form"))


@query(f"""WITH {TOK}, p AS (SELECT doc_id, lang, w, count(*) AS n FROM tok GROUP BY ALL), {TYPES}, own AS (SELECT p.doc_id, p.lang, p.w FROM p JOIN ty USING (w) WHERE ty.n = p.n AND length(p.w) >= 4), c AS (SELECT doc_id, lang, w, k, substr(w, 1, k) AS x, substr(w, k + 1) AS y FROM (SELECT doc_id, lang, w, CAST(unnest(range(1, length(w))) AS BIGINT) AS k FROM own)),
j AS (SELECT DISTINCT c.doc_id, c.lang, c.w FROM c JOIN ty a ON a.w = x JOIN ty b ON b.w = y LEFT JOIN p pa ON pa.doc_id = c.doc_id AND pa.w = x LEFT JOIN p pb ON pb.doc_id = c.doc_id AND pb.w = y WHERE a.n - coalesce(pa.n, 0) >= 20 AND b.n - coalesce(pb.n, 0) >= 20)
SELECT own.lang, count(*) AS types, count(j.w) AS split, round(count(j.w) / CAST(count(*) AS DOUBLE), 9) AS rate FROM own LEFT JOIN j ON j.doc_id = own.doc_id AND j.w = own.w GROUP BY own.lang""")
def left_out_page_splits(spark, d):
    """Types that one page alone has, and those that part into two words frequent on the other pages: counts without a page are totals less its own."""
    tok = toks(spark, d, "lang")
    p = tok.groupBy("doc_id", "lang", "w").agg(F.count("*").alias("n"))
    ty = p.groupBy("w").agg(F.sum("n").alias("total"))
    own = p.join(ty, "w").where("total = n and length(w) >= 4").select("doc_id", "lang", "w")
    often = ty.where("total >= 20")
    cuts = own.select("doc_id", "w", F.explode(T.cuts(F.col("w"))).alias("k")).selectExpr("doc_id", "w", "substring(w, 1, k) AS x", "substring(w, k + 1) AS y")
    for c in "xy":
        cuts = cuts.join(often.select(F.col("w").alias(c), F.col("total").alias(f"n{c}")), c).join(p.select("doc_id", F.col("w").alias(c), F.col("n").alias(f"p{c}")), ["doc_id", c], "left")
    found = cuts.fillna(0, ["px", "py"]).where("nx - px >= 20 and ny - py >= 20").select("doc_id", "w", F.lit(1).alias("hit")).distinct()
    out = own.join(found, ["doc_id", "w"], "left").groupBy("lang").agg(F.count("*").alias("types"), F.count("hit").alias("split"))
    return out.withColumn("rate", F.round(F.col("split") / F.col("types"), 9))


@query(f"""WITH {TOK}, win AS (SELECT lang, doc_id, pos // 500 AS win, w, count(*) OVER (PARTITION BY doc_id, pos // 500) AS size FROM tok), g AS (SELECT lang, doc_id, win, {GLYPHS.format('w')} AS g FROM win WHERE size = 500), b AS (SELECT lang, doc_id, win, g[i] AS a, g[i + 1] AS b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT lang, doc_id, win, g, unnest(range(1, len(g))) AS i FROM g) GROUP BY ALL),
h AS (SELECT lang, doc_id, win, -sum(n / tot * log2(n / na)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, win) AS tot, sum(n) OVER (PARTITION BY doc_id, win, a) AS na FROM b) GROUP BY ALL) SELECT lang, count(*) AS windows, round(min(h), 7) AS low, round(avg(h), 7) AS mean, round(max(h), 7) AS high FROM h GROUP BY lang""")
def windowed_glyph_entropy(spark, d):
    """Entropy of a glyph given the one before it in the word, in whole windows of 500 words."""
    keys = ["lang", "doc_id", "win"]
    tok = toks(spark, d, "lang").withColumn("win", F.floor(F.col("pos") / 500).cast("long"))
    full = tok.groupBy("doc_id", "win").agg(F.count("*").alias("size")).where("size = 500").select("doc_id", "win")
    g = tok.join(full, ["doc_id", "win"], "left_semi").select(*keys, T.glyphs(F.col("w")).alias("g")).where(F.size("g") > 1)
    pairs = g.select(*keys, F.explode(F.arrays_zip(F.expr("slice(g, 1, size(g) - 1)").alias("a"), F.expr("slice(g, 2, size(g) - 1)").alias("b"))).alias("p"))
    cells = pairs.groupBy(*keys, F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b")).agg(F.count("*").alias("n"))
    two, one = I.entropy(cells, *keys), I.entropy(cells.groupBy(*keys, "a").agg(F.sum("n").alias("n")), *keys)
    h = two.select(*keys, F.col("entropy").alias("h2")).join(one.select(*keys, F.col("entropy").alias("h1")), keys).withColumn("h", F.col("h2") - F.col("h1"))
    return h.groupBy("lang").agg(F.count("*").alias("windows"), *(F.round(f("h"), 7).alias(n) for n, f in (("low", F.min), ("mean", F.avg), ("high", F.max))))


@query(f"""WITH {TOK}, win AS (SELECT doc_id, pos // 500 AS win, w, count(*) OVER (PARTITION BY doc_id, pos // 500) AS size FROM tok), pre AS (SELECT DISTINCT doc_id, win, substr(w, 1, 2) AS p, substr(w, 3) AS rest FROM win WHERE size = 500 AND length(w) >= 5), c AS (SELECT a.doc_id, a.win, a.p AS p1, b.p AS p2, count(*) AS shared FROM pre a JOIN pre b ON a.rest = b.rest AND a.p < b.p AND a.doc_id = b.doc_id AND a.win = b.win GROUP BY ALL)
SELECT doc_id, win, p1, p2, shared FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, win ORDER BY shared DESC, p1, p2) AS r FROM c) WHERE r = 1""")
def window_top_pairs(spark, d):
    """The two beginnings that share most remainders, window by window."""
    tok = toks(spark, d).withColumn("win", F.floor(F.col("pos") / 500).cast("long"))
    full = tok.groupBy("doc_id", "win").agg(F.count("*").alias("size"), F.collect_set("w").alias("ws")).where("size = 500").select("doc_id", "win", F.explode("ws").alias("w"))
    best = lattice(full, 1, "doc_id", "win").groupBy("doc_id", "win").agg(F.min(F.struct((-F.col("shared")).alias("s"), "p1", "p2")).alias("x"))
    return best.select("doc_id", "win", "x.p1", "x.p2", (-F.col("x.s")).alias("shared"))


JOINED = """j AS (SELECT DISTINCT turn % 3 AS fold, w, nxt FROM (SELECT turn, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok) WHERE nxt IS NOT NULL AND length(w) >= 2 AND length(nxt) >= 2), fq AS (SELECT turn % 3 AS fold, w, count(*) AS n FROM ttok GROUP BY ALL), al AS (SELECT w, sum(n) AS n FROM fq GROUP BY w),
c AS (SELECT fold, w, nxt, k, substr(w || nxt, 1, k) AS x, substr(w || nxt, k + 1) AS y FROM (SELECT fold, w, nxt, CAST(unnest(range(1, length(w) + length(nxt))) AS BIGINT) AS k FROM j)),
s AS (SELECT c.fold, c.w, c.nxt, k, least(a.n - coalesce(fa.n, 0), b.n - coalesce(fb.n, 0)) AS score FROM c JOIN al a ON a.w = x JOIN al b ON b.w = y LEFT JOIN fq fa ON fa.fold = c.fold AND fa.w = x LEFT JOIN fq fb ON fb.fold = c.fold AND fb.w = y)"""


def located(spark, d) -> DataFrame:
    """fold, w, nxt and the best cut (k, score) of two neighbouring words written as one, by how often the rarer half occurs in the other two folds of lines; null where no cut has both halves there."""
    t = turn_tokens(spark, d).withColumn("fold", F.col("turn") % 3)
    pairs = t.withColumn("nxt", F.lead("w").over(V.within("conv_id", "turn"))).where("length(w) >= 2 and length(nxt) >= 2").select("fold", "w", "nxt").distinct()
    own = t.groupBy("fold", "w").agg(F.count("*").alias("n"))
    every = own.groupBy("w").agg(F.sum("n").alias("n"))
    cuts = pairs.select("*", F.explode(F.expr("sequence(1, length(w) + length(nxt) - 1)")).alias("k")).selectExpr("fold", "w", "nxt", "k", "substring(concat(w, nxt), 1, k) AS x", "substring(concat(w, nxt), k + 1) AS y")
    for c in "xy":
        cuts = cuts.join(every.select(F.col("w").alias(c), F.col("n").alias(f"n{c}")), c).join(own.select("fold", F.col("w").alias(c), F.col("n").alias(f"f{c}")), ["fold", c], "left")
    scored = cuts.fillna(0, ["fx", "fy"]).withColumn("score", F.least(F.col("nx") - F.col("fx"), F.col("ny") - F.col("fy"))).where("score > 0")
    best = scored.groupBy("fold", "w", "nxt").agg(F.min(F.struct((-F.col("score")).alias("s"), "k")).alias("x"))
    return pairs.join(best, ["fold", "w", "nxt"], "left").select("fold", "w", "nxt", "x.k", (-F.col("x.s")).alias("score"))


@query(f"""WITH {TURN}, {JOINED}, b AS (SELECT *, row_number() OVER (PARTITION BY fold, w, nxt ORDER BY score DESC, k) AS r FROM s WHERE score > 0) SELECT CAST(j.fold AS BIGINT) AS fold, count(*) AS pairs, count(b.k) AS evaluable, CAST(sum(CASE WHEN b.k = length(j.w) THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM j LEFT JOIN b ON b.fold = j.fold AND b.w = j.w AND b.nxt = j.nxt AND b.r = 1 GROUP BY 1""")
def boundary_localisation(spark, d):
    """How often the place where two words were joined is found again, from the other lines' counts."""
    return located(spark, d).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("pairs"), F.count("k").alias("evaluable"), F.sum(F.when(F.col("k") == F.length("w"), 1).otherwise(0)).alias("correct"))


@query(f"""WITH {TURN}, {JOINED}, best AS (SELECT j.fold, j.w, j.nxt, coalesce(max(CASE WHEN score > 0 THEN score END), 0) AS score FROM j LEFT JOIN s USING (fold, w, nxt) GROUP BY ALL), lv AS (SELECT unnest([1, 2, 3, 5, 8, 13]) AS t), x AS (SELECT t, md5(w || nxt) < '8' AS train, score >= t AS called, length(w) + length(nxt) >= 8 AS long FROM best, lv),
r AS (SELECT t, train, (avg(CASE WHEN long THEN CASE WHEN called THEN 1.0 ELSE 0.0 END END) + avg(CASE WHEN NOT long THEN CASE WHEN called THEN 0.0 ELSE 1.0 END END)) / 2 AS balanced FROM x GROUP BY ALL), p AS (SELECT t FROM r WHERE train ORDER BY round(balanced, 9) DESC, t LIMIT 1)
SELECT CAST(r.t AS INTEGER) AS threshold, r.train, round(r.balanced, 8) AS balanced FROM r JOIN p USING (t)""")
def learned_threshold(spark, d):
    """The least score at which joined words are called long, chosen by balanced accuracy on one half, and its accuracy on both."""
    rows = located(spark, d).select((F.md5(F.concat("w", "nxt")) < "8").alias("train"), F.coalesce("score", F.lit(0)).alias("score"), ((F.length("w") + F.length("nxt")) >= 8).alias("long"), F.explode(F.array(*(F.lit(t) for t in (1, 2, 3, 5, 8, 13)))).alias("threshold"))
    called = F.col("score") >= F.col("threshold")
    share = lambda who, what: F.avg(F.when(who, what.cast("double")))
    r = rows.groupBy("threshold", "train").agg(((share(F.col("long"), called) + share(~F.col("long"), ~called)) / 2).alias("balanced"))
    best = r.where("train").agg(F.min(F.struct((-F.round("balanced", 9)).alias("b"), "threshold")).alias("x")).select("x.threshold")
    return r.join(F.broadcast(best), "threshold").select("threshold", "train", F.round("balanced", 8).alias("balanced"))  # one row


@query("SELECT source, CAST(seed AS INTEGER) AS seed, CAST(size AS INTEGER) AS size, md5(concat_ws('|', source, seed, size)) AS key FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(range(4)) AS seed), (SELECT unnest([2000, 5000]) AS size)")
def configuration_grid(spark, d):
    """Every configuration of source, seed and window, with its key."""
    cells = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.lit(n).alias("size")) for s in range(4) for n in (2000, 5000))))
    rows = V.read(spark, d, "documents").select("source").distinct().select("source", cells.alias("x")).select("source", "x.seed", "x.size")
    return rows.withColumn("key", md5_of(F.col("source"), F.col("seed"), F.col("size")))


@query(f"""WITH {TOK}, {TYPES}, l AS (SELECT c, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT unnest(string_split(w, '')) AS c, n FROM ty) WHERE c <> '' GROUP BY c), q AS (SELECT c, 100 * n / (SELECT sum(n) FROM l) AS share FROM l), f AS (SELECT c, share, CAST(floor(share) AS BIGINT) AS base, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, c) AS r FROM q)
SELECT c AS letter, CAST(base + CASE WHEN r <= 100 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS codes FROM f""")
def homophone_allocation(spark, d):
    """A hundred codes given to letters by their frequency, those left over to the largest remainders."""
    ty = V.types(toks(spark, d))
    l = ty.select(F.explode(F.split("w", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").cast("double").alias("n"))
    q = l.crossJoin(l.agg(F.sum("n").alias("all"))).select("c", (100 * F.col("n") / F.col("all")).alias("share")).withColumn("base", F.floor("share"))  # 26 letters
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), "c")
    left = q.agg((100 - F.sum("base")).alias("left"))
    return q.withColumn("r", F.row_number().over(order)).crossJoin(left).select(F.col("c").alias("letter"), (F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).cast("long").alias("codes"))


GRAMMAR = """pt AS (SELECT left(w, 1) AS a, substr(w, 2, length(w) - 2) AS m, right(w, 1) AS z, n FROM ty WHERE length(w) BETWEEN 3 AND 5), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM pt), pa AS (SELECT a, sum(n) AS n FROM pt GROUP BY a ORDER BY n DESC, a LIMIT 6), pm AS (SELECT m, sum(n) AS n FROM pt GROUP BY m ORDER BY n DESC, m LIMIT 6), pz AS (SELECT z, sum(n) AS n FROM pt GROUP BY z ORDER BY n DESC, z LIMIT 6)"""


@query(f"""WITH {TOK}, {TYPES}, {GRAMMAR} SELECT a || m || z AS w, round(sum(log2(pa.n / t) + log2(pm.n / t) + log2(pz.n / t)), 7) AS bits, max(CASE WHEN ty.w IS NOT NULL THEN 1 ELSE 0 END) = 1 AS attested FROM pa CROSS JOIN pm CROSS JOIN pz CROSS JOIN tot LEFT JOIN ty ON ty.w = a || m || z GROUP BY 1""")
def slot_grammar(spark, d):
    """Words that a grammar of three slots makes of the six most frequent parts of each, their bits, and whether they are there."""
    ty = V.types(toks(spark, d))
    parts = ty.where("length(w) between 3 and 5").selectExpr("left(w, 1) AS a", "substring(w, 2, length(w) - 2) AS m", "right(w, 1) AS z", "n")
    total = parts.agg(F.sum("n").cast("double").alias("t"))
    top = lambda c: parts.groupBy(c).agg(F.sum("n").alias(f"n{c}")).orderBy(F.desc(f"n{c}"), c).limit(6)
    made = top("a").crossJoin(top("m")).crossJoin(top("z")).crossJoin(total)  # six rows each
    bits = sum((F.log2(F.col(f"n{c}") / F.col("t")) for c in "mz"), F.log2(F.col("na") / F.col("t")))
    rows = made.select(F.concat("a", "m", "z").alias("w"), bits.alias("bits")).groupBy("w").agg(F.round(F.sum("bits"), 7).alias("bits"))
    return rows.join(ty.select("w", F.lit(True).alias("there")), "w", "left").select("w", "bits", F.coalesce("there", F.lit(False)).alias("attested"))


@query(f"""WITH {TURN}, u AS (SELECT w, {UNIFORM.format("concat_ws('|', 6, conv_id, turn, pos)")} AS u FROM ttok) SELECT w || CASE WHEN u < 0.5 THEN '1' WHEN u < 0.8 THEN '2' ELSE '3' END AS code, count(*) AS n FROM u GROUP BY 1""")
def word_homophone_counts(spark, d):
    """Each word under one of three codes, drawn with chances 1/2, 3/10 and 1/5."""
    u = T.hash_uniform(F.lit(6), F.col("conv_id"), F.col("turn"), F.col("pos"))
    rows = turn_tokens(spark, d).select("w", u.alias("u"))
    return rows.groupBy(F.concat("w", F.when(F.col("u") < 0.5, "1").when(F.col("u") < 0.8, "2").otherwise("3")).alias("code")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, r AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM (SELECT lang, w, count(*) AS n FROM tok GROUP BY ALL)) SELECT a.w AS word, b.w AS code, CAST(a.k AS INTEGER) AS rank FROM r a JOIN r b ON a.k = b.k WHERE a.lang = 'en' AND b.lang = 'es'""")
def ranked_codebook(spark, d):
    """A codebook that gives each word of one section the word of another with its rank."""
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    r = V.types(toks(spark, d, "lang").where(F.col("lang").isin("en", "es")), "lang").withColumn("rank", k)
    side = lambda x, name: r.where(F.col("lang") == x).select("rank", F.col("w").alias(name))
    return side("en", "word").join(side("es", "code"), "rank").select("word", "code", "rank")


@query(f"""WITH {TURN}, x AS (SELECT left(w, 1) AS c, CASE WHEN nxt IS NULL THEN '$' WHEN left(nxt, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'v' ELSE 'k' END AS ctx, {UNIFORM.format("concat_ws('|', 8, conv_id, turn, pos)")} AS u FROM (SELECT conv_id, turn, pos, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok)) SELECT c || ctx || CASE WHEN u < 0.6 THEN '1' ELSE '2' END AS code, count(*) AS n FROM x GROUP BY 1""")
def context_codes(spark, d):
    """Codes of initials that depend on the next word's beginning, each drawn from two."""
    nxt = F.lead("w").over(V.within("conv_id", "turn"))
    u = T.hash_uniform(F.lit(8), F.col("conv_id"), F.col("turn"), F.col("pos"))
    rows = turn_tokens(spark, d).select(F.expr("left(w, 1)").alias("c"), F.when(nxt.isNull(), "$").when(F.substring(nxt, 1, 1).isin(*"aeiou"), "v").otherwise("k").alias("ctx"), u.alias("u"))
    return rows.groupBy(F.concat("c", "ctx", F.when(F.col("u") < 0.6, "1").otherwise("2")).alias("code")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, min(value) AS oracle, min(CASE WHEN event_type = 'view' THEN value END) AS selected FROM events GROUP BY user_id) SELECT CASE WHEN selected IS NULL THEN 'none' WHEN selected = oracle THEN 'found' WHEN selected - oracle < 0.5 THEN 'near' ELSE 'missed' END AS gap, count(*) AS n FROM s GROUP BY 1""")
def gap_diagnosis(spark, d):
    """Whether what a search selected is as good as the best there was."""
    s = V.read(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("oracle"), F.min(F.when(F.col("event_type") == "view", F.col("value"))).alias("selected"))
    gap = F.when(F.col("selected").isNull(), "none").when(F.col("selected") == F.col("oracle"), "found").when(F.col("selected") - F.col("oracle") < 0.5, "near").otherwise("missed")
    return s.groupBy(gap.alias("gap")).agg(F.count("*").alias("n"))


@query()
def forest_sensitivity(spark, d):
    """Quality of held-out documents told by a random forest of five text shares. No SQL."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    share = lambda p: F.length(F.regexp_replace("text", p, "")) / F.greatest(F.length("text"), F.lit(1))
    names = {"letters": share("[^A-Za-z]"), "blanks": share(r"[^\s]"), "marks": share("[^.,;:!?]"), "digits": share("[^0-9]"), "size": F.log(1.0 + F.length("text"))}
    rows = V.read(spark, d, "documents").where("text is not null").join(V.read(spark, d, "labels"), "doc_id").select(F.col("quality").cast("double").alias("label"), T.hash_fold(F.col("doc_id"), 4).alias("fold"), *(c.alias(n) for n, c in names.items()))
    ready = VectorAssembler(inputCols=[*names], outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=20, maxDepth=5, seed=3).fit(ready.where("fold > 0"))
    out = model.transform(ready.where("fold = 0"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
