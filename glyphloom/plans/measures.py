"""Information, nulls, lags, contexts, joins, sets, predictions, language models, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import information as I
from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import resampling as R
from ..operators import views as V
from .profiles import toks, turn_tokens
from .registry import GLYPHS, LINE, TOK, TURN, UNIFORM, mi_sql, query

#: Edges of neighbouring words: the last letter of one and the first of the next.
EDGE = f"""edge AS (SELECT doc_id, lang, pos, right(w, 1) AS a, left(nxt, 1) AS b FROM (SELECT doc_id, lang, pos, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL)"""


def edges(spark, d):
    return V.beside(V.read(spark, d, "documents"), ("doc_id", "lang"), nxt=1).where("nxt is not null").select("doc_id", "lang", "pos", F.expr("right(w, 1)").alias("a"), F.expr("left(nxt, 1)").alias("b"))


def counted(rows, *keys):
    return rows.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


@query(f"WITH {TOK}, {EDGE}, c AS (SELECT a, b, count(*) AS n FROM edge GROUP BY ALL) SELECT CAST(total AS BIGINT) AS total, round(mi, 8) AS mi FROM ({mi_sql('c')})")
def adjacent_mi(spark, d):
    return I.mutual_information(counted(edges(spark, d))).select("total", F.round("mi", 8).alias("mi"))


@query(f"WITH {TOK}, {EDGE}, c AS (SELECT lang, a, b, count(*) AS n FROM edge GROUP BY ALL) SELECT lang, CAST(total AS BIGINT) AS total, round(mi, 8) AS mi FROM ({mi_sql('c', 'lang')})")
def stratified_mi(spark, d):
    return I.mutual_information(counted(edges(spark, d), "lang"), "lang").select("lang", "total", F.round("mi", 8).alias("mi"))


@query(f"WITH {TOK}, {EDGE}, c AS (SELECT lang, a, b, count(*) AS n FROM edge GROUP BY ALL) SELECT CAST(sum(total) AS BIGINT) AS total, round(sum(total * mi) / sum(total), 8) AS cmi FROM ({mi_sql('c', 'lang')})")
def conditional_mi(spark, d):
    return I.conditional_information(counted(edges(spark, d), "lang"), "lang").select("total", F.round("cmi", 8).alias("cmi"))


@query(f"""WITH c AS (SELECT year(l_shipdate) AS y, l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(y AS INTEGER) AS y, CAST(total AS BIGINT) AS total, round(mi, 8) AS mi FROM ({mi_sql('c', 'y')})""")
def flag_status_mi_by_year(spark, d):
    cells = V.read(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"))
    return I.mutual_information(cells, "y").select("y", "total", F.round("mi", 8).alias("mi"))


BIN = "CASE WHEN n = 1 THEN '1' WHEN n < 10 THEN '2-9' WHEN n < 100 THEN '10-99' ELSE '100+' END"


def frequency_bin(n):
    return F.when(n == 1, "1").when(n < 10, "2-9").when(n < 100, "10-99").otherwise("100+")


@query(f"""WITH {TOK}, ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w), c AS (SELECT w AS a, lang AS b, count(*) AS n FROM tok GROUP BY ALL), na AS (SELECT a, sum(n) AS na FROM c GROUP BY a), nb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM c)
SELECT bin, CAST(sum(c.n) AS BIGINT) AS pairs, round(sum(CAST(c.n AS DOUBLE) / total * log2(CAST(c.n AS DOUBLE) * total / (CAST(na AS DOUBLE) * nb))), 8) AS mi FROM c JOIN na USING (a) JOIN nb USING (b) JOIN (SELECT w AS a, {BIN} AS bin FROM ty) USING (a), t GROUP BY bin""")
def mi_frequency_decomposition(spark, d):
    tok = toks(spark, d, "lang")
    cells = tok.groupBy(F.col("w").alias("a"), F.col("lang").alias("b")).agg(F.count("*").alias("n"))
    bins = V.types(tok).select(F.col("w").alias("a"), frequency_bin(F.col("n")).alias("bin"))
    return I.information_by_bin(cells, bins).select("bin", "pairs", F.round("mi", 8).alias("mi"))


@query(f"""WITH {TOK}, c1 AS (SELECT w AS a, doc_id AS b, count(*) AS n FROM tok GROUP BY ALL), c2 AS (SELECT w AS a, lang AS b, count(*) AS n FROM tok GROUP BY ALL), c3 AS (SELECT lang, w AS a, doc_id AS b, count(*) AS n FROM tok GROUP BY ALL), p AS ({mi_sql('c1')}), s AS ({mi_sql('c2')}), i AS (SELECT sum(total * mi) / sum(total) AS mi FROM ({mi_sql('c3', 'lang')}))
SELECT round(p.mi, 7) AS page, round(s.mi, 7) AS section, round(i.mi, 7) AS inner_, abs(round(p.mi - s.mi - i.mi, 6)) AS residual FROM p, s, i""")
def chain_rule_residual(spark, d):
    """I(w; page), I(w; section), I(w; page | section), and what the first differs from the others' sum by: nothing if a page is of one section."""
    cells = toks(spark, d, "lang").groupBy("lang", F.col("w").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("n"))
    page = I.mutual_information(cells.groupBy("a", "b").agg(F.sum("n").alias("n"))).select(F.col("mi").alias("page"))
    section = I.mutual_information(cells.groupBy("a", F.col("lang").alias("b")).agg(F.sum("n").alias("n"))).select(F.col("mi").alias("section"))
    out = page.crossJoin(section).crossJoin(I.conditional_information(cells, "lang"))  # one row each
    residual = F.abs(F.round(F.col("page") - F.col("section") - F.col("cmi"), 6)) + 0.0
    return out.select(F.round("page", 7).alias("page"), F.round("section", 7).alias("section"), F.round("cmi", 7).alias("inner_"), residual.alias("residual"))


def null_sql(pairs: str, strata: str, reps: int, key: str) -> str:
    """Oracle of a permutation within strata; key: the concatenation that is hashed."""
    s = f"{strata}, " if strata else ""
    return f"""rows_ AS (SELECT rep, {s}pos, a, b FROM {pairs}, (SELECT unnest(range(1, {reps + 1})) AS rep)),
l AS (SELECT rep, {s}a, row_number() OVER (PARTITION BY rep, {strata} ORDER BY pos) AS k FROM rows_), r AS (SELECT rep, {s}b, row_number() OVER (PARTITION BY rep, {strata} ORDER BY md5({key}), pos) AS k FROM rows_),
c AS (SELECT rep, {s}a, b, count(*) AS n FROM l JOIN r USING (rep, {s}k) GROUP BY ALL)"""


REPS = 20


@query(f"""WITH {TOK}, {EDGE}, conv AS (SELECT doc_id, pos, a, b FROM edge), {null_sql('conv', 'doc_id', REPS, "concat_ws('|', rep, doc_id, pos)")}, cn AS (SELECT rep, a, b, sum(n) AS n FROM c GROUP BY ALL), nul AS ({mi_sql('cn', 'rep')}), co AS (SELECT a, b, count(*) AS n FROM conv GROUP BY ALL), obs AS ({mi_sql('co')})
SELECT CAST(max(obs.total) AS BIGINT) AS pairs, round(max(obs.mi), 7) AS observed, round(avg(nul.mi), 7) AS null_mean, round(max(obs.mi) - avg(nul.mi), 7) AS excess, round((1 + sum(CASE WHEN nul.mi >= obs.mi - 1e-12 THEN 1 ELSE 0 END)) / CAST(1 + count(*) AS DOUBLE), 7) AS p FROM nul, obs""")
def edge_coupling_null(spark, d):
    """Information between the edges of neighbouring words, over permutations within each page."""
    out = R.edge_test_by_hash(V.read(spark, d, "documents"), REPS)
    return out.select("pairs", *(F.round(c, 7).alias(c) for c in ("observed", "null_mean", "excess", "p")))


TEST_REPS = 299


@query()
def edge_coupling_test(spark, d):
    """The same with 299 replicates drawn in whole arrays; p can be as small as 1/300. Its random orders are not SQL's."""
    return R.edge_test(V.read(spark, d, "documents"), TEST_REPS)


@query(f"""WITH {TURN}, conv AS (SELECT conv_id, turn * 100000 + pos AS pos, right(w, 1) AS a, left(nxt, 1) AS b FROM (SELECT conv_id, turn, pos, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok) WHERE nxt IS NOT NULL), {null_sql('conv', 'conv_id', REPS, "concat_ws('|', rep, conv_id, pos)")}, cs AS (SELECT rep * 10000000 + conv_id AS s, a, b, n FROM c), nul AS (SELECT s // 10000000 AS rep, sum(total * mi) / sum(total) AS mi FROM ({mi_sql('cs', 's')}) GROUP BY 1), co AS (SELECT conv_id, a, b, count(*) AS n FROM conv GROUP BY ALL), obs AS (SELECT sum(total) AS total, sum(total * mi) / sum(total) AS mi FROM ({mi_sql('co', 'conv_id')}))
SELECT CAST(max(obs.total) AS BIGINT) AS pairs, round(max(obs.mi), 7) AS observed, round(avg(nul.mi), 7) AS null_mean, round(max(obs.mi) - avg(nul.mi), 7) AS excess, round((1 + sum(CASE WHEN nul.mi >= obs.mi - 1e-12 THEN 1 ELSE 0 END)) / CAST(1 + count(*) AS DOUBLE), 7) AS p FROM nul, obs""")
def page_association_null(spark, d):
    """Information given the page, over permutations within the page."""
    out = R.conditional_edge_test(V.read(spark, d, "conversations"), REPS)
    return out.select("pairs", *(F.round(c, 7).alias(c) for c in ("observed", "null_mean", "excess", "p")))


BOOT = 200


@query(f"""WITH s AS (SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY l_suppkey),
u AS (SELECT rep, s, c, {UNIFORM.format("concat_ws('|', rep, l_suppkey)")} AS u FROM s, (SELECT unnest(range(1, {BOOT + 1})) AS rep)),
d AS (SELECT rep, s, c, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT AS times FROM u),
r AS (SELECT rep, sum(times * s) / sum(times * c) AS ratio FROM d GROUP BY rep)
SELECT round(quantile_cont(ratio, 0.025), 8) AS low, round(quantile_cont(ratio, 0.975), 8) AS high, (SELECT round(sum(s) / sum(c), 8) FROM s) AS estimate, (SELECT count(*) FROM s) AS clusters FROM r""")
def cluster_bootstrap_ci(spark, d):
    sums = V.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("s"), F.count("*").cast("double").alias("c"))
    out = R.cluster_bootstrap(sums, BOOT, "l_suppkey")
    return out.select(*(F.round(c, 8).alias(c) for c in ("low", "high", "estimate")), "clusters")


@query(f"""WITH {TOK}, blk AS (SELECT lang, doc_id, pos, w, pos // 256 AS blk FROM tok), g AS (SELECT lang, k, CASE k WHEN 1 THEN a WHEN 2 THEN concat_ws(' ', a, b) ELSE concat_ws(' ', a, b, c) END AS gram FROM (SELECT lang, left(w, 1) AS a, left(lead(w, 1) OVER q, 1) AS b, left(lead(w, 2) OVER q, 1) AS c FROM blk WINDOW q AS (PARTITION BY doc_id, blk ORDER BY pos)), (SELECT unnest([1, 2, 3]) AS k) WHERE k = 1 OR (k = 2 AND b IS NOT NULL) OR (k = 3 AND c IS NOT NULL)),
n AS (SELECT lang, k, gram, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY ALL)
SELECT lang, CAST(k AS INTEGER) AS k, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 8) AS entropy, round(log2(sum(n)) - sum(n * log2(n)) / sum(n) + (count(*) - 1) / (2 * sum(n) * ln(2)), 8) AS corrected FROM n GROUP BY lang, k""")
def block_entropy_profile(spark, d):
    """Entropy of 1, 2 and 3 first letters in a row within blocks of 256 words, with the Miller-Madow correction."""
    q = Window.partitionBy("doc_id", "blk").orderBy("pos")
    rows = toks(spark, d, "lang").withColumn("blk", F.floor(F.col("pos") / 256)).select("lang", *(F.expr("left(w, 1)").alias("a") if k == 0 else F.lead(F.expr("left(w, 1)"), k).over(q).alias("abc"[k]) for k in range(3)))
    grams = F.array(F.struct(F.lit(1).alias("k"), F.col("a").alias("gram")), F.struct(F.lit(2).alias("k"), F.when(F.col("b").isNotNull(), F.concat_ws(" ", "a", "b")).alias("gram")), F.struct(F.lit(3).alias("k"), F.when(F.col("c").isNotNull(), F.concat_ws(" ", "a", "b", "c")).alias("gram")))
    cells = rows.select("lang", F.explode(grams).alias("g")).where("g.gram is not null").groupBy("lang", "g.k", "g.gram").agg(F.count("*").alias("n"))
    extra = cells.groupBy("lang", "k").agg(((F.count("*") - 1) / (2 * F.sum("n") * F.log(F.lit(2.0)))).alias("extra"))
    return I.entropy(cells, "lang", "k").join(extra, ["lang", "k"]).select("lang", "k", F.round("entropy", 8).alias("entropy"), F.round(F.col("entropy") + F.col("extra"), 8).alias("corrected"))


LAGS = (1, 2, 4, 8, 16)


@query(f"""WITH {TOK}, x AS (SELECT lang, k, w, lag(w, k) OVER (PARTITION BY doc_id, k ORDER BY pos) AS p FROM tok, (SELECT unnest([1, 2, 4, 8, 16]) AS k)) SELECT lang, CAST(k AS INTEGER) AS k, count(*) AS pairs, round(avg(CASE WHEN w = p THEN 1.0 ELSE 0.0 END), 9) AS rate FROM x WHERE p IS NOT NULL GROUP BY ALL""")
def lag_repeat_rates(spark, d):
    """A text's words lie beside themselves at every lag."""
    near = V.beside(V.read(spark, d, "documents"), ("lang",), **{f"p{k}": -k for k in LAGS})
    rows = near.select("lang", *((F.col(f"p{k}") == F.col("w")).cast("double").alias(f"l{k}") for k in LAGS))
    out = rows.select("lang", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("hit")) for k in LAGS))).alias("x")).where("x.hit is not null")
    return out.groupBy("lang", "x.k").agg(F.count("*").alias("pairs"), F.round(F.avg("x.hit"), 9).alias("rate"))


EVENTS = "e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


@query(f"WITH {EVENTS}, x AS (" + " UNION ALL ".join(f"SELECT {k} AS k, s = lag(s, {k}) OVER (PARTITION BY user_id ORDER BY pos) AS hit, count(s) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND CURRENT ROW) = {k + 1} AS ok FROM e" for k in LAGS) + ") SELECT CAST(k AS INTEGER) AS k, count(*) AS pairs, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS rate FROM x WHERE ok GROUP BY k")
def lag_gap_aware(spark, d):
    """A pair counts only if all symbols from one to the other are readable; errors are not."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = V.read(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("s"))
    pair = lambda k: F.when(F.count("s").over(order.rowsBetween(-k, 0)) == k + 1, (F.col("s") == F.lag("s", k).over(order)).cast("double"))
    rows = e.select(*(pair(k).alias(f"l{k}") for k in LAGS))
    out = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("hit")) for k in LAGS))).alias("x")).where("x.hit is not null")
    return out.groupBy("x.k").agg(F.count("*").alias("pairs"), F.round(F.avg("x.hit"), 9).alias("rate"))


CTX = f"""ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w), top AS (SELECT w FROM ty WHERE n >= 10 AND length(w) >= 2), vec AS (SELECT w AS item, f AS feature, CAST(count(*) AS DOUBLE) AS value FROM (
 SELECT w, 'L' || coalesce(left(lag(w) OVER q, 2), '^') AS f FROM tok WINDOW q AS (PARTITION BY doc_id ORDER BY pos) UNION ALL SELECT w, 'R' || coalesce(left(lead(w) OVER q, 2), '$') FROM tok WINDOW q AS (PARTITION BY doc_id ORDER BY pos)) WHERE w IN (SELECT w FROM top) GROUP BY ALL)"""


def context_vectors(spark, d):
    """Of every word that occurs ten times or more: counts of the first two letters of its neighbours."""
    tok = toks(spark, d)
    often = V.types(tok).where("n >= 10 and length(w) >= 2").select("w")
    sides = F.array(F.concat(F.lit("L"), F.coalesce("l", F.lit("^"))), F.concat(F.lit("R"), F.coalesce("r", F.lit("$"))))
    near = V.beside(V.read(spark, d, "documents"), (), lw=-1, rw=1)
    rows = near.select("w", F.expr("left(lw, 2)").alias("l"), F.expr("left(rw, 2)").alias("r")).groupBy("w", "l", "r").agg(F.count("*").alias("n"))
    return rows.join(often, "w", "left_semi").select(F.col("w").alias("item"), "n", F.explode(sides).alias("feature")).groupBy("item", "feature").agg(F.sum("n").cast("double").alias("value"))


STEM = "left({0}.item, length({0}.item) - 1)"


@query(f"""WITH {TOK}, {CTX}, nm AS (SELECT item, sqrt(sum(value * value)) AS nm FROM vec GROUP BY item) SELECT x.item AS a, y.item AS b, round(sum(x.value * y.value) / max(p.nm * q.nm), 8) AS cosine FROM vec x JOIN vec y ON x.feature = y.feature AND {STEM.format('x')} = {STEM.format('y')} AND x.item < y.item JOIN nm p ON p.item = x.item JOIN nm q ON q.item = y.item GROUP BY ALL""")
def context_cosine_pairs(spark, d):
    """Cosines of the contexts of every two frequent words that differ in their last letter; a stem has at most 26 of them."""
    return I.cosine(of_stems(context_vectors(spark, d)), feature="own").select("a", "b", F.round("cosine", 8).alias("cosine"))


def of_stems(vectors):
    """Features within the stem, so that words of one stem alone meet."""
    return vectors.withColumn("own", F.concat(F.expr("left(item, length(item) - 1)"), F.lit(" "), "feature"))


@query(f"""WITH {TOK}, {CTX}, sh AS (SELECT item, left(item, length(item) - 1) AS stem, feature, value / sum(value) OVER (PARTITION BY item) AS p FROM vec), fs AS (SELECT DISTINCT stem, feature FROM sh), al AS (SELECT i.item, f.stem, f.feature, coalesce(sh.p, 0.0) AS p FROM (SELECT DISTINCT item, stem FROM sh) i JOIN fs f ON f.stem = i.stem LEFT JOIN sh ON sh.item = i.item AND sh.feature = f.feature)
SELECT x.item AS a, y.item AS b, round(sum(CASE WHEN x.p > 0 THEN 0.5 * x.p * log2(2 * x.p / (x.p + y.p)) ELSE 0 END + CASE WHEN y.p > 0 THEN 0.5 * y.p * log2(2 * y.p / (x.p + y.p)) ELSE 0 END), 7) AS js FROM al x JOIN al y ON x.stem = y.stem AND x.feature = y.feature AND x.item < y.item GROUP BY ALL HAVING sum(CASE WHEN x.p > 0 AND y.p > 0 THEN 1 ELSE 0 END) > 0""")
def js_divergence_pairs(spark, d):
    """The same pairs, those that share a context, by Jensen-Shannon divergence."""
    v = of_stems(context_vectors(spark, d))
    shares = v.select("item", "own", (F.col("value") / F.sum("value").over(Window.partitionBy("item"))).alias("p"))
    return I.jensen_shannon(shares, feature="own").select("a", "b", F.round("js", 7).alias("js"))


@query(f"""WITH {TOK}, {CTX}, c AS (SELECT item AS a, feature AS b, value AS n FROM vec), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT sum(n) AS total FROM c)
SELECT a, b, n, round(ln(n * total / (na * nb)), 8) AS ppmi FROM c JOIN ra USING (a) JOIN rb USING (b), t WHERE n >= 5 AND ln(n * total / (na * nb)) > 0""")
def ppmi_cells(spark, d):
    cells = context_vectors(spark, d).select(F.col("item").alias("a"), F.col("feature").alias("b"), F.col("value").alias("n"))
    return I.ppmi(cells, 5).select("a", "b", "n", F.round("ppmi", 8).alias("ppmi"))


COS = "list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) * list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))"


def nearest(spark, d, k: int):
    """Queries: ids divisible by 20; the k nearest other vectors, by id on ties: a stated query set against all rows."""
    e = V.read(spark, d, "embeddings")
    return N.nearest(e, e.where("vec_id % 20 = 0"), k)


KNN = f"near AS (SELECT x.vec_id AS query, x.label AS query_label, y.vec_id, y.label, round({COS}, 6) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS rank FROM near)"


@query(f"WITH {KNN} SELECT query, vec_id, CAST(rank AS INTEGER) AS rank, cosine FROM rk WHERE rank <= 10")
def embedding_cosine_topk(spark, d):
    return nearest(spark, d, 10).select("query", "vec_id", "rank", "cosine")


@query(f"WITH {KNN}, h AS (SELECT query, max(CASE WHEN rank = 1 AND label = query_label THEN 1.0 ELSE 0.0 END) AS nn, max(CASE WHEN rank <= 5 AND label = query_label THEN 1.0 ELSE 0.0 END) AS top5 FROM rk GROUP BY query) SELECT count(*) AS queries, round(avg(nn), 9) AS nn, round(avg(top5), 9) AS top5 FROM h")
def retrieval_nn_top5(spark, d):
    hit = lambda k: F.max(F.when((F.col("rank") <= k) & (F.col("label") == F.col("query_label")), 1.0).otherwise(0.0))
    return nearest(spark, d, 5).groupBy("query").agg(hit(1).alias("nn"), hit(5).alias("top5")).agg(F.count("*").alias("queries"), F.round(F.avg("nn"), 9).alias("nn"), F.round(F.avg("top5"), 9).alias("top5"))


DOCF = "f AS (SELECT d.doc_id, d.lang, d.source, l.quality AS y, round(length(regexp_replace(d.text, '[A-Za-z ]', '', 'g')) / CAST(length(d.text) AS DOUBLE), 4) AS score FROM documents d JOIN labels l USING (doc_id))"


def scored(spark, d):
    """Labelled documents with a text statistic as score: the share of characters other than letters and blanks."""
    docs = V.read(spark, d, "documents").join(V.read(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "lang", "source", F.col("quality").alias("y"), F.round(F.length(F.regexp_replace("text", "[A-Za-z ]", "")) / F.length("text"), 4).alias("score"))


@query(f"""WITH {DOCF}, c AS (SELECT lang, score, sum(1 - y) AS p, sum(y) AS q FROM f GROUP BY ALL), w AS (SELECT lang, p, q, p * (coalesce(sum(q) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0) AS won FROM c)
SELECT lang, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, round(CAST(sum(won) AS DOUBLE) / CAST(nullif(sum(p) * sum(q), 0) AS DOUBLE), 8) AS auc FROM w GROUP BY lang""")
def roc_auc(spark, d):
    return M.roc_auc(scored(spark, d).withColumn("bad", 1 - F.col("y")), "score", "bad", "lang").withColumn("auc", F.round("auc", 8))


@query(f"""WITH {DOCF}, c AS (SELECT score, CAST(sum(1 - y) AS DOUBLE) AS p, count(*) AS n FROM f GROUP BY score), r AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS found FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p * tp / found) / sum(p), 8) AS average_precision FROM r""")
def average_precision(spark, d):
    return M.average_precision(scored(spark, d).withColumn("bad", 1 - F.col("y")), "score", "bad").withColumn("average_precision", F.round("average_precision", 8))


@query(f"""WITH {DOCF}, p AS (SELECT least(1.0, greatest(0.0, 1 - score * 5)) AS p, y FROM f) SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(CAST(y AS DOUBLE)), 8) AS rate, round(avg((p - y) * (p - y)), 8) AS brier, round(avg(-log2(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))), 7) AS bits FROM p GROUP BY 1""")
def brier_reliability(spark, d):
    p = scored(spark, d).select(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("score") * 5)).alias("p"), "y")
    bits, brier = M.losses(F.col("p"), F.col("y"))
    return p.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 8).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 8).alias("rate"), F.round(F.avg(brier), 8).alias("brier"), F.round(F.avg(bits), 7).alias("bits"))


@query(f"WITH {DOCF} SELECT y, CAST(sum(CASE WHEN score > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS called_0, CAST(sum(CASE WHEN score > 0.1 THEN 0 ELSE 1 END) AS BIGINT) AS called_1 FROM f GROUP BY y")
def confusion_matrix(spark, d):
    called = F.when(F.col("score") > 0.1, "called_0").otherwise("called_1")
    return scored(spark, d).withColumn("called", called).groupBy("y").pivot("called", ["called_0", "called_1"]).count().fillna(0)


FOLD = "CAST(floor(" + UNIFORM.format("{}") + " * 5) AS INTEGER)"


@query(f"""WITH {DOCF}, g AS (SELECT *, {FOLD.format("CAST(doc_id AS VARCHAR)")} AS fold FROM f), t AS (SELECT source, sum(y) AS sy, count(*) AS n FROM g GROUP BY source), tf AS (SELECT source, fold, sum(y) AS sy, count(*) AS n FROM g GROUP BY ALL), a AS (SELECT avg(CAST(y AS DOUBLE)) AS prior FROM g)
SELECT doc_id, fold, round((t.sy - tf.sy + 10 * prior) / (t.n - tf.n + 10), 8) AS encoded FROM g JOIN t USING (source) JOIN tf USING (source, fold), a""")
def target_encoding_oof(spark, d):
    """Smoothed mean of the label per source, without the row's own fold: totals less the fold's."""
    g = scored(spark, d).withColumn("fold", T.hash_fold(F.col("doc_id").cast("string"), 5))
    cells = g.groupBy("source", "fold").agg(F.sum("y").alias("fy"), F.count("*").alias("fn"))
    totals = cells.groupBy("source").agg(F.sum("fy").alias("sy"), F.sum("fn").alias("n"))
    prior = g.agg(F.avg(F.col("y").cast("double")).alias("prior"))
    out = g.join(cells.join(totals, "source"), ["source", "fold"]).crossJoin(prior)  # one row
    return out.select("doc_id", "fold", F.round((F.col("sy") - F.col("fy") + 10 * F.col("prior")) / (F.col("n") - F.col("fn") + 10), 8).alias("encoded"))


@query(f"SELECT source, {FOLD.format('source')} AS fold, count(*) AS n FROM documents GROUP BY ALL")
def group_folds(spark, d):
    return V.read(spark, d, "documents").groupBy("source", T.hash_fold(F.col("source"), 5).alias("fold")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w), f AS (SELECT w, n, right(w, 1) AS e FROM ty WHERE n >= 50) SELECT a.w AS a, b.w AS b, a.e AS ending FROM f a JOIN f b ON a.e = b.e AND a.w < b.w AND left(a.w, 1) <> left(b.w, 1) AND b.n >= 0.8 * a.n AND b.n <= 1.25 * a.n""")
def matched_pairs_band(spark, d):
    """Types of like frequency and the same ending but unlike beginnings: a band join, as an equi-join on the ending and on neighbouring buckets of the logarithm of the frequency."""
    f = V.types(toks(spark, d)).where("n >= 50").select("w", "n", F.expr("right(w, 1)").alias("e"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).alias("bucket"))
    a = f.select(F.col("w").alias("a"), F.col("n").alias("na"), "e", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = f.select(F.col("w").alias("b"), F.col("n").alias("nb"), "e", "bucket")
    return a.join(b, ["e", "bucket"]).where("a < b and left(a, 1) <> left(b, 1) and nb >= 0.8 * na and nb <= 1.25 * na").select("a", "b", F.col("e").alias("ending"))


@query(f"""WITH {TOK}, ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w), f AS (SELECT w, n, substr(w, 1, length(w) - 1) AS stem FROM ty WHERE n >= 20 AND length(w) >= 3) SELECT a.w AS a, b.w AS b, a.stem, a.n AS n_a, b.n AS n_b FROM f a JOIN f b ON a.stem = b.stem AND a.w < b.w""")
def same_stem_pairs(spark, d):
    f = V.types(toks(spark, d)).where("n >= 20 and length(w) >= 3").select("w", "n", F.expr("substring(w, 1, length(w) - 1)").alias("stem"))
    side = lambda c: f.select("stem", F.col("w").alias(c), F.col("n").alias(f"n_{c}"))
    return side("a").join(side("b"), "stem").where("a < b").select("a", "b", "stem", "n_a", "n_b")


@query("""WITH c AS (SELECT l_linestatus AS cell, l_returnflag AS g, avg(CAST(l_quantity AS DOUBLE)) AS m, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL), p AS (SELECT a.cell, a.m AS ma, b.m AS mb, a.n AS na, b.n AS nb FROM c a JOIN c b USING (cell) WHERE a.g = 'A' AND b.g = 'R')
SELECT count(*) AS cells, round(sum(nb * (ma - mb)) / sum(nb), 7) AS contrast FROM p""")
def matched_contrast(spark, d):
    """Mean difference of two groups over the cells both have, weighted by the second's counts."""
    c = V.read(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy(F.col("l_linestatus").alias("cell"), F.col("l_returnflag").alias("g")).agg(F.avg(F.col("l_quantity").cast("double")).alias("m"), F.count("*").alias("n"))
    side = lambda g, x: c.where(F.col("g") == g).select("cell", F.col("m").alias(f"m{x}"), F.col("n").alias(f"n{x}"))
    return side("A", "a").join(side("R", "b"), "cell").agg(F.count("*").alias("cells"), F.round(F.sum(F.col("nb") * (F.col("ma") - F.col("mb"))) / F.sum("nb"), 7).alias("contrast"))


ISL = """isl AS (SELECT user_id, event_type, pos, sum(brk) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS brk FROM events)), sp AS (SELECT user_id, island, count(*) AS n, string_agg(left(event_type, 1), '' ORDER BY pos) AS word FROM isl WHERE event_type <> 'error' GROUP BY ALL)"""


def islands(spark, d):
    """Spans of a user's events between errors, gaps and islands: a running sum of breaks numbers them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = V.read(spark, d, "events").select("user_id", "event_type", F.row_number().over(order).alias("pos"), F.sum((F.col("event_type") == "error").cast("int")).over(order).alias("island"))
    span = F.sort_array(F.collect_list(F.struct("pos", F.expr("left(event_type, 1)").alias("s"))))
    return e.where("event_type <> 'error'").groupBy("user_id", "island").agg(F.count("*").alias("n"), F.array_join(F.transform(span, lambda x: x["s"]), "").alias("word"))


@query(f"WITH {ISL} SELECT word, count(*) AS n FROM sp GROUP BY word")
def islands_join_tokens(spark, d):
    return islands(spark, d).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {ISL} SELECT user_id, count(*) AS spans, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM sp GROUP BY user_id")
def spans_between_gaps(spark, d):
    return islands(spark, d).groupBy("user_id").agg(F.count("*").alias("spans"), F.max("n").alias("longest"), F.sum("n").alias("events"))


@query(f"""WITH {LINE}, pg AS (SELECT lang, source, doc_id, count(*) AS rows_ FROM ltok GROUP BY ALL HAVING count(*) >= 64), one AS (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1), eight AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 8)
SELECT lang, doc_id, CAST(k AS INTEGER) AS k, w FROM (SELECT t.lang, t.doc_id, t.w, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.line, t.pos) AS k FROM ltok t JOIN eight USING (doc_id)) WHERE k <= 64""")
def panel_selection(spark, d):
    """The first 64 words of the first eight pages of a section that have so many, one page of a source."""
    t = V.line_tokens(V.read(spark, d, "documents"), ("doc_id", "lang", "source"))
    pages = t.groupBy("lang", "source", "doc_id").agg(F.count("*").alias("c")).where("c >= 64").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    eight = pages.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 8").select("doc_id")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "pos"))
    return t.join(eight, "doc_id", "left_semi").withColumn("k", k).where("k <= 64").select("lang", "doc_id", "k", "w")


BYLANG = "ty AS (SELECT lang, w, count(*) AS n FROM tok GROUP BY ALL)"


def by_lang(spark, d, lang):
    return V.types(toks(spark, d, "lang").where(F.col("lang") == lang)).select("w", "n")


@query(f"WITH {TOK}, {BYLANG} SELECT w FROM ty WHERE lang = 'fr' EXCEPT SELECT w FROM ty WHERE lang = 'es'")
def unseen_types(spark, d):
    return by_lang(spark, d, "fr").select("w").join(by_lang(spark, d, "es").select("w"), "w", "left_anti")


@query(f"WITH {TOK}, {BYLANG} SELECT w FROM ty WHERE lang = 'fr' INTERSECT SELECT w FROM ty WHERE lang = 'es'")
def shared_types(spark, d):
    return by_lang(spark, d, "fr").select("w").join(by_lang(spark, d, "es").select("w"), "w", "left_semi")


@query(f"WITH {TOK}, {BYLANG} SELECT w, n, 'fr' AS arm FROM ty WHERE lang = 'fr' UNION ALL SELECT w, n, 'es' FROM ty WHERE lang = 'es'")
def arm_union(spark, d):
    return by_lang(spark, d, "fr").withColumn("arm", F.lit("fr")).unionByName(by_lang(spark, d, "es").withColumn("arm", F.lit("es")))


@query(f"WITH {TOK}, {BYLANG} SELECT count(*) AS only_one FROM (SELECT w FROM ty WHERE lang IN ('fr', 'es') GROUP BY w HAVING count(*) = 1)")
def symmetric_difference(spark, d):
    return by_lang(spark, d, "fr").unionByName(by_lang(spark, d, "es")).groupBy("w").agg(F.count("*").alias("c")).where("c = 1").agg(F.count("*").alias("only_one"))


@query(f"WITH {TOK}, {BYLANG} SELECT count(*) AS shared FROM (SELECT w FROM (SELECT w FROM ty WHERE lang = 'fr' ORDER BY n DESC, w LIMIT 100) JOIN (SELECT w FROM ty WHERE lang = 'es' ORDER BY n DESC, w LIMIT 100) USING (w))")
def top100_overlap(spark, d):
    top = lambda x: by_lang(spark, d, x).orderBy(F.desc("n"), "w").limit(100).select("w")  # noqa: E731  a top-k report
    return top("fr").join(top("es"), "w").agg(F.count("*").alias("shared"))


@query(f"""WITH {TOK}, {BYLANG}, j AS (SELECT a.w, a.n AS x, b.n AS y FROM ty a JOIN ty b USING (w) WHERE a.lang = 'fr' AND b.lang = 'es'), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j) SELECT round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 7) AS rho, count(*) AS n FROM r""")
def spearman_rank(spark, d):
    j = by_lang(spark, d, "fr").select("w", F.col("n").alias("x")).join(by_lang(spark, d, "es").select("w", F.col("n").alias("y")), "w")
    ranked = M.average_ranks(M.average_ranks(j, "x").withColumnRenamed("rank", "rx"), "y").withColumnRenamed("rank", "ry")
    return ranked.agg(F.round(F.corr("rx", "ry"), 7).alias("rho"), F.count("*").alias("n"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(f"SELECT item_id, CAST(s AS INTEGER) AS shift, translate(lower(text), '{LETTERS}', substr('{LETTERS}{LETTERS}', s + 1, 26)) AS shifted FROM benchmark, (SELECT CAST(unnest(range(26)) AS INTEGER) AS s)")
def caesar_enumeration(spark, d):
    b = V.read(spark, d, "benchmark").select("item_id", F.lower("text").alias("t"))
    return b.select("item_id", F.posexplode(F.array(*(T.caesar(F.col("t"), s) for s in range(26)))).alias("shift", "shifted"))


@query("WITH c AS (SELECT DISTINCT lower(left(n_name, 1 + n_nationkey % 4)) AS code FROM nation) SELECT a.code AS prefix, b.code AS code FROM c a JOIN c b ON a.code <> b.code AND starts_with(b.code, a.code)")
def prefix_free_violations(spark, d):
    """Codes, the beginnings of names, that begin another: each code's own beginnings are looked up by equality."""
    c = V.read(spark, d, "nation").select(F.lower(F.expr("left(n_name, 1 + n_nationkey % 4)")).alias("code")).distinct()
    begins = c.select("code", F.explode(F.expr("transform(sequence(1, length(code)), k -> substring(code, 1, k))")).alias("prefix")).where("prefix <> code")
    return begins.join(c.select(F.col("code").alias("prefix")), "prefix").select("prefix", "code")


@query("""WITH RECURSIVE p AS (SELECT list(length(r_name) ORDER BY r_regionkey) AS ls FROM region), c AS (SELECT CAST('' AS VARCHAR) AS choice, 0 AS k, 0 AS s FROM p UNION ALL SELECT choice || t, k + 1, s + CAST(t AS INT) * ls[k + 1] FROM c, p, (SELECT unnest(['0', '1', '2']) AS t) WHERE k < len(ls)) SELECT choice, CAST(s % 7 AS INTEGER) AS state FROM c, p WHERE k = len(ls)""")
def page_choice_enumeration(spark, d):
    """All choices of one of three tables for each page (a region), and the state that the choices, weighted by the pages' lengths, end in. A choice is a number in base three, so no product of tables is needed."""
    pages = V.read(spark, d, "region").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", F.length("r_name").alias("n")))), lambda x: x["n"]).alias("ls"))  # five rows
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(3), F.size("ls")).cast("long") - 1))
    digits = F.transform(F.sequence(F.lit(0), F.size("ls") - 1), lambda k: (F.floor(F.col("id") / F.pow(F.lit(3), k)) % 3).cast("int"))
    rows = pages.select("ls", each.alias("id")).select("ls", digits.alias("ds"))
    total = F.aggregate(F.zip_with("ds", "ls", lambda x, n: x * n), F.lit(0), lambda a, x: a + x)
    return rows.select(F.array_join(F.transform("ds", lambda x: x.cast("string")), "").alias("choice"), (total % 7).alias("state"))


@query("""WITH c AS (SELECT item_id, lower(text) AS t, unnest(range(1, length(text) + 1)) AS i FROM benchmark), f AS (SELECT substr(t, i, 1) AS u, count(*) AS n FROM c WHERE regexp_matches(substr(t, i, 1), '^[a-z]$') GROUP BY 1), k AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, u) AS INTEGER) AS i, u FROM f) SELECT a.i AS i, b.i AS j, b.u AS new_i, a.u AS new_j FROM k a JOIN k b ON a.i < b.i""")
def neighbourhood_moves(spark, d):
    """Every exchange of two units of the key that orders the passages' letters by frequency."""
    letters = V.read(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "")).alias("u")).where(F.col("u").rlike("^[a-z]$")).groupBy("u").agg(F.count("*").alias("n"))
    key = letters.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "u"))), lambda x: x["u"]).alias("key"))  # 26 letters
    later = F.expr("filter(transform(key, (u, p) -> struct(p + 1 as j, u as u)), x -> x.j > i + 1)")
    rows = key.select("key", F.posexplode("key").alias("i", "u")).select("i", "u", F.explode(later).alias("x"))
    return rows.select((F.col("i") + 1).alias("i"), F.col("x.j").alias("j"), F.col("x.u").alias("new_i"), F.col("u").alias("new_j"))


CHARS = "SELECT item_id, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS t FROM benchmark"
TRI = f"""tr AS (SELECT w, count(*) AS n FROM tok GROUP BY w), g3 AS (SELECT substr(' ' || w || ' ', i, 3) AS g, sum(n) AS n FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM tr) GROUP BY 1), g2 AS (SELECT substr(' ' || w || ' ', i, 2) AS c, sum(n) AS n, count(DISTINCT substr(' ' || w || ' ', i, 3)) AS k FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM tr) GROUP BY 1),
bt AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM benchmark), bg AS (SELECT item_id, substr(' ' || w || ' ', i, 3) AS g FROM (SELECT item_id, w, unnest(range(1, length(w) + 1)) AS i FROM bt))"""


def trigrams(types):
    """g and n: trigrams of words with a blank on either side."""
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    return types.withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(padded, i, F.lit(3)))))


def language_model(spark, d):
    g3 = trigrams(V.types(toks(spark, d))).groupBy("g").agg(F.sum("n").alias("n3"))
    g2 = g3.groupBy(F.substring("g", 1, 2).alias("c")).agg(F.sum("n3").alias("n2"), F.count("*").alias("k2"))
    return g3, g2


def held_trigrams(spark, d):
    held = V.read(spark, d, "benchmark").select("item_id", F.explode(T.words(F.col("text"))).alias("w"))
    return trigrams(held).select("item_id", "g", F.substring("g", 1, 2).alias("c"))


@query(f"""WITH {TOK}, {TRI} SELECT item_id, count(*) AS n, round(sum(-log2((coalesce(g3.n, 0) + 0.5) / (coalesce(g2.n, 0) + 0.5 * 27))), 5) AS nll FROM bg LEFT JOIN g3 ON g3.g = bg.g LEFT JOIN g2 ON g2.c = substr(bg.g, 1, 2) GROUP BY item_id""")
def ngram_nll(spark, d):
    """Bits of held-out passages under letter trigrams of the documents with half a count added."""
    g3, g2 = language_model(spark, d)
    rows = held_trigrams(spark, d).join(g3, "g", "left").join(g2, "c", "left").fillna(0, ["n3", "n2"])
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.sum(-F.log2((F.col("n3") + 0.5) / (F.col("n2") + 13.5))), 5).alias("nll"))


@query(f"""WITH {TOK}, {TRI} SELECT count(*) AS n, round(avg(-log2((coalesce(g3.n, 0) + coalesce(k, 0) / 27.0) / (coalesce(g2.n, 0) + coalesce(k, 0)))), 6) AS bits FROM bg LEFT JOIN g3 ON g3.g = bg.g JOIN g2 ON g2.c = substr(bg.g, 1, 2)""")
def witten_bell_cross_entropy(spark, d):
    """Mean bits under trigrams backed off to uniform letters by Witten and Bell's weights, over known contexts."""
    g3, g2 = language_model(spark, d)
    rows = held_trigrams(spark, d).join(g3, "g", "left").join(g2, "c").fillna(0, ["n3"])
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(-F.log2((F.col("n3") + F.col("k2") / 27.0) / (F.col("n2") + F.col("k2")))), 6).alias("bits"))


@query(f"""WITH {TOK}, l AS (SELECT lang, left(w, 2) AS g, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT g, sum(n) AS n FROM l GROUP BY g), tl AS (SELECT lang, sum(n) AS n FROM l GROUP BY lang), al AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM l)
SELECT l.lang, CAST(sum(l.n) AS BIGINT) AS n, round(sum(l.n * -log2((t.n - l.n + 1) / (al.n - tl.n + 676))) / CAST(sum(l.n) AS DOUBLE), 7) AS bits FROM l JOIN t USING (g) JOIN tl ON tl.lang = l.lang, al GROUP BY l.lang""")
def lopo_cross_entropy(spark, d):
    """Each section's first two letters under the counts of all the others: totals less its own."""
    l = toks(spark, d, "lang").groupBy("lang", F.expr("left(w, 2)").alias("g")).agg(F.count("*").alias("n"))
    own, every = l.groupBy("lang").agg(F.sum("n").alias("nl")), l.groupBy("g").agg(F.sum("n").alias("ng"))
    whole = l.agg(F.sum("n").cast("double").alias("na"))
    p = (F.col("ng") - F.col("n") + 1) / (F.col("na") - F.col("nl") + 676)
    return l.join(every, "g").join(own, "lang").crossJoin(whole).groupBy("lang").agg(F.sum("n").alias("c"), F.round(F.sum(F.col("n") * -F.log2(p)) / F.sum("n"), 7).alias("bits")).withColumnRenamed("c", "n")


@query("""WITH x AS (SELECT item_id, regexp_replace(lower(text), '[^ -~\n]', '#', 'g') AS a FROM benchmark), y AS (SELECT item_id, a, replace(a, 'th', 't') AS b FROM x) SELECT item_id, CAST(levenshtein(a, b) AS INTEGER) AS distance, round(levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 9) AS rate FROM y""")
def char_error_rate(spark, d):
    """Edit distance of each whole passage to a reading of it that writes th as t; characters beyond ASCII count as one symbol."""
    x = V.read(spark, d, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), r"[^ -~\n]", "#").alias("a")).withColumn("b", F.replace("a", F.lit("th"), F.lit("t")))
    e = F.levenshtein("a", "b")
    return x.select("item_id", e.alias("distance"), F.round(e / F.greatest(F.length("a"), F.length("b")), 9).alias("rate"))


@query(f"""WITH {TURN}, s AS (SELECT conv_id, role, turn * 10 AS a, turn * 10 + len(ws) AS b FROM turns) SELECT x.conv_id, x.role AS role_a, y.role AS role_b, count(*) AS overlaps FROM s x JOIN s y ON x.conv_id = y.conv_id AND x.role < y.role AND greatest(x.a, y.a) < least(x.b, y.b) GROUP BY ALL""")
def span_overlap_across_roles(spark, d):
    s = V.read(spark, d, "conversations").select("conv_id", "role", (F.col("turn") * 10).alias("a"), (F.col("turn") * 10 + F.size(T.words(F.col("text")))).alias("b"))
    x, y = s.select("conv_id", F.col("role").alias("role_a"), F.col("a").alias("a1"), F.col("b").alias("b1")), s.select("conv_id", F.col("role").alias("role_b"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return x.join(y, "conv_id").where("role_a < role_b and greatest(a1, a2) < least(b1, b2)").groupBy("conv_id", "role_a", "role_b").agg(F.count("*").alias("overlaps"))


@query(f"""WITH {DOCF} SELECT 'x' AS k, round(sum(both_) * 1.0 / sum(in_c), 8) AS precision, round(sum(both_) * 1.0 / sum(in_t), 8) AS recall FROM (SELECT sum(n * (n - 1) / 2.0) AS both_, 0 AS in_t, 0 AS in_c FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY lang, y) UNION ALL SELECT 0, sum(n * (n - 1) / 2.0), 0 FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY lang) UNION ALL SELECT 0, 0, sum(n * (n - 1) / 2.0) FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY y))""")
def cluster_pair_scores(spark, d):
    return M.pair_scores(scored(spark, d), "lang", "y").select(F.lit("x").alias("k"), F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query("""WITH n AS (SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)) SELECT * FROM n""")
def exposure_rollup(spark, d):
    return V.read(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("""WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: CAST(i AS INTEGER)) AS ix FROM embeddings LIMIT 0), m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), dist AS (SELECT e.vec_id, e.label, m.label AS centre, round(sqrt(sum((CAST(e.embedding[m.i] AS DOUBLE) - m.m) ** 2)), 6) AS dist FROM embeddings e, m GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, centre) AS r FROM dist)
SELECT label, count(*) AS n, round(avg(CASE WHEN label = centre THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM best WHERE r = 1 GROUP BY label""")
def centroid_predict(spark, d):
    """Nearest class centroid. There are as many centroids as labels; all of one dimension's means are one array."""
    e = V.read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centres = means.groupBy(F.col("label").alias("centre")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    gap = F.sqrt(F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z))
    best = e.crossJoin(centres).groupBy("vec_id", "label").agg(F.min(F.struct(F.round(gap, 6).alias("dist"), "centre")).alias("b"))  # a row for each label
    return best.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("label") == F.col("b.centre"), 1.0).otherwise(0.0)), 8).alias("accuracy"))
