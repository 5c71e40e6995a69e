"""Shuffle controls, negatives, planted signals, matched draws, classical tests and capacity checks.

All chance is a hash of the place, so a control is the same in every engine. A shuffle keeps the words of each stratum and changes their order alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import information as I
from ..operators import metrics as M
from ..operators import views as V
from .profiles import toks, turn_tokens
from .registry import LINE, TOK, TURN, UNIFORM, mi_sql, query


def md5_of(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def shuffled(rows: DataFrame, strata: list[Column], place: list[Column], payload: str, *keep: str) -> DataFrame:
    """rows with payload dealt anew within the strata by the order of a hash of the place; strata of any size, as the windows spill."""
    named = rows.select("*", *(s.alias(f"__s{i}") for i, s in enumerate(strata)))
    keys = [f"__s{i}" for i in range(len(strata))]
    own = named.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*place)))
    drawn = named.select(*keys, F.col(payload).alias("__p"), F.row_number().over(Window.partitionBy(*keys).orderBy(md5_of(*place), *place)).alias("__k"))
    return own.join(drawn, [*keys, "__k"]).select(*keep, F.col("__p").alias(payload))


def shuffle_sql(strata: str, payload: str = "w", rows: str = "ttok") -> str:
    return f"""a AS (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY conv_id, turn, pos) AS k FROM {rows}), b AS (SELECT {strata}, {payload} AS drawn, row_number() OVER (PARTITION BY {strata} ORDER BY md5(concat_ws('|', conv_id, turn, pos)), conv_id, turn, pos) AS k FROM {rows})"""


PLACE = ("conv_id", "turn", "pos")


def place() -> list[Column]:
    return [F.col(c) for c in PLACE]


@query(f"WITH {TURN}, {shuffle_sql('conv_id, turn')} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, drawn AS w FROM a JOIN b USING (conv_id, turn, k)")
def shuffled_lines(spark, d):
    """Words shuffled within each line."""
    return shuffled(turn_tokens(spark, d), [F.col("conv_id"), F.col("turn")], place(), "w", *PLACE)


@query(f"WITH {TURN}, {shuffle_sql('conv_id')} SELECT a.conv_id, turn, CAST(pos AS INTEGER) AS pos, drawn AS w FROM a JOIN b USING (conv_id, k)")
def shuffled_pages(spark, d):
    """Words shuffled within each page; lines keep their lengths."""
    return shuffled(turn_tokens(spark, d), [F.col("conv_id")], place(), "w", *PLACE)


ROLE = "CASE WHEN pos = 0 THEN 'first' WHEN pos = n - 1 THEN 'last' ELSE 'inner' END"


@query(f"WITH {TURN}, r AS (SELECT *, {ROLE} AS part FROM ttok), {shuffle_sql('conv_id, part', rows='r')} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, drawn AS w FROM a JOIN b USING (conv_id, part, k)")
def shuffled_within_roles(spark, d):
    """Words shuffled within each page among those at the same kind of place: first, last, inner."""
    return shuffled(turn_tokens(spark, d), [F.col("conv_id"), F.expr(ROLE)], place(), "w", *PLACE)


@query(f"WITH {TURN}, f AS (SELECT * FROM ttok WHERE pos = 0), {shuffle_sql('role', rows='f')} SELECT conv_id, turn, drawn AS w FROM a JOIN b USING (role, k)")
def shuffled_first_words(spark, d):
    """First words of lines shuffled among all lines of a hand; the rest stays."""
    return shuffled(turn_tokens(spark, d).where("pos = 0"), [F.col("role")], place(), "w", "conv_id", "turn")


@query(f"WITH {TURN}, e AS (SELECT *, right(w, 1) AS e FROM ttok WHERE length(w) >= 2), {shuffle_sql('conv_id', 'e', 'e')} SELECT a.conv_id, turn, CAST(pos AS INTEGER) AS pos, left(w, length(w) - 1) || drawn AS w FROM a JOIN b USING (conv_id, k)")
def permuted_endings(spark, d):
    """Last letters shuffled within each page; beginnings stay."""
    rows = turn_tokens(spark, d).where("length(w) >= 2").withColumn("e", F.expr("right(w, 1)"))
    return shuffled(rows, [F.col("conv_id")], place(), "e", *PLACE, "w").select(*PLACE, F.concat(F.expr("substring(w, 1, length(w) - 1)"), "e").alias("w"))


@query(f"""WITH {TURN}, ty AS (SELECT DISTINCT w FROM ttok), c AS (SELECT w, i, substr(w, i, 1) AS ch FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM ty)) SELECT w, string_agg(ch, '' ORDER BY md5(concat_ws('|', w, i)), i) AS shuffled FROM c GROUP BY w""")
def shuffled_symbols(spark, d):
    """Letters shuffled within each type, once for all its occurrences."""
    ty = turn_tokens(spark, d).select("w").distinct()
    drawn = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.struct(md5_of(F.col("w"), i).alias("h"), i.alias("i"), F.substring(F.col("w"), i, F.lit(1)).alias("c")))
    return ty.select("w", F.array_join(F.transform(F.sort_array(drawn), lambda x: x["c"]), "").alias("shuffled"))


LETTERS = "l AS (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM benchmark), ch AS (SELECT item_id, t, length(t) AS n, i, substr(t, CAST(i + 1 AS BIGINT), 1) AS c FROM (SELECT item_id, t, unnest(range(length(t))) AS i FROM l))"


@query(f"""WITH {LETTERS}
SELECT item_id, 'shuffled' AS kind, string_agg(c, '' ORDER BY md5(concat_ws('|', item_id, i)), i) AS text FROM ch GROUP BY item_id UNION ALL
SELECT item_id, 'drawn', string_agg(substr(t, CAST(floor({UNIFORM.format("concat_ws('|', 1, item_id, i)")} * n) AS BIGINT) + 1, 1), '' ORDER BY i) FROM ch GROUP BY item_id UNION ALL
SELECT item_id, 'reversed', string_agg(c, '' ORDER BY i // 5, i DESC) FROM ch GROUP BY item_id""")
def cipher_negatives(spark, d):
    """Three negatives of each passage's letters: shuffled, drawn with replacement, reversed in blocks of five."""
    t = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    rows = V.read(spark, d, "benchmark").select("item_id", t.alias("t")).where("t <> ''").withColumn("at", F.sequence(F.lit(0), F.length("t") - 1))
    letter = lambda i: F.substring(F.col("t"), i + 1, F.lit(1))
    by = lambda *key: F.array_join(F.transform(F.sort_array(F.transform("at", lambda i: F.struct(*(k(i).alias(f"k{j}") for j, k in enumerate(key)), letter(i).alias("c")))), lambda x: x["c"]), "")
    drawn = F.array_join(F.transform("at", lambda i: letter(F.floor(T.hash_uniform(F.lit(1), F.col("item_id"), i) * F.length("t")).cast("int"))), "")
    kinds = {"shuffled": by(lambda i: md5_of(F.col("item_id"), i), lambda i: i), "drawn": drawn, "reversed": by(lambda i: F.floor(i / 5), lambda i: -i)}
    return rows.select("item_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in kinds.items()))).alias("x")).select("item_id", "x.kind", "x.text")


@query(f"""WITH {TURN}, p AS (SELECT role, pos = n - 1 AS last, w LIKE '%m' AS own, w LIKE '%m' OR (pos = n - 1 AND {UNIFORM.format("concat_ws('|', 9, conv_id, turn, pos)")} < 0.3) AS planted FROM ttok)
SELECT role, last, count(*) AS n, round(avg(CASE WHEN own THEN 1.0 ELSE 0.0 END), 9) AS before, round(avg(CASE WHEN planted THEN 1.0 ELSE 0.0 END), 9) AS after FROM p GROUP BY ALL""")
def planted_endings(spark, d):
    """The rate of words in m, inside lines and at their ends, before and after an m is planted at three line ends of ten."""
    u = T.hash_uniform(F.lit(9), F.col("conv_id"), F.col("turn"), F.col("pos"))
    rows = turn_tokens(spark, d).select("role", (F.col("pos") == F.col("n") - 1).alias("last"), F.col("w").endswith("m").alias("own"), u.alias("u"))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return rows.groupBy("role", "last").agg(F.count("*").alias("n"), rate(F.col("own")).alias("before"), rate(F.col("own") | (F.col("last") & (F.col("u") < 0.3))).alias("after"))


@query(f"""WITH {TOK}, ty AS (SELECT w, length(w) AS len, CASE WHEN count(*) < 5 THEN 1 WHEN count(*) < 20 THEN 2 ELSE 3 END AS bin FROM tok GROUP BY w), r AS (SELECT *, row_number() OVER (PARTITION BY len, bin ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY len, bin) AS k FROM ty), x AS (SELECT w, len, bin, CAST(floor({UNIFORM.format("concat_ws('|', 5, w)")} * k) AS BIGINT) AS i FROM r WHERE w LIKE '%n')
SELECT x.w, r.w AS control FROM x JOIN r USING (len, bin, i)""")
def matched_cell_draws(spark, d):
    """For each type in n, another drawn by a hash from the types of its length and frequency bin; cells are numbered, so none is gathered."""
    n = F.col("n")
    ty = V.types(toks(spark, d)).select("w", F.length("w").alias("len"), F.when(n < 5, 1).when(n < 20, 2).otherwise(3).alias("bin"))
    cells = ty.groupBy("len", "bin").agg(F.count("*").alias("k"))
    numbered = ty.withColumn("i", F.row_number().over(Window.partitionBy("len", "bin").orderBy("w")) - 1)
    wanted = ty.where(F.col("w").endswith("n")).join(F.broadcast(cells), ["len", "bin"]).select("w", "len", "bin", F.floor(T.hash_uniform(F.lit(5), F.col("w")) * F.col("k")).cast("int").alias("i"))  # a row for each length and bin
    return wanted.join(numbered.withColumnRenamed("w", "control"), ["len", "bin", "i"]).select("w", "control")


@query("""WITH f AS (SELECT l.quality AS y, length(d.text) >= 300 AS a, d.text LIKE '%.%' AND d.lang = 'en' AS b FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT sum(CASE WHEN (a = (y = 1)) AND (b <> (y = 1)) THEN 1 ELSE 0 END) AS n10, sum(CASE WHEN (a <> (y = 1)) AND (b = (y = 1)) THEN 1 ELSE 0 END) AS n01 FROM f)
SELECT CAST(n10 AS BIGINT) AS only_first, CAST(n01 AS BIGINT) AS only_second, round(least(1.0, 2 * (SELECT sum(exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2))) FROM (SELECT unnest(range(CAST(least(n10, n01) AS BIGINT) + 1)) AS i))), 8) AS p FROM c""")
def mcnemar_exact(spark, d):
    """Two rules that judge the same documents, by how often only one is right; the exact two-sided binomial p."""
    f = V.read(spark, d, "documents").join(V.read(spark, d, "labels"), "doc_id").select((F.col("quality") == 1).alias("y"), (F.length("text") >= 300).alias("a"), (F.col("text").contains(".") & (F.col("lang") == "en")).alias("b"))
    one = lambda x, z: F.sum(F.when((F.col(x) == F.col("y")) & (F.col(z) != F.col("y")), 1).otherwise(0))
    return f.agg(one("a", "b").alias("only_first"), one("b", "a").alias("only_second")).withColumn("p", F.round(binomial_two_sided(F.col("only_first"), F.col("only_second")), 8))


def log_gamma(x: Column) -> Column:
    """log(gamma(x)) for x >= 1: Stirling's series at x + 10, less the logarithm of the ten factors between."""
    y = x.cast("double") + 10
    product = x.cast("double")
    for k in range(1, 10):
        product = product * (x + k)
    z = 1 / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z * (1.0 / 1680 - z / 1188)))) / y
    return (y - 0.5) * F.log(y) - y + math.log(2 * math.pi) / 2 + series - F.log(product)


def binomial_two_sided(a: Column, b: Column) -> Column:
    """Twice the chance of min(a, b) or fewer of a + b fair coins, 1 at most: a term for each number of coins, so the work grows with it."""
    n = (a + b).cast("double")
    term = lambda i: F.exp(log_gamma(n + 1) - log_gamma(i + 1) - log_gamma(n - i + 1) - n * math.log(2.0))
    return F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(a, b).cast("long")), F.lit(0.0), lambda s, i: s + term(i)))


@query("""WITH s AS (SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'view' THEN value END), 6) AS d FROM events GROUP BY user_id), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM s WHERE d <> 0)
SELECT count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 4) AS w_plus, round((sum(CASE WHEN d > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(sum(r * r) / 4.0), 8) AS z FROM r""")
def wilcoxon_signed_rank(spark, d):
    """Paired differences by user: the sum of the ranks of the positive ones, and z with its variance from the ranks that ties share."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    s = V.read(spark, d, "events").groupBy("user_id").agg(F.round(mean("click") - mean("view"), 6).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    r, plus = M.average_ranks(s, "size"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0))
    n = F.count("*")
    return r.agg(n.alias("n"), F.round(plus, 4).alias("w_plus"), F.round((plus - n * (n + 1) / 4) / F.sqrt(F.sum(F.col("rank") * F.col("rank")) / 4), 8).alias("z"))


@query("""WITH s AS (SELECT event_type = 'click' AS g, value FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM s), a AS (SELECT CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) AS DOUBLE) AS n1, CAST(sum(CASE WHEN g THEN 0 ELSE 1 END) AS DOUBLE) AS n2, sum(CASE WHEN g THEN r ELSE 0 END) AS s1 FROM r)
SELECT round(s1 - n1 * (n1 + 1) / 2, 4) AS u, round((s1 - n1 * (n1 + 1) / 2) / (n1 * n2), 9) AS share FROM a""")
def mann_whitney(spark, d):
    """How often a value of one kind is above one of the other, ties counting half; values are counted before they are ranked."""
    s = V.read(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("value", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("y"))
    u = M.roc_auc(s, "value", "y")
    return u.select(F.round(F.col("auc") * F.col("positives") * F.col("negatives"), 4).alias("u"), F.round("auc", 9).alias("share"))


@query(f"""WITH {TOK}, b AS (SELECT doc_id, pos // 8 AS blk, left(w, 1) AS a FROM tok), n AS (SELECT doc_id, max(blk) + 1 AS k FROM b GROUP BY doc_id), bl AS (SELECT DISTINCT doc_id, blk FROM b), o AS (SELECT doc_id, blk, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, blk)), doc_id, blk) AS r, row_number() OVER (ORDER BY doc_id, blk) AS s FROM bl), m AS (SELECT x.doc_id, x.blk, y.doc_id AS page FROM o x JOIN o y ON x.r = y.s),
c AS (SELECT a, page AS b, count(*) AS n FROM (SELECT b.a, m.page FROM b JOIN m USING (doc_id, blk)) GROUP BY ALL), co AS (SELECT a, doc_id AS b, count(*) AS n FROM b GROUP BY ALL), x AS ({mi_sql('c')}), y AS ({mi_sql('co')}) SELECT CAST(y.total AS BIGINT) AS tokens, round(y.mi, 7) AS observed, round(x.mi, 7) AS permuted FROM x, y""")
def block_permutation_null(spark, d):
    """Information between words' beginnings and pages, as it is and with blocks of eight words dealt to other pages: blocks are ordered by a hash, in chunks of the hash, and take the page of the block with their number."""
    tok = toks(spark, d).select("doc_id", F.floor(F.col("pos") / 8).cast("long").alias("blk"), F.expr("left(w, 1)").alias("a"))
    blocks = tok.select("doc_id", "blk").distinct()
    order = numbered(blocks.withColumn("h", md5_of(F.col("doc_id"), F.col("blk"))), F.substring("h", 1, 2), ["h", "doc_id", "blk"]).select("doc_id", "blk", "number")
    pages = blocks.groupBy("doc_id").agg(F.count("*").alias("k"))
    firsts = numbered_by_sum(pages).select(F.col("doc_id").alias("page"), F.explode(F.sequence(F.col("before"), F.col("before") + F.col("k") - 1)).alias("number"))
    moved = tok.join(order.join(firsts, "number"), ["doc_id", "blk"])
    cells = lambda rows, page: I.mutual_information(rows.groupBy("a", F.col(page).alias("b")).agg(F.count("*").alias("n")))
    own = cells(tok, "doc_id").select(F.col("total").cast("long").alias("tokens"), F.round("mi", 7).alias("observed"))
    return own.crossJoin(cells(moved, "page").select(F.round("mi", 7).alias("permuted")))  # one row each


def numbered(rows: DataFrame, chunk: Column, order: list[str]) -> DataFrame:
    """rows with number, from 0, in that order; chunk: parts of the rows that follow one another in it, so no task gets all."""
    own = rows.withColumn("__c", chunk)
    counts = own.groupBy("__c").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each chunk
    rank = F.row_number().over(Window.partitionBy("__c").orderBy(*order)) - 1
    return own.withColumn("__r", rank).join(F.broadcast(counts.select("__c", before.alias("__b"))), "__c").withColumn("number", F.col("__b") + F.col("__r")).drop("__c", "__r", "__b")


def numbered_by_sum(rows: DataFrame, key: str = "doc_id", weight: str = "k", step: int = 1024) -> DataFrame:
    """rows with before: the sum of the weights of rows with smaller keys, in chunks of the key."""
    own = rows.withColumn("__c", F.floor(F.col(key) / step))
    sums = own.groupBy("__c").agg(F.sum(weight).alias("__n"))
    low = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each chunk
    inner = F.coalesce(F.sum(weight).over(Window.partitionBy("__c").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("__i", inner).join(sums.select("__c", low.alias("__l")), "__c").withColumn("before", F.col("__l") + F.col("__i")).drop("__c", "__i", "__l")


CAP = f"""u AS (SELECT lang, doc_id, pos // 128 AS blk, left(w, 1) AS a, left(lead(w) OVER (PARTITION BY doc_id, pos // 128 ORDER BY pos), 1) AS b FROM tok), e1 AS (SELECT lang, doc_id, blk, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h1, sum(n) AS size FROM (SELECT lang, doc_id, blk, a, CAST(count(*) AS DOUBLE) AS n FROM u GROUP BY ALL) GROUP BY ALL), e2 AS (SELECT lang, doc_id, blk, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h2 FROM (SELECT lang, doc_id, blk, a, b, CAST(count(*) AS DOUBLE) AS n FROM u WHERE b IS NOT NULL GROUP BY ALL) GROUP BY ALL),
h AS (SELECT lang, h1, h2 - h1 AS rate FROM e1 JOIN e2 USING (lang, doc_id, blk) WHERE size = 128)"""


def block_rates(spark, d):
    """lang, h1 and rate, the entropy of pairs less that of single first letters, for each whole block of 128 words."""
    tok = toks(spark, d, "lang").withColumn("blk", F.floor(F.col("pos") / 128)).withColumn("a", F.expr("left(w, 1)"))
    keys = ["lang", "doc_id", "blk"]
    rows = tok.select(*keys, "a", F.lead("a").over(Window.partitionBy(*keys).orderBy("pos")).alias("b"))
    cells = rows.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))  # the single letters are sums of these
    one = I.entropy(cells.groupBy(*keys, "a").agg(F.sum("n").alias("n")), *keys).select(*keys, "total", F.col("entropy").alias("h1"))
    two = I.entropy(cells.where("b is not null"), *keys).select(*keys, F.col("entropy").alias("h2"))
    return one.where("total = 128").join(two, keys).select("lang", "h1", (F.col("h2") - F.col("h1")).alias("rate"))


@query(f"""WITH {TOK}, {CAP} SELECT lang, count(*) AS blocks, round(min(rate), 7) AS low, round(avg(rate), 7) AS mean, round(max(rate), 7) AS high, round(max(h1) - min(rate), 7) AS gap FROM h GROUP BY lang""")
def capacity_gap(spark, d):
    """Least, mean and largest entropy rate of blocks, and the gap from the most that single letters could carry."""
    return block_rates(spark, d).groupBy("lang").agg(F.count("*").alias("blocks"), *(F.round(f("rate"), 7).alias(n) for n, f in (("low", F.min), ("mean", F.avg), ("high", F.max))), F.round(F.max("h1") - F.min("rate"), 7).alias("gap"))


@query(f"""WITH {TOK}, {CAP}, m AS (SELECT lang, avg(rate) AS r, avg(h1) AS h FROM h GROUP BY lang) SELECT a.lang AS source, b.lang AS target, round(a.h / b.r, 7) AS expansion, a.h <= b.r AS fits FROM m a JOIN m b ON a.lang <> b.lang""")
def required_expansion(spark, d):
    """How many symbols at one section's rate it takes to carry a letter of another section; a row for each two sections."""
    m = block_rates(spark, d).groupBy("lang").agg(F.avg("rate").alias("r"), F.avg("h1").alias("h"))
    a, b = m.select(F.col("lang").alias("source"), "h"), m.select(F.col("lang").alias("target"), "r")
    return a.crossJoin(b).where("source <> target").select("source", "target", F.round(F.col("h") / F.col("r"), 7).alias("expansion"), (F.col("h") <= F.col("r")).alias("fits"))  # sections, not rows


@query(f"""WITH {TURN}, p AS (SELECT role, conv_id, turn, n, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok), b AS (SELECT role, sum(CASE WHEN nxt IS NOT NULL THEN 1 ELSE 0 END) AS truth, sum(CASE WHEN nxt IS NOT NULL AND right(w, 1) IN ('e', 's', 'n', 't', 'd') THEN 1 ELSE 0 END) AS hit, sum(length(w) - length(regexp_replace(CASE WHEN nxt IS NULL THEN left(w, length(w) - 1) ELSE w END, '[esntd]', '', 'g')) - CASE WHEN nxt IS NULL THEN 1 ELSE 0 END) AS called FROM p GROUP BY role)
SELECT role, CAST(truth AS BIGINT) AS truth, CAST(called AS BIGINT) AS called, CAST(hit AS BIGINT) AS hit, round(2.0 * hit / (truth + called), 9) AS f1 FROM b""")
def space_boundary_f1(spark, d):
    """Spaces called behind every e, s, n, t and d against the spaces there are, within lines."""
    rows = turn_tokens(spark, d).withColumn("nxt", F.lead("w").over(V.within("conv_id", "turn")))
    inner = F.when(F.col("nxt").isNull(), F.expr("substring(w, 1, length(w) - 1)")).otherwise(F.col("w"))
    marks = F.length(inner) - F.length(F.regexp_replace(inner, "[esntd]", ""))
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.groupBy("role").agg(flag(F.col("nxt").isNotNull()).alias("truth"), F.sum(marks).alias("called"), flag(F.col("nxt").isNotNull() & F.expr("right(w, 1)").isin("e", "s", "n", "t", "d")).alias("hit"))
    return out.withColumn("f1", F.round(2 * F.col("hit") / (F.col("truth") + F.col("called")), 9))


@query(f"""WITH {LINE}, f AS (SELECT doc_id, right(w, 1) AS e, lead(left(w, 1)) OVER (PARTITION BY doc_id, line ORDER BY pos) AS b FROM ltok), l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, e = 's' AS y, b = 't' AS x FROM f WHERE b IS NOT NULL)
SELECT half, count(*) AS n, round(avg(CASE WHEN x THEN CASE WHEN y THEN 1.0 ELSE 0.0 END END) - avg(CASE WHEN NOT x THEN CASE WHEN y THEN 1.0 ELSE 0.0 END END), 9) AS difference, round(CAST(sum(CASE WHEN x AND y THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN NOT x AND NOT y THEN 1 ELSE 0 END) / (CAST(sum(CASE WHEN x AND NOT y THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN NOT x AND y THEN 1 ELSE 0 END)), 7) AS odds_ratio FROM l GROUP BY half""")
def indicator_halves(spark, d):
    """Difference of rates and odds ratio of one edge letter given the next word's, in two halves of the pages."""
    t = V.line_tokens(V.read(spark, d, "documents"))
    nxt = F.lead(F.expr("left(w, 1)")).over(V.within("doc_id", "line"))
    rows = t.select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("half"), (F.expr("right(w, 1)") == "s").alias("y"), (nxt == "t").alias("x")).where("x is not null")
    cells = rows.groupBy("half").agg(F.count("*").alias("n"), *(F.sum(F.when((F.col("x") == x) & (F.col("y") == y), 1).otherwise(0)).cast("double").alias(f"c{int(x)}{int(y)}") for x in (True, False) for y in (True, False)))
    return cells.selectExpr("half", "n", "round(c11 / (c11 + c10) - c01 / (c01 + c00), 9) AS difference", "round(c11 * c00 / (c10 * c01), 7) AS odds_ratio")
