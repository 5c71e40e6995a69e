"""Selections, layouts, lookups, rankings and samples.

A page is a document or a conversation, its section the language, its hand the source or role, a line a line of text or a turn. A word of one letter counts as unreadable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import views as V
from .profiles import toks, turn_tokens
from .registry import GLYPHS, LINE, TOK, TURN, UNIFORM, query


def select_pages(pages: DataFrame, section: str | None = None, hands: tuple[str, ...] = ()) -> DataFrame:
    """Pages of a section and of any of the hands; what is not given does not matter."""
    if section is not None:
        pages = pages.where(F.col("lang") == section)
    return pages.where(F.col("source").isin(*hands)) if hands else pages


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source IN ('src0', 'src3', 'src5', 'src9')")
def page_selection(spark, d):
    return select_pages(V.read(spark, d, "documents"), "de", ("src0", "src3", "src5", "src9")).select("doc_id", "lang", "source")


@query(f"WITH {LINE}, own AS (SELECT doc_id FROM documents WHERE lang = 'fr') SELECT doc_id, count(*) AS lines, CAST(sum(len(ws)) AS BIGINT) AS words FROM lin WHERE len(ws) > 0 AND doc_id IN (SELECT doc_id FROM own) GROUP BY doc_id")
def lines_of_selected_pages(spark, d):
    docs = V.read(spark, d, "documents")
    lines = V.lines(docs).join(select_pages(docs, "fr").select("doc_id"), "doc_id", "left_semi")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.size("ws")).alias("words"))


@query(f"WITH {LINE} SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(len(ws) AS INTEGER) AS n FROM lin WHERE len(ws) >= 9 AND len(list_filter(ws[1:9], lambda x: length(x) < 2)) = 0")
def qualifying_lines(spark, d):
    """Lines whose first nine words are all readable."""
    lines = V.lines(V.read(spark, d, "documents"))
    return lines.where((F.size("ws") >= 9) & F.forall(F.slice("ws", 1, 9), lambda x: F.length(x) >= 2)).select("doc_id", "line", F.size("ws").alias("n"))


SEALED = "CAST(floor(" + UNIFORM.format("CAST(doc_id AS VARCHAR)") + " * 10) AS INTEGER) = 0"


@query(f"SELECT lang, count(*) AS pages FROM documents WHERE lang IN ('en', 'es') AND NOT ({SEALED}) GROUP BY lang")
def pages_off_sealed(spark, d):
    """Pages of two sections that are not sealed: a semi join on the section and an anti join on the sealed pages."""
    pages = V.read(spark, d, "documents").select("doc_id", "lang")
    sealed = pages.where(T.hash_fold(F.col("doc_id").cast("string"), 10) == 0).select("doc_id")
    return pages.where(F.col("lang").isin("en", "es")).join(sealed, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("pages"))


@query(f"""WITH {TOK}, ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w HAVING length(w) >= 6)
SELECT bin, CAST(length(w) AS INTEGER) AS len, count(DISTINCT w) AS labels, count(*) AS splits FROM (SELECT w, CASE WHEN n = 1 THEN '1' WHEN n < 5 THEN '2-4' WHEN n < 20 THEN '5-19' ELSE '20+' END AS bin, unnest(range(3, length(w) - 2)) AS k FROM ty) GROUP BY ALL""")
def label_splits(spark, d):
    """Long words by frequency bin and length, and their cuts that leave three letters on either side."""
    ty = V.types(toks(spark, d)).where(F.length("w") >= 6)
    n = F.col("n")
    bins = F.when(n == 1, "1").when(n < 5, "2-4").when(n < 20, "5-19").otherwise("20+")
    rows = ty.select("w", bins.alias("bin"), F.explode(F.sequence(F.lit(3), F.length("w") - 3)).alias("k"))
    return rows.groupBy("bin", F.length("w").alias("len")).agg(F.countDistinct("w").alias("labels"), F.count("*").alias("splits"))


@query(f"""WITH {TURN}, {TOK}, slot AS (SELECT conv_id, turn, pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS slot FROM ttok)
SELECT conv_id, turn, CAST(s.pos AS INTEGER) AS pos, t.w FROM slot s JOIN tok t ON t.doc_id = s.conv_id AND t.pos = s.slot""")
def template_application(spark, d):
    """The words of a document onto the slots of the conversation of the same number, in order, as far as both reach."""
    slot = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos")) - 1
    slots = turn_tokens(spark, d).select("conv_id", "turn", "pos", slot.alias("slot"))
    words = toks(spark, d).select(F.col("doc_id").alias("conv_id"), F.col("pos").alias("slot"), "w")
    return slots.join(words, ["conv_id", "slot"]).select("conv_id", "turn", "pos", "w")


@query(f"""WITH {TURN}, u AS (SELECT role, pos = n - 1 AS last, {UNIFORM.format("concat_ws('|', conv_id, turn, pos)")} AS u FROM ttok)
SELECT role, CASE WHEN last AND u < 0.5 THEN '=' WHEN u < 0.1 THEN '-' ELSE '.' END AS sign, count(*) AS n FROM u GROUP BY ALL""")
def layout_signs(spark, d):
    """A sign behind each word: line ends get = with chance 1/2, all others - with chance 1/10, by a hash of the place."""
    u = T.hash_uniform(F.col("conv_id"), F.col("turn"), F.col("pos"))
    rows = turn_tokens(spark, d).select("role", (F.col("pos") == F.col("n") - 1).alias("last"), u.alias("u"))
    sign = F.when(F.col("last") & (F.col("u") < 0.5), "=").when(F.col("u") < 0.1, "-").otherwise(".")
    return rows.groupBy("role", sign.alias("sign")).agg(F.count("*").alias("n"))


@query(f"""WITH {TURN} SELECT role, gap, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS letters FROM (SELECT role, w, CASE WHEN nxt IS NULL THEN 'line' WHEN length(w) < 2 OR length(nxt) < 2 THEN 'uncertain' ELSE 'ordinary' END AS gap FROM (SELECT role, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok)) GROUP BY ALL""")
def gap_after(spark, d):
    """What kind of gap follows each word."""
    rows = turn_tokens(spark, d).withColumn("nxt", F.lead("w").over(V.within("conv_id", "turn")))
    short = (F.length("w") < 2) | (F.length("nxt") < 2)
    gap = F.when(F.col("nxt").isNull(), "line").when(short, "uncertain").otherwise("ordinary")
    return rows.groupBy("role", gap.alias("gap")).agg(F.count("*").alias("n"), F.sum(F.length("w")).alias("letters"))


@query(f"""WITH {TURN}, g AS (SELECT CASE WHEN n = 1 THEN 'only' WHEN pos = 0 THEN 'first' WHEN pos = n - 1 THEN 'last' ELSE 'inner' END AS word_place, gs, unnest(range(len(gs))) AS i FROM (SELECT pos, n, {GLYPHS.format('w')} AS gs FROM ttok))
SELECT gs[i + 1] AS glyph, word_place, CASE WHEN len(gs) = 1 THEN 'only' WHEN i = 0 THEN 'first' WHEN i = len(gs) - 1 THEN 'last' ELSE 'inner' END AS glyph_place, count(*) AS n FROM g GROUP BY ALL""")
def glyph_occurrences(spark, d):
    """Every glyph of every word of every line, by the place of the word in its line and of the glyph in its word."""
    place = lambda i, n: F.when(n == 1, "only").when(i == 0, "first").when(i == n - 1, "last").otherwise("inner")
    rows = turn_tokens(spark, d).select(place(F.col("pos"), F.col("n")).alias("word_place"), T.glyphs(F.col("w")).alias("gs"))
    rows = rows.groupBy("word_place", "gs").agg(F.count("*").alias("n")).select("word_place", "n", F.size("gs").alias("k"), F.posexplode("gs").alias("i", "glyph"))
    return rows.groupBy("glyph", "word_place", place(F.col("i"), F.col("k")).alias("glyph_place")).agg(F.sum("n").alias("n"))


OTHER = "list_transform(ws, lambda x: replace(x, 'th', 't'))"


@query(f"""WITH {LINE}, b AS (SELECT doc_id, line, {OTHER} AS ws FROM lin WHERE len(ws) > 0 AND {UNIFORM.format("concat_ws('|', doc_id, line)")} < 0.7),
p AS (SELECT a.ws AS x, b.ws AS y FROM lin a JOIN b USING (doc_id, line) WHERE len(a.ws) = len(b.ws) AND length(list_aggregate(b.ws, 'string_agg', '')) BETWEEN 0.8 * length(list_aggregate(a.ws, 'string_agg', '')) AND 1.25 * length(list_aggregate(a.ws, 'string_agg', '')))
SELECT x[i] AS a, y[i] AS b, count(*) AS n FROM (SELECT x, y, unnest(range(1, len(x) + 1)) AS i FROM p) WHERE x[i] <> y[i] GROUP BY ALL""")
def seed_pairs(spark, d):
    """Words of two readings of a line, zipped where page, line number and word count agree and the lengths are alike; pairs that differ."""
    lines = V.lines(V.read(spark, d, "documents")).select("doc_id", "line", "ws")
    other = lines.where(T.hash_uniform(F.col("doc_id"), F.col("line")) < 0.7).select("doc_id", "line", F.transform("ws", lambda x: F.replace(x, F.lit("th"), F.lit("t"))).alias("vs"))
    size = lambda c: F.length(F.array_join(c, ""))
    both = lines.join(other, ["doc_id", "line"]).where((F.size("ws") == F.size("vs")) & size("vs").between(0.8 * size("ws"), 1.25 * size("ws")))
    pairs = both.select(F.explode(F.arrays_zip("ws", "vs")).alias("p")).where("p.ws <> p.vs")
    return pairs.groupBy(F.col("p.ws").alias("a"), F.col("p.vs").alias("b")).agg(F.count("*").alias("n"))


@query("""SELECT c.role, coalesce(d.lang, 'unknown') AS lang, coalesce(l.quality, -1) AS quality, count(*) AS n FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 20 + c.turn LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL""")
def metadata_enrichment(spark, d):
    """Turns with the metadata of the document they are aligned with, where there is one."""
    turns = V.read(spark, d, "conversations").select("role", (F.col("conv_id") * 20 + F.col("turn")).alias("doc_id"))
    docs, labels = V.read(spark, d, "documents").select("doc_id", "lang"), V.read(spark, d, "labels").select("doc_id", "quality")
    rows = turns.join(docs, "doc_id", "left").join(labels, "doc_id", "left")
    return rows.groupBy("role", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)
SELECT a.user_id, a.n AS n_view, b.n AS n_click, round(b.v / b.n - a.v / a.n, 6) AS difference FROM s a JOIN s b USING (user_id) WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def paired_rows(spark, d):
    """One row a user from its control and its treated row; each side has one row a key, as it is aggregated by it."""
    s = V.read(spark, d, "events").where(F.col("event_type").isin("view", "click")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    side = lambda kind: s.where(F.col("event_type") == kind).select("user_id", F.col("n").alias(f"n_{kind}"), (F.col("v") / F.col("n")).alias(kind))
    return side("view").join(side("click"), "user_id").select("user_id", "n_view", "n_click", F.round(F.col("click") - F.col("view"), 6).alias("difference"))


@query(f"""WITH {TURN}, lab AS (SELECT DISTINCT conv_id, w FROM ttok WHERE role = 'user' AND length(w) >= 5), own AS (SELECT DISTINCT conv_id, w FROM ttok WHERE role <> 'user'), adj AS (SELECT DISTINCT conv_id, w, nxt FROM (SELECT conv_id, role, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok) WHERE nxt IS NOT NULL AND role <> 'user'),
cut AS (SELECT conv_id, w, substr(w, 1, k) AS x, substr(w, k + 1) AS y FROM (SELECT conv_id, w, unnest(range(2, length(w) - 1)) AS k FROM lab)), spl AS (SELECT DISTINCT cut.conv_id, cut.w FROM cut JOIN adj ON adj.conv_id = cut.conv_id AND adj.w = x AND adj.nxt = y)
SELECT count(*) AS labels, count(o.w) AS whole_hits, count(s.w) AS split_hits FROM lab LEFT JOIN own o ON o.conv_id = lab.conv_id AND o.w = lab.w LEFT JOIN spl s ON s.conv_id = lab.conv_id AND s.w = lab.w""")
def label_hits(spark, d):
    """Long words of user turns that stand whole, or as two neighbouring words, in the other turns of their conversation."""
    t = turn_tokens(spark, d)
    labels = t.where((F.col("role") == "user") & (F.length("w") >= 5)).select("conv_id", "w").distinct()
    rest = t.where("role <> 'user'")
    whole = rest.select("conv_id", "w").distinct().withColumn("whole", F.lit(1))
    adjacent = V.adjacent(rest, ("conv_id", "turn")).select("conv_id", F.col("w").alias("x"), F.col("nxt").alias("y")).distinct()
    cuts = labels.select("conv_id", "w", F.explode(F.sequence(F.lit(2), F.length("w") - 2)).alias("k")).selectExpr("conv_id", "w", "substring(w, 1, k) AS x", "substring(w, k + 1) AS y")
    split = cuts.join(adjacent, ["conv_id", "x", "y"]).select("conv_id", "w").distinct().withColumn("split", F.lit(1))
    return labels.join(whole, ["conv_id", "w"], "left").join(split, ["conv_id", "w"], "left").agg(F.count("*").alias("labels"), F.count("whole").alias("whole_hits"), F.count("split").alias("split_hits"))


@query(f"""WITH {TURN}, p AS (SELECT conv_id, turn, w, sum(length(w)) OVER q - length(w) AS a, sum(length(w)) OVER q AS b FROM ttok WINDOW q AS (PARTITION BY conv_id, turn ORDER BY pos)), len AS (SELECT conv_id, turn, max(b) AS n FROM p GROUP BY ALL),
blk AS (SELECT conv_id, turn, k, k * 5 AS a, least(n, k * 5 + 5) AS b FROM (SELECT conv_id, turn, n, unnest(range(CAST((n + 4) // 5 AS BIGINT))) AS k FROM len)), o AS (SELECT blk.conv_id, blk.turn, blk.k, p.a, p.w, least(p.b, blk.b) - greatest(p.a, blk.a) AS shared FROM blk JOIN p ON p.conv_id = blk.conv_id AND p.turn = blk.turn AND p.a < blk.b AND blk.a < p.b)
SELECT conv_id, turn, CAST(k AS INTEGER) AS block, w AS label, CAST(shared AS INTEGER) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY shared DESC, a) AS r FROM o) WHERE r = 1""")
def interval_alignment(spark, d):
    """Blocks of five letters against words, by running lengths: each block's label is the word that it shares most letters with. A block meets a word in the one or two multiples of five that the word touches, so the join is on equal keys."""
    t = turn_tokens(spark, d)
    end = F.sum(F.length("w")).over(Window.partitionBy("conv_id", "turn").orderBy("pos"))
    spans = t.select("conv_id", "turn", "w", end.cast("int").alias("b")).withColumn("a", F.col("b") - F.length("w"))
    met = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / 5).cast("int"), F.floor((F.col("b") - 1) / 5).cast("int"))))
    shared = F.least("b", F.col("block") * 5 + 5) - F.greatest("a", F.col("block") * 5)
    best = met.withColumn("shared", shared).groupBy("conv_id", "turn", "block").agg(F.max_by(F.struct("w", "shared"), F.struct("shared", -F.col("a"))).alias("x"))
    return best.select("conv_id", "turn", "block", F.col("x.w").alias("label"), F.col("x.shared").alias("shared"))


@query(f"""WITH {LINE}, f AS (SELECT CAST(j AS INTEGER) AS j, right(ws[j], 1) AS a, left(ws[j + 2], 1) AS b FROM (SELECT ws, unnest(range(1, 8)) AS j FROM lin WHERE len(ws) >= 9)), c AS (SELECT j, a, b, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY ALL), t AS (SELECT j, sum(n) AS total FROM c GROUP BY j), ca AS (SELECT j, a, sum(n) AS na FROM c GROUP BY ALL), cb AS (SELECT j, b, sum(n) AS nb FROM c GROUP BY ALL)
SELECT j, CAST(max(total) AS BIGINT) AS pairs, round(sum(n / total * log2(n * total / (na * nb))), 8) AS mi FROM c JOIN t USING (j) JOIN ca USING (j, a) JOIN cb USING (j, b) GROUP BY j""")
def position_contributions(spark, d):
    """Information between the end of the word at place j and the beginning of the next but one, by place."""
    from ..operators import information as I

    lines = V.lines(V.read(spark, d, "documents")).where(F.size("ws") >= 9)
    rows = lines.select("ws", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("j")).select("j", F.expr("right(element_at(ws, j), 1)").alias("a"), F.expr("left(element_at(ws, j + 2), 1)").alias("b"))
    mi = I.mutual_information(rows.groupBy("j", "a", "b").agg(F.count("*").alias("n")), "j")
    return mi.select("j", F.col("total").cast("long").alias("pairs"), F.round("mi", 8).alias("mi"))


@query(f"""WITH {TURN} SELECT role, w, left(nxt, 1) AS initial, count(*) AS n FROM (SELECT role, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok) WHERE length(w) >= 2 AND length(nxt) >= 2 GROUP BY ALL HAVING count(*) >= 3""")
def next_initial_streams(spark, d):
    """Readable words with the first letter of the readable word behind them."""
    rows = turn_tokens(spark, d).withColumn("nxt", F.lead("w").over(V.within("conv_id", "turn"))).where("length(w) >= 2 and length(nxt) >= 2")
    return rows.groupBy("role", "w", F.expr("left(nxt, 1)").alias("initial")).agg(F.count("*").alias("n")).where("n >= 3")


@query(f"""WITH {TOK}, ty AS (SELECT lang, w, count(*) AS n, min(doc_id * 1000000 + pos) AS spot FROM tok GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, spot) AS f, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS i, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS a FROM ty)
SELECT policy, lang, w, n FROM (SELECT 'first' AS policy, lang, w, n FROM r WHERE f <= 10 UNION ALL SELECT 'identity', lang, w, n FROM r WHERE i <= 10 UNION ALL SELECT 'all', lang, w, n FROM r WHERE a <= 10)""")
def top_words_by_tie_policy(spark, d):
    """The ten most frequent words of each section, ties going to the first in the text, to the first in the alphabet, or all kept."""
    ty = toks(spark, d, "lang").groupBy("lang", "w").agg(F.count("*").alias("n"), F.min(F.col("doc_id") * 1000000 + F.col("pos")).alias("at"))
    by = lambda *c: Window.partitionBy("lang").orderBy(F.desc("n"), *c)
    ranked = ty.select("lang", "w", "n", F.row_number().over(by("at")).alias("first"), F.row_number().over(by("w")).alias("identity"), F.rank().over(by()).alias("all"))
    long = ranked.select("lang", "w", "n", F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("rank")) for p in ("first", "identity", "all")))).alias("x"))
    return long.where("x.rank <= 10").select("x.policy", "lang", "w", "n")


@query(f"""WITH {TOK}, ty AS (SELECT w, count(*) AS n FROM tok GROUP BY w), g AS (SELECT k, substr(w, i, k) AS unit, sum(n) AS n FROM (SELECT w, n, k, unnest(range(1, length(w) - k + 2)) AS i FROM ty, (SELECT unnest([1, 2, 3]) AS k) WHERE length(w) >= k) GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, unit, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, unit) AS r FROM g) WHERE r <= 50""")
def unit_inventory(spark, d):
    """The 50 most frequent units of one, two and three letters."""
    ty = V.types(toks(spark, d)).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("w")))))
    units = ty.select("k", "n", F.explode(F.expr("transform(sequence(1, length(w) - k + 1), i -> substring(w, i, k))")).alias("unit")).groupBy("k", "unit").agg(F.sum("n").alias("n"))
    r = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "unit"))
    return units.withColumn("r", r).where("r <= 50").select("k", "unit", "n")


@query("""WITH c AS (SELECT user_id, event_id, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) SELECT user_id, event_id, loss, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY loss, user_id) AS rank FROM c WHERE r = 1) WHERE rank <= 20""")
def retained_candidates(spark, d):
    """Each candidate's best attempt, and of those the 20 with the least loss, ties by id."""
    best = V.read(spark, d, "events").groupBy("user_id").agg(F.min(F.struct(F.col("value").alias("loss"), "event_id")).alias("x")).select("user_id", "x.event_id", "x.loss")
    top = best.orderBy("loss", "user_id").limit(20)  # a top-k report
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("loss", "user_id")))


@query("SELECT doc_id, md5(concat_ws('|', 7, doc_id)) AS draw FROM documents ORDER BY draw, doc_id LIMIT 100")
def reservoir_sample(spark, d):
    """A sample of 100 that does not depend on the order of rows: those with the least hash."""
    rows = V.read(spark, d, "documents").select("doc_id", F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string"))).alias("draw"))
    return rows.orderBy("draw", "doc_id").limit(100)


@query(f"""WITH {TOK}, n AS (SELECT lang, doc_id, count(*) AS n FROM tok GROUP BY ALL HAVING count(*) >= 20), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', 3, doc_id)), doc_id) AS r FROM n), p AS (SELECT lang, doc_id, CAST(floor({UNIFORM.format("concat_ws('|', 4, doc_id)")} * (n - 19)) AS INTEGER) AS a FROM r WHERE r <= 5)
SELECT p.lang, p.doc_id, a AS start, string_agg(w, ' ' ORDER BY pos) AS passage FROM p JOIN tok USING (doc_id) WHERE pos >= a AND pos < a + 20 GROUP BY p.lang, p.doc_id, a""")
def sampled_passages(spark, d):
    """Five passages of 20 words from each section, drawn by a hash: first the page, then the place."""
    words = V.read(spark, d, "documents").select("lang", "doc_id", T.words(F.col("text")).alias("ws")).withColumn("n", F.size("ws")).where("n >= 20")
    draw = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat_ws("|", F.lit("3"), F.col("doc_id").cast("string"))), "doc_id"))
    chosen = words.select("lang", "doc_id", "n", draw.alias("r")).where("r <= 5").select("lang", "doc_id", F.floor(T.hash_uniform(F.lit(4), F.col("doc_id")) * (F.col("n") - 19)).cast("int").alias("start"))
    return words.select("doc_id", "ws").join(F.broadcast(chosen), "doc_id").select("lang", "doc_id", "start", F.array_join(F.slice("ws", F.col("start") + 1, 20), " ").alias("passage"))  # five rows a section


@query("""WITH o AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY ALL), p AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT CASE WHEN o.n IS NULL THEN 'added' WHEN p.n IS NULL THEN 'removed' WHEN o.n = p.n THEN 'same' ELSE 'changed' END AS change, event_type AS path, count(*) AS n FROM o FULL JOIN p USING (user_id, event_type) GROUP BY ALL""")
def scope_changes(spark, d):
    """Two manifests, flattened to paths and values, by what became of each path."""
    e = V.read(spark, d, "events")
    side = lambda k, c: e.where(F.col("event_id") % 2 == k).groupBy("user_id", F.col("event_type").alias("path")).agg(F.count("*").alias(c))
    both = side(0, "old").join(side(1, "new"), ["user_id", "path"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return both.groupBy(change.alias("change"), "path").agg(F.count("*").alias("n"))
