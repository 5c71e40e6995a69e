"""Transcription sources: the conversations are written out in either format, as text files in the shared folder, and read back.

A conversation is a page, a turn a line; system turns are labels. A word of one letter follows a doubtful space; words that begin with k get a mark of doubt.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import views as V
from ..sources import transcription as X
from ..sources.sinks import shared_folder
from .registry import TURN, query


def turns(spark, d) -> DataFrame:
    rows = V.read(spark, d, "conversations").select("conv_id", "turn", "role", T.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    q = Window.partitionBy("conv_id").orderBy("turn")
    marked = F.transform("ws", lambda w: F.when(w.startswith("k"), F.concat(w, F.lit("?"))).otherwise(w))
    body = F.array_join(F.transform(marked, lambda w, i: F.concat(F.when(i == 0, "").when(F.length(F.get("ws", i)) == 1, ",").otherwise("."), w)), "")
    return rows.select("*", body.alias("body"), F.lead("role").over(q).alias("later"))


def written(spark, rows: DataFrame, line, head=None) -> str:
    """A file text for each page, its lines in order; returns the folder."""
    pages = rows.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    value = F.col("lines") if head is None else F.concat(head, F.lit("\n"), F.col("lines"))
    path = f"{shared_folder(spark)}/transcription-{uuid.uuid4().hex}"
    pages.select(value.alias("value")).write.text(path)
    return path


def tagged(spark, d) -> str:
    page = F.concat(F.lit("f"), "conv_id", F.lit("r"))
    descriptor = F.when(F.col("role") == "user", "@P0").when(F.col("role") == "assistant", "+P1").otherwise("=Lx")
    line = F.concat(F.lit("<"), page, F.lit("."), (F.col("turn") + 1).cast("string"), F.lit(","), descriptor, F.lit("> "), F.when(F.col("turn") == 0, "<%>").otherwise(""), "body", F.when(F.col("later").isNull(), "<$>").otherwise("<!more>"))
    head = F.concat(F.lit("<"), page, F.lit("> <! $H="), (F.col("conv_id") % 5).cast("string"), F.lit(" $L="), F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B"), F.lit(" $I=H>"))
    return written(spark, turns(spark, d), line, head)


def records(spark, d) -> str:
    line = F.concat(F.lit("<"), "conv_id", F.lit("r."), F.when(F.col("role") == "system", F.lit("ring")).otherwise((F.col("turn") + 1).cast("string")), F.lit(">"), "body", F.when(F.col("later").isNull() | (F.col("later") != F.col("role")), "=").otherwise("-"))
    return written(spark, turns(spark, d), line)


PARSED = """CAST(len(ws) AS INTEGER) AS words, CAST(len(list_filter(ws, lambda x: x LIKE 'k%')) AS INTEGER) AS doubtful, CAST(len(list_filter(ws[2:], lambda x: length(x) = 1)) AS INTEGER) AS uncertain"""


def parsed() -> list:
    return [F.size("words").alias("words"), F.size(F.filter("words", lambda w: ~w["clean"])).alias("doubtful"), F.size(F.filter("gaps", lambda g: g == "uncertain")).alias("uncertain")]


@query(f"WITH {TURN} SELECT 'f' || conv_id || 'r' AS page, CAST(turn + 1 AS INTEGER) AS number, {PARSED}, turn = 0 AS paragraph_start, CAST(conv_id % 5 AS VARCHAR) AS hand FROM turns WHERE len(ws) > 0 AND role = 'user'")
def tagged_lines(spark, d):
    """Lines of one descriptor, with the variables of their pages."""
    return X.read_lines(spark, tagged(spark, d), "P0").select("page", "number", *parsed(), "paragraph_start", F.col("meta.H").alias("hand"))


@query(f"WITH {TURN} SELECT CASE role WHEN 'user' THEN '@P0' WHEN 'assistant' THEN '+P1' ELSE '=Lx' END AS descriptor, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words, CAST(sum(uncertain) AS BIGINT) AS uncertain, CAST(sum(CASE WHEN last THEN 1 ELSE 0 END) AS BIGINT) AS paragraph_ends FROM (SELECT role, {PARSED}, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM turns WHERE len(ws) > 0) GROUP BY 1")
def tagged_loci(spark, d):
    """Lines of every kind."""
    rows = X.read_lines(spark, tagged(spark, d), None).select("descriptor", "paragraph_end", *parsed())
    return rows.groupBy("descriptor").agg(F.count("*").alias("lines"), F.sum("words").alias("words"), F.sum("uncertain").alias("uncertain"), F.sum(F.col("paragraph_end").cast("int")).alias("paragraph_ends"))


@query(f"WITH {TURN} SELECT w, count(*) AS n FROM ttok WHERE role <> 'system' GROUP BY w")
def lossy_token_counts(spark, d):
    """Words of all body text with doubts left out."""
    return X.read_lines(spark, tagged(spark, d), "P").select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("SELECT 'f' || conv_id || 'r' AS page, 'f' || conv_id AS folio, CAST(conv_id % 5 AS VARCHAR) AS hand, CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'B' END AS language, 'H' AS section FROM (SELECT DISTINCT conv_id FROM conversations WHERE regexp_matches(lower(text), '[a-z]'))")
def page_metadata(spark, d):
    return X.read_lines(spark, tagged(spark, d), None).select("page", "folio", F.col("meta.H").alias("hand"), F.col("meta.L").alias("language"), F.col("meta.I").alias("section")).distinct()


@query(f"""WITH {TURN}, l AS (SELECT *, lag(e) OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) AS before FROM (SELECT conv_id, turn, role, ws, CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN '-' ELSE '=' END AS e FROM turns WHERE len(ws) > 0))
SELECT 'f' || conv_id || 'r' AS page, CAST(turn + 1 AS INTEGER) AS number, {PARSED}, e AS ending, before IS NULL OR before = '=' AS paragraph_start FROM l WHERE role <> 'system'""")
def record_lines(spark, d):
    """Text lines of the second format, with the paragraphs that line ends tell."""
    rows = X.read_records(spark, records(spark, d), "UTF-8").where("kind = 'text'")
    return rows.select("page", "number", *parsed(), F.col("end").alias("ending"), "paragraph_start")


@query(f"WITH {TURN} SELECT 'f' || conv_id || 'r' AS page, count(DISTINCT CASE WHEN role = 'system' THEN -1 ELSE turn END) AS lines, CAST(sum(CASE WHEN w LIKE 'k%' THEN 0 ELSE 1 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN w LIKE 'k%' THEN 1 ELSE 0 END) AS BIGINT) AS left_out FROM ttok GROUP BY conv_id")
def page_omissions(spark, d):
    """Words kept and words left out for doubt, page by page."""
    return X.page_counts(X.read_records(spark, records(spark, d), "UTF-8")).select("page", "lines", "kept", "left_out")


@query(f"""WITH {TURN}, a AS (SELECT conv_id, role = 'system' AS label, w, lead(w) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM ttok) SELECT 'f' || conv_id || 'r' AS page, count(DISTINCT CASE WHEN label THEN w END) AS labels, count(DISTINCT CASE WHEN NOT label THEN w END) AS words, count(DISTINCT CASE WHEN NOT label AND nxt IS NOT NULL THEN w || ' ' || nxt END) AS pairs FROM a GROUP BY conv_id""")
def page_label_words(spark, d):
    """Labels, words of the running text and pairs of neighbours of each page, as sets."""
    lines = X.read_records(spark, records(spark, d), "UTF-8").select("page", "kind", F.transform("words", lambda w: F.regexp_replace(w["word"], r"\?", "")).alias("ws"))
    pairs = F.transform(F.arrays_zip(F.expr("slice(ws, 1, size(ws) - 1)").alias("x"), F.expr("slice(ws, 2, size(ws))").alias("y")), lambda p: F.concat_ws(" ", p["x"], p["y"]))
    kinds = F.explode(F.array(F.struct(F.when(F.col("kind") == "label", "labels").otherwise("words").alias("what"), F.col("ws").alias("items")), F.struct(F.when(F.col("kind") != "label", "pairs").alias("what"), F.when(F.size("ws") > 1, pairs).alias("items"))))
    items = lines.select("page", kinds.alias("k")).select("page", "k.what", F.explode("k.items").alias("item")).where("what is not null").distinct()
    return items.groupBy("page").pivot("what", ["labels", "words", "pairs"]).count().fillna(0)


@query(f"WITH {TURN} SELECT w, count(DISTINCT conv_id) AS pages FROM ttok WHERE role = 'system' GROUP BY w HAVING count(DISTINCT conv_id) >= 2")
def repeated_labels(spark, d):
    """Labels that stand on several pages."""
    labels = X.read_lines(spark, tagged(spark, d), "Lx").select("page", F.explode("tokens").alias("w")).distinct()
    return labels.groupBy("w").agg(F.count("*").alias("pages")).where("pages >= 2")
