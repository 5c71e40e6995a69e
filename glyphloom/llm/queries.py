"""The registered queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.col("predicted"), "n_matches")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2, which SQL can say."""
    from pyspark.sql import functions as F

    from .quality import base_fails, statistics

    found = statistics(table(spark, sf_dir, "documents")).withColumn("base_failed", base_fails(F.col("n_words"), F.col("n_repeat_words")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op8, and the verdict where a rule gives it."""
    from .urls import judge

    return judge(table(spark, sf_dir, "pages")).selectExpr("page_id", "host", "path", "rule", "CASE WHEN rule IS NOT NULL THEN verdict END AS ruled")


BLANK = "[\\x20\\x09-\\x0D]"
SQL = {
    "quality_base": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{BLANK}+'), lambda x: x <> '') AS ws FROM d), win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)), rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2), cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id), f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f""",
    "url_rules": """WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages), h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a), r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(own, start, verdict)),
m AS (SELECT page_id, own || start AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(own || start) DESC) AS k FROM h JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start))
SELECT h.page_id, host, path, rule, verdict AS ruled FROM h LEFT JOIN m ON m.page_id = h.page_id AND k = 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality, op3_licenses, op4_jaccard, op5_dedup, op6_sharding, op7_embeddings, op8_urls, op9_toxicity, op10_bpe, quality_base, url_rules)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
