"""Where queries register: a name, a callable of (spark, sf_dir), and, where SQL can express it, the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


#: Views in DuckDB's SQL that the oracles share.
TOK = """tok AS (SELECT doc_id, lang, source, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (
  SELECT doc_id, lang, source, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM documents))"""
LINE = """lin AS (SELECT doc_id, lang, source, line, list_filter(string_split_regex(lower(t), '[^a-z]+'), lambda x: x <> '') AS ws FROM (
  SELECT doc_id, lang, source, unnest(ts) AS t, unnest(range(len(ts))) AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ts FROM documents))),
ltok AS (SELECT doc_id, lang, source, line, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM lin WHERE len(ws) > 0)"""
TURN = """turns AS (SELECT conv_id, role, turn, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM conversations),
ttok AS (SELECT conv_id, role, turn, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM turns WHERE len(ws) > 0)"""
GLYPHS = "regexp_extract_all({}, 'cth|ckh|cph|cfh|ch|sh|.')"
#: DuckDB's twin of hash_uniform.
UNIFORM = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0)"


def mi_sql(cells: str, strata: str = "") -> str:
    """SELECT of strata, total, mi over a relation cells(strata, a, b, n)."""
    s = f"{strata}, " if strata else ""
    using = f"USING ({strata})" if strata else ""
    total = f"t {using}" if strata else "t ON true"
    return f"""SELECT {s}max(total) AS total, sum(CAST(n AS DOUBLE) / total * log2(CAST(n AS DOUBLE) * total / (CAST(na AS DOUBLE) * nb))) AS mi
FROM {cells} JOIN (SELECT {s}a, sum(n) AS na FROM {cells} GROUP BY ALL) USING ({s}a) JOIN (SELECT {s}b, sum(n) AS nb FROM {cells} GROUP BY ALL) USING ({s}b) JOIN (SELECT {s}CAST(sum(n) AS DOUBLE) AS total FROM {cells} {'GROUP BY ' + strata if strata else ''}) {total}{' GROUP BY ' + strata if strata else ''}"""
