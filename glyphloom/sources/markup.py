"""Paragraph text of HTML and XML, and box lists in JSON."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of headings and notes within paragraphs, and tags that have no end.
SKIPPED, ENDLESS = {"center", "pagenum", "fnanchor"}, {"br", "hr", "img", "meta", "link", "input"}


class Paragraphs(HTMLParser):
    """Text inside <p>, without what stands in skipped classes."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, bool]] = []
        self.paragraphs: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "p":
            self.paragraphs.append("")
        if tag not in ENDLESS:
            names = set((dict(attrs).get("class") or "").split())
            self.open.append((tag, bool(names & SKIPPED) or bool(self.open and self.open[-1][1])))
        elif tag == "br" and self.paragraphs:
            self.paragraphs[-1] += " "

    def handle_endtag(self, tag: str) -> None:
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if self.open and not self.open[-1][1] and any(t == "p" for t, _ in self.open):
            self.paragraphs[-1] += data


def html_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, paragraph (from 0), text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, h in zip(f["k"], f["h"]):
                p = Paragraphs()
                p.feed(h or "")
                rows += [(k, i, " ".join(t.split())) for i, t in enumerate(p.paragraphs)]
            yield pd.DataFrame(rows, columns=["k", "paragraph", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"k {kind}, paragraph int, text string").withColumnRenamed("k", key)


def xml_text(rows: DataFrame, key: str, xml: str, without: tuple[str, ...] = ("note",)) -> DataFrame:
    """key, text: all text of a document but that of some elements, whose tails stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as E

        def text(e) -> str:
            inner = "" if e.tag.rpartition("}")[2] in without else (e.text or "") + "".join(text(c) for c in e)
            return inner + (e.tail or "")

        for f in frames:
            yield pd.DataFrame({"k": f["k"], "text": [" ".join(text(E.fromstring(x)).split()) for x in f["x"]]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(xml).alias("x")).mapInPandas(run, f"k {kind}, text string").withColumnRenamed("k", key)


def boxes(rows: DataFrame, json: str = "value") -> DataFrame:
    """seq, word, x, y, w, h from [[[word, n, pages, [ids]], ...], [[index, x, y, w, h], ...]]."""
    parsed = rows.select(F.from_json(F.get_json_object(json, "$[0]"), "array<array<string>>").alias("words"), F.from_json(F.get_json_object(json, "$[1]"), "array<array<int>>").alias("places"))
    one = parsed.select("words", F.posexplode("places").alias("seq", "p"))
    return one.select("seq", F.get(F.get("words", F.get("p", F.lit(0))), F.lit(0)).alias("word"), *(F.get("p", F.lit(i + 1)).alias(c) for i, c in enumerate("xywh")))
