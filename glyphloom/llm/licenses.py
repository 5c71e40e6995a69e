"""License scans by conditional compression.

A notice may stand in a line of prose, fill a paragraph or be wrapped over lines, so candidate blocks are runs of words, whatever parts them. A template counts as found where words lacking and words added together are at most a DIFFERENT-th of its words. Cut into one run of words more than that, at least one run of the template then stands in the text as it is; texts are searched for these runs, and a block is the words around a run that the template could reach. This loses nothing that could be confirmed, and blocks are as long as their notices, not as their paragraphs.

Each block is compressed by zstandard without a dictionary and with its template as raw dictionary. What saves a SAVED-th of the template's own compressed size at least is ranked by what it saves, and confirmed in that order by the exact differences of wording: the fewest words of the template that the block lacks and of the block that the template has not. A notice goes to the template that saves most; others that are confirmed for the same words give no row.

Defined results: null and empty texts have no blocks; a block that no template is confirmed for gives no row; equal rows give equal rows; several notices in a block give a row each; ties go to the template that is named first.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col, give_back, kept, schema_of, small_batches

# Licence ids and the wordings of public licences' notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: A template must save so much of its own compressed size; words lacking and added together may be this share of the template's words (an exchanged word is one of each).
SAVED, DIFFERENT, LEVEL = 0.1, 0.2, 3


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Templates:
    """Templates ready for search and compression."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        import ahocorasick
        import zstandard as z

        self.names = [name for name, _ in templates]
        self.words = [words(t) for _, t in templates]
        self.most = [int(DIFFERENT * len(w)) for w in self.words]
        self.plain = z.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [z.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for _, t in templates]
        self.least = [SAVED * len(self.plain.compress(t.encode())) for _, t in templates]
        runs: dict[str, list[tuple[int, int]]] = {}
        for k, (w, d) in enumerate(zip(self.words, self.most)):
            edges = [i * len(w) // (d + 1) for i in range(d + 2)]
            for a, b in zip(edges, edges[1:]):
                runs.setdefault(f" {' '.join(w[a:b])} ", []).append((k, a))
        self.signs = sorted({max(run.split(), key=len) for run in runs})  # a text without any of these has no run
        self.runs = ahocorasick.Automaton()
        for run, of in runs.items():
            self.runs.add_word(run, (len(run), of))
        self.runs.make_automaton()

    def begins(self, text: str) -> tuple[list[tuple[str, tuple[int, int]]], dict[int, list[int]]]:
        """The words of a text that has any run, with their places in it, and by template the words at which a run says that it should begin."""
        low = text.lower()
        if not any(s in low for s in self.signs):
            return [], {}
        found = [(m.group().lower(), m.span()) for m in WORD.finditer(text)]
        at, places = 1, []
        for w, _ in found:
            places.append(at)
            at += len(w) + 1
        out: dict[int, list[int]] = {}
        for end, (n, of) in self.runs.iter(f" {' '.join([w for w, _ in found])} "):
            first = bisect.bisect_left(places, end - n + 2)
            for k, a in of:
                out.setdefault(k, []).append(first - a)
        return found, out


def differences(template: list[str], block: list[str]) -> tuple[int, int, list[str], list[str]]:
    """Where the template stands in the block with the fewest words lacking or added: first and last word behind, words lacking, words added. Words before and behind it do not count; of equal places the first."""
    n, m = len(template), len(block)
    table = [[0] * (m + 1)]
    for i, w in enumerate(template, 1):
        above, row = table[-1], [i]
        left = i
        for j, x in enumerate(block, 1):
            left = above[j - 1] if w == x else min(above[j], left) + 1
            row.append(left)
        table.append(row)
    end = j = min(range(m + 1), key=lambda j: table[n][j])
    i, lacking, added = n, [], []
    while i:
        if j and template[i - 1] == block[j - 1]:
            i, j = i - 1, j - 1
        elif j and table[i][j] == table[i][j - 1] + 1:
            j -= 1
            added.append(block[j])
        else:
            i -= 1
            lacking.append(template[i])
    return j, end, lacking[::-1], added[::-1]


def near(begins: list[int], gap: int) -> list[tuple[int, int]]:
    """First and last of each group of begins that follow one another within the gap."""
    groups: list[list[int]] = []
    for x in sorted(set(begins)):
        if groups and x - groups[-1][1] <= gap:
            groups[-1][1] = x
        else:
            groups.append([x, x])
    return [(a, b) for a, b in groups]


def places(template: list[str], most: int, block: list[str]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """The places of a block where the template is confirmed: the best, and then those on either side of it."""
    todo = [(0, len(block))]
    while todo:
        a, b = todo.pop()
        if b - a < len(template) - most:
            continue
        i, j, lacking, added = differences(template, block[a:b])
        if len(lacking) + len(added) <= most:
            yield a + i, a + j, lacking, added
            todo += [(a, a + i), (a + j, b)]


def scan(text: str | None, templates: Templates) -> list[tuple]:
    """(start, length, licence, plain size, size with the template, words lacking, words added, wording) of the confirmed notices."""
    out, ranked, taken = [], [], []
    found, begins = templates.begins(text or "")
    for k, own in begins.items():
        most = templates.most[k]
        for first, last in near(own, most):
            a, b = max(0, first - most), min(len(found), last + len(templates.words[k]) + most)
            raw = text[found[a][1][0] : found[b - 1][1][1]].encode("utf-8", "replace")
            plain, size = len(templates.plain.compress(raw)), len(templates.given[k].compress(raw))
            if plain - size >= templates.least[k]:
                ranked.append((size - plain, k, a, b, plain, size))
    for _, k, a, b, plain, size in sorted(ranked):
        for i, j, lacking, added in places(templates.words[k], templates.most[k], [w for w, _ in found[a:b]]):
            if any(a + i < y and x < a + j for x, y in taken):
                continue
            taken.append((a + i, a + j))
            start, end = found[a + i][1][0], found[a + j - 1][1][1]
            out.append((start, end - start, templates.names[k], plain, size, len(lacking), len(added), " ".join([*(f"-{w}" for w in lacking), *(f"+{w}" for w in added)])))
    return sorted(out)


KINDS = {"start": "long", "length": "long", "license": "string", "size_plain": "long", "size_dictionary": "long", "n_lacking": "long", "n_added": "long", "differences": "string"}


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """key, start, length, license, size_plain, size_dictionary, n_lacking, n_added and differences of every confirmed notice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = kept(Templates, templates)
        for b in batches:
            found = [(i, *r) for i, t in enumerate(b.column(1).to_pylist()) for r in scan(t, ready)]
            cols = list(zip(*found)) if found else [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(cols[1:], KINDS.values()))], ["k", *KINDS])
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(col(key).alias("k"), col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, schema_of(rows, "k", **{n: T.LongType() if k == "long" else T.StringType() for n, k in KINDS.items()})).withColumnRenamed("k", key)
