"""Licence scans: units of a text compared with licence templates by the Dice coefficient over word bigrams.

Templates are short notices, told apart by their versions, and whole licence texts.  The units of a text are its lines, its paragraphs
of several lines and, if it has several paragraphs, the whole text.  A unit is normalised to its ASCII words in lower case and
stands for the set of its word pairs.  With a and b pairs the coefficient is at most 2 min(a, b) / (a + b), so only templates
whose size is between t / (2 - t) and (2 - t) / t times the unit's are candidates.

Notices that share their line or paragraph with other words are looked for within the text: its sentences, and all
windows of its words that are as long as a short template or longer, up to the size bound, are compared in the same way.
Windows aren't shorter than the template, since any other word in a short notice could be left out of the window then.  For a whole
licence text one window is compared: the run of words in which pairs of the template outnumber others the most.  Of matches that
overlap the best counts, and none counts that lies for half of its words or more in a unit that matches.

A match has two thirds of its template's pairs.  So a text can match a short template only if it has one of the last third of its pairs,
its rarest-looking ones, and a whole licence text only if two thirds as many of its pairs are in that text.  Both are counted
for a batch of texts at once from hashes of all pairs; the few texts that pass are compared exactly.

Everything happens within a row, in one Arrow function, so no rows move and hot keys don't matter.

Defined results: a null or empty text has no units and no licence; of several matches the one with the largest
coefficient counts, ties by name; repeated rows are scanned alike; very long texts are scanned whole, in time in proportion to their length
unless much of them is licence texts; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm import _ngrams
from quillseek.llm._shared import SLICE_ROWS

THRESHOLD = 0.8

#: Names and texts of common licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)

#: Fixed values, too: whole texts of licences, one file each, named by the licence.
WHOLE_TEXTS = Path(__file__).parent / "licence_texts"

WORDS = "[A-Za-z0-9]+"
BLANK_LINE = r"\n[ \t\r]*\n"
#: Where sentences end: at stops before white space and at blank lines, or at stops and at all line ends.
SENTENCE_ENDS = (rf"[.!?;:][\"')\]]*\s|{BLANK_LINE}", r"[.!?;:][\"')\]]*\s|\n")


def whole_texts() -> tuple[tuple[str, str], ...]:
    return tuple((p.stem, p.read_text(encoding="utf-8", errors="replace")) for p in sorted(WHOLE_TEXTS.glob("*.txt")))


def bigrams(text: str) -> list[str]:
    """The distinct word pairs of a text, in order."""
    words = [w.lower() for w in re.findall(WORDS, text)]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def template_grams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(name, grams) for name, text in templates if (grams := bigrams(text))]


class Finder:
    """Finds the units of a text, and the places within others, that match a template."""

    def __init__(self, templates=TEMPLATES, texts=(), threshold: float = THRESHOLD):
        self.threshold = threshold
        self.short = [(name, len(re.findall(WORDS, text)), frozenset(grams)) for name, text in templates if (grams := bigrams(text))]
        self.long = [(name, frozenset(grams)) for name, text in texts if (grams := bigrams(text))]
        self.sizes = [(name, len(grams)) for name, _, grams in self.short] + [(name, len(grams)) for name, grams in self.long]
        self.templates_with: dict[str, list[int]] = {}
        for t, grams in enumerate([g for *_, g in self.short] + [g for _, g in self.long]):
            for p in grams:
                self.templates_with.setdefault(p, []).append(t)
        anchors: set[str] = set()
        for _, _, grams in self.short:
            most_missing = int(len(grams) - len(grams) * self.low + 1e-9)
            anchors.update(sorted(grams, key=lambda g: (-max(map(len, g.split())), g))[: most_missing + 1])
        self.anchors = self._hashes(anchors)
        self.of_long = self._hashes({p for _, grams in self.long for p in grams})
        self.least_long = min((len(grams) for _, grams in self.long), default=0) * self.low - 1e-9

    @property
    def low(self) -> float:
        return self.threshold / (2 - self.threshold)

    @staticmethod
    def _hashes(pairs: set[str]) -> np.ndarray:
        return np.unique(_ngrams.pairs(sorted(pairs), _ngrams.NOT_ALPHANUMERIC)[0])

    def possible(self, texts: list[str]) -> np.ndarray:
        """Which texts may have a match."""
        pairs, text = _ngrams.pairs(texts, _ngrams.NOT_ALPHANUMERIC)

        def counts(known: np.ndarray) -> np.ndarray:
            if not len(known) or not len(pairs):
                return np.zeros(len(texts), np.int64)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            return np.bincount(text[known[at] == pairs], minlength=len(texts))

        found = counts(self.anchors) > 0
        return found | (counts(self.of_long) >= self.least_long) if self.long else found

    def best(self, pairs: list[str]) -> tuple[float, str] | None:
        """The largest coefficient of a unit, with its name, if it reaches the threshold."""
        distinct = set(pairs)
        candidates = {t for t, (_, n) in enumerate(self.sizes) if self.low * len(distinct) - 1e-9 <= n <= len(distinct) / self.low + 1e-9}
        if not candidates:
            return None
        shared = Counter(t for p in distinct for t in self.templates_with.get(p, ()) if t in candidates)
        found = [(2.0 * n / (len(distinct) + self.sizes[t][1]), self.sizes[t][0]) for t, n in shared.items()]
        return max((m for m in found if m[0] >= self.threshold), default=None)

    def find(self, text: str) -> list[tuple[float, str]]:
        """The matches of units and, after them, of what lies within others."""
        raw = text.encode("utf-8", "replace").lower()
        spans = [m.span() for m in re.finditer(WORDS.encode(), raw)]
        words = [raw[a:b].decode() for a, b in spans]
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        starts = [a for a, _ in spans]

        def pieces(ends: str, several_lines: bool = False) -> list[tuple[int, int]]:
            """The words of each piece of the text, as ranges."""
            breaks = [(0, 0), *(m.span() for m in re.finditer(ends.encode(), raw)), (len(raw), len(raw))]
            bounds = [(a[1], b[0]) for a, b in zip(breaks, breaks[1:], strict=False)]
            return [(bisect_left(starts, a), bisect_left(starts, b)) for a, b in bounds if not several_lines or b"\n" in raw[a:b]]

        units = pieces("\n") + pieces(BLANK_LINE, True) + [(0, len(words))] * bool(re.search(BLANK_LINE.encode(), raw))
        matched = [(u, m) for u in units if u[1] - u[0] > 1 and (m := self.best(pairs[u[0] : u[1] - 1]))]
        taken, out = [u for u, _ in matched], [m for _, m in matched]
        found = [(*m, a, b) for a, b in {p for e in SENTENCE_ENDS for p in pieces(e)} if b - a > 1 and (m := self.best(pairs[a : b - 1]))]
        for template in self.short:
            found += self.windows(pairs, *template)
        for name, grams in self.long:
            found += self.run(pairs, name, grams)
        for dice, name, a, b in sorted(found, key=lambda m: (-m[0], m[2], m[3], m[1])):
            if all(2 * (min(b, d) - max(a, c)) < b - a for c, d in taken):
                taken.append((a, b))
                out.append((dice, name))
        return out

    def windows(self, pairs: list[str], name: str, size: int, grams: frozenset) -> list[tuple[float, str, int, int]]:
        """For each place the window from there that is most like one short template, if it reaches the threshold."""
        longest, least = int(len(grams) / self.low + 1e-9) + size - len(grams), len(grams) * self.low - 1e-9
        inside = np.concatenate([[0], np.cumsum(np.fromiter((p in grams for p in pairs), np.int64, len(pairs)))])
        places = np.arange(max(0, len(pairs) - size + 2))
        places = places[inside[np.minimum(places + longest - 1, len(pairs))] - inside[places] >= least]
        out = []
        for a in places.tolist():
            seen, shared, top = set(), 0, (0.0, 0)
            for k, p in enumerate(pairs[a : a + longest - 1], 2):
                if p not in seen:
                    seen.add(p)
                    shared += p in grams
                if k >= size and (dice := 2.0 * shared / (len(seen) + len(grams))) > top[0]:
                    top = (dice, a + k)
            if top[0] >= self.threshold:
                out.append((top[0], name, a, top[1]))
        return out

    def run(self, pairs: list[str], name: str, grams: frozenset) -> list[tuple[float, str, int, int]]:
        """The run in which pairs of a long template outnumber others the most, if it reaches the threshold."""
        if len(pairs) < len(grams) * self.low - 1e-9:
            return []
        gain = np.concatenate([[0], np.cumsum(np.where(np.fromiter((p in grams for p in pairs), bool, len(pairs)), 1, -1))])
        lowest = np.minimum.accumulate(gain)
        b = int(np.argmax(gain - lowest))
        a = int(np.argmin(gain[: b + 1]))
        own = set(pairs[a:b])
        dice = 2.0 * len(own & grams) / (len(own) + len(grams))
        return [(dice, name, a, b + 1)] if dice >= self.threshold else []


def matches(text: Column, finder: Finder) -> Column:
    """The matches (dice, name) of a text."""

    @F.arrow_udf("array<struct<dice: double, name: string>>")
    def found(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for start in range(0, len(texts), SLICE_ROWS):
            part = [t or "" for t in texts.slice(start, SLICE_ROWS).to_pylist()]
            out += [[{"dice": d, "name": n} for d, n in finder.find(t)] if may else [] for t, may in zip(part, finder.possible(part).tolist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("dice", pa.float64()), ("name", pa.string())])))

    return found(text)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, texts: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """doc_id, licence (null if none), dice (0 if none), n_matches (units, and places within others, that match some template) for each document.

    templates: short notices; texts: whole licence texts, those of the folder beside this module by default.
    """
    finder = Finder(templates, whole_texts() if texts is None else texts, threshold)
    found = docs.select("doc_id", matches(F.col("text"), finder).alias("matches"))
    top = F.expr("array_max(matches)")
    return found.select("doc_id", top["name"].alias("licence"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"), F.size("matches").cast("long").alias("n_matches"))


def scan_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB."""
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in grams)}])" for name, grams in template_grams(templates))
    return f"""
        WITH t(name, grams) AS (VALUES {values}),
        raw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        u AS (
            SELECT r, unnest(string_split(text, chr(10))) AS unit FROM raw
            UNION ALL SELECT r, p FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS p FROM raw) WHERE contains(p, chr(10))
            UNION ALL SELECT r, text FROM raw WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n')
        ),
        w AS (SELECT row_number() OVER () AS k, r, list_transform(regexp_extract_all(unit, '{WORDS}'), lambda x: lower(x)) AS w FROM u),
        g AS (SELECT k, r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
        m AS (
            SELECT k, r, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
            FROM g, t WHERE list_has_any(g, grams)
        ),
        hits AS (SELECT * FROM m WHERE dice >= {threshold}),
        best AS (
            SELECT r, count(DISTINCT k) AS n_matches, max(dice) AS dice, max(name) FILTER (WHERE dice = top) AS licence
            FROM (SELECT *, max(dice) OVER (PARTITION BY r) AS top FROM hits) GROUP BY r
        )
        SELECT doc_id, licence, coalesce(dice, 0) AS dice, coalesce(n_matches, 0) AS n_matches FROM raw LEFT JOIN best USING (r)
    """
