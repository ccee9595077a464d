"""License scans by Dice coefficient over word bigrams (operator 1, native).

Texts are cut into lines and sentences; each piece is normalised (A-Z folded,
runs of other bytes than a-z and 0-9 to one space) and compared with templates
by the Dice coefficient of their sets of word bigrams.  A piece of n bigrams
can reach a coefficient of t with a template of m only if
m * t <= n * (2 - t) and n * t <= m * (2 - t), so only templates within these
size bounds are candidates, and pieces outside the bounds of all templates are
dropped before their bigrams are built.  Everything runs as DataFrame
expressions in one pass, without a shuffle.

Notices that are wrapped, or have marks inside, are found in runs: consecutive
pieces of a paragraph (lines without a word end one), as long as a template
allows, are compared as one.  Texts without a word of ``_anchors`` can't match
and are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and the operative sentences of public licences.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3 or later."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under the CC0 1.0 Universal public domain dedication."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved."],
}
THRESHOLD = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of pieces: line breaks, and white space after the end of a sentence.
PIECE_END = r"[\n\r]+|(?<=[.!?:;])[ \t]+"
#: Ends of paragraphs: two line breaks without a letter or digit between.
PARAGRAPH_END = r"(?>\r\n|\r|\n)[^A-Za-z0-9\r\n]*+(?:[\r\n][^A-Za-z0-9]*+)"
#: Words that prose has often; a run is not looked for by them if others will do.
COMMON = set("a all and any as at be but by conditions following for free from in including is it its may not of on or provided public software that the this to under use work with without you".split())


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def bigrams_of(text: str) -> list[str]:
    """The sorted distinct word bigrams of a normalised piece; of one word, the word alone."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))


def template_rows(templates: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    chosen = TEMPLATES if templates is None else templates
    return [(name, bigrams_of(text)) for name in sorted(chosen) for text in chosen[name]]


def _bounds(m: int, threshold: float) -> tuple[int, int]:
    """The least and most bigrams that a piece can have to reach ``threshold`` with a template of ``m``, in exact arithmetic."""
    t = Fraction(str(threshold))
    return ceil(m * t / (2 - t)), floor(m * (2 - t) / t)


def _anchors(grams: list[str], threshold: float) -> set[str]:
    """Words, one of which is in every piece that reaches ``threshold``: without them too few bigrams of the template are left."""
    chosen: set[str] = set()
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if sum(chosen.isdisjoint(g.split()) for g in grams) < max(1, _bounds(len(grams), threshold)[0]):
            break
        chosen.add(word)
    return chosen


def _heads(templates: dict[str, list[str]]) -> list[list[str]]:
    """Words before a mark inside templates of several names, as of every SPDX line: alone they name no licence."""
    names: dict[tuple[str, ...], set[str]] = {}
    for name, texts in templates.items():
        for text in texts:
            for end in re.finditer(PIECE_END, text):
                if words_of(text[end.end() :]):
                    names.setdefault(tuple(words_of(text[: end.start()])), set()).add(name)
    return sorted(list(head) for head, of in names.items() if head and len(of) > 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _strings(values: list[str] | set[str]) -> Column:
    return F.array(*map(F.lit, sorted(values))).cast("array<string>")


def _words(piece: Column) -> Column:
    return F.filter(F.split(F.translate(piece, _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(words)


def _runs(text: Column, anchors: set[str], most: int) -> Column:
    """Words of each run of two or more consecutive pieces of a paragraph, of ``most`` words at most and with an anchor."""
    marked = F.translate(text, _UPPER + "|\u00b6", _LOWER + "  ")
    for pattern, mark in ((PARAGRAPH_END, " \u00b6 "), (PIECE_END, " | "), ("[^a-z0-9|\u00b6]+", " "), (r" ?\|[ |]*", " | "), ("[ |]*\u00b6[ |\u00b6]*", " \u00b6 ")):
        marked = F.regexp_replace(marked, pattern, mark)
    limit = 2 * most  # between two words there is one mark at most

    def of(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(words))
        ends = F.concat(F.array(F.lit(0)), F.filter(at, lambda i: F.element_at(words, i).isin("|", "\u00b6")), F.array(F.size(words) + 1))
        hits = F.filter(at, lambda i: F.array_contains(_strings(anchors), F.element_at(words, i)))
        return _let(F.struct(ends.alias("ends"), hits.alias("hits")), lambda x: F.flatten(F.transform(x["ends"], lambda a, k: starting(words, x["ends"], x["hits"], a, k))))

    def starting(words: Column, ends: Column, hits: Column, a: Column, k: Column) -> Column:
        near = F.filter(hits, lambda h: (h > a) & (h <= a + limit))
        last = F.filter(F.slice(ends, k + 3, most), lambda b: (b - a <= limit) & F.exists(near, lambda h: h < b))
        runs = F.transform(last, lambda b: F.slice(words, a + 1, b - a - 1))
        whole = F.filter(runs, lambda r: ~F.array_contains(r, "\u00b6"))
        return F.when(F.size(near) > 0, F.filter(F.transform(whole, lambda r: F.array_remove(r, "|")), lambda r: F.size(r) <= most)).otherwise(F.array().cast("array<array<string>>"))

    return _let(F.filter(F.split(marked, " "), lambda w: w != ""), lambda w: F.when(F.size(w) > 0, of(w)).otherwise(F.array().cast("array<array<string>>")))


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``licenses``, ``best`` and ``dice``.

    ``licenses`` has the names of all templates that a piece of the text
    reaches ``threshold`` with, sorted; ``best`` is the one with the highest
    coefficient, the first by name of equals, and ``dice`` that coefficient
    (null without a match).  Pieces are compared alone and in runs.  Null and empty texts match nothing.  Repeated rows
    get a row each, an empty table none; other columns are not read.
    """
    chosen = TEMPLATES if templates is None else templates
    rows = [(name, grams, *_bounds(len(grams), threshold)) for name, grams in template_rows(chosen) if grams]
    least, most = min((r[2] for r in rows), default=0), max((r[3] for r in rows), default=0)
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("m"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams, low, high in rows]) if rows else F.array().cast("array<struct<name:string,m:int,low:int,high:int,grams:array<string>>>")
    every = _strings({g for r in rows for g in r[1]})
    anchors = {w for r in rows for w in _anchors(r[1], threshold)}
    heads = [F.array(*map(F.lit, head)) for head in _heads(chosen)]
    # A run has its words with repetition, as templates do.
    longest = max((_bounds(len(words_of(text)), threshold)[1] for texts in chosen.values() for text in texts), default=0) + 1

    def matches(piece: Column) -> Column:
        n = F.size(piece)
        near = F.filter(known, lambda t: (t["low"] <= n) & (n <= t["high"]))
        scored = F.transform(near, lambda t: F.struct((F.size(F.array_intersect(t["grams"], piece)) * 2.0 / (n + t["m"])).alias("dice"), t["name"].alias("name")))
        return F.filter(scored, lambda s: s["dice"] >= threshold)

    def found_in(worded: Column) -> Column:
        # A piece of w words has w - 1 bigrams at most; repetition lowers this, so only the lower bound prunes here.
        whole = F.filter(worded, lambda w: ~w.isin(*heads)) if heads else worded
        large = F.filter(whole, lambda w: (F.size(w) > least) | ((F.size(w) == 1) & F.lit(least <= 1)))
        grams = F.filter(F.transform(large, _bigrams), lambda g: (F.size(g) >= least) & (F.size(g) <= most))
        # Only pieces that share a bigram with some template are scored.
        return F.flatten(F.transform(F.filter(grams, lambda g: F.arrays_overlap(g, every)), matches))

    def with_runs(worded: Column) -> Column:
        joined = found_in(_runs(F.col(text_col), anchors, longest))
        several = (F.size(worded) > 1) & F.arrays_overlap(F.flatten(worded), _strings(anchors))
        return F.concat(found_in(worded), F.when(several, joined).otherwise(F.array().cast("array<struct<dice:double,name:string>>")))

    pieces = F.split(F.coalesce(text_col, F.lit("")), PIECE_END)
    found = _let(F.filter(F.transform(pieces, _words), lambda w: F.size(w) >= 1), with_runs)
    out = docs.select(F.col(id_col), found.alias("found"))
    ordered = F.array_sort(F.transform("found", lambda s: F.struct((-s["dice"]).alias("d"), s["name"].alias("name"))))
    return out.select(
        id_col,
        F.array_sort(F.array_distinct(F.transform("found", lambda s: s["name"]))).alias("licenses"),
        F.when(F.size("found") > 0, F.element_at(ordered, 1)["name"]).alias("best"),
        F.when(F.size("found") > 0, F.round(-F.element_at(ordered, 1)["d"], 6)).alias("dice"),
    )


def oracle(templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` as DuckDB SQL, with the licences joined by commas: all pieces and all runs, without pruning."""
    chosen = TEMPLATES if templates is None else templates
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    strings = lambda xs: "[" + ", ".join(map(quote, xs)) + "]::VARCHAR[]"
    values = ", ".join(f"({quote(n)}, {strings(g)})" for n, g in template_rows(chosen) if g)
    heads = ", ".join(strings(h) for h in _heads(chosen))
    longest = max((_bounds(len(words_of(text)), threshold)[1] for texts in chosen.values() for text in texts), default=0) + 1
    pieces_of = lambda lines: f"string_split(regexp_replace({lines}, '([.!?:;])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))"
    words_in = lambda piece: f"list_filter(string_split_regex(translate({piece}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH t(name, grams) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS k FROM docs),
single AS (SELECT r, {words_in("piece")} AS w FROM (SELECT r, unnest({pieces_of("line")}) AS piece FROM lines)),
paragraphs AS (SELECT r, k, translate(line, '|¶', '  ') AS line, sum(CASE WHEN regexp_matches(line, '[A-Za-z0-9]') THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS p FROM lines),
cut AS (SELECT r, p, k, unnest({pieces_of("line")}) AS piece, generate_subscripts({pieces_of("line")}, 1) AS j FROM paragraphs),
numbered AS (SELECT r, p, w, row_number() OVER o AS i, sum(len(w)) OVER o AS upto FROM (SELECT r, p, k, j, {words_in("piece")} AS w FROM cut) WHERE len(w) > 0 WINDOW o AS (PARTITION BY r, p ORDER BY k, j)),
paged AS (SELECT r, p, list(w ORDER BY i) AS ws, list(upto ORDER BY i) AS upto FROM numbered GROUP BY r, p HAVING count(*) > 1),
starts AS (SELECT r, ws, upto, unnest(range(1, len(ws))) AS a FROM paged),
ends AS (SELECT r, ws, a, unnest(list_filter(range(a + 1, len(ws) + 1), lambda b: upto[b] - upto[a] + len(ws[a]) <= {longest})) AS b FROM starts),
words AS (SELECT r, w FROM single WHERE len(w) > 0 UNION ALL SELECT r, flatten(ws[a:b]) AS w FROM ends),
grams AS (SELECT r, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS g FROM words{f" WHERE w NOT IN ({heads})" if heads else ""}),
pairs AS (SELECT r, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grams, t WHERE list_has_any(g, grams)),
good AS (SELECT r, name, max(dice) AS dice FROM pairs WHERE dice >= {threshold} GROUP BY ALL),
top AS (SELECT r, string_agg(name, ',' ORDER BY name) AS licenses, arg_min(name, struct_pack(d := -dice, n := name)) AS best, max(dice) AS dice FROM good GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses, best, round(dice, 6) AS dice FROM docs LEFT JOIN top USING (r)
"""
