"""Licence scan: Dice coefficient over word bigrams, in DataFrame functions only.

A text's lines (split at line feeds) and the whole text are its units.  A unit and a
template are normalised alike: lower case, every run of characters other than letters
and digits is one space.  Their Dice coefficient is 2 |A and B| / (|A| + |B|) over the
sets of adjacent word pairs.  With a threshold t it needs

    |A| t / (2 - t) <= |B| <= |A| (2 - t) / t,

so a unit outside the bounds of every template is dropped, and another is compared
with the templates whose bounds it meets.  Texts and units without any of the anchor
words, of which every unit that reaches the threshold must hold one, aren't cut up.
Templates are one literal of the query (at most ``max_templates`` texts), which functions
of higher order go through; no join is made.

A document gets the template with the highest coefficient of its units (ties: the
first in alphabetical order), or null.

With ``passages`` (file headers, licence texts or their openings) windows of words of the
normalised whole text are compared too, so that line ends and the text around don't
matter, of every size that the bounds allow at every place.  A document with a window that reaches the threshold with a
passage gets the passage with which it has the most pairs in common; else its units
decide; and one whose units fit nothing gets the best window of a notice.  Null and empty texts have no licence; texts
of a single word have no pairs and fit none.  Repeated rows are judged each, other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The notices of common licences, by SPDX id.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
}
#: File headers, and licence texts or the openings that tell them apart, by SPDX id.
_GPL = "you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software Foundation, either version %s of the License, or (at your option) any later version."
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
PASSAGES = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: " + _GPL % ("Affero General Public License", "3")],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD-2-Clause": [_BSD],
    "BSD-3-Clause": [
        _BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This program is free software; " + _GPL % ("General Public License", "2")],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This program is free software: " + _GPL % ("General Public License", "3")],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This library is free software; " + _GPL % ("Lesser General Public License", "2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This program is free software: " + _GPL % ("Lesser General Public License", "3")],
    "MIT": [
        "The MIT License (MIT) Copyright (c)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
THRESHOLD = 0.8


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bigram_sets(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return sorted((name, b) for name, texts in templates.items() for t in texts if (b := bigrams_of(t)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The numbers of pairs that a unit can have to reach the threshold with a template of ``size`` pairs."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def pairs_of(words: Column) -> Column:
    """Distinct pairs of adjacent words; ``words`` must be a column or a lambda's variable, as it is read per word."""
    firsts = F.slice(words, F.lit(1), F.size(words) - 1)
    return F.array_distinct(F.transform(firsts, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))))


def anchors(sets: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold holds one.

    With a template of n pairs it shares at least n t / (2 - t) of them, so it holds one
    of any n + 1 less that many: those with the longest words are taken, and of each its
    longer word.
    """
    found = set()
    for _, pairs in sets:
        most = len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9) + 1
        long = sorted((max(p.split(" "), key=lambda w: (len(w), w)) for p in pairs), key=lambda w: (-len(w), w))
        found.update(long[:most])
    return sorted(w for w in found if not any(v in w for v in found if v != w))


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words; a balanced tree, as a long chain of OR is too deep to plan."""
    some = [F.contains(text, F.lit(w)) for w in words] or [F.lit(False)]
    while len(some) > 1:
        some = [some[i] | some[i + 1] if i + 1 < len(some) else some[i] for i in range(0, len(some), 2)]
    return some[0]


def _bound(value: Column, use) -> Column:
    """``use`` of the value, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def linked(pairs: Column) -> Column:
    """The pairs in order, each with its place and the places of the same pair before (-1: none) and after it (null: none)."""

    def beside(ordered: Column) -> Column:
        def link(x: Column, i: Column) -> Column:
            # get of a place before the first is null
            back, on = F.get(ordered, i - 1), F.get(ordered, i + 1)
            before = F.when(back["pair"] == x["pair"], back["at"]).otherwise(-1)
            return F.struct(x["at"].alias("at"), x["pair"].alias("pair"), before.alias("before"), F.when(on["pair"] == x["pair"], on["at"]).alias("after"))

        return F.array_sort(F.transform(ordered, link))

    return _bound(F.array_sort(F.transform(pairs, lambda p, i: F.struct(p.alias("pair"), i.alias("at")))), beside)


#: A template's place, name, pairs, their number, and the numbers of pairs that a unit may have.
TEMPLATE = "array<struct<order:int,name:string,n:int,low:int,high:int,pairs:array<string>>>"


def literal(sets: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The templates as one literal, so that the plan doesn't grow with their number."""
    rows = [dict(zip(("order", "name", "n", "low", "high", "pairs"), (i, name, len(b), *bounds(len(b), threshold), b))) for i, (name, b) in enumerate(sets)]
    return F.from_json(F.lit(json.dumps(rows)), TEMPLATE)


def best_window(text: Column, template: Column, threshold: float) -> Column:
    """(shared, score, order, name) of the window with the best score of a template, null if none reaches the threshold.

    All windows are judged, in one pass from each start.  A window begins with a pair of the
    template that it does not hold again: without such a start its score is no lower.  So it
    ends before the next place of that pair, and before it holds more distinct pairs than the
    bounds allow: at the latest where the text has that many first places of pairs, counted
    from a start that is one, or last ones.
    """
    high, n = template["high"], template["n"]

    def judged(places: Column) -> Column:
        held = F.filter(places, lambda x: x["held"])
        return _bound(held, lambda starts: F.array_max(F.transform(starts, lambda s: widened(places, s, F.get(starts, F.size(starts) - 1)["at"] + 1))))

    def widened(places: Column, start: Column, end: Column) -> Column:
        """(score, shared) of the best window that begins at ``start`` and ends before ``end``."""
        at = start["at"]
        by_first = F.when(start["before"] < 0, F.get(text["firsts"], (F.array_position(text["firsts"], at) - 1 + high).cast("int")))
        by_last = F.when(start["after"].isNull(), F.get(text["lasts"], (F.array_position(text["lasts"], at) - 1 + high).cast("int")))
        reach = F.slice(places, at + 1, F.least(end, start["after"], by_first, by_last) - at)

        def wider(so_far: Column, x: Column) -> Column:
            fresh = x["before"] < at
            size = so_far["size"] + fresh.cast("int")
            shared = so_far["shared"] + (fresh & x["held"]).cast("int")
            rated = F.struct((shared * 2.0 / (size + n)).alias("score"), shared.alias("shared"))
            return F.struct(size.alias("size"), shared.alias("shared"), F.greatest(so_far["best"], rated).alias("best"))

        none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("shared"), F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("shared")).alias("best"))
        return F.aggregate(reach, none, wider, lambda x: x["best"])

    marked = F.transform(text["places"], lambda x: F.struct(x["at"].alias("at"), x["before"].alias("before"), x["after"].alias("after"), F.array_contains(template["pairs"], x["pair"]).alias("held")))
    return _bound(_bound(marked, judged), lambda w: F.when(w["score"] >= threshold, F.struct(w["shared"].alias("shared"), w["score"].alias("score"), (-template["order"]).alias("order"), template["name"].alias("name"))))


def windows_of(pairs: Column, sets: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The best windows of the templates that reach the threshold with one, null if too few pairs are shared; ``pairs`` with repeats, in order, a lambda's variable."""

    def tried(enough: Column) -> Column:
        def every(places: Column) -> Column:
            of = lambda kept: F.transform(F.filter(places, kept), lambda x: x["at"])
            text = F.struct(places.alias("places"), of(lambda x: x["before"] < 0).alias("firsts"), of(lambda x: x["after"].isNull()).alias("lasts"))
            return _bound(text, lambda t: F.array_compact(F.transform(enough, lambda x: best_window(t, x, threshold))))

        return F.when(F.size(enough) > 0, _bound(linked(pairs), every))

    if not sets:
        return F.lit(None)
    # what the text shares with any template is little, mostly too little for all of them
    known = F.from_json(F.lit(json.dumps(sorted({p for _, b in sets for p in b}))), "array<string>")
    least = min(bounds(len(b), threshold)[0] for _, b in sets)
    enough = lambda shared: F.filter(literal(sets, threshold), lambda t: F.size(F.array_intersect(shared, t["pairs"])) >= t["low"])
    return _bound(F.array_intersect(pairs, known), lambda shared: F.when(F.size(shared) >= least, _bound(enough(shared), tried)))


def scan(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", max_templates: int = 500, passages: dict[str, list[str]] | None = None
) -> DataFrame:
    """doc_id, license, score (null without one) and n_matches (pairs of a distinct unit and a template, and templates that a window fits) of every document."""
    sets = bigram_sets(templates)
    if len(sets) > max_templates:
        raise ValueError(f"{len(sets)} templates; they are a literal of the query, at most max_templates = {max_templates}")
    sized = [bounds(len(b), threshold) for _, b in sets]
    least, most = min((x for x, _ in sized), default=0), max((x for _, x in sized), default=-1)
    known = F.array(*[F.lit(p) for p in sorted({p for _, b in sets for p in b})])

    def matches(pairs: Column) -> Column:
        fits = F.filter(literal(sets, threshold), lambda t: F.size(pairs).between(t["low"], t["high"]))
        rated = F.transform(fits, lambda t: F.struct((F.size(F.array_intersect(pairs, t["pairs"])) * 2.0 / (F.size(pairs) + t["n"])).alias("score"), t["name"].alias("name")))
        return F.filter(rated, lambda x: x["score"] >= threshold)

    words = anchors(sets, threshold)

    def anchored(lowered: Column) -> Column:
        return holds_any(lowered, words)

    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.array_distinct(F.transform(F.concat(F.split(text, "\n"), F.array(text)), normalised))
    paired = F.transform(F.transform(F.filter(units, lambda u: F.contains(u, F.lit(" ")) & anchored(u)), lambda u: F.split(u, " ")), pairs_of)
    near = F.filter(paired, lambda p: F.size(p).between(least, most) & F.arrays_overlap(p, known))
    found = F.flatten(F.transform(near, matches))
    none = F.array().cast("array<struct<score:double,name:string>>")
    scored = docs.select(F.col(id_col).alias("id"), F.when(anchored(F.lower(text)), found).otherwise(none).alias("found"))
    top = F.array_max(F.transform("found", lambda f: f["score"]))
    name = F.array_min(F.transform(F.filter("found", lambda f: f["score"] == F.array_max(F.transform("found", lambda g: g["score"]))), lambda f: f["name"]))
    if passages is None:
        return scored.select(F.col("id").alias(id_col), name.alias("license"), F.round(top, 6).alias("score"), F.size("found").cast("bigint").alias("n_matches"))

    long = bigram_sets(passages)
    if len(sets) + len(long) > max_templates:
        raise ValueError(f"{len(sets) + len(long)} templates; they are a literal of the query, at most max_templates = {max_templates}")
    anchor_words = anchors(sets + long, threshold)
    held = holds_any(F.lower(text), anchor_words)

    def windows(of: list[tuple[str, list[str]]]) -> Column:
        words = F.split(normalised(text), " ")
        every = lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
        return F.when(held & F.contains(normalised(text), F.lit(" ")), _bound(words, lambda w: _bound(every(w), lambda p: windows_of(p, of, threshold))))

    empty = F.array().cast("array<struct<shared:int,score:double,order:int,name:string>>")
    both = docs.select(F.col(id_col).alias("id"), F.when(anchored(F.lower(text)), found).otherwise(none).alias("found"), F.coalesce(windows(long), empty).alias("long"), text.alias("text"))
    # the windows of notices are for documents that nothing else fits
    text = F.col("text")
    rest = F.when((F.size("found") == 0) & (F.size("long") == 0), F.coalesce(windows(sets), empty)).otherwise(empty)
    judged = both.select("id", "found", "long", rest.alias("rest"))
    by_score = F.array_max(F.transform("rest", lambda w: F.struct(w["score"], w["order"], w["name"])))
    window = F.when(F.size("long") > 0, F.struct(F.array_max("long")["score"].alias("score"), F.array_max("long")["name"].alias("name"))).when(F.size("rest") > 0, F.struct(by_score["score"].alias("score"), by_score["name"].alias("name")))
    judged = judged.select("*", window.alias("window"))
    return judged.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("window")["name"], name).alias("license"),
        F.round(F.coalesce(F.col("window")["score"], top), 6).alias("score"),
        (F.size("found") + F.size("long") + F.size("rest")).cast("bigint").alias("n_matches"),
    )
