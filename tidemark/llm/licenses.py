"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are short notices and the fixed parts of whole licence texts; several may stand for one
licence.  Each is looked for in windows of the smallest of a few sizes that leaves it a quarter of
its length as slack, so up to a quarter of inserted words keeps it in one window.  Windows of one
size overlap: they begin at every ``stride``-th word, and the stride is at most the rest of the
slack, so a place with its insertions lies wholly in some window.

A window and a template are sets of 5-word shingles; each has a MinHash signature, the least of its
shingles' hashes under ``BANDS x ROWS`` permutations.  They are compared where a band agrees.  The
sizes are a factor of 1.5 apart, so at containment 0.8 a window's similarity to its template is 0.38
or more: with 18 bands of one row it is missed with probability (1 - 0.38)^18 = 2e-4 at most, and 0
where the window holds nothing else.  A band agrees only if a shingle is shared, so bands of one row
retrieve no window in vain but those that share one.  Every retrieved pair is verified exactly: the
share of the template's shingles in the window must be 0.8.  A match is the stretch from the first to
the last shared shingle.  Of a template's matches with one beginning the best stays, the shortest at
equal shares, and so of those with one end; the rest is read from left to right by their ends, and a
match stays if it begins at or behind the end of the last one that stayed.  So a notice repeated
without a gap counts each time, and a text with n matches costs their sort.

Shingles hold the words of one line or more, in lower case and without punctuation around them.

Only DataFrame functions are used, without any shuffle of text: the templates' signatures are a
table of a few rows (its size is that of the template list, a parameter that is checked), which is
joined by broadcast on (size, band, value).  Every shingle of every template holds a word of a
hitting set computed from the templates of its window size, and a word lies in five shingles at most; so a window with
fewer such words than a fifth of the shingles that must match holds no match, and only the other
windows are formed.  This is exact and drops nothing.

Defined cases: null or empty texts have no match; a text shorter than a window is one window; a
template of less than five words is one shingle of all its words and is looked for in windows of
exactly its words; equal rows give their matches once; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents

WORDS, BANDS, ROWS, LEAST, MOST_TEMPLATES, SLACK, GROWTH = 5, 18, 1, 0.8, 10_000, 0.25, 1.5
#: Notices and fixed parts of licence texts; what stands behind '#' tells templates of one licence apart.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT#grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT#notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT#warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0#header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL#header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0#header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Fixed value: words that any prose is full of; they are marked only where a shingle has no other word.
COMMON = set("a an and are as at be been but by can do for from had has have he her his if in is it its may no not of on or our she so that the their them there they this to was we were which who will with would you your".split())
_EDGE = r"^[^a-z0-9]+|[^a-z0-9]+$"


def plain_words(text: str) -> list[str]:
    return [w for w in (re.sub(_EDGE, "", x) for x in re.split(r"\s+", text.lower())) if w]


def hitting_words(templates: dict[str, str], size: int = WORDS) -> list[str]:
    """Words of which every shingle of every template has one: long ones, which are rare in prose, first, greedily."""
    shingles = [set(ws[i : i + size]) for ws in map(plain_words, templates.values()) for i in range(max(1, len(ws) - size + 1))]
    out: list[str] = []
    while shingles:
        count: dict[str, tuple] = {}
        for s in shingles:
            for w in s:
                count[w] = (count.get(w, (0,))[0] + 1, len(w), w)
        best = max(count, key=lambda w: (w not in COMMON, min(len(w), 7), count[w]))
        out.append(best)
        shingles = [s for s in shingles if best not in s]
    return sorted(out)


def one_of(words: list[str]) -> str:
    """A regular expression for any of the words (or a longer word that begins so), branching letter by letter."""
    if "" in words:
        return ""
    heads = sorted({w[0] for w in words})
    parts = [re.escape(h) + one_of([w[1:] for w in words if w[0] == h]) for h in heads]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: w != "")


def _signature(hashes: str) -> str:
    """BANDS values, each of ROWS minima, over an array of shingle hashes under BANDS x ROWS permutations."""
    minima = [f"array_min(transform({hashes}, h -> xxhash64(h, {k})))" for k in range(BANDS * ROWS)]
    return "array(" + ", ".join(f"xxhash64({', '.join(minima[b * ROWS : (b + 1) * ROWS])})" for b in range(BANDS)) + ")"


def _shingles(words: str, n: str) -> str:
    """Hashes of the shingles that start at each word of an array of n words."""
    return f"transform(sequence(1, greatest({n} - {WORDS} + 1, 1)), i -> xxhash64(array_join(slice({words}, i, {WORDS}), ' ')))"


def window_size(n: int) -> int:
    """The words of a window for a template of n words: the first of 6, 9, 14, 21, ... that leaves it its slack."""
    if n < WORDS:
        return n
    size = 6
    while size < n * (1 + SLACK):
        size = math.ceil(size * GROWTH)
    return size


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, size, band, value, shingles) of each template and band."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates are broadcast; scan in groups")
    rows = spark.createDataFrame([(k, v, window_size(len(plain_words(v)))) for k, v in sorted(templates.items()) if plain_words(v)], "license string, body string, size int")
    rows = rows.select("license", "size", _words(F.col("body")).alias("ws")).withColumn("n", F.size("ws"))
    rows = rows.withColumn("shingles", F.expr(f"array_distinct({_shingles('ws', 'n')})"))
    return rows.select("license", "size", "shingles", F.posexplode(F.expr(_signature("shingles"))).alias("band", "value"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start_word, end_word, containment): the stretches of each row's text that match a template."""
    spark, templates = docs.sparkSession, templates or TEMPLATES
    lengths: dict[int, tuple[int, int]] = {}  # of each window size, the longest template's words and the least number of marks
    for ws in filter(None, map(plain_words, templates.values())):
        shingles = len({tuple(ws[i : i + WORDS]) for i in range(max(1, len(ws) - WORDS + 1))})
        longest, need = lengths.get(window_size(len(ws)), (0, shingles))
        lengths[window_size(len(ws))] = max(len(ws), longest), min(need, math.ceil(math.ceil(least * shingles - 1e-9) / WORDS))
    table = template_table(spark, templates)
    needed = {m: hitting_words({k: v for k, v in templates.items() if plain_words(v) and window_size(len(plain_words(v))) == m}) for m in lengths}
    words = sorted(set().union(*needed.values()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.lower("text").rlike(rf"(?<![a-z0-9]){one_of(words)}"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), _words(F.col("text")).alias("ws")).withColumn("w", F.size("ws"))
    needles = ", ".join(f"'{w}'" for w in words)
    rows = rows.withColumn("marks", F.expr(f"filter(sequence(1, greatest(w, 1)), i -> get(ws, i - 1) IN ({needles}))"))  # no filter here: pushed down, it would split the text anew for each word
    rows = rows.withColumn("hashes", F.expr(_shingles("ws", "w")))
    # of each size, the windows that hold enough marked words; each leaves its row with its own shingles alone
    sizes = F.array(*[F.struct(F.lit(m).alias("size"), F.lit(max(1, m - math.ceil(n * (1 + SLACK)) + 1)).alias("stride"), F.lit(max(1, m - WORDS + 1)).alias("own"), F.lit(need).alias("need"), F.array(*map(F.lit, needed[m])).alias("words")) for m, (n, need) in sorted(lengths.items())])
    rows = rows.select("doc_id", "h", "ws", "marks", "hashes", F.explode(sizes).alias("s")).select("doc_id", "h", "ws", F.col("marks").alias("any"), "hashes", "s.*")
    rows = rows.select("*", F.expr("filter(any, i -> array_contains(words, get(ws, i - 1)))").alias("marks"))  # of this size alone
    covering = "array_sort(flatten(transform(marks, q -> sequence(CAST(greatest(0, ceil((q - size) / stride)) AS INT), CAST((q - 1) div stride AS INT)))))"
    rows = rows.withColumn("covering", F.expr(f"IF(size(marks) >= need, {covering}, CAST(array() AS array<int>))"))
    later = "slice(covering, need, greatest(0, size(covering) - need + 1))"  # the same list, begun need - 1 entries later
    rows = rows.withColumn("starts", F.expr(f"array_distinct(filter(zip_with(covering, {later}, (k, x) -> IF(k = x, k, NULL)), k -> k IS NOT NULL))"))
    # outer forms: from plain ones Spark infers a filter on the list's size, which it pushes down as a copy of all that makes the list
    places = rows.select("doc_id", "h", "size", "stride", "own", "hashes", F.explode_outer("starts").alias("k")).where("k IS NOT NULL AND k * stride < size(hashes)")
    places = places.select("doc_id", "h", "size", F.expr("CAST(k * stride + 1 AS INT)").alias("p"), F.expr("slice(hashes, CAST(k * stride + 1 AS INT), own)").alias("own"))
    places = places.withColumn("signature", F.expr(_signature("own")))
    bands = places.select("doc_id", "h", "size", "p", "own", F.posexplode_outer("signature").alias("band", "value"))
    met = bands.join(F.broadcast(table), ["size", "band", "value"])
    share = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    hits = F.expr("filter(transform(own, (x, i) -> IF(array_contains(shingles, x), p + i, -1)), i -> i > 0)")  # words (from 1) at which shared shingles begin
    found = met.withColumn("c", share).where(F.col("c") >= least).withColumn("hits", hits).select("doc_id", "h", "license", F.array_min("hits").alias("p"), (F.array_max("hits") + F.lit(WORDS)).alias("q"), "c")
    by = ["doc_id", "h", "license"]
    found = found.groupBy(*by, "p").agg(F.max(F.struct("c", (-F.col("q")).alias("q"))).alias("m")).select(*by, "p", (-F.col("m.q")).alias("q"), "m.c")
    found = found.groupBy(*by, "q").agg(F.max(F.struct("c", "p")).alias("m")).select(*by, F.struct("q", "m.p", "m.c").alias("hit"))
    # From left to right, where the last end is all that one match hands on to the next.  An aggregate copies what it holds at
    # each step, so a first pass notes the last end at every 256th match only, and a second one gathers what stays in each such block.
    per = found.groupBy(*by).agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    noted = """aggregate(hits, named_struct('last', 0, 'n', 0, 'ends', CAST(array() AS array<int>)),
        (s, x) -> named_struct('last', IF(x.p < s.last, s.last, x.q), 'n', s.n + 1, 'ends', IF(s.n % 256 = 255, array_append(s.ends, IF(x.p < s.last, s.last, x.q)), s.ends)), s -> s.ends)"""
    per = per.select("doc_id", "license", "hits", F.expr(noted).alias("ends"))
    block = "transform(sequence(0, size(ends)), b -> named_struct('last', IF(b = 0, 0, get(ends, b - 1)), 'hits', slice(hits, 256 * b + 1, 256)))"
    parts = per.select("doc_id", "license", F.explode_outer(F.expr(block)).alias("s"))
    kept = """aggregate(s.hits, named_struct('last', s.last, 'kept', CAST(array() AS array<struct<q:int,p:int,c:double>>)),
        (a, x) -> IF(x.p < a.last, a, named_struct('last', x.q, 'kept', array_append(a.kept, x))), a -> a.kept)"""
    out = parts.select("doc_id", "license", F.explode_outer(F.expr(kept)).alias("m")).where("m IS NOT NULL")
    return out.select("doc_id", F.substring_index("license", "#", 1).alias("license"), F.expr("IF(instr(license, '#') > 0, substring_index(license, '#', -1), 'notice')").alias("part"), (F.col("m.p") - 1).cast("long").alias("start_word"), (F.col("m.q") - 1).cast("long").alias("end_word"), F.col("m.c").alias("containment"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
