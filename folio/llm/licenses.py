"""License scan in DataFrame operations only: MinHash bands retrieve templates, containment verifies.

Words are runs of [a-z0-9] of the lower-cased text; shingles are runs of 5 words (a shorter template
has one shingle, all of its words). A template with s shingles is looked for in windows of s + step - 1
shingles at every step = max(1, s // 4), so any occurrence lies wholly in one window. With containment
c of the template, window and template have a Jaccard similarity of c / (2 + 1/4 - c) at least, 0.55 for
c = 0.8; BANDS bands of ROWS values then meet with a probability of 1 - (1 - 0.55**2)**24 = 0.9998.
Exact containment of the template's distinct shingles decides.

A window without any shingle of the templates has no MinHash value in common with them, so only windows
that hold one are signed; the test is a look into a constant set, before anything is exploded.
Templates are a fixed list, taken in parts of MAX_TEMPLATES, so the bands of a part may be broadcast.

Defined cases: null and empty texts match nothing; a template without words is an error; repeated rows
count as one document (by doc_id) in the result; an empty table gives an empty result; further columns are left alone,
whatever their names; a text of any length is one row until its windows that hold a shingle are laid out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 24
ROWS = 2
MAX_TEMPLATES = 1000

# Notices of public licenses, as their stewards publish them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def _runs(w: Column, k: int) -> Column:
    """Hashes of the runs of k words in the array w."""
    places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def _seeded(seed: int):
    return lambda h: F.xxhash64(h, F.lit(seed))


def _bands(runs: Column) -> Column:
    """A key for each band: its number and the smallest hash in each of its rows."""
    rows = [F.array_min(F.transform(runs, _seeded(s))) for s in range(BANDS * ROWS)]
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*rows[b * ROWS : (b + 1) * ROWS]).alias("value")) for b in range(BANDS)])


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, k, span and the distinct shingles' hashes."""
    rows = []
    for name, text in templates.items():
        w = template_words(text)
        if not w:
            raise ValueError(f"template {name} has no words")
        k = min(SHINGLE, len(w))
        rows.append((name, k, len(w) - k + 1, w))
    df = spark.createDataFrame(rows, "template string, k int, span int, w array<string>")
    runs = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        runs = F.when(F.col("k") == k, _runs(F.col("w"), k)).otherwise(runs)
    return df.select("template", "k", "span", F.array_distinct(runs).alias("shingles"))


def _reach(step: int, size: int):
    """Numbers of the windows that hold a place."""
    return lambda p: F.sequence(F.ceil(F.greatest(p - size + 1, F.lit(0)) / step).cast("int"), F.floor(p / step).cast("int"))


def _signed(k: int, span: int, step: int, size: int, runs: Column):
    return lambda j: F.struct(F.lit(k).alias("k"), F.lit(span).alias("span"), (j * step).alias("start"), F.slice(runs, j * step + 1, F.lit(size)).alias("runs"))


def _among(values: set[int]):
    return lambda h: h.isin(*values)


def _place_among(values: set[int]):
    return lambda h, i: F.when(h.isin(*values), i)


def _let(value: Column, body) -> Column:
    """body of value, with value worked out once, however often body names it and wherever the optimiser moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, most: int = MAX_TEMPLATES) -> DataFrame:
    """doc_id, template, containment (of the best window), first_word (of that window, the first of equals) and windows that match."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > most:  # a constant set for each part, one after the other
        names = list(templates)
        parts = [{n: templates[n] for n in names[i : i + most]} for i in range(0, len(names), most)]
        return reduce(DataFrame.unionByName, [scan(docs, templates=p, containment=containment, most=most) for p in parts])
    spark = docs.sparkSession
    known = _templates(spark, templates)
    sets: dict[tuple[int, int], set[int]] = defaultdict(set)
    for row in known.collect():  # the fixed list
        sets[row.k, row.span].update(row.shingles)
    by_k: dict[int, set[int]] = defaultdict(set)
    for (k, _), values in sets.items():
        by_k[k] |= values
    ks = list(by_k)

    def found_in(runs: dict[int, Column]) -> Column:
        some = F.lit(False)
        for k, values in by_k.items():
            some = some | F.exists(runs[k], _among(values))
        kinds = []
        for (k, span), values in sets.items():
            step = max(1, span // 4)
            size = span + step - 1
            places = F.filter(F.transform(runs[k], _place_among(values)), lambda i: i.isNotNull())
            numbers = F.array_distinct(F.flatten(F.transform(places, _reach(step, size))))
            kinds.append(F.transform(numbers, _signed(k, span, step, size, runs[k])))
        return F.when(some, F.concat(*kinds))

    words = word_array(F.col("text"))
    runs = _let(words, lambda w: F.struct(*[_runs(w, k).alias(f"r{k}") for k in ks]))
    windows = _let(runs, lambda r: found_in({k: r[f"r{k}"] for k in ks}))
    # the outer form: no filter is inferred that would work all this out once more
    windows = docs.select("doc_id", F.explode_outer(windows).alias("x")).filter("x is not null").select("doc_id", "x.*")
    keyed = windows.withColumn("b", F.explode(_bands(F.col("runs")))).select("doc_id", "k", "span", "start", "runs", "b.band", "b.value")
    index = known.withColumn("b", F.explode(_bands(F.col("shingles")))).select("template", "k", "span", "shingles", "b.band", "b.value")
    met = keyed.join(F.broadcast(index), ["k", "span", "band", "value"])  # MAX_TEMPLATES * BANDS rows at most
    share = F.size(F.array_intersect("runs", "shingles")) / F.size("shingles")
    found = met.select("doc_id", "template", "start", share.alias("c")).filter(F.col("c") >= containment)
    best = found.groupBy("doc_id", "template").agg(F.max(F.struct("c", (-F.col("start")).alias("s"))).alias("m"), F.count_distinct("start").alias("windows"))
    return best.select("doc_id", "template", F.col("m.c").alias("containment"), (-F.col("m.s")).cast("int").alias("first_word"), "windows")


def oracle() -> str:
    """DuckDB SQL that finds the same without MinHash: every window that holds a shingle of the template."""
    rows = []
    for name, text in TEMPLATES.items():
        w = template_words(text)
        k = min(SHINGLE, len(w))
        rows += [f"('{name}', {k}, {len(w) - k + 1}, '{s}')" for s in dict.fromkeys(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))]
    return f"""
WITH t(template, k, span, s) AS (VALUES {", ".join(rows)}),
t2 AS (SELECT *, greatest(1, span // 4) AS step, count(*) OVER (PARTITION BY template) AS n FROM t),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM t),
r AS (SELECT doc_id, k, i, list_aggregate(w[i + 1:i + k], 'string_agg', ' ') AS s FROM w, ks, range(0, greatest(len(w) - k + 1, 0)) x(i)),
hit AS (SELECT doc_id, template, span, step, n, i, r.s FROM r JOIN t2 ON r.k = t2.k AND r.s = t2.s),
win AS (
  SELECT DISTINCT doc_id, template, span, step, n, j FROM hit,
  range(((greatest(i - (span + step - 1) + 1, 0) + step - 1) // step)::BIGINT, (i // step + 1)::BIGINT) x(j)
),
c AS (
  SELECT win.doc_id, win.template, win.j * win.step AS start, count(DISTINCT s) / any_value(win.n) AS c
  FROM win JOIN hit ON win.doc_id = hit.doc_id AND win.template = hit.template
   AND hit.i >= win.j * win.step AND hit.i < win.j * win.step + win.span + win.step - 1
  GROUP BY ALL
)
SELECT doc_id, template, max(c)::DOUBLE AS containment, arg_max(start, struct_pack(a := c, b := -start))::INT AS first_word, count(*) AS windows
FROM c WHERE c >= {CONTAINMENT} GROUP BY doc_id, template"""
