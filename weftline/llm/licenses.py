"""License scans: normalised text against license templates by the Dice coefficient over word bigrams.

Units are a text's lines, its paragraphs (parted by empty lines) and the whole text. A unit is put in lower case and
its words are runs of letters and digits. With sets A of a unit's and B of a template's bigrams, Dice is
2|A and B| / (|A| + |B|). It can reach t only if t/(2-t)|B| <= |A| <= (2-t)/t|B|; these bounds prune templates before any
intersection. A second exact bound spares most texts: a unit that reaches t shares more than so many bigrams of B that
it must hold at least one of some words (``anchors``); a text without any can't match.

A statement may also be part of a line or paragraph, or run over several. So templates that no unit reaches are looked
for in runs of words of the whole text. The places of a template's bigrams in the text form blocks of neighbours. A run
begins where a block begins and ends where one ends, as a bigram more of the template always brings a run nearer to it: for
each beginning that enough bigrams follow closely, the end with the largest Dice, bigrams counted as often as they occur;
in a block that is longer than any match, which is a text that repeats itself, as many words as the template has. The Dice
of the sets decides. Such a template counts as one match.

A match must also hold one of the template's version numbers, if it has any (``versions``), so that a notice of one version is
not taken for another's. Of several matches the longest template names the license.

Templates are short statements, notices, and whole license texts (the files in ``license_texts``); they are a small table,
which is broadcast, as are their bigrams. Only texts with an anchor word are looked into, and of these what is shuffled is the
places of templates' bigrams, and once more the texts of which some template has enough places. All of it is JVM expressions.

Defined cases: null and empty texts, and texts of one word, match nothing; of templates of one length the larger Dice names the
license, then the smaller name; repeated rows get equal rows; texts and units of any length are compared whole; an empty table gives no rows; a kept column that is named as a
result gives way to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

LEAST = 0.8
LONG = 300  # bigrams of a text whose anchors are chosen by how many bigrams they are in
NUMBERED = {"by", "license", "nc", "sa", "v", "version"}  # words that a version number follows
COMMON = {"by", "from", "in", "is", "of", "on", "or", "the", "this", "to", "under", "with"}  # anchors of the last resort

# Public license statements, notices and permission paragraphs.
TEMPLATES: dict[str, str] = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    "isc-permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain.""",
}

TEMPLATES |= {f"{f.stem}-text": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, least: float = LEAST) -> tuple[int, int]:
    """Fewest and most bigrams of a unit whose Dice with a set of this size can reach `least`."""
    return math.ceil(least / (2 - least) * size - 1e-9), math.floor((2 - least) / least * size + 1e-9)


def anchors(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words such that a unit which reaches `least` with a template holds one of them.

    At the smallest size that can match, a unit lacks at most |B| - ceil(t/(2-t)|B|) bigrams of B (a larger unit lacks no
    more); words that are in more bigrams than that can't all be missing. Of a long text the words in most bigrams go first,
    else uncommon and long ones.
    """
    found: set[str] = set()
    for text in sorted(templates.values(), key=len):
        b = bigrams(text)
        lacking = len(b) - bounds(len(b), least)[0]
        of: dict[str, set[str]] = {}
        for x in b:
            for w in x.split():
                of.setdefault(w, set()).add(x)
        held = {x for w in found & of.keys() for x in of[w]}
        if len(b) > LONG:
            free = {w: n for w, n in of.items() if w not in COMMON and len(w) > 4}
            while len(held) <= lacking and free:
                w = max(free, key=lambda w: (len(free[w] - held), w))
                found.add(w)
                held |= free.pop(w)
        for w in sorted(of, key=lambda w: (w in COMMON, -len(w), w)):
            if len(held) > lacking:
                break
            found.add(w)
            held |= of[w]
    return sorted(found)


def _words(lower: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " ")), " ")


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def versions(b: list[str]) -> list[str]:
    """The bigrams that give a version: a number behind one of a few words."""
    return [x for x in b if x.split()[0] in NUMBERED and x.split()[1].isdigit()]


def _pairs(words: Column) -> Column:
    """All bigrams of an array of words, in their order."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _best_run(h: Column, pairs: Column, t: Column, least: float) -> Column:
    """The largest Dice of a run of the text's bigrams with template t; h: the places of the template's bigrams, ascending."""
    n = F.size(h)
    place = lambda k: F.element_at(h, k)
    size = lambda k, e: place(e) - place(k) + 1
    gain = lambda k, i: 2.0 * k - least * i

    def end(k: Column) -> Column:
        ends = F.sequence(k + t["lo"] - 1, F.least(n, k + t["most"] - 1))
        fits = F.filter(ends, lambda e: (size(k, e) <= t["most"]) & ((e == n) | (place(e + 1) != place(e) + 1)) & (2.0 * (e - k + 1) >= least * (size(k, e) + t["n"]) - 1e-9))
        best = F.array_max(F.transform(fits, lambda e: F.struct((2.0 * (e - k + 1) / (size(k, e) + t["n"])).alias("d"), place(e).alias("to"))))
        long = (k + t["most"] <= n) & (place(k + t["most"]) == place(k) + t["most"])  # the block goes on beyond any match
        return F.struct(place(k).alias("a"), F.when(long, place(k) + t["length"] - 1).otherwise(best["to"]).alias("to"))

    def dice(r: Column) -> Column:
        own = F.array_distinct(F.slice(pairs, r["a"], r["to"] - r["a"] + 1))
        return F.when(F.arrays_overlap(own, t["v"]), 2.0 * F.size(F.array_intersect(own, t["b"])) / (F.size(own) + t["n"]))

    # behind a beginning so many hits must be within the longest run, and some end must reach `least`: from one of a few places
    # to the next, a run comes nearer by no more than if all between were hits
    step = F.greatest(F.lit(1), F.floor((t["most"] - t["lo"]) / 16).cast("int"))
    near = lambda k: F.exists(F.sequence(k + t["lo"] - 1, F.least(n, k + t["most"] - 1), step), lambda e: gain(e, place(e)) + (2 - least) * step >= gain(k - 1, place(k) - 1) + least * t["n"] - 1e-9)
    starts = F.filter(F.sequence(F.lit(1), n - (t["lo"] - 1)), lambda k: ((k == 1) | (place(k - 1) != place(k) - 1)) & (size(k, k + t["lo"] - 1) <= t["most"]) & near(k))
    runs = F.filter(F.transform(starts, end), lambda r: r["to"].isNotNull())
    return F.array_max(F.transform(runs, dice))


def _inside(texts: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """id and inside: the templates that a run of words of a text reaches, as (n, dice, name); texts: id, pairs, names (found already)."""
    small = F.broadcast(known)  # a row for each template
    grams = F.broadcast(known.select(F.explode("b").alias("g"), "name").groupBy("g").agg(F.collect_list("name").alias("of")))  # and for each of their bigrams
    hits = texts.select("id", "names", F.posexplode("pairs").alias("i", "g")).join(grams, "g")
    hits = hits.select("id", (F.col("i") + 1).alias("i"), F.explode(F.array_except("of", "names")).alias("name")).groupBy("id", "name").agg(F.sort_array(F.collect_list("i")).alias("h"))
    hits = hits.join(small, "name").where(F.size("h") >= F.col("t.lo"))
    got = hits.join(texts.select("id", "pairs"), "id").select("id", "name", F.col("t.n").alias("n"), _best_run(F.col("h"), F.col("pairs"), F.col("t"), least).alias("dice"))
    return got.where(F.col("dice") >= least).groupBy("id").agg(F.collect_list(F.struct("n", "dice", "name")).alias("inside"))


def _known(spark: SparkSession, templates: dict[str, str], least: float) -> DataFrame:
    """name, b and t (sizes, bounds and sets) of each template that has a bigram."""
    rows = []
    for k, v in sorted(templates.items()):
        b, length = bigrams(v), len(re.sub(r"[\W_]+", " ", v.lower()).split()) - 1
        if b:
            low, high = bounds(len(b), least)
            rows.append((k, b, (k, len(b), low, high, length, math.floor((2 - least) / least * length + 1e-9), b, versions(b) or b)))
    return spark.createDataFrame(rows, "name string, b array<string>, t struct<name:string,n:int,lo:int,hi:int,length:int,most:int,b:array<string>,v:array<string>>")


def matched(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, license and dice (of the longest template that matches, null if none), licenses (all names found, joined) and n_matches."""
    templates = templates or TEMPLATES
    known = _known(docs.sparkSession, templates, least)
    held = F.array(*[F.lit(w) for w in anchors(templates, least)])
    spread = [bounds(len(b), least) for b in map(bigrams, templates.values()) if b]
    low, high = min(x for x, _ in spread), max(x for _, x in spread)
    keep = [c for c in keep if c not in ("license", "dice", "licenses", "n_matches")]
    names = [unused("__kept", docs.columns) + str(i) for i in range(len(keep))]
    got = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__text"))
    got = got.withColumn("__words", _words(F.col("__text"))).withColumn("__may", F.arrays_overlap("__words", held))

    texts = got.where("__may").withColumn("id", F.monotonically_increasing_id())
    units = F.array_distinct(F.concat(F.split("__text", "\n"), F.split("__text", "\n[ \t\r]*\n"), F.array("__text")))
    # as many words less one are the most bigrams there can be
    split = F.filter(F.transform(units, _words), lambda w: (F.size(w) > low) & F.arrays_overlap(w, held))
    sets_of = F.array_distinct(F.filter(F.transform(split, lambda w: F.array_distinct(_pairs(w))), lambda a: (F.size(a) >= low) & (F.size(a) <= high)))

    def against(a: Column) -> Column:
        fits = F.filter("known", lambda t: (F.size(a) >= t["lo"]) & (F.size(a) <= t["hi"]) & F.arrays_overlap(a, t["v"]))
        return F.transform(fits, lambda t: F.struct(t["n"].alias("n"), (2.0 * F.size(F.array_intersect(a, t["b"])) / (F.size(a) + t["n"])).alias("dice"), t["name"].alias("name")))

    texts = texts.crossJoin(F.broadcast(known.agg(F.collect_list("t").alias("known"))))  # one row, of so many templates
    texts = texts.select("id", *names, _pairs(F.col("__words")).alias("pairs"), F.filter(F.flatten(F.transform(sets_of, against)), lambda h: h["dice"] >= least).alias("own"))
    inside = _inside(texts.select("id", "pairs", F.transform("own", lambda h: h["name"]).alias("names")), known, least)
    none = F.array().cast("array<struct<n:int,dice:double,name:string>>")
    found = texts.select("id", *names, "own").join(inside, "id", "left").select(*names, F.concat("own", F.coalesce("inside", none)).alias("__hits"))
    every = found.unionByName(got.where(~F.col("__may")).select(*names, none.alias("__hits")))
    order = lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    best = F.try_element_at(F.array_sort("__hits", order), F.lit(1))
    return every.withColumn("__best", best).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        F.col("__best.name").alias("license"),
        F.round(F.col("__best.dice"), 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["name"]))), ",").alias("licenses"),
        F.size("__hits").cast("long").alias("n_matches"),
    )


def op7(docs: DataFrame) -> DataFrame:
    return matched(docs)

