"""Licence scan: a positional index of rare licence words, with built-in functions only.

Templates are indexed by word and position. A file goes on if it has one of a
template's words of highest IDF (over all files), so many that no placement with
enough votes does without them; all its licence words then look up their
postings. Postings whose file position minus template position lies within a
band vote for one placement, so words put in, left out or replaced shift a
notice and don't split it; a template of whose positions enough vote for a
placement is named if its key phrases stand in the file.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters named and not excluded: Java tells a negated union of ranges more than ten times slower.
JAVA_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: A placement needs this share of a template's rare words, and at least 2.
LEAST_SHARE = 0.6
#: Words by which the positions of one placement may be shifted against each other.
BAND = 4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases that name a licence wherever their words stand consecutively. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by which texts state a licence, and the phrases that must stand in the text. Fixed values.
TEMPLATES = [
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    Template("apache-2.0", "Licensed under the Apache License Version 2.0", ("apache license",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "under the terms of the GNU General Public License version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY NC 4.0", ("cc by nc",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY SA 4.0", ("cc by sa",)),
    Template("bsd", "Redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0", ("mozilla public license",)),
    Template("mit", "to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software", ("merge publish distribute sublicense",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License You may obtain a copy of the License at http www apache org licenses LICENSE 2 0", ("apache org licenses license 2 0",)),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    Template("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version", ("gnu general public license", "version 3 of the license")),
    Template("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Template("artistic-2.0", "you can redistribute it and or modify it under the terms of the Artistic License 2.0", ("artistic license",)),
    Template("bsl-1.0", "Distributed under the Boost Software License Version 1.0", ("boost software license",)),
    Template("zlib", "In no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable for any damages",)),
    Template("cc0-1.0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("related or neighboring rights",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
]

#: Words that any English text may have and that no posting is kept for. Fixed values.
COMMON = set("a all an and any are as at be by can code either except file for form forms free has held http in into is it its law made may name names no nor not obtain of or org person possible program software source subject terms that the this to under use used v will with without work www you your".split())


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def lowered(text: Column) -> Column:
    """A-Z to a-z. Two letters beyond ASCII whose lower case holds ASCII ones are replaced first by another of the same class."""
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, F.lower(F.translate(text, "İK", "éé"))).otherwise(F.lower(text))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(F.coalesce(text.cast("string"), F.lit(""))), F.lit(f"({JAVA_WORD})"), F.lit(1))


def vocabulary(templates: list[Template] = TEMPLATES) -> list[str]:
    """Template words that are not common: some dozens."""
    return sorted({w for t in templates for w in words_of(t.text)} - COMMON)


def document_frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """Each template word that stands in a document, and in how many documents it does."""
    # exploded as it is worked out: of a column, Spark asks first whether it is empty, and cuts every text twice
    words = docs.select(F.explode(F.array_intersect(_strings(vocabulary(templates)), _words(F.col(text)))).alias("w"))
    return words.groupBy("w").count()


def inverse_frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES, text: str = "text") -> dict[str, float]:
    """IDF of the template words over all documents; its rows are as many as the vocabulary."""
    vocab = vocabulary(templates)
    n = docs.count()
    df = {r["w"]: r["count"] for r in document_frequencies(docs, templates, text).collect()}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocab}


def license_scan(docs: DataFrame, idf: dict[str, float], templates: list[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """docs (a text column at least) with n_words, n_base, first_word, last_word, base_labels, labels and score; null text is empty, rows stay as they are.

    n_base counts all places of PHRASES; first_word and last_word are the least
    and greatest start (null without any). labels has the templates' too.
    score is 1 - 2^-n for n phrase places and named templates: 0 without any.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    # other columns are put away, so their names can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("_row"), F.col(text).alias("_text"))
    vocab = vocabulary(templates)
    postings = [(w, t, q) for t, x in enumerate(templates) for q, w in enumerate(words_of(x.text)) if w not in COMMON]
    sizes = [sum(1 for _, t, _ in postings if t == k) for k in range(len(templates))]
    needs = [max(2, math.ceil(LEAST_SHARE * n)) for n in sizes]
    # template and position of each word, by word
    of = {w: [(t, q) for x, t, q in postings if x == w] for w in vocab}
    index = F.create_map(*[c for w, places in of.items() for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in places]))])
    by_idf = sorted(vocab, key=lambda w: (-idf[w], w))
    # a placement that has enough of a template's words has one of these
    seeds = sorted({w for k in range(len(templates)) for w in sorted((w for w, t, _ in postings if t == k), key=by_idf.index)[: max(0, sizes[k] - needs[k] + 1)]})

    first = rows.withColumn("_words", _words(F.col("_text"))).drop("_text")
    # words of the file that the index knows, the rarest first; most files have none and do no more
    ranked = F.array_intersect(_strings(by_idf), F.col("_words"))
    second = first.withColumn("_rare", F.when(F.arrays_overlap("_words", _strings(seeds)), ranked).otherwise(F.array().cast("array<string>"))).withColumn("_any", F.arrays_overlap("_words", _strings(sorted({p.split()[0] for p in PHRASES}))))

    def places(phrase: str) -> Column:
        parts = phrase.split()
        return F.filter(
            F.transform("_words", lambda w, i: F.when((w == parts[0]) & _all([F.get("_words", i + k) == p for k, p in enumerate(parts) if k]), F.struct(i.alias("i"), F.lit(PHRASES[phrase]).alias("l")))),
            lambda x: x.isNotNull(),
        )

    none = F.array().cast("array<struct<i:int,l:string>>")
    base = F.when(F.col("_any"), F.concat(*[places(p) for p in PHRASES])).otherwise(none)
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("_rare", x["w"]))
    hits = F.when(F.size("_rare") >= 2, hits).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    third = second.withColumns({"_base": base, "_hits": hits, "n_words": F.size("_words").cast("long")})
    third = third.withColumn("_joined", F.when(F.size("_hits") > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))).drop("_words", "_rare", "_any")

    votes = F.flatten(F.transform("_hits", lambda h: F.transform(F.try_element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["q"]).alias("d"), p["q"].alias("q")))))
    fourth = third.withColumn("_votes", F.sort_array(votes)).drop("_hits")
    need = F.array(*[F.lit(n) for n in needs])
    # votes stand by template and shift: where need - 1 further on the shift is within the band, enough may agree; each position counts once
    first_of = F.transform("_votes", lambda v, j: F.when((F.get("_votes", j + F.get(need, v["t"]) - 1)["t"] == v["t"]) & (F.get("_votes", j + F.get(need, v["t"]) - 1)["d"] <= v["d"] + BAND), v))
    agree = lambda c: F.size(F.array_distinct(F.transform(F.filter("_votes", lambda v: (v["t"] == c["t"]) & v["d"].between(c["d"], c["d"] + BAND)), lambda v: v["q"])))
    enough = F.transform(F.filter(F.array_distinct(F.transform(F.filter(first_of, lambda c: c.isNotNull()), lambda c: F.struct(c["t"].alias("t"), c["d"].alias("d")))), lambda c: agree(c) >= F.get(need, c["t"])), lambda c: c["t"])
    fifth = fourth.withColumn("_named", F.array_distinct(enough))
    keyed = [_all([F.col("_joined").contains(f" {k} ") for k in t.keys]) & F.array_contains("_named", i) for i, t in enumerate(templates)]
    found = F.filter(F.array(*[F.when(ok, F.lit(t.label)) for ok, t in zip(keyed, templates, strict=True)]), lambda x: x.isNotNull())
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda x: x["l"])))
    sixth = fifth.withColumns(
        {
            "_found": F.when(F.size("_named") > 0, found).otherwise(F.array().cast("array<string>")),
            "_labels": base_labels,
            "n_base": F.size("_base").cast("long"),
            "first_word": F.array_min(F.transform("_base", lambda x: x["i"])).cast("long"),
            "last_word": F.array_max(F.transform("_base", lambda x: x["i"])).cast("long"),
        }
    )
    all_labels = F.array_sort(F.array_union("_labels", "_found"))
    evidence = F.size("_base") + F.size("_found")
    best = F.least(F.lit(1.0), 1.0 - F.pow(F.lit(2.0), -evidence))
    last = sixth.withColumns({"base_labels": F.array_join("_labels", ","), "labels": F.array_join(all_labels, ","), "score": best})
    return last.select("_row.*", *names)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = license_scan(docs, inverse_frequencies(docs))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
