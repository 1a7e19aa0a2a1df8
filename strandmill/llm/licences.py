"""License scans with a positional rare-token index, in DataFrame operations only.

Base labels come from phrases whose words stand consecutively.  The method adds labels from licence templates.  Every template
is indexed under its words of the highest inverse document frequency (IDF) among the templates, with all their places.  A
document looks up, for each template, the `LOOKED_UP` words of highest IDF that it holds itself.  A hit at position `p` of a word
that a template has at place `q` is a posting at relative position `p - q`; a template is a candidate where the postings of
`AGREEING` different words meet at one relative position (all words of a shorter template), and it is found if its mandatory key
phrase stands at its place there, word by word.  The IDF belongs to the templates alone, so a label never hangs on other rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.lineage import cut
from strandmill.llm.common import row_key, shield, table
from strandmill.llm.native import SEPARATORS, lower_ascii, words

#: Phrases and their base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Licence templates as (label, mandatory key phrase, text).
TEMPLATES = [
    ("gpl", "gnu general public license as published by",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
     "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "gnu lesser general public license",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
     "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
     "version."),
    ("agpl", "gnu affero general public license",
     "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
     "Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "apache license version 2 0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable "
     "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "apache license version 2 0", "Licensed under the Apache License, Version 2.0"),
    ("apache", "except in compliance with the license",
     "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "permission is hereby granted free of charge",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions:"),
    ("mit", "released under the mit license", "Released under the MIT License."),
    ("bsd", "source and binary forms with or without modification",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
     "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "for any purpose with or without fee is hereby granted",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "mozilla public license",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl", "eclipse public license",
     "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which "
     "accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0"),
    ("bsl", "boost software license", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", "altered source versions must be plainly marked as such",
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
     "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you "
     "must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not "
     "be misrepresented as being the original software."),
    ("cc-by", "creative commons attribution 4 0 international",
     "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
     "https://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", "creative commons attribution sharealike",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "creative commons attribution noncommercial",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "dedicated to the public domain", "To the extent possible under law, all copyright and related or neighboring rights to "
     "this work have been waived and dedicated to the public domain under CC0 1.0 Universal."),
    ("unlicense", "released into the public domain",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
     "or non-commercial, and by any means."),
    ("all-rights-reserved", "all rights reserved", "All rights reserved."),
]

#: Words so common in English that their IDF counts as 0.
FUNCTION_WORDS = frozenset(
    "a an and any are as at be been being but by can do even for from have if in into is it its may must no not of on one or other so "
    "that the their then there these they this those to under was which who will with without would you your".split()
)

#: Words of a template that are indexed at most, that a document looks up for it, and that must agree.
INDEXED, LOOKED_UP, AGREEING = 62, 8, 3
#: Words in more than this share of the templates are indexed only for templates that have hardly any others.
COMMON = 0.25


def _listed(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_words() -> list[list[str]]:
    """Each template's indexed words, by falling IDF."""
    texts = [_listed(text) for *_, text in TEMPLATES]
    held = Counter(w for text in texts for w in set(text))
    idf = {w: math.log(len(texts) / n) for w, n in held.items() if w not in FUNCTION_WORDS}
    out = []
    for text in texts:
        ranked = sorted(idf.keys() & set(text), key=lambda w: (-idf[w], w))
        rare = [w for w in ranked if held[w] <= COMMON * len(texts) and len(w) > 1]
        out.append((rare if len(rare) > AGREEING else ranked[: AGREEING + 1])[:INDEXED])
    return out


def postings() -> list[tuple[str, int, int, int]]:
    """(word, template, place, bit): every place of every indexed word."""
    out = []
    for number, ranked in enumerate(template_words()):
        bit = {w: 1 << i for i, w in enumerate(ranked)}
        out += [(w, number, place, bit[w]) for place, w in enumerate(_listed(TEMPLATES[number][2])) if w in bit]
    return out


def template_facts() -> list[tuple[int, str, int, int, int]]:
    """(template, label, place of the key phrase, words that must agree, words that make a full score)."""
    out = []
    for number, ((label, key, text), ranked) in enumerate(zip(TEMPLATES, template_words(), strict=True)):
        listed, wanted = _listed(text), key.split()
        at = next(i for i in range(len(listed)) if listed[i : i + len(wanted)] == wanted)
        out.append((number, label, at, min(AGREEING, len(ranked)), min(LOOKED_UP, len(ranked))))
    return out


def _needle(phrase: str) -> str:
    return f" {phrase.replace(' ', '  ')} "


def _spaced(lowered: Column) -> Column:
    """The words of a lower-cased text, each between two spaces of its own; empty without words."""
    joined = F.trim(F.regexp_replace(F.coalesce(lowered, F.lit("")), SEPARATORS, "  "))
    return F.when(joined == "", "").otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_places(docs: DataFrame) -> DataFrame:
    """Adds `n_words`, `n_base`, `first_word`, `last_word` and `base` (the labels found by phrase)."""
    out = docs.withColumn("__spaced", _spaced(lower_ascii(F.col("text"))))
    spaced = F.col("__spaced")
    n_words = (_spaces(spaced) / 2).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        needle = _needle(phrase)
        there = F.contains(spaced, F.lit(needle))
        gone = F.length(spaced) - F.length(F.replace(spaced, F.lit(needle), F.lit("")))
        counts.append(F.when(there, (gone / len(needle)).cast("long")).otherwise(0))
        before = F.substring(spaced, F.lit(1), F.instr(spaced, needle) - 1)
        firsts.append(F.when(there, (_spaces(before) / 2).cast("long")))
        back = F.reverse(spaced)
        after = F.substring(back, F.lit(1), F.instr(back, needle[::-1]) - 1 + len(needle))
        lasts.append(F.when(there, n_words - (_spaces(after) / 2).cast("long")))
        labels.append(F.when(there, F.lit(label)))
    return out.withColumns(
        {
            "n_words": n_words,
            "n_base": sum(counts[1:], counts[0]),
            "first_word": F.least(*firsts),
            "last_word": F.greatest(*lasts),
            "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
        }
    ).drop("__spaced")


def key_places(texts: DataFrame) -> DataFrame:
    """(row key, template, keys): the positions of the templates' key phrases in the texts that hold them."""

    listed = [F.struct(F.lit(i).alias("template"), F.array(*map(F.lit, key.split())).alias("key")) for i, (_, key, _) in enumerate(TEMPLATES)]
    rarest = sorted({min(key.split(), key=lambda w: (sum(w in _listed(t) for *_, t in TEMPLATES), -len(w), w)) for _, key, _ in TEMPLATES})

    def held(spaced: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(spaced, F.lit(_needle(t[1])[1:])), x) for t, x in zip(TEMPLATES, listed, strict=True)]))

    def likely(lowered: Column) -> Column:
        # plain searches for each phrase's rarest word spare most texts the splitting
        any_of = reduce(Column.__or__, [F.contains(lowered, F.lit(w)) for w in rarest])
        return F.when(any_of, F.transform(F.array(_spaced(lowered)), held)[0])

    # a lambda's argument is computed once, where a column would be computed for each of its uses; the outer form keeps
    # Spark from filtering by the size of the list first, which would compute it twice
    found = texts.select("__key_a", "__key_b", "text", F.inline_outer(F.transform(F.array(lower_ascii(F.col("text"))), likely)[0]))
    found = found.where(F.col("template").isNotNull())
    size = F.size("key")

    def starts(w: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.slice(w, i + 1, size) == F.col("key"))

    places = F.transform(F.array(words(F.col("text"))), starts)[0]
    return found.select("__key_a", "__key_b", "template", places.alias("keys")).distinct()


def _looked_up(w: Column) -> Column:
    """For each template the words of highest IDF that a text holds, as one list."""
    ranked = template_words()
    every = sorted({x for listed in ranked for x in listed})
    held = F.array_intersect(F.array(*map(F.lit, every)), w)
    # bound once, as it is used for each template
    one = F.transform(F.array(held), lambda h: F.flatten(F.array(*[F.slice(F.array_intersect(F.array(*map(F.lit, r)), h), 1, LOOKED_UP) for r in ranked])))
    return F.array_distinct(one[0])


def found_templates(texts: DataFrame) -> DataFrame:
    """(row key, found labels, best share) of the templates found in `texts` (row key, text)."""
    spark = texts.sparkSession
    index = spark.createDataFrame(postings(), "word string, template int, place int, bit long")
    facts = spark.createDataFrame(template_facts(), "template int, label string, key_at int, least int, whole int")
    split = texts.select("__key_a", "__key_b", words(F.col("text")).alias("w")).withColumn("asked", _looked_up(F.col("w")))
    # no template is found by fewer words
    enough = F.when(F.size("asked") >= min(least for *_, least, _ in template_facts()), F.col("w"))
    hits = split.select("__key_a", "__key_b", "asked", F.posexplode_outer(enough).alias("p", "word")).join(F.broadcast(index), "word")
    hits = hits.where(F.array_contains("asked", F.col("word")))
    agreed = hits.groupBy("__key_a", "__key_b", "template", (F.col("p") - F.col("place")).alias("at")).agg(F.bit_or("bit").alias("bits"))
    agreed = agreed.withColumn("votes", F.bit_count("bits")).join(F.broadcast(facts), "template").where("votes >= least")
    found = agreed.join(key_places(texts), ["__key_a", "__key_b", "template"]).where(F.array_contains("keys", F.col("at") + F.col("key_at")))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("whole"))
    return found.groupBy("__key_a", "__key_b").agg(F.collect_set("label").alias("found"), F.max(share).alias("share"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """Adds `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels` and `score` to every row of `docs`.

    The score is the number of words by which a found template agrees over `LOOKED_UP` (1 at most), of the best template, and
    1 where a base phrase stands.  Nulls and empty texts have no words, no labels (empty strings) and score 0.  Each row is
    judged by its own text, also where doc_id is null or repeated.  Extra columns of any name pass through; columns named like
    the added ones are replaced.  An empty table gives an empty result.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs, back = shield(docs, ["text"], added)
    # cut, so that the join reads plain exchanges and Spark can split a text that very many rows share
    found = cut(found_templates(docs.select(*row_key("text"), "text")))
    base = base_places(docs.withColumns(dict(zip(("__key_a", "__key_b"), row_key("text"), strict=True))))
    more = F.coalesce("found", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return (
        base.join(found, ["__key_a", "__key_b"], "left")
        .withColumn("base_labels", F.concat_ws(",", "base"))
        .withColumn("labels", F.concat_ws(",", F.array_sort(F.array_union("base", more))))
        .withColumn("score", score)
        .select(*back, *added)
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs).drop("text")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def _oracle() -> str:
    phrases = _values([(k, v, len(k.split())) for k, v in PHRASES.items()])
    ranked = _values([(i, rank, w) for i, listed in enumerate(template_words()) for rank, w in enumerate(listed)])
    facts = _values([(*f, TEMPLATES[f[0]][1], len(TEMPLATES[f[0]][1].split())) for f in template_facts()])
    split = (
        "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    )
    return f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {split} AS w FROM documents),
spot AS MATERIALIZED (SELECT rid, w, unnest(w) AS word, unnest(range(len(w))) AS p FROM doc),
phrase(phrase, label, n) AS (VALUES {phrases}),
base AS (
  SELECT rid, p, label FROM spot, phrase
  WHERE word = split_part(phrase, ' ', 1) AND array_to_string(w[p + 1 : p + n], ' ') = phrase
), based AS (
  SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid
), ranked(template, rank, word) AS (VALUES {ranked}),
posting(word, template, place, bit) AS (VALUES {_values(postings())}),
fact(template, label, key_at, least, whole, key, n) AS (VALUES {facts}),
asked AS (
  SELECT DISTINCT rid, word FROM (
    SELECT rid, word, row_number() OVER (PARTITION BY rid, template ORDER BY rank) AS r
    FROM (SELECT DISTINCT rid, word FROM spot) JOIN ranked USING (word)
  ) WHERE r <= {LOOKED_UP}
), vote AS (
  SELECT rid, template, p - place AS o, count(DISTINCT word) AS votes
  FROM spot JOIN asked USING (rid, word) JOIN posting USING (word) GROUP BY ALL
), hit AS (
  SELECT rid, label, least(1.0, votes / whole) AS share
  FROM vote JOIN fact USING (template) JOIN doc USING (rid)
  WHERE votes >= least AND o + key_at >= 0 AND array_to_string(w[o + key_at + 1 : o + key_at + n], ' ') = key
), found AS (SELECT rid, max(share) AS share FROM hit GROUP BY rid),
every AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT rid, label FROM base UNION ALL SELECT rid, label FROM hit
  ) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM doc LEFT JOIN based USING (rid) LEFT JOIN found USING (rid) LEFT JOIN every USING (rid)
"""


ORACLE_SQL = _oracle()
