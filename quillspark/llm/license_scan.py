"""License scans by a positional rare-token index, in DataFrame functions only.

Base labels come from phrases whose words stand consecutively. The method adds
labels: a template's index entry is its words of highest inverse document
frequency, with their positions; frequencies are counted over all documents that
are scanned. A document looks up the index
words it has, each occurrence votes for (template, document position - template
position), and the longest run of equal differences, over the number of indexed
words, is the template's score. A template counts from ``THRESHOLD`` on, if the
document also has its mandatory key phrase. Everything happens within a row: no
shuffle, no join, no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.75
#: Words that a template keeps in the index.
INDEXED = 10

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Label, mandatory key phrase and wording of common licence notices.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("apache-2", "apache license version 2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license version"),
    ("agpl-3", "gnu affero general public license", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("isc", "isc license", "released under the isc license"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "attribution noncommercial", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "attribution sharealike", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mit", "the above copyright notice and this permission notice shall be included", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "may be used to endorse or promote products", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc", "the software is provided as is and the author disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("apache-2", "unless required by applicable law or agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "terms and conditions for use reproduction and distribution", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution"),
    ("gpl-3", "you should have received a copy of the gnu general public license", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("mpl-2", "a copy of the mpl was not distributed with this file", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("bsl-1", "boost software license", "distributed under the boost software license version 1 0"),
    ("cc0", "waive all copyright and related or neighboring rights", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
)


def index(counts: dict[str, int] | None = None) -> list[tuple[str, str, list[tuple[str, int]]]]:
    """(label, key phrase, [(word, position), ...]) of each template: its words that fewest documents have, ties by position.

    The inverse document frequency falls as the count grows, so the order needs no
    logarithm. Words without a count stand in no document.
    """
    counts, out = counts or {}, []
    for label, phrase, text in TEMPLATES:
        words = sorted(enumerate(text.split()), key=lambda x: (counts.get(x[1], 0), x[0]))
        out.append((label, phrase, sorted(((w, i) for i, w in words[:INDEXED]), key=lambda x: x[1])))
    return out


def document_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How many documents have each word of the templates, over all of them: a row a word reaches the driver."""
    known = sorted({w for *_, t in TEMPLATES for w in t.split()})
    words = F.split(F.btrim(license_columns(F.col(f"`{text_col}`"))["_l_norm"]), "  ")
    own = docs.select(F.explode(F.array_distinct(F.filter(words, lambda w: w.isin(known)))).alias("w"))
    return {r["w"]: r["n"] for r in own.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _padded(phrase: str) -> str:
    """A phrase as it stands in normalised text, where two spaces part words and surround the text."""
    return f" {phrase.replace(' ', '  ')} "


def _gaps(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("  "), F.lit(" ")))


def _votes(postings: Column):
    """Document position less template position, for each posting of a hit's word."""
    return lambda h: F.transform(F.filter(postings, lambda p: p.w == h.w), lambda p: h.i - p.r)


def license_columns(text: Column) -> dict[str, Column]:
    """Column expressions over a text column; see ``scan_licenses``."""
    norm = F.regexp_replace(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" ")), SEPARATOR, "  ")
    return {"_l_norm": norm}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates).

    ``templates`` lists (label, score) of every template found. Null and empty
    texts have no words, no labels and score 0; repeated and null ids are scanned
    row by row; other columns aren't read; an empty table gives none.
    """
    found = index(document_counts(docs, text_col))
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    df = df.select("id", license_columns(F.col("text"))["_l_norm"].alias("norm"))
    has = [F.col("norm").contains(_padded(p)) for p, _ in BASE]
    n_words = (_gaps(F.col("norm")) - 1).cast("long")
    counts, first, last = [], [], []
    for (p, _), here in zip(BASE, has, strict=True):
        pad = _padded(p)
        counts.append(F.when(here, (F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(pad), F.lit("")))) / len(pad)).otherwise(0).cast("long"))
        first.append(F.when(here, _gaps(F.substring_index("norm", pad, 1)).cast("long")))
        last.append(F.when(here, n_words - _gaps(F.substring_index("norm", pad, -1)).cast("long") - len(p.split())))
    phrases = sorted({p for _, p, _ in found})
    vocabulary = sorted({w for _, _, words in found for w, _ in words})
    some = F.lit(False)
    for p in phrases:  # the key phrase is mandatory, so documents without any need no lookup
        some = some | F.col("norm").contains(_padded(p))
    df = df.select(
        "id",
        "norm",
        n_words.alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_compact(F.array(*(F.when(h, F.lit(lab)) for h, (_, lab) in zip(has, BASE, strict=True)))).alias("base"),
        F.when(
            some,
            F.filter(F.transform(F.split(F.btrim("norm"), "  "), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x.w.isin(vocabulary)),
        ).alias("hits"),
    )
    scores = []
    for label, phrase, words in found:
        postings = F.expr("array(" + ",".join(f"named_struct('w', '{w}', 'r', {r})" for w, r in words) + ")")
        votes = F.sort_array(F.flatten(F.transform("hits", _votes(postings))))
        zero = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(s: Column, v: Column) -> Column:
            run = F.when(s["at"] == v, s["run"] + 1).otherwise(1)
            return F.struct(v.alias("at"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

        best = F.aggregate(votes, zero, step, lambda s: s["best"])
        scores.append(F.when(F.col("hits").isNotNull() & F.col("norm").contains(_padded(phrase)), F.struct(F.lit(label).alias("label"), (best / F.lit(float(len(words)))).alias("score"))))
    df = df.withColumn("templates", F.filter(F.array_compact(F.array(*scores)), lambda s: s.score >= THRESHOLD))
    join = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return df.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.transform("templates", lambda s: s.label))).alias("labels"),
        F.coalesce(F.array_max(F.transform("templates", lambda s: s.score)), F.lit(0.0)).alias("score"),
        "templates",
    )


def oracle_sql() -> str:
    """The same rows in SQL, with one row a word; made from the same templates."""
    values = ", ".join(f"({t}, '{label}', '{w}', {r})" for t, (label, _, text) in enumerate(TEMPLATES) for r, w in enumerate(text.split()))
    keys = ", ".join(f"({t}, '{_padded(p)}')" for t, (_, p, _) in enumerate(TEMPLATES))
    base = ", ".join(f"('{_padded(p)}', '{label}', {len(p.split())})" for p, label in BASE)
    return rf"""
WITH n AS (SELECT doc_id, regexp_replace(' ' || translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || ' ', '{SEPARATOR}', '  ', 'g') AS norm FROM documents),
b(p, label, k) AS (VALUES {base}),
a(t, label, w, r) AS (VALUES {values}),
y(t, p) AS (VALUES {keys}),
w AS (SELECT doc_id, list_filter(string_split(norm, '  '), lambda x: x <> '') AS w FROM n),
o AS (SELECT doc_id, b.label, len(string_split(norm, p)) - 1 AS c, len(list_filter(string_split(string_split(norm, p)[1], '  '), lambda x: trim(x) <> '')) AS f,
      len(w.w) - len(list_filter(string_split(string_split(norm, p)[-1], '  '), lambda x: trim(x) <> '')) - k AS l FROM n JOIN w USING (doc_id) JOIN b ON contains(norm, p)),
v AS (SELECT doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS pos FROM w),
f AS (SELECT w, count(DISTINCT doc_id) AS n FROM v WHERE w IN (SELECT w FROM a) GROUP BY w),
i AS (SELECT t, label, w, r, least(k, {INDEXED}) AS size FROM (SELECT a.*, count(*) OVER (PARTITION BY t) AS k, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), r) AS x FROM a LEFT JOIN f USING (w)) WHERE x <= {INDEXED}),
s AS (SELECT doc_id, t, label, max(c) / max(size) AS score FROM (SELECT doc_id, i.t, i.label, pos - r, count(*)::DOUBLE AS c, max(size) AS size FROM v JOIN i USING (w) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT s.doc_id, s.label, s.score FROM s JOIN y USING (t) JOIN n ON n.doc_id = s.doc_id AND contains(norm, p) WHERE s.score >= {THRESHOLD}),
g AS (SELECT doc_id, sum(c)::BIGINT AS n_base, min(f)::BIGINT AS first_word, max(l)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM o GROUP BY doc_id),
z AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM o UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, max(score) AS score FROM m GROUP BY doc_id)
SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN x USING (doc_id)
"""
