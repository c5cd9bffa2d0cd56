"""License scans by diagonal voting.

Word k-grams of every text meet the k-grams of license templates in a join. A hit of text position p with template
position t votes for the diagonal p - t, which is where the template would start; words put in or left out move the
votes to diagonals nearby, so the diagonals around each one are read with it. A span counts if its hits, whose words are
compared and not their hashes alone, cover the template: whole for phrases, by ``COVER`` of the words for notices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from privloom.llm.common import table

#: Words of a gram in phrases and in notices.
PHRASE_K, NOTICE_K = 2, 4
#: Least share of a notice's words that hits cover, and how far diagonals of one span may lie apart, in words.
COVER, NEAR = 0.8, 16
#: Most grams of templates that are sent to every executor; more are shuffled.
MAX_GRAMS = 200_000

# The phrases of the base labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Other phrases that name a license.
PHRASES = (
    ("bsd license", "bsd"), ("2 clause bsd", "bsd"), ("3 clause bsd", "bsd"), ("isc license", "isc"), ("mozilla public license", "mpl"), ("boost software license", "boost"),
    ("zlib license", "zlib"), ("eclipse public license", "epl"), ("lesser general public license", "lgpl"), ("affero general public license", "agpl"),
    ("creative commons attribution", "cc"), ("cc by 4", "cc"), ("cc by sa", "cc"), ("cc by nc", "cc"), ("cc by nd", "cc"), ("cc0 1 0", "cc0"),
)
# The wording of common license notices.
NOTICES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions"""),
    ("cc", """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit
http://creativecommons.org/licenses/by/4.0/"""),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that ``lower`` makes into k and i, and one that it leaves.
KELVIN, DOTTED, NO_CASE = "\u212a", "\u0130", "\u0138"
#: What lies between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    base: bool = False
    notice: bool = False

    @property
    def k(self) -> int:
        return NOTICE_K if self.notice else PHRASE_K

    def grams(self) -> list[tuple[str, ...]]:
        return [self.words[i : i + self.k] for i in range(len(self.words) - self.k + 1)]


def template(label: str, text: str, base: bool = False, notice: bool = False) -> Template:
    """A phrase of two words or more, or a notice of four or more."""
    lowered = text.lower()
    words = tuple("".join(c if c in LOWER or c.isdigit() or c > "\x7f" else " " for c in lowered).split(" "))
    made = Template(label, tuple(w for w in words if w), base, notice)
    if not made.grams():
        raise ValueError(f"a template of {made.k} words or more is needed: {text!r}")
    return made


def default_templates() -> list[Template]:
    return [template(b, a, base=True) for a, b in BASE] + [template(b, a) for a, b in PHRASES] + [template(a, b, notice=True) for a, b in NOTICES]


def words_of(text: Column) -> Column:
    """Words of a text in lower case. Two letters whose small form would be one of a-z are kept apart, so that of these only A-Z become small."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    odd = F.contains(text, F.lit(KELVIN)) | F.contains(text, F.lit(DOTTED))
    return F.array_remove(F.split(F.lower(F.when(odd, F.translate(text, KELVIN + DOTTED, NO_CASE * 2)).otherwise(text)), BETWEEN), "")


def gram_hits(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(doc_id, h, n_words, template, diagonal, position, copies): distinct hits of grams with how many equal rows have each, and for each
    distinct (doc_id, text) a row without a template, so that texts without hits stay and nothing is scanned twice."""
    spark = docs.sparkSession
    grams = [(i, t.k, at, *g, *[None] * (NOTICE_K - t.k)) for i, t in enumerate(templates) for at, g in enumerate(t.grams())]
    names = [f"t{j}" for j in range(NOTICE_K)]
    index = spark.createDataFrame(grams, "template int, tk int, at int, " + ", ".join(f"{n} string" for n in names))
    index = index.withColumn("gram", F.when(F.col("tk") == PHRASE_K, F.xxhash64(*names[:PHRASE_K])).otherwise(F.xxhash64(*names)))
    if len(grams) <= MAX_GRAMS:
        index = F.broadcast(index)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    ahead = [F.slice("words", j + 1, F.greatest(n - j, F.lit(0))).alias(f"w{j}") for j in range(NOTICE_K)]
    # outer: texts without words stay, and no filter repeats the split
    rows = rows.select("doc_id", "h", n.alias("n_words"), F.posexplode_outer(F.arrays_zip(*ahead)).alias("position", "w"))
    w = [F.col(f"w.w{j}") for j in range(NOTICE_K)]
    rows = rows.select("doc_id", "h", "n_words", "position", *w)
    at_k = [F.struct(F.lit(k).alias("k"), F.xxhash64(*[f"w{j}" for j in range(k)]).alias("gram")) for k in (PHRASE_K, NOTICE_K)]
    itself = F.struct(F.lit(0).alias("k"), F.lit(None).cast("long").alias("gram"))
    rows = rows.withColumn("g", F.explode(F.when(F.coalesce("position", F.lit(0)) == 0, F.array(itself, *at_k)).otherwise(F.array(*at_k))))
    rows = rows.select("*", "g.k", F.col("g.gram").alias("of")).drop("g")
    same = (F.col("k") == F.col("tk")) & (F.col("of") == F.col("gram"))
    for j in range(NOTICE_K):
        alike = F.col(f"w{j}") == F.col(f"t{j}")
        same = same & (alike if j < PHRASE_K else alike | (F.col("tk") == PHRASE_K))
    found = rows.join(index, same, "left").filter(F.col("template").isNotNull() | (F.col("k") == 0))
    return found.groupBy("doc_id", "h", "n_words", "template", (F.col("position") - F.col("at")).alias("diagonal"), "at").agg(F.count("*").cast("int").alias("copies"))


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, spans) for each row of ``docs`` (doc_id, text): spans is an array of (label, template, base, start, coverage), where
    ``template`` is the place in ``templates`` and ``start`` the word, from 0, where it starts, by start, label and template.

    A phrase has a span at each place where it stands; a notice one at each diagonal whose cover is the largest within ``NEAR``, if that is ``COVER``
    or more. A null text is an empty one and has no spans. Very long texts are scanned whole; repeated rows are judged each; an empty table
    gives an empty one. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    templates = default_templates() if templates is None else templates
    known = [(i, t.label, t.base, t.notice, len(t.words)) for i, t in enumerate(templates)]
    known = spark.createDataFrame(known, "template int, label string, base boolean, notice boolean, length int")
    if len(templates) <= MAX_GRAMS:
        known = F.broadcast(known)
    text = ["doc_id", "h", "n_words"]
    # from here all work of one text is in one place, and has the size of that text at most
    hits = gram_hits(docs, templates).repartition("doc_id", "h")
    lines = hits.groupBy(*text, "template", "diagonal").agg(F.collect_list("at").alias("ats"), F.max("copies").alias("copies")).join(known, "template", "left")

    around = Window.partitionBy(*text, "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    near = F.when(F.col("notice"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("notice"), F.col("ats"))).over(around))))
    lines = lines.withColumn("near", near)
    whole = F.size("ats") == F.col("length") - (PHRASE_K - 1)
    touched = F.size(F.array_distinct(F.flatten(F.transform("near", lambda a: F.sequence(a, a + (NOTICE_K - 1))))))
    lines = lines.withColumn("coverage", F.when(F.col("notice"), touched / F.col("length")).otherwise(F.when(whole, F.lit(1.0)).otherwise(F.lit(0.0))))
    strength = F.struct(F.col("coverage"), F.size("ats").alias("votes"), (-F.col("diagonal")).alias("earlier"))
    lines = lines.withColumn("strength", strength).withColumn("best", F.max("strength").over(around))
    kept = F.when(F.col("notice"), (F.col("coverage") >= COVER) & (F.col("strength") == F.col("best"))).otherwise(F.col("coverage") == 1.0)
    start = F.greatest(F.col("diagonal"), F.lit(0))
    span = F.struct(start.cast("long").alias("start"), F.col("label"), F.col("template"), F.col("base"), F.col("coverage"))
    rows = lines.groupBy(*text).agg(
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"), F.array_sort(F.collect_list(F.when(kept, span))).alias("spans")
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    values = ", ".join(f"({i}, '{t.label}', {t.base}, {t.notice}, {t.k}, {list(t.words)})" for i, t in enumerate(default_templates()))
    translated = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH templates(template, label, base, notice, k, tw) AS (VALUES {values}),
tg AS (SELECT template, label, base, notice, k, len(tw) AS length, tp, array_to_string(tw[tp + 1 : tp + k], ' ') AS gram
  FROM templates, unnest(range(0, len(tw) - k + 1)) AS u(tp)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({translated}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, p, k, array_to_string(w[p + 1 : p + k], ' ') AS gram FROM docs, (VALUES ({PHRASE_K}), ({NOTICE_K})) AS ks(k), unnest(range(0, len(w) - k + 1)) AS u(p)),
hit AS (SELECT r, template, label, base, notice, length, p - tp AS d, tp FROM g JOIN tg USING (k, gram)),
diag AS (SELECT r, template, any_value(label) AS label, any_value(base) AS base, any_value(notice) AS notice, any_value(length) AS length, d, count(*) AS votes FROM hit GROUP BY r, template, d),
near AS (SELECT x.r, x.template, x.d, count(DISTINCT y.tp + o) AS touched FROM diag x JOIN hit y ON x.r = y.r AND x.template = y.template AND y.d BETWEEN x.d - {NEAR} AND x.d + {NEAR},
  unnest(range(0, {NOTICE_K})) AS u(o) WHERE x.notice GROUP BY x.r, x.template, x.d),
cover AS (SELECT diag.*, CASE WHEN notice THEN touched / length WHEN votes = length - {PHRASE_K - 1} THEN 1.0 ELSE 0.0 END AS coverage FROM diag LEFT JOIN near USING (r, template, d)),
span AS (SELECT r, label, base, greatest(d, 0) AS start, coverage FROM cover x WHERE CASE WHEN notice THEN coverage >= {COVER} AND NOT EXISTS (
    SELECT 1 FROM cover y WHERE y.r = x.r AND y.template = x.template AND y.d BETWEEN x.d - {NEAR} AND x.d + {NEAR} AND (y.coverage, y.votes, -y.d) > (x.coverage, x.votes, -x.d)) ELSE coverage = 1 END)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, CAST(min(start) FILTER (base) AS BIGINT) AS first_word,
  CAST(max(start) FILTER (base) AS BIGINT) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(coalesce(max(coverage), 0) AS DOUBLE) AS score
FROM docs LEFT JOIN span USING (r) GROUP BY r"""


OP13_SQL = _oracle()
