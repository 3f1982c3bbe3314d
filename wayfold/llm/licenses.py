"""Licence scan by diagonal voting.

All rolling k-grams of words are hashed and joined to the k-grams of licence templates. A match
of document word i with template word j votes for diagonal i - j; neighbouring diagonals of a
document and template merge (an inserted or missing word shifts the rest by one). Merged runs, and
each diagonal alone, are verified: the words of a run must cover ``COVER`` of the template, and all
k-grams of its key, the words that tell it from others of its family, must be there. Of runs of one
family that overlap in a document the one that covers most words stays. Fixed phrases are counted
besides.

Everything is DataFrame expressions. Null texts are empty; a document without matches has empty
label lists and score 0; equal matches at several places of a document are separate runs; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.common import pick, read, written

#: What separates words, once A-Z are lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals that far apart are one run.
NEIGHBOUR = 4
#: Share of a template's words that a run must cover, and how much longer than it a run may be.
COVER, STRETCH = 0.8, 1.5
#: Characters of templates up to which their k-grams are broadcast; beyond, the join shuffles.
BROADCAST = 1 << 22
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (label, family, key, text) of notices and permission texts of public licences. The
#: key must stand as it is; where it is empty the whole text must.
TEMPLATES: tuple[tuple[str, str, str, str], ...] = (
    ("apache-2.0", "apache", "", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "apache",
        "except in compliance with the License",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("mit", "mit", "", "released under the MIT license"),
    ("mit", "mit", "", "licensed under the MIT license"),
    (
        "mit",
        "mit",
        "to deal in the Software without restriction",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction""",
    ),
    (
        "mit",
        "mit",
        "to deal in the Software without restriction",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("gpl-3.0", "gpl", "", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "gpl", "", "licensed under the GNU General Public License, version 2"),
    (
        "gpl",
        "gpl",
        "of the GNU General Public License",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation""",
    ),
    (
        "gpl-2.0",
        "gpl",
        "either version 2 of the License",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    ),
    (
        "gpl-3.0",
        "gpl",
        "either version 3 of the License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    ),
    ("lgpl", "gpl", "GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "cc", "", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "cc", "", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "cc", "", "licensed under CC BY 4.0"),
    ("cc-by", "cc", "Creative Commons Attribution 4", "licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "cc0",
        "cc0",
        "copyright and related and neighboring rights",
        """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain
worldwide""",
    ),
    (
        "bsd",
        "bsd",
        "redistribution and use in source and binary forms",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met""",
    ),
    (
        "bsd-3-clause",
        "bsd",
        "may be used to endorse or promote products",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.""",
    ),
    (
        "isc",
        "isc",
        "for any purpose with or without fee",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    ),
    ("mpl-2.0", "mpl", "Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "zlib",
        "zlib",
        "in no event will the authors be held liable",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely""",
    ),
    ("unlicense", "unlicense", "unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
)


def plain_words(text: str) -> list[str]:
    """``words`` of a Python string."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def must(words: list[str], key: list[str], gram: int) -> list[int]:
    """The places of the k-grams of the key, all of them if it is empty or not found."""
    at = [i for i in range(len(words) - len(key) + 1) if key and words[i : i + len(key)] == key]
    first, n = (at[0], len(key)) if at else (0, len(words))
    return list(range(first, first + max(n, gram) - gram + 1))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and anything beyond ASCII; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def template_grams(spark: SparkSession, templates=TEMPLATES, gram: int = GRAM) -> DataFrame:
    """h, template, at: the k-grams of the templates. As many rows as the templates have words."""
    rows = [(i, plain_words(text)) for i, (*_, text) in enumerate(templates)]
    split = spark.createDataFrame(rows, "template int, w array<string>").where(F.size("w") >= gram)
    at = split.select("template", "w", F.explode(F.sequence(F.lit(0), F.size("w") - gram)).alias("at"))
    return at.select("template", "at", F.slice("w", F.col("at") + 1, gram).alias("gram")).withColumn("h", F.xxhash64("gram"))


def _scan(w: Column, phrases: dict[str, str], vocabulary: list[str], gram: int) -> Column:
    """Of a word array: its size, the (place, label) of phrases, and the k-grams that can be a
    template's: those that begin and end with a word that occurs in a template."""
    size = F.size(w)
    firsts = sorted({p.split()[0] for p in phrases})
    none = F.array().cast("array<int>")
    places = F.sequence(F.lit(0), size - 1)
    starts = F.when(size > 0, F.filter(places, lambda i: F.get(w, i).isin(firsts))).otherwise(none)

    def stands(phrase: str, label: str):
        reads = lambda i: reduce(and_, [F.get(w, i + j) == F.lit(x) for j, x in enumerate(phrase.split())])
        return lambda at: F.transform(F.filter(at, reads), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    found = [stands(p, label) for p, label in phrases.items()]
    base = F.transform(F.array(starts), lambda at: F.concat(*[f(at) for f in found]))[0]
    both = F.when(size >= gram, F.filter(places, lambda i: F.get(w, i).isin(vocabulary) & F.get(w, i + gram - 1).isin(vocabulary))).otherwise(none)
    grams = F.transform(both, lambda i: F.struct(i.alias("i"), F.slice(w, i + 1, gram).alias("gram")))
    return F.struct(size.cast("long").alias("n"), base.alias("base"), grams.alias("grams"))


def _labels(array: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(array)), ",")


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, gram: int = GRAM) -> DataFrame:
    """A row per document: n_words, the phrases' places, labels of both kinds, and the score: 1
    for a phrase, else the largest share of a template that a run covers."""
    spark = docs.sparkSession
    split = [plain_words(text) for *_, text in templates]
    vocabulary = sorted({x for w in split for x in w})
    slim = pick(docs, "doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    seen = F.transform(F.array(words(F.col("text"))), lambda w: _scan(w, phrases, vocabulary, gram))[0]
    # each text is scanned once, into counts, places and the few k-grams that a template can have
    rows = written(slim.select("uid", "doc_id", seen.alias("s")).select("uid", "doc_id", "s.n", "s.base", "s.grams"), "licences")

    grams = rows.select("uid", F.explode("grams").alias("g")).select("uid", "g.i", "g.gram", F.xxhash64("g.gram").alias("h"))
    known = template_grams(spark, templates, gram)
    if sum(len(text) for *_, text in templates) < BROADCAST:
        known = F.broadcast(known)
    hits = grams.join(known.withColumnRenamed("gram", "k"), "h").where(F.col("gram") == F.col("k"))
    votes = hits.groupBy("uid", "template", (F.col("i") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    by = Window.partitionBy("uid", "template").orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= NEIGHBOUR, 0).otherwise(1)
    runs = votes.withColumn("new", step).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.struct("ats", "lo", "hi")
    merged = runs.groupBy("uid", "template", "run").agg(
        F.struct(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("all"), F.collect_list(whole).alias("each")
    )
    # stray words can stretch a merged run, so its diagonals are candidates too
    tried = merged.select("uid", "template", F.inline(F.concat(F.array("all"), F.when(F.size("each") > 1, F.col("each")).otherwise(F.array().cast(merged.schema["each"].dataType)))))
    of = lambda values: F.element_at(F.array(*values), F.col("template") + 1)
    length, family = of([F.lit(len(w)) for w in split]), of([F.lit(f) for _, f, *_ in templates])
    keys = of([F.array(*[F.lit(x) for x in must(w, plain_words(key), gram)]) for w, (_, _, key, _) in zip(split, templates, strict=True)])
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + gram - 1)))))
    spans = tried.select("uid", "template", "lo", "hi", covered.alias("covered"), length.alias("length"), family.alias("family"), F.size(F.array_except(keys, F.col("ats"))).alias("lacks"))
    spans = spans.where((F.col("covered") >= COVER * F.col("length")) & (F.col("lacks") == 0) & (F.col("hi") + gram - F.col("lo") <= STRETCH * F.col("length")))
    inside = Window.partitionBy("uid", "family").orderBy("lo", "hi", "template", "covered")
    before = F.max("hi").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("new", F.when(F.col("lo") < before + gram, 0).otherwise(1))
    islands = apart.withColumn("island", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    best = islands.groupBy("uid", "family", "island").agg(F.max(F.struct("covered", (-F.col("template")).alias("t"), "length")).alias("b"))
    best = best.select("uid", (-F.col("b.t")).alias("template"), (F.col("b.covered") / F.col("b.length")).alias("share"))
    found = best.groupBy("uid").agg(F.collect_set(of([F.lit(label) for label, *_ in templates])).alias("own"), F.max("share").alias("share"))

    empty = F.array().cast("array<string>")
    base = F.transform("base", lambda b: b["label"])
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.join(found, "uid", "left").select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).cast("long").alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.concat(base, F.coalesce("own", empty))).alias("labels"),
        score.cast("double").alias("score"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in DuckDB's SQL; k-grams are joined as texts instead of hashes."""
    split = [plain_words(text) for *_, text in TEMPLATES]
    keys = [must(w, plain_words(key), GRAM) for w, (_, _, key, _) in zip(split, TEMPLATES, strict=True)]
    values = ", ".join(f"({i}, '{label}', '{family}', {k}, '{' '.join(w)}')" for i, ((label, family, *_), w, k) in enumerate(zip(TEMPLATES, split, keys, strict=True)))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    lengths = {len(p.split()) for p in PHRASES}
    columns = ", ".join(" || ' ' || ".join(["w", *[f"lead(w, {j}) OVER o" for j in range(1, n)]]) + f" AS g{n}" for n in sorted(lengths | {GRAM}))
    base = " UNION ALL ".join(f"SELECT t.doc_id, t.i, p.label FROM t JOIN p ON p.n = {n} AND t.g{n} = p.phrase" for n in sorted(lengths))
    return rf"""
WITH p(phrase, label, n) AS (VALUES {phrases}),
m0(template, label, family, must, text) AS (VALUES {values}),
m AS (SELECT template, label, family, must, string_split(text, ' ') AS w FROM m0),
k AS (SELECT template, j - 1 AS pos, w[j] {''.join(f" || ' ' || w[j + {n}]" for n in range(1, GRAM))} AS g
      FROM (SELECT template, w, unnest(range(1, len(w) - {GRAM} + 2)) AS j FROM m)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
t AS (SELECT doc_id, i, {columns} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS ({base}),
bs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS labels FROM b GROUP BY doc_id),
v AS (SELECT t.doc_id, k.template, t.i - k.pos AS diagonal, list(k.pos) AS ats, min(t.i) AS lo, max(t.i) AS hi FROM t JOIN k ON t.g{GRAM} = k.g GROUP BY ALL),
r AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEIGHBOUR} THEN 0 ELSE 1 END AS new FROM v),
q AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r),
f AS (SELECT doc_id, template, list_distinct(flatten(list(ats))) AS ats, min(lo) AS lo, max(hi) AS hi FROM q GROUP BY doc_id, template, run
      UNION ALL SELECT doc_id, template, ats, lo, hi FROM v),
c AS (SELECT DISTINCT f.doc_id, m.template, m.label, m.family, f.lo, f.hi, len(m.w) AS n, len(list_distinct(flatten(list_transform(f.ats, lambda a: range(a, a + {GRAM}))))) AS covered
      FROM f JOIN m USING (template) WHERE f.hi + {GRAM} - f.lo <= {STRETCH} * len(m.w) AND len(list_filter(m.must, lambda x: NOT list_contains(f.ats, x))) = 0),
e AS (SELECT * FROM c WHERE covered >= {COVER} * n),
i0 AS (SELECT *, CASE WHEN lo < max(hi) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GRAM} THEN 0 ELSE 1 END AS new FROM e
       WINDOW x AS (PARTITION BY doc_id, family ORDER BY lo, hi, template, covered)),
i1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, family ORDER BY lo, hi, template, covered ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM i0),
i2 AS (SELECT * FROM i1 QUALIFY row_number() OVER (PARTITION BY doc_id, family, island ORDER BY covered DESC, template) = 1),
o AS (SELECT doc_id, list(label) AS own, max(covered / n) AS share FROM i2 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(bs.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(o.own, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN o USING (doc_id)
"""


OP3_SQL = _sql()
