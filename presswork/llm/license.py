"""License scans by sparse TF-IDF cosine, with inheritance along directories.

A file is compared unit by unit: its lines, its sentences, its blocks of lines between blank ones (headers, wrapped notices) and its whole
text (licence files). A unit's terms, weighted by frequency and by the inverse document frequency among the templates (terms
that no template has get the largest weight), are compared by cosine with each template that shares a term; the best template at or above
``LEAST`` is the file's licence. A *licence file* is named like one, or the best unit holds at least four fifths of its words. A file
without a licence of its own takes that of the nearest ancestor directory that has a licence file, by equi-joins on paths. Column
expressions only.

Two exact tests leave out units that can't reach ``LEAST``, before any term is shuffled. A unit must have one of a few *key terms*: as a dot
product is at most the length of the template's part that is shared, terms of a template with a squared weight above 1 - LEAST ** 2 together
can't all be absent. And its known terms, squared and weighted, must outweigh the number of its unknown ones, as these have the
largest weight each.

Templates are broadcast after a count of their terms. Ancestors are taken per directory, not per file. The directories' answers are
broadcast to the files while a count shows few, else joined by a plain equi-join that adaptive execution splits where a directory is hot.

Nulls and edges: a null text or path has no units or no directory; equal scores go to the smaller license name, then the longer unit; two licence
files of one directory: the better score, then the smaller name, decides; repeated rows are scanned each; very long texts are compared
whole; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswork.llm.common import broadcast_if_small, numbered, table, word_count
from presswork.schema import STOP_WORDS
from presswork.session import checkpoint

LEAST, DOMINANT = 0.8, 0.8
#: Letters of a key term that is likely to be rare.
LONG = 7
#: Common words of licence texts that the list of stop words lacks.
COMMON = ("you", "we", "all", "any", "out", "other", "such", "which", "must", "can", "use", "only", "also", "who", "they", "work", "file", "means")
NAMES = r"(?i)^(licen[sc]e|copying|unlicense|notice)(\.|$)"
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later version."
_LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
    "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
#: Short notices, headers and bodies of licences by SPDX identifier; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", _APACHE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("MIT", _MIT + " " + _MIT_WARRANTY),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Released under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GPL.format(2)),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "Released under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _LGPL),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD2),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD2 + " " + _BSD3),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "Released under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
#: Identifiers get one more template each: the line that names them in a header.
SPDX = tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in TEMPLATES}))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits, dots and hyphens without dots and hyphens at their ends."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)"), 1)


def template_weights(templates: DataFrame) -> DataFrame:
    """``(term, template, license, weight, idf)``; weights are normalised per template."""
    n = templates.count()
    counted = templates.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    spread = counted.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weighed = counted.join(spread, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighed.join(norms, "template").select("term", "template", "license", (F.col("raw") / F.col("norm")).alias("weight"), "idf")


def key_terms(weights: list) -> list[str]:
    """Few terms of which every unit that can reach ``LEAST`` has one, such as are likely to be rare in other texts.

    Greedily, the next is that which adds most to the templates' squared weights, up to what each needs, with terms of few templates preferred;
    terms of less than ``LONG`` letters, and then common words, count only for templates that need them.
    """
    need = dict.fromkeys((r.template for r in weights), 1 - LEAST**2 + 1e-9)
    by_term: dict[str, list] = {}
    for r in weights:
        by_term.setdefault(r.term, []).append(r)
    keys: list[str] = []
    for may in (lambda t: len(t) >= LONG, lambda t: t not in STOP_WORDS and t not in COMMON, lambda t: True):
        while any(n > 0 for n in need.values()):
            gain = {t: sum(min(max(need[r.template], 0), r.weight**2) for r in rows) * rows[0].idf ** 8 for t, rows in by_term.items() if may(t)}
            best = max(sorted(gain), key=gain.get, default="")
            if not gain or gain[best] <= 0:
                break
            keys.append(best)
            for r in by_term.pop(best):
                need[r.template] -= r.weight**2
    return sorted(keys)


def units(text: Column) -> Column:
    """Lines, sentences, blocks between blank lines and the whole text, each once."""
    lines = F.split(text, "\n")
    sentences = F.split(F.regexp_replace(text, r"([.!?;])[ \t]+", "$1\n"), "\n")
    blocks = F.split(text, r"\n[ \t\r]*\n")
    return F.array_distinct(F.concat(lines, sentences, blocks, F.array(text)))


def _possible(own: Column, shares: dict[str, float]) -> Column:
    """Whether a unit with these terms can reach ``LEAST``; ``shares`` are the templates' terms with the squares of idf over the largest idf."""
    pairs = F.str_to_map(F.lit(",".join(f"{t}:{x:.9f}" for t, x in sorted(shares.items()))), F.lit(","), F.lit(":"))  # folded to one literal
    known = F.map_keys(pairs)
    unknown = F.size(F.array_except(own, known))
    times = lambda t: F.size(F.filter(own, lambda x: x == t)).cast("double")
    squares = F.aggregate(F.array_intersect(own, known), F.lit(0.0), lambda a, t: a + times(t) * times(t) * F.element_at(pairs, t).cast("double"))
    return squares * (1 / LEAST**2 - 1) >= unknown * (1 - 1e-6)


def unit_matches(rows: DataFrame, weights: DataFrame, n_templates: int) -> DataFrame:
    """``(file, license, score, words)``: the best template of each file with a unit at or above the least score, and that unit's words."""
    held = weights.collect()  # as many rows as the templates have terms
    keys, largest = key_terms(held), math.log(1.0 + n_templates) + 1.0
    shares = {r.term: (r.idf / largest) ** 2 for r in held}
    wanted = F.split(F.lit(" ".join(keys)), " ")
    has_key = lambda text: F.arrays_overlap(F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), "[.-]*[^a-z0-9.-]+[.-]*"), wanted)
    # made inside the generator, so that each unit's terms are taken once
    made = F.transform(F.filter(units(F.col("text")), has_key), lambda u: F.struct(word_count(u).alias("words"), terms(u).alias("terms")))
    unit = rows.where(has_key(F.col("text"))).select("file", F.posexplode(made).alias("unit", "u")).where(_possible(F.col("u.terms"), shares))
    unit = unit.select("file", "unit", "u.words", "u.terms")
    idf = weights.groupBy("term").agg(F.first("idf").alias("t_idf"))
    counted = unit.select("file", "unit", "words", F.explode("terms").alias("term")).groupBy("file", "unit", "term").agg(F.count("*").alias("tf"), F.first("words").alias("words"))
    few, _ = broadcast_if_small(idf)
    raw = checkpoint(counted.join(few, "term", "left").select("file", "unit", "words", "term", (F.col("tf") * F.coalesce("t_idf", F.lit(largest))).alias("raw")))
    norms = raw.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.first("words").alias("words"))
    sides, _ = broadcast_if_small(weights.select("term", "template", "license", "weight"))
    dots = raw.join(sides, "term").groupBy("file", "unit", "template", "license").agg(F.sum(F.col("raw") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, ["file", "unit"]).select("file", "license", "words", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= LEAST)
    # the largest score first, then the smallest name with it, then the longest unit
    top = scores.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", (-F.col("words")).alias("w"))).alias("best"))
    return top.select("file", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"), (-F.col("best.w")).alias("unit_words"))


def scan(files: DataFrame, templates: DataFrame) -> DataFrame:
    """``path, license, score, origin, license_dir`` per row of ``files`` (``path``, ``text``, and a unique ``file``), with ``file``.

    ``origin`` is ``own``, ``inherited`` or null; ``license_dir`` is the directory inherited from. ``templates`` has a unique ``template``,
    ``license`` and ``text``.
    """
    files = files.select("file", "path", "text")
    weights = checkpoint(template_weights(templates))
    own = unit_matches(files, weights, templates.count())
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    narrow = files.select("file", "path", folder.alias("dir"), F.regexp_like(base, F.lit(NAMES)).alias("named"), word_count(F.col("text")).alias("all_words"))
    is_license = F.col("named") | (F.col("unit_words") >= F.lit(DOMINANT) * F.col("all_words"))
    rows = checkpoint(narrow.join(own, "file", "left").withColumn("is_license", is_license).drop("named", "all_words", "unit_words"))
    declared = (
        rows.where("is_license and license is not null and dir is not null").groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")).select(F.col("dir").alias("d_dir"), F.col("best.license").alias("d_license"), (-F.col("best.s")).alias("d_score"))
    )
    dirs = rows.where("license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("at")))
    steps = dirs.select("dir", F.explode(F.concat(root, above)).alias("up")).select("dir", "up.depth", "up.at")
    nearest = steps.join(declared, F.col("at") == F.col("d_dir")).groupBy("dir").agg(F.max(F.struct("depth", "d_dir", "d_license", "d_score")).alias("n"))
    nearest = nearest.select(F.col("dir").alias("n_dir"), F.col("n.d_dir").alias("license_dir"), F.col("n.d_license").alias("n_license"), F.col("n.d_score").alias("n_score"))
    nearest, _ = broadcast_if_small(checkpoint(nearest))
    joined = rows.join(nearest, (F.col("dir") == F.col("n_dir")) & F.col("license").isNull(), "left")
    return joined.select(
        "file", "path", F.coalesce("license", "n_license").alias("license"), F.coalesce("score", "n_score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("n_license").isNotNull(), "inherited").alias("origin"), "license_dir",
    )


def templates_frame(spark: SparkSession, templates=TEMPLATES + SPDX) -> DataFrame:
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: the source at the top, below it the language, below that a numbered folder; two fifths lie higher up."""
    docs = table(spark, sf_dir, "documents")
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    lang = F.when(F.pmod(number, F.lit(5)) != 0, F.coalesce("lang", F.lit("none")))
    sub = F.when(F.pmod(number, F.lit(5)) > 1, F.concat(F.lit("d"), F.pmod(number, F.lit(8)).cast("string")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), lang, sub, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    files = numbered(docs.select("doc_id", path.alias("path"), "text"), "file")
    found = scan(files, templates_frame(spark))
    return found.select(F.expr("try_cast(regexp_extract(path, '([^/]*)[.]txt$', 1) as long)").alias("doc_id"), "path", "license", "score", "origin", "license_dir")


_ALL = TEMPLATES + SPDX
_NOTICES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(_ALL))
_TERMS = "regexp_extract_all(lower({0}), '[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?')"
OP9_SQL = rf"""
WITH t(template, license, text) AS (VALUES {_NOTICES}),
tc AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({_TERMS.format("text")}) AS term FROM t) GROUP BY ALL),
ti AS (SELECT term, ln((1.0 + {len(_ALL)}) / (1.0 + count(*))) + 1.0 AS idf FROM tc GROUP BY term),
tw AS (SELECT template, license, term, tf * idf AS raw FROM tc JOIN ti USING (term)),
tn AS (SELECT template, sqrt(sum(raw * raw)) AS norm FROM tw GROUP BY template),
w AS (SELECT template, license, term, raw / norm AS weight FROM tw JOIN tn USING (template)),
d AS (SELECT row_number() OVER () AS file, doc_id, text, coalesce(doc_id::VARCHAR, 'none') || '.txt' AS name,
             concat_ws('/', coalesce(source, 'none'), CASE WHEN coalesce(doc_id, 0) % 5 <> 0 THEN coalesce(lang, 'none') END,
                       CASE WHEN coalesce(doc_id, 0) % 5 > 1 THEN 'd' || coalesce(doc_id, 0) % 8 END) AS dir FROM documents),
ul AS (SELECT file, unnest(string_split(text, chr(10))) AS unit FROM d
       UNION ALL SELECT file, unnest(string_split(regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10))) FROM d
       UNION ALL SELECT file, unnest(string_split_regex(text, '\n[ \t\r]*\n')) FROM d
       UNION ALL SELECT file, text FROM d),
u AS (SELECT row_number() OVER () AS n, file, unit, len(regexp_extract_all(unit, '[^\x20\x09-\x0D]+')) AS words
      FROM (SELECT DISTINCT file, unit FROM ul WHERE unit IS NOT NULL)),
c AS (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest({_TERMS.format("unit")}) AS term FROM u) GROUP BY ALL),
r AS (SELECT n, term, tf * coalesce(idf, ln(1.0 + {len(_ALL)}) + 1.0) AS raw FROM c LEFT JOIN ti USING (term)),
rn AS (SELECT n, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY n),
s AS (SELECT r.n, w.template, w.license, round(sum(r.raw * w.weight) / any_value(rn.norm), 9) AS score FROM r JOIN w USING (term) JOIN rn ON r.n = rn.n GROUP BY ALL),
own AS (SELECT file, license, score, words FROM s JOIN u USING (n) WHERE score >= {LEAST}
        QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, license, words DESC) = 1),
f AS (SELECT d.file, doc_id, dir, dir || '/' || name AS path, own.license, own.score, words >= {DOMINANT} * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS is_license
      FROM d LEFT JOIN own USING (file)),
dl AS (SELECT dir, license, score FROM f WHERE is_license AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
up AS (SELECT x.dir, dl.dir AS at, dl.license, dl.score FROM (SELECT DISTINCT dir FROM f) x JOIN dl ON x.dir = dl.dir OR starts_with(x.dir, dl.dir || '/')
       QUALIFY row_number() OVER (PARTITION BY x.dir ORDER BY length(dl.dir) DESC) = 1)
SELECT doc_id, path, coalesce(f.license, up.license) AS license, coalesce(f.score, up.score) AS score,
       CASE WHEN f.license IS NOT NULL THEN 'own' WHEN up.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN f.license IS NULL THEN up.at END AS license_dir
FROM f LEFT JOIN up USING (dir)
"""
