"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A header is a line that names a licence (anywhere in a text), alone and joined with the one and the two lines that follow it,
since titles and notices run over lines; a licence file is a text whose file name says so, and counts as one piece as well.  A
piece that is as near to another licence tells nothing, so that a wrong version is never named.  Words of the templates are weighted by how many texts of the corpus hold them; a piece is
compared with every template by the cosine of sparse vectors, through a join on words.  A file without a licence of its
own takes that of the licence file in the nearest directory above it, by joining the directories on its path with those
of licence files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import col, spread, stored

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(kind: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


def _cc(terms: str, version: str) -> str:
    return f"This work is licensed under a Creative Commons {terms} {version} International License."


# The texts, notices and names of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "MIT License " + _MIT),
    ("ISC", "Released under the ISC License."),
    ("ISC", "ISC License " + _ISC),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("", "2")),
    ("LGPL-3.0", _gnu("Lesser", "3")),
    ("LGPL-2.1", _gnu("Lesser", "2.1")),
    ("AGPL-3.0", _gnu("Affero", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Artistic-1.0", "The Artistic License Preamble"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", _cc("Attribution-NonCommercial", "4.0")),
    ("CC-BY-4.0", _cc("Attribution", "4.0")),
    ("CC-BY-SA-4.0", _cc("Attribution-ShareAlike", "4.0")),
    *[(name, f"SPDX-License-Identifier: {tag}") for name, tag in (("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-3.0", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-3.0", "LGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"))],
]
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What a line must hold to be a header: a cheap test before any weighing.
NAMES = r"(?i)licen[sc]e|redistribution|permission (is hereby|to use)|redistribute|unencumbered|spdx|creative commons"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z]+)?$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _template_words() -> list[tuple[int, str, str, int]]:
    out = []
    for i, (licence, text) in enumerate(TEMPLATES):
        found = re.findall(WORD, text.lower())
        out += [(i, licence, w, found.count(w)) for w in sorted(set(found))]
    return out


def parent(path: Column) -> Column:
    """The directory of a path; the empty string at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def licence_scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6, margin: float = 0.005, whole: float = 0.85) -> DataFrame:
    """One row per row of docs: id, path, own_licence, score (of the best template, rounded to 6 digits), licence (own
    or inherited), inherited_from (the directory), n_headers (lines that, alone or with the next two, match a template).

    path: an expression over docs, the same for two rows only if they are the same file.  least: the least cosine.
    margin: how much nearer a piece must be to its licence than to any other; a piece without it counts for none, nor does one without a word that its licence's template has and the
    other's has not (so that a notice without its version names no version).  A licence
    file's licence is that of the file as a whole if its cosine is `whole` or more, since one that lists the licences of its
    parts is near to none, or to a wrong one; otherwise a text's own licence is that of its best piece, of
    equally good ones the first.  Lines of white space alone are passed over.  Null, empty and
    plain texts have no licence of their own (null, score 0); a null path inherits nothing; of several licence files
    in one directory the best, then the first by name, counts.  Repeated rows give repeated rows; no rows give no rows;
    other columns are left out.
    """
    spark = docs.sparkSession
    base = docs.select(col(id_col).alias("id"), path.alias("path"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    known = _template_words()
    vocabulary = sorted({w for _, _, w, _ in known})
    # Words: how many texts hold each of the vocabulary's, over the whole corpus, from one pass that also finds the pieces.
    held = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    after = lambda lines, x, i: F.array(x, F.concat_ws(" ", x, F.get(lines, i + 1)), F.concat_ws(" ", x, F.get(lines, i + 1), F.get(lines, i + 2)))
    named = lambda lines: F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(NAMES), after(lines, x, i))))
    lines = F.get(F.transform(F.array(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))), named), F.lit(0))
    lines = F.when(F.col("text").rlike(NAMES), lines).otherwise(F.array().cast("array<array<string>>"))
    is_file = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    as_one = F.when(is_file & F.col("text").rlike(NAMES), F.array("text")).otherwise(F.array().cast("array<string>"))
    rows = stored(base.select("id", "path", is_file.alias("is_file"), held.alias("held"), lines.alias("lines"), as_one.alias("whole")).withColumn("rid", F.monotonically_increasing_id()), "licence-rows")

    total = rows.count()
    df = rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    values = ", ".join(f"({i}, '{licence}', '{word}', {n})" for i, licence, word, n in known)  # words of a-z, 0-9, dots and dashes
    template = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, licence, word, n)")
    vocab = template.select("word").distinct().join(df, "word", "left").select("word", (F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    vocab = stored(vocab, "licence-vocabulary")  # a row for each word of the templates, some 150
    weighed = template.join(F.broadcast(vocab), "word").withColumn("w", F.col("n") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighed = stored(weighed.join(norms, "template").select("template", "licence", "word", (F.col("w") / F.col("norm")).alias("tw")), "licence-templates")

    header = rows.select("rid", F.posexplode("lines").alias("line", "pieces")).select("rid", "line", F.posexplode(F.array_distinct("pieces")).alias("more", "piece"))
    found = header.select("rid", (F.col("line") * 3 + F.col("more")).alias("at"), "piece").unionByName(rows.select("rid", F.lit(-1).alias("at"), F.explode("whole").alias("piece")))
    rare = F.log(F.lit(total) + 1) + 1  # a word outside the vocabulary weighs as one that no text holds
    tf = found.select("rid", "at", F.explode(words(F.col("piece"))).alias("word")).groupBy("rid", "at", "word").agg(F.count("*").alias("n"))
    tf = tf.join(F.broadcast(vocab), "word", "left").withColumn("w", F.col("n") * F.coalesce("idf", rare))
    size = tf.groupBy("rid", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = tf.join(F.broadcast(weighed), "word").groupBy("rid", "at", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.collect_list("word").alias("met"))
    scored = dot.join(size, ["rid", "at"]).select("rid", "at", "template", "licence", "met", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    # of a piece the nearest licence; at most as many others as there are licences
    of_template = F.broadcast(template.groupBy("template").agg(F.collect_set("word").alias("words")))
    each = scored.join(of_template, "template").groupBy("rid", "at", "licence").agg(F.max(F.struct("score", "words", "met")).alias("m"))
    each = each.groupBy("rid", "at").agg(F.sort_array(F.collect_list(F.struct("m.score", "licence", "m.words", "m.met")), asc=False).alias("near"))
    each = each.select("rid", "at", F.get("near", F.lit(0)).alias("first"), F.slice("near", 2, len(TEMPLATES)).alias("others"))

    def farther(other):
        own_words = F.array_except(F.col("first.words"), other["words"])
        return (F.col("first.score") - other["score"] > margin) & ((F.size(own_words) == 0) | F.arrays_overlap(own_words, F.col("first.met")))

    sure = each.where(F.forall("others", farther)).select("rid", "at", "first")
    # a whole file first, then the greatest score, then the first piece: one ordered value for each
    best = F.min(F.struct(((F.col("at") >= 0) | (F.col("first.score") < whole)).alias("part"), (-F.col("first.score")).alias("far"), "at", F.col("first.licence").alias("licence"))).alias("best")
    headers = F.countDistinct(F.when(F.col("at") >= 0, F.floor(F.col("at") / 3))).alias("n_headers")
    own = sure.groupBy("rid").agg(best, headers)
    own = stored(own.select("rid", (-F.col("best.far")).alias("score"), "n_headers", F.col("best.licence").alias("own_licence")), "licences")

    per_row = stored(rows.select("rid", "id", "path", "is_file").join(own, "rid", "left"), "licence-own")
    files = per_row.where(F.col("is_file") & F.col("own_licence").isNotNull()).select(parent(F.col("path")).alias("dir"), "score", F.col("own_licence").alias("inherited"))
    files = files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "inherited")).alias("best")).select("dir", "best.inherited")
    # All directories above a file's: prefixes of its path, as many as it has slashes.
    dirs = per_row.where("own_licence IS NULL AND path IS NOT NULL").select(parent(F.col("path")).alias("own_dir")).distinct()
    parts = F.split("own_dir", "/")
    above = dirs.withColumn("parts", parts).select("own_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))).alias("dir")).distinct()
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    nearest = spread(above, "dir").join(spread(files, "dir"), ["dir", "_spread"]).groupBy("own_dir").agg(F.max(F.struct(depth.alias("depth"), "dir", "inherited")).alias("n"))
    nearest = nearest.select("own_dir", F.col("n.dir").alias("inherited_from"), "n.inherited")
    out = spread(per_row.withColumn("own_dir", parent(F.col("path"))), "own_dir").join(spread(nearest, "own_dir"), ["own_dir", "_spread"], "left")
    inherits = F.col("own_licence").isNull()
    return out.select(
        F.col("id").alias(id_col), "path", "own_licence", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("own_licence", "inherited").alias("licence"), F.when(inherits, F.col("inherited_from")).alias("inherited_from"),
        F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"),
    )


def document_path() -> Column:
    """A file tree over documents: source/thousand/hundred/id.txt, where every hundredth is its directory's LICENSE and
    every thousandth that of the directory above."""
    i = F.col("doc_id")
    thousand, hundred = F.concat_ws("/", F.lit("t"), F.floor(i / 1000)), F.concat_ws("/", F.lit("t"), F.floor(i / 1000), F.floor(i / 100))
    return F.when(i % 1000 == 0, F.concat(thousand, F.lit("/LICENSE"))).when(i % 100 == 0, F.concat(hundred, F.lit("/LICENSE"))).otherwise(F.concat(hundred, F.lit("/"), i, F.lit(".txt")))


def op9_licence_scan(spark, sf_dir):
    return licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), document_path())
