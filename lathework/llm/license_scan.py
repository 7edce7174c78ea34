"""License scan with a positional rare-token index, in DataFrame functions only.

A library of templates holds, for each, a whole notice and within it a mandatory key phrase. One pass counts in how many
files each word of the key phrases stands (over all files). The two words of a key phrase with the highest IDF are its
postings: word -> (template, place in the phrase). A second pass finds each file's indexed words, which are its rarest
licence words, looks them up in the postings, turns what they name into template starts, intersects the starts that the
rarest and the second word give, and verifies the key phrase word by word. As a verified phrase must hold both of its
indexed words, the index loses no place, whichever words it picks. Only templates that both postings name for a file are
looked at, so the cost follows a file's rare words and not the size of the library. A place's score is the share of the
notice's words that stand where the notice has them.

Postings and templates travel in the plan as one constant each; what reaches the driver is one count for each library
word. The library is a parameter, so its size is known.

Edge cases: null and empty texts have no words, no label and score 0; rows with a null or repeated id are scanned like any
other; an empty table gives an empty result; extra columns are ignored. Overlapping places all count.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import UPPER_AZ, lowered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words. Splitting here is many times faster than matching WORD, as Java is slow at negated ranges.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER_AZ, UPPER_AZ.lower())))


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    #: A phrase of the notice that must stand whole; the notice itself if not given.
    phrase: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return words_of(self.notice)

    @property
    def key(self) -> list[str]:
        return words_of(self.phrase or self.notice)

    @property
    def before(self) -> int:
        """Words of the notice before the key phrase."""
        words, key = self.words, self.key
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


# The phrases and labels asked for, and the notices of common licenses.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
NO_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
FREE_PROGRAM = """This program is free software; you can redistribute it and/or modify it under the terms of the {0} as published by the
Free Software Foundation; either version {1} of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the {0} for more details."""
LIBRARY = BASE + (
    Template("agpl-3", FREE_PROGRAM.format("GNU Affero General Public License", 3), "GNU Affero General Public License"),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "Apache License Version 2 0"),
    Template("artistic-2", "You may distribute this package under the terms of The Artistic License 2.0.", "Artistic License 2 0"),
    Template("boost-1", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)""", "Boost Software License"),
    Template("bsd", f"{BSD} {DISCLAIMER}", "Redistribution and use in source and binary forms"),
    Template("bsd-3-clause", f"{BSD} {NO_ENDORSEMENT} {DISCLAIMER}", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    Template("bsd-3-clause", "Licensed under the BSD 3-Clause License", "BSD 3 Clause"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons license, CC BY 4.0.", "CC BY 4 0"),
    Template("cc-by-nc-4.0", "This work is licensed under a Creative Commons license, CC BY-NC 4.0.", "CC BY NC 4 0"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons license, CC BY-SA 4.0.", "CC BY SA"),
    Template("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal.", "CC0 1 0"),
    Template("epl-2", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/""", "Eclipse Public License"),
    Template("gpl-2", FREE_PROGRAM.format("GNU General Public License", 2), "GNU General Public License as published by the Free Software Foundation either version 2"),
    Template("gpl-2", "Licensed under the GNU General Public License, version 2", "GNU General Public License version 2"),
    Template("gpl-3", FREE_PROGRAM.format("GNU General Public License", 3), "GNU General Public License as published by the Free Software Foundation either version 3"),
    Template("gpl-3", "Licensed under the GNU General Public License, version 3", "GNU General Public License version 3"),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""", "Permission to use copy modify and or distribute this software"),
    Template("lgpl", FREE_PROGRAM.format("GNU Lesser General Public License", 3), "GNU Lesser General Public License"),
    Template("mit-grant", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "Permission is hereby granted free of charge"),
    Template("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "Mozilla Public License"),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""", "free and unencumbered software"),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""", "Permission is granted to anyone to use this software for any purpose"),
)


def file_words(text: Column | str) -> Column:
    return F.array_remove(F.split(lowered(F.col(text) if isinstance(text, str) else text), GAP, -1), "")


def word_counts(docs: DataFrame, library: tuple[Template, ...], text: str = "text") -> dict[str, int]:
    """In how many files each word of the key phrases stands."""
    vocabulary = sorted({w for t in library for w in t.key})
    words = F.array_intersect(file_words(text), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counted}


def _postings(template: Template, counts: dict[str, int]) -> list[tuple[str, int]]:
    """The two rarest words of the key phrase, each with its first position in it."""
    key = template.key
    at = sorted({w: key.index(w) for w in key}.items(), key=lambda x: (counts[x[0]], x[1]))
    return [at[0], at[min(1, len(at) - 1)]]


TEMPLATES = "array<struct<label:string,base:boolean,before:int,key:array<string>,words:array<string>>>"
POSTINGS = "map<string,array<struct<t:int,at:int>>>"


def _constant(value: object, kind: str) -> Column:
    """A value as a constant of the plan; the optimizer reads the JSON once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def license_scan(docs: DataFrame, library: tuple[Template, ...] = LIBRARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, places (label, base, first word, score) of every file, in one scan after the counting one."""
    counts = word_counts(docs, library, text)
    rarest, second = {}, {}
    for number, template in enumerate(library):
        for index, (word, at) in zip((rarest, second), _postings(template, counts)):
            index.setdefault(word, []).append({"t": number, "at": at})
    first, other = _constant(rarest, POSTINGS), _constant(second, POSTINGS)
    templates = _constant([{"label": t.label, "base": t.base, "before": t.before, "key": t.key, "words": t.words} for t in library], TEMPLATES)
    indexed = sorted({*rarest, *second})

    rows = docs.select(F.col(doc_id).alias("doc_id"), file_words(text).alias("words"))
    rows = rows.withColumn("hits", F.filter(F.transform("words", lambda w, i: F.when(w.isin(indexed), i)), lambda i: i.isNotNull()))
    word = lambda i: F.get(F.col("words"), i)
    none = F.array().cast("array<struct<t:int,start:int>>")

    def starts(postings: Column) -> Column:
        """The template starts that a file's indexed words name."""
        named = lambda i: F.transform(F.try_element_at(postings, word(i)), lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("start")))
        return F.flatten(F.transform("hits", lambda i: F.coalesce(named(i), none)))

    both = F.when(F.size("hits") > 0, F.array_intersect(starts(first), starts(other))).otherwise(none)
    # Each candidate start meets its template here, and only there.
    met = F.transform(F.filter(both, lambda c: c["start"] >= 0), lambda c: F.struct(F.get(templates, c["t"]).alias("t"), c["start"].alias("start")))
    sure = F.filter(met, lambda c: F.slice("words", c["start"] + 1, F.size(c["t"]["key"])) == c["t"]["key"])

    def score(c: Column) -> Column:
        t = c["t"]
        same = F.filter(t["words"], lambda w, j: word(c["start"] - t["before"] + j) == w)
        return F.size(same).cast("double") / F.size(t["words"])

    places = F.transform(sure, lambda c: F.struct(c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), c["start"].cast("long").alias("start"), score(c).alias("score")))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"))


def summary(scanned: DataFrame) -> DataFrame:
    """One flat row per file from `license_scan`."""
    base = F.filter("places", lambda p: p["base"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    return scanned.withColumn("b", base).select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda p: p["start"])).alias("first_word"), F.array_max(F.transform("b", lambda p: p["start"])).alias("last_word"),
        labels("b").alias("base_labels"), labels("places").alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def summary_sql(library: tuple[Template, ...] = LIBRARY) -> str:
    """DuckDB: every place of every key phrase, by trying all starts."""

    def one(t: Template) -> str:
        quote = "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        at = f"list_sum(list_transform(range({len(t.words)}), lambda j: CASE WHEN s.s - {t.before} + j >= 0 AND s.w[s.s - {t.before} + j + 1] = {quote}[j + 1] THEN 1 ELSE 0 END))"
        n = len(t.key)
        tries = " AND ".join(f"w[i + {j + 1}] = '{w}'" for j, w in enumerate(t.key))
        return f"SELECT s.doc_id, '{t.label}' AS label, {str(t.base).lower()} AS base, s.s AS start, CAST({at} AS DOUBLE) / {len(t.words)} AS score FROM (SELECT doc_id, w, unnest(list_filter(range(len(w) - {n} + 1), lambda i: {tries})) AS s FROM d WHERE len(w) >= {n}) s"

    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
p AS ({" UNION ALL ".join(one(t) for t in library)}),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (doc_id)"""
