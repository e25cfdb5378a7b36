"""License scans: canonical texts, and a hash join of their digests with those of known licences. DataFrame functions only.

The canonical form of a text is in small ASCII letters and digits: copyright lines go, equivalent spellings become
one, and punctuation and white space separate words. An entire text (a document, or a line as a notice of its own)
matches where its canonical form's SHA-256 is that of a known text. Only canonical forms as long as a known one are
hashed; a form of another length cannot be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.llm.common import ASCII_UPPER

#: Equivalent spellings, as (pattern over the words between spaces, word).
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("per cent", "percent"),
    ("version three", "version 3"),
    ("version two", "version 2"),
]
#: Lines that name a holder or reserve rights, in small letters.
COPYRIGHT = r"^[ \t*#/>-]*(copyright[ ,:]*(\(c\)|©|[0-9]|by )|\(c\)|©|all rights reserved)"
#: A short line of the word and a holder or a placeholder is one too, unless what follows makes it a clause.
HOLDER, MOST_HOLDER = r"^[ \t*#/>-]*copyright[ ,:]+[^ ,:]", 120
CLAUSE = r"^[ \t*#/>-]*copyright[ ,:]+(act|and|are|as|claims?|disclaimer|for|holders?|in|infringement|interests?|is|laws?|licen[sc]es?|material|notices?|of|on|or|owners?|permission|protected|protection|statements?|status|terms|to|works?)([^a-z]|$)"
#: What separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The catalogue is broadcast, so it is checked to have no more entries.
MOST_KNOWN = 100_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

#: Known texts, as (id, text). The first ones are entire licences, the others usual notices.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("ISC", _ISC + "\n" + _DISCLAIMER),
    ("ISC", "ISC License\n" + _ISC + "\n" + _DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _DISCLAIMER),
    ("BSD-2-Clause", _BSD_2 + "\n" + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_2 + "\n" + _BSD_3 + "\n" + _BSD_DISCLAIMER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("ISC", "SPDX-License-Identifier: ISC"),
]


def canonical_line(c: Column) -> Column:
    """One line's words: small letters, digits and characters beyond ASCII between single spaces; empty for a copyright line."""
    folded = F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())
    holder = folded.rlike(HOLDER) & (F.length(c) <= MOST_HOLDER) & ~folded.rlike(CLAUSE)
    return F.when(folded.rlike(COPYRIGHT) | holder, F.lit("")).otherwise(F.trim(F.regexp_replace(folded, SEPARATORS, " ")))


def spelled(c: Column) -> Column:
    """Canonical words with one spelling for equivalent ones. Words stand between two spaces, so that neighbours are told apart."""
    padded = F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(padded, F.lit("  "), F.lit(" ")))


def canonical_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), canonical_line), lambda x: x != "")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, size and license of the known texts; where two ids claim one canonical text, the first by name has it."""
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in known) + " AS t(license, text)")
    forms = table.select("license", spelled(F.array_join(canonical_lines(F.col("text")), " ")).alias("form")).where("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("size")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, canonical_sha256 of the entire text, license (of the entire text, else null), notices (sorted ids of the lines that are known texts as a whole) and n_notices.

    known: digest, size and license of a catalogue, which is checked to be small enough to broadcast. Null texts are
    empty; the empty form has a digest but matches nothing. Repeated rows are documents of their own: notices are
    looked up within the row, so that nothing is shuffled. Other columns are ignored; an empty table gives no row.
    """
    if known.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        raise ValueError(f"the catalogue has more than {MOST_KNOWN} texts")
    by_digest = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license")))).scalar()
    sizes = known.agg(F.collect_set("size")).scalar()
    rows = docs.select(F.col(key).alias("doc_id"), canonical_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    spelled_lines = rows.select("doc_id", by_digest.alias("by_digest"), sizes.alias("sizes"), F.sha2(spelled(F.array_join("lines", " ")), 256).alias("canonical_sha256"), F.transform("lines", spelled).alias("lines"))
    hashed = spelled_lines.select("doc_id", "by_digest", "canonical_sha256", F.transform(F.filter("lines", lambda x: F.array_contains("sizes", F.length(x))), lambda x: F.sha2(x, 256)).alias("parts"))
    found = hashed.select("doc_id", "canonical_sha256", F.filter(F.transform("parts", lambda d: F.col("by_digest")[d]), lambda x: x.isNotNull()).alias("all"))
    texts = F.broadcast(known.select(F.col("digest").alias("canonical_sha256"), "license"))
    return found.join(texts, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license", F.array_join(F.array_sort(F.array_distinct("all")), ",").alias("notices"), F.size("all").cast("long").alias("n_notices"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the built-in catalogue."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    folded = f"translate(x, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"
    line = f"CASE WHEN regexp_matches({folded}, {q(COPYRIGHT)}) OR (regexp_matches({folded}, {q(HOLDER)}) AND length(x) <= {MOST_HOLDER} AND NOT regexp_matches({folded}, {q(CLAUSE)})) THEN '' ELSE trim(regexp_replace({folded}, {q(SEPARATORS)}, ' ', 'g')) END"
    lines = lambda c: f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {line}), lambda x: x <> '')"

    def one(c: str) -> str:
        c = f"' ' || replace({c}, ' ', '  ') || ' '"
        for a, b in SPELLINGS:
            c = f"replace({c}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(replace({c}, '  ', ' '))"

    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    whole = one("array_to_string(lines, ' ')")
    return f"""
WITH k AS (
  SELECT sha256(form) AS digest, min(license) AS license FROM (
    SELECT license, {whole} AS form FROM (SELECT license, {lines('text')} AS lines FROM (VALUES {values}) AS t(license, text)))
  WHERE form <> '' GROUP BY 1),
d AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
n AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
  FROM (SELECT doc_id, sha256({one('x')}) AS digest FROM d, unnest(lines) AS t(x)) JOIN k USING (digest) GROUP BY doc_id)
SELECT doc_id, canonical_sha256, k.license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM (SELECT doc_id, sha256({whole}) AS canonical_sha256 FROM d) LEFT JOIN k ON canonical_sha256 = digest LEFT JOIN n USING (doc_id)
"""


ORACLE = _oracle()
