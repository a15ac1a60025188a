"""Licence scans: canonical digests of entire texts, hash-joined to those of known licences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Spellings that count as one (left as right), applied in this order to canonical words.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
    (" version ", " v "),
    (" v2 0", " v 2 0"),
    (" v3", " v 3"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’“”–—", "abcdefghijklmnopqrstuvwxyz\"\"\"\"--"
#: A line that opens so says whose it is, not what is allowed, unless it goes on so (wrapped inside a sentence).
OWNER_LINE = r"^[^a-z0-9©]*(copyright|©|\(c\)|c [12][0-9]{3}|all rights reserved)"
GOES_ON = r"^[^a-z0-9]*copyright[^a-z0-9]+(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|and|or|in|is|to|are|that|which)([^a-z0-9]|$)"
#: A line that is only a licence's name; a text that has other lines is the same with or without it.
TITLE_LINE = r"^[^a-z0-9]*(the +)?(mit|expat|x11|isc|0bsd|bsd|(new|revised|modified|simplified) +bsd|freebsd|zlib|boost +software|apache|unlicense|(bsd[ -]+)?zero[ -]+clause([ -]+bsd)?)([ -]+[0-9][ -]+clause)?( +.(new|revised|modified|simplified|original).)?( +licen[cs]e)?( *- *version +[0-9.]+( *- *[a-z]+ +[0-9]+th, +[0-9]{4})?)?( *,? *.?(mit|isc|zlib|0bsd|bsd-[0-9]-clause|version +[0-9.]+).?)?[^a-z0-9]*$"
NOT_WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version %d of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\n"
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
#: Licences and notices by identifier. Longer texts (of whole Apache, GPL, LGPL, MPL or CC licences) come in as a table ``known``.
KNOWN = [
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AUTHOR),
    ("BSD-2-Clause", _BSD_START + _BSD_1 + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_1 + _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END),
    (
        "Zlib",
        "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n'
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", _GPL % 3),
    ("GPL-2.0-or-later", _GPL % 2),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
]


def _canonical_of(lines: Column) -> Column:
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.array_join(lines, " "), NOT_WORD, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def canonical(text: Column) -> Column:
    """Lower case, without owner lines and titles, words between single blanks, one spelling; a text of titles only is those."""
    lines = F.filter(F.split(F.translate(text, UPPER, LOWER), "\n", -1), lambda line: ~line.rlike(OWNER_LINE) | line.rlike(GOES_ON))
    body = F.filter(lines, lambda line: ~line.rlike(TITLE_LINE))
    return _canonical_of(F.when(F.exists(body, lambda line: line.rlike("[a-z0-9]|[^\\x00-\\x7f]")), body).otherwise(lines))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id, length, n_words): of equal digests the first identifier; canonically empty texts drop out."""
    if known is None:
        known = spark.createDataFrame(KNOWN, "license_id string, text string")
    texts = known.select("license_id", canonical(F.col("text")).alias("t")).where("t <> ''")
    return texts.groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.first(F.length("t")).alias("length"), F.first(F.size(F.split("t", " "))).alias("n_words"))


#: Known texts that are broadcast at most (about 100 bytes each); more of them are joined by a shuffle of digests.
FEW = 1 << 16
#: Spellings lengthen a text by a third at most (" v3" to " v 3").
LONGER = 4 / 3


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per document: id, digest of its canonical text, license_id if the entire text is a known one, notices.

    ``notices`` lists in order the distinct identifiers of the lines that are, entire, a known text.
    Both are hash joins on digests; texts never shuffle. Lines too short for any known text, or of a
    number of words that none has, are left out before that. ``known`` (license_id, text) is a table of texts in place of
    ``KNOWN``; of known texts with one digest the first identifier counts. A null text has no digest, an empty one that
    of the empty text; neither matches. Rows of one id share their notices, repeated rows have equal results; null ids have none.
    An empty table gives an empty result; other columns don't come along.
    """
    known = known_digests(docs.sparkSession, known)
    bounds = known.agg(F.count("*").alias("n"), F.min("length").alias("length"), F.min("n_words").alias("low"), F.max("n_words").alias("high")).first()
    matching = known.select("digest", "license_id")
    matching = F.broadcast(matching) if bounds.n <= FEW else matching
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = rows.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.where(F.length("line") * LONGER >= F.lit(bounds.length or 0)).select("doc_id", canonical(F.col("line")).alias("line"))
    lines = lines.where(F.size(F.split("line", " ")).between(bounds.low or 0, bounds.high or 0)).select("doc_id", F.sha2("line", 256).alias("digest"))
    noted = lines.join(matching, "digest").groupBy("doc_id").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    whole = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(matching, "digest", "left")
    return whole.join(noted, "doc_id", "left").select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    lines = f"list_filter(string_split(translate({text}, {_quoted(UPPER)}, {_quoted(LOWER)}), chr(10)), lambda line: NOT regexp_matches(line, {_quoted(OWNER_LINE)}) OR regexp_matches(line, {_quoted(GOES_ON)}))"
    body = f"list_filter({lines}, lambda line: NOT regexp_matches(line, {_quoted(TITLE_LINE)}))"
    some = f"len(list_filter({body}, lambda line: regexp_matches(line, '[a-z0-9]|[^\\x00-\\x7f]'))) > 0"
    rest = f"array_to_string(CASE WHEN {some} THEN {body} ELSE {lines} END, ' ')"
    out = f"' ' || trim(regexp_replace({rest}, {_quoted(NOT_WORD)}, ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"trim({out})"


def oracle() -> str:
    values = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)
    return f"""
    WITH k AS (SELECT sha256({_canonical_sql('t')}) AS digest, min(i) AS license_id FROM (VALUES {values}) v(i, t) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    noted AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM lines JOIN k ON k.digest = sha256({_canonical_sql('line')}) GROUP BY doc_id)
    SELECT d.doc_id, sha256({_canonical_sql('d.text')}) AS digest, k.license_id, coalesce(n.notices, '') AS notices
    FROM documents d LEFT JOIN k ON k.digest = sha256({_canonical_sql('d.text')}) LEFT JOIN noted n ON n.doc_id = d.doc_id"""
