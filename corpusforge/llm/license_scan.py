"""Licence scan by canonical digest lookup.

A text is brought to a canonical form, and the SHA-256 of the form is joined
with the digests of known licences. The form has lower case, equivalent
spellings, no copyright notices, no title line, no item numbers, no punctuation
and single blanks; names that licences leave to be filled in count as the same.
The whole document is one unit, and each of its lines is another, so that a
notice line inside a longer document is found too.

A line is a copyright notice if a year, a sign or a blank to fill in follows the
word: a line of a licence's body may begin with that word as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, sized_broadcast, small_batches, table, text_of

#: Licence texts and notices, as published.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
#: One-line notices and what they name.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-only",
    "Released under the BSD 3-Clause License.": "BSD-3-Clause",
    "Released into the public domain.": "Unlicense",
}
#: Spellings that count as the same, applied in this order to
#: lower-cased text, at ASCII word boundaries.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("whilst", "while"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("per cent", "percent"), ("https", "http"), ("merchantibility", "merchantability"), ("creative commons attribution", "cc by"), ("gnu gpl", "gnu general public license"),
]
#: Names that a licence leaves to be filled in, as patterns over the
#: canonical form and what stands for them.
_NAMES = r"(?:[\p{L}\p{N}]+ ){1,20}?"
BLANKS = [
    ("non infringement", "noninfringement"),  # broken at the hyphen by a line end
    (rf"neither the names? of {_NAMES}nor the names of (?:its|their|the) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (rf"(software is provided by) {_NAMES}(as is)", "{1} the copyright holders {2}"),
    (rf"(in no event (?:shall|will)) {_NAMES}(be (?:held )?liable)", "{1} the copyright holders {2}"),
]
#: Digests of the canonical forms of licences that are too long to stand here, as
#: published; ``digest_rows`` of their texts gives them. None of them has a notice.
DIGESTS = {
    "Apache-2.0": ["4860a840b41e26ebd87d875791b0cd8b1cf1c1097732f416b788cb6d08f7d499", "e5b2a6debcaeb97dcc7b6617f22f367a3d5073501b13376f5790e04a632921e7", "93a5cefc88fd762f3afc85bd0f0669440d53fa6f9f164fb638e6805e5c5b73ca"],
    "Artistic-1.0-Perl": ["a2999bc0ec2b13b836cf8288a267332d6be33708f9302aa6ba730fdd0bd9a305"],
    "CC0-1.0": ["adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a"],
    "GFDL-1.2": ["d2829493edbfdd75120d8d74e66849b31cf29a6f56e0e8f5ca9ea3e48d5a5340"],
    "GFDL-1.3": ["02b8b651116d8cd9bb90dcf86e5da73a6f5b77f83c209afc469997f84f75bfa4"],
    "GPL-1.0-only": ["72aae297a7d05b2e902a3feeee1de2e387096103a56afeb8749dfcc7f498fba4"],
    "GPL-2.0-only": ["709bca6949795d428b249a07e851ffe4ae4bb854da2cc80581bf9eec7044efb6"],
    "GPL-3.0-only": ["f10bbc444871e6c086a7219f72e4d7112e8f5969e87e9355b7df3788a360b555"],
    "LGPL-2.0-only": ["47298ffd998ad88dba95ca6842817b26efe765a81e632b76d41abe1dbcd181ef"],
    "LGPL-2.1-only": ["7e325d538c8ff1aec0d5999e7305e8f12effb6de983ec3f28456463171bed1d4"],
    "LGPL-3.0-only": ["e38620db98ec1ef92f6302fea98dc93c98d2161866c62ff98ab16d3554fd471a"],
    "MPL-1.1": ["b08398b2b05860a224f8c97d08c77d0fb92e24e0dcfbf505af1f91eb9be10b5b"],
    "MPL-2.0": ["010cf146cb5bded05e14379ab2b000d72ed04d4dff61761a29906e7e4bbd6d73"],
    "Python-2.0": ["546e62af9463990de034eae357e7f325b78d54f696c4f1a53db2a6eeba62c19e"],
}
_NOTICE = r"(?m)^[^\p{L}\p{N}\n]*(?:(?:portions|parts|modifications) )?(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|[<\[{]|by\b|yyyy)|\(c\)[ \t]*(?:copyright|[0-9]{4})|©)[^\n]*$"
_ITEM = r"(?m)^[^\p{L}\p{N}\n]*[0-9]{1,2}[.)][ \t]+"
_TITLE = r"^(?:the )?(?:[\p{L}\p{N}]+ ){0,8}license(?: [\p{L}\p{N}]+){0,6}$"
_FIRST = r"^[ \n]*([^\n]*)\n"
#: What every notice line among NOTICES holds in its canonical form.
_SIGNAL = ("licens", "public domain")


def _holds(c: Column, *words: str) -> Column:
    """True if one of the words stands in the text; cheaper than a pattern of them."""
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


def canonical(df: DataFrame) -> DataFrame:
    """``df`` with ``form``, the canonical form of its column ``text``, and
    ``lines``, where lines are still apart; ``text`` goes.

    Each step is a column of its own, so that none is worked out twice.
    """
    out = df.withColumn("text", F.regexp_replace(F.lower("text"), r"\r\n?", "\n"))
    spelled = F.col("text")
    for old, new in SPELLINGS:
        spelled = F.regexp_replace(spelled, rf"(?<![a-z0-9]){old}(?![a-z0-9])", new)
    # Most texts hold none of the spellings; one look spares them the chain.
    out = out.withColumn("text", F.when(_holds(F.col("text"), *[old for old, _ in SPELLINGS]), spelled).otherwise(F.col("text")))
    noticed = F.when(_holds(F.col("text"), "copyright", "(c)", "©"), F.regexp_replace("text", _NOTICE, " ")).otherwise(F.col("text"))
    plain = F.replace(F.regexp_replace(noticed, _ITEM, " "), F.lit("all rights reserved"), F.lit(" "))
    out = out.withColumn("lines", F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")).drop("text")
    out = out.withColumn("title", F.trim(F.regexp_extract("lines", _FIRST, 1)))
    body = F.when(F.col("title").rlike(_TITLE) & ~F.col("title").rlike(r"\bunder\b"), F.regexp_replace("lines", _FIRST, ""))
    out = out.withColumn("body", body).withColumn("body", F.when(F.col("body").rlike(r"[\p{L}\p{N}]"), F.col("body")).otherwise(F.col("lines"))).drop("title")
    out = out.withColumn("body", F.trim(F.regexp_replace("body", r"[ \n]+", " ")))
    named = F.col("body")
    for old, new in BLANKS:
        named = F.regexp_replace(named, old, new.replace("{1}", "$1").replace("{2}", "$2"))
    return out.withColumn("form", F.when(_holds(F.col("body"), "neither the name", "software is provided by", "in no event", "non infringement"), named).otherwise(F.col("body"))).drop("body")


def fixed_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text, line of the fixed texts and notices; a few dozen rows."""
    rows = [(k, v, False) for k, v in LICENSES.items()] + [(v, k, True) for k, v in NOTICES.items()]
    return spark.createDataFrame(rows, "license_id string, text string, line boolean")


def digest_rows(known: DataFrame) -> DataFrame:
    """digest, license_id, line of known texts, and if the form holds a signal word."""
    forms = canonical(known.select("license_id", F.coalesce("line", F.lit(False)).alias("line"), text_of("text").alias("text")))
    forms = forms.withColumn("form", F.when(F.col("line"), F.trim(F.regexp_replace("lines", r"[ \n]+", " "))).otherwise(F.col("form")))
    return forms.select(F.sha2("form", 256).alias("digest"), "license_id", "line", _holds(F.col("form"), *_SIGNAL).alias("signal"))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, canonical_sha256, license_id, notices.

    ``license_id`` names the licence that the whole text is, or is null.
    ``notices`` holds the sorted distinct licences that a single line names.
    ``known`` is the table of what is looked up: license_id, text and line, which
    tells that the text is a notice of one line; by default the fixed licences.
    A licence may have any number of texts. Of two licences with one canonical
    text the least id is named. Both lookups are joins of digests.

    Null text: the empty text, no licence. A text whose lines are all copyright
    notices counts as empty. Ties and repeated rows: each row by itself. Empty
    table: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    found = digest_rows(fixed_licenses(spark) if known is None else known)
    if known is None:
        more = [(d, k, False, True) for k, digests in DIGESTS.items() for d in digests]
        found = found.union(spark.createDataFrame(more, "digest string, license_id string, line boolean, signal boolean"))
    found = checkpoint(found.groupBy("digest", "line").agg(F.min("license_id").alias("license_id"), F.min("signal").alias("signal")))
    found = found.where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))  # texts without words name nothing
    texts = sized_broadcast(found.where("NOT line").select("digest", "license_id"))
    notices = found.where("line")

    rows = canonical(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")))
    alone = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    if notices.where("NOT signal").isEmpty():
        # Every notice holds one of these words, so other lines are none.
        alone = F.when(_holds(F.col("lines"), *_SIGNAL), F.filter(alone, lambda x: _holds(x, *_SIGNAL))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", F.sha2("form", 256).alias("digest"), F.transform(alone, lambda x: F.sha2(x, 256)).alias("said"))
    rows = rows.join(texts, "digest", "left")
    # Narrow rows, frozen so that each has a number; only those with lines to look up are grouped.
    rows = checkpoint(rows.select("id", "digest", "license_id", F.array_distinct("said").alias("said"), F.monotonically_increasing_id().alias("at")))
    none = F.array().cast("array<string>")
    quiet = rows.where("size(said) = 0").select("id", "digest", "license_id", none.alias("notices"))
    asked = rows.where("size(said) > 0")
    named = asked.select("at", F.explode("said").alias("line_digest")).join(sized_broadcast(notices.select(F.col("digest").alias("line_digest"), F.col("license_id").alias("notice"))), "line_digest")
    named = named.groupBy("at").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    loud = asked.join(named, "at", "left").select("id", "digest", "license_id", F.coalesce("notices", none).alias("notices"))
    return quiet.unionByName(loud).select(F.col("id").alias(id_col), F.col("digest").alias("canonical_sha256"), "license_id", "notices")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "canonical_sha256", F.coalesce("license_id", F.lit("")).alias("license_id"), F.array_join("notices", ",").alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    out = f"regexp_replace(lower({text}), '\\r\\n?', chr(10), 'g')"
    for old, new in SPELLINGS:
        # No lookaround here: double the separators so that neighbours match too.
        out = f"regexp_replace({out}, '(^|[^a-z0-9]){old}(?:$|([^a-z0-9]))', '\\1{new}\\2', 'g')"
    for pattern in (_NOTICE, _ITEM, "all rights reserved", r"[^\p{L}\p{N}\n]+"):
        out = f"regexp_replace({out}, {_quoted(pattern)}, ' ', 'g')"
    return out


def _sql_form(lines: str) -> str:
    first, rest = f"trim(regexp_extract({lines}, {_quoted(_FIRST)}, 1))", f"regexp_replace({lines}, {_quoted(_FIRST)}, '')"
    titled = f"regexp_matches({first}, {_quoted(_TITLE)}) AND NOT regexp_matches({first}, '\\bunder\\b') AND regexp_matches({rest}, '[\\p{{L}}\\p{{N}}]')"
    out = f"trim(regexp_replace(CASE WHEN {titled} THEN {rest} ELSE {lines} END, '[ \\n]+', ' ', 'g'))"
    for old, new in BLANKS:
        sign = new.replace("{1}", "\\1").replace("{2}", "\\2")
        out = f"regexp_replace({out}, {_quoted(old)}, '{sign}', 'g')"
    return out


def _sql_known() -> str:
    rows = [f"({_quoted(k)}, {_quoted(v)}, false)" for k, v in LICENSES.items()] + [f"({_quoted(v)}, {_quoted(k)}, true)" for k, v in NOTICES.items()]
    return ", ".join(rows)


def _sql_digests() -> str:
    return ", ".join(f"('{d}', '{k}')" for k, digests in DIGESTS.items() for d in digests)


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES = {
    "op9_license_scan": f"""
        WITH given AS (SELECT license_id, line, {_sql_lines("text")} AS lines FROM (VALUES {_sql_known()}) v(license_id, text, line)),
        texts AS (
            SELECT digest, min(license_id) AS license_id FROM (
                SELECT sha256({_sql_form("lines")}) AS digest, license_id FROM given WHERE NOT line
                UNION ALL SELECT * FROM (VALUES {_sql_digests()}) d(digest, license_id)) GROUP BY 1),
        notices AS (
            SELECT sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))) AS digest, min(license_id) AS license_id FROM given WHERE line GROUP BY 1),
        docs AS (SELECT doc_id, {_sql_lines("coalesce(text, '')")} AS lines FROM documents),
        named AS (
            SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
            FROM (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM docs) l JOIN notices USING (digest) GROUP BY 1)
        SELECT d.doc_id, d.digest AS canonical_sha256, coalesce(k.license_id, '') AS license_id, coalesce(n.notices, '') AS notices
        FROM (SELECT doc_id, sha256({_sql_form("lines")}) AS digest FROM docs) d LEFT JOIN texts k USING (digest) LEFT JOIN named n ON n.doc_id = d.doc_id""",
}
