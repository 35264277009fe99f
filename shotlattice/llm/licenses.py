"""Licence scans by canonical digest: a text is brought to a canonical form and its digest looked up among those of known licences."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Equivalent spellings as the public matching guidelines for licence texts list them, applied in this order to lower-case text; of two forms the one stands that isn't part of the other. Fixed values.
SPELLINGS = (
    ("https://", "http://"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfill", "fulfil"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non-commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("willful", "wilful"),
    ("copyright owner", "copyright holder"),
    ("&", " and "),
)
#: Words that follow "copyright" in running text and in wrapped lines of licences; a line that goes on with one of them says nothing about a holder.
RUNNING = "act acts also and are as can cases claim claims disclaimer doctrines exceptions for has have if in including infringement infringements interest interests is issue issues law laws license licenses like line lines management material may more must notice notices of office on or owner owners ownership patent permission permissions protection protections resulting right rights shall should statement statements status term that the then those to treaties treaty under violation violations was were which will with work works holder holders".split()


def _other(words_: list[str], first: bool = True) -> str:
    """Pattern of the start of a word that is none of ``words_``, without looking ahead, which not every engine can."""
    heads = sorted({w[0] for w in words_ if w})
    free = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in heads)
    if first:
        here = [rf"[{free}]", r"[^\x00-\x7f]"]
    else:  # where one of the words ends, only more letters make another word of it
        here = [rf"[{free}]"] if "" in words_ else [rf"[^{''.join(heads)}]", "$"]
    return "(" + "|".join([*here, *[h + _other([w[1:] for w in words_ if w[:1] == h], False) for h in heads]]) + ")"


#: A line that says whose copyright it is, behind whatever marks a comment; dropped. Neither year nor sign is needed where a holder follows.
COPYRIGHT = (
    r"^[^\p{L}\p{N}]*((portions\s+)?(spdx-filecopyrighttext:|copyright\s*:?\s*(\(c\)|©|\d{4}|[<\[{]|by\s|the\s.{0,80}(authors|committee|community|company|contributors|developers|foundation|group|maintainers|organization|owners|project|regents|team|university))|copyright\s+"
    + _other(RUNNING)
    + r".{0,80}$)|\(c\)\s*\d{4}|©|all rights reserved)"
)
PUNCTUATION = r"[^\p{L}\p{N}]+"

#: Known licences and notices. Fixed values.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)

#: Whole texts: licence and file, count of title lines at its top, other titles, what its appendix starts with.
WHOLE = (
    ("Apache-2.0", 3, ("Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004"), "END OF TERMS|APPENDIX"),
    ("BSD-2-Clause", 1, ("The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"), None),
    ("BSD-3-Clause", 1, ("The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"), None),
    ("CC-BY-SA-4.0", 1, ("Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0"), None),
    ("CC0-1.0", 2, ("CC0 1.0 Universal",), None),
    ("GPL-2.0", 2, (), "END OF TERMS|How to Apply These Terms"),
    ("GPL-3.0", 2, (), "END OF TERMS|How to Apply These Terms"),
    ("LGPL-2.1", 2, (), "END OF TERMS|How to Apply These Terms"),
    ("LGPL-3.0", 2, (), None),
    ("MPL-2.0", 2, ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"), "Exhibit A|Exhibit B"),
    ("Unlicense", 0, ("The Unlicense", "Unlicense"), "For more information"),
)
#: Titles of the bodies above.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License", "0BSD License")}


def _whole() -> tuple:
    """(license, text) of every whole text with each of its titles and without, with its appendix and without, with numbered items and, in short texts, without."""
    found = []
    bodies = {name: next(t for n, t in KNOWN if n == name) for name in TITLES}
    bodies = [(n, t, TITLES[n], None) for n, t in bodies.items()]
    for name, lines, titles, end in WHOLE:
        text = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8")
        rows = [x for x in text.split("\n") if x.strip()]
        bodies.append((name, "\n".join(rows[lines:]), (*["\n".join(rows[:lines])] * bool(lines), *titles), end))
    for name, body, titles, end in bodies:
        cuts = [m.start() for m in re.finditer(rf"(?m)^\W*({end})", body)] if end else []
        parts = [body, *[body[:c] for c in cuts]]
        if len(body) < 3000:
            parts += [re.sub(r"(?m)^\s*\d\.\s", "", x) for x in parts if re.search(r"(?m)^\s*\d\.\s", x)]
        found += [(name, f"{t}\n{x}") for x in parts for t in ("", *titles)]
    return tuple(dict.fromkeys(found))


KNOWN += _whole()


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without copyright and blank lines."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for a, b in SPELLINGS:
        low = F.replace(low, F.lit(a), F.lit(b))
    own = F.filter(F.split(low, "\n"), lambda x: ~F.rlike(x, F.lit(COPYRIGHT)))
    return F.array_remove(F.transform(own, lambda x: F.trim(F.regexp_replace(x, F.lit(PUNCTUATION), F.lit(" ")))), "")


def known(spark: SparkSession, licenses=KNOWN) -> DataFrame:
    """(digest, license): canonical digests of the given (license, text) pairs, a fixed list."""
    rows = spark.createDataFrame([(a, b) for a, b in licenses], "license string, text string")
    text = F.array_join(canonical_lines(F.col("text")), " ")
    return rows.select(F.sha2(text, 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses=KNOWN) -> DataFrame:
    """One row per document: doc_id, digest, license (of the entire text, else null), n_license_lines, line_licenses (names of its licence lines, sorted, by comma).

    A null text is empty; an empty text has the digest of the empty string and no licence; texts of any length are brought to canonical form whole. Of licences with equal digests the first by name is
    given. Repeated rows are scanned each for itself. An empty table gives an empty result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    table = known(spark, licenses)
    listed = [(r.digest, r.license) for r in table.collect()]  # the fixed list
    names = F.create_map(*[F.lit(x) for pair in listed for x in pair]) if listed else F.expr("cast(map() as map<string,string>)")
    lines = F.filter(F.transform(F.col("lines"), lambda x: names[F.sha2(x, 256)]), lambda x: x.isNotNull())
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), lines.alias("found"))
    return rows.join(F.broadcast(table), "digest", "left").select("doc_id", "digest", "license", F.size("found").cast("long").alias("n_license_lines"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("line_licenses"))


def sql(licenses=KNOWN) -> str:
    """The same scan in DuckDB's SQL, over ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for a, b in SPELLINGS:
        low = f"replace({low}, {quoted(a)}, {quoted(b)})"
    lines = f"list_filter(list_transform(list_filter(string_split({low}, chr(10)), lambda x: NOT regexp_matches(x, {quoted(COPYRIGHT)})), lambda x: trim(regexp_replace(x, {quoted(PUNCTUATION)}, ' ', 'g'))), lambda x: x <> '')"
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in licenses)
    return f"""
WITH given(license, text) AS (VALUES {values}),
known AS (SELECT sha256(array_to_string({lines}, ' ')) AS digest, min(license) AS license FROM given GROUP BY 1),
named AS (SELECT map_from_entries(list((digest, license))) AS m FROM known),
canonical AS (SELECT doc_id, {lines} AS lines FROM documents),
found AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest, list_filter(list_transform(lines, lambda x: m[sha256(x)]), lambda x: x IS NOT NULL) AS found FROM canonical, named)
SELECT f.doc_id, f.digest, k.license, len(f.found)::BIGINT AS n_license_lines, array_to_string(list_sort(list_distinct(f.found)), ',') AS line_licenses
FROM found f LEFT JOIN known k ON f.digest = k.digest
"""
