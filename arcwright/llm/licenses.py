"""License scans by canonical digests, in SQL functions alone.

A text's canonical form: A-Z lower-cased, copyright lines and "all rights reserved" lines taken out, every run of
other characters than letters, digits and non-ASCII ones made one space, equivalent spellings replaced; non-ASCII
punctuation and spaces count as other characters.  An entire text has a second form, without copyright lines that have
neither sign nor year ("Copyright The X Authors").  The SHA-256 digest of a form of an entire text, or of the form of an
entire line, is looked up among the digests of known licenses by a hash join; the known table is a stated, small one
(each license with its published titles and without, with its appendix and without), and is broadcast only if its size
is under a bound.

``oracle_sql`` looks up the same digests: those of all stated texts, which Python computes by the same rules, and both
forms of documents and lines in DuckDB's functions.

Defined cases: a null or empty text has no license and no notices; a canonical form that is empty matches nothing; rows
of the same doc_id (or of none) give one row, in which the notices of all of them count; of several known licenses
with an equal canonical form the least id counts; a very long text is one text like any other; an empty table gives no
rows, and an empty known table no licenses; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: Permissive license texts by their SPDX ids.
TEXTS: list[tuple[str, str]] = [
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]

#: One-line notices.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]

#: Spellings that count as the same, as (from, to) in canonical text.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
    ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
]

#: Titles over the short texts, as published.
TITLES: dict[str, list[str]] = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD License (0BSD)", "BSD-0-Clause", "0BSD"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)", "The ISC License (ISC)", "ISC"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "The MIT License (Expat)", "MIT License (Expat)", "Expat License", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "The New BSD License", "Modified BSD License", "BSD License", "The BSD License", "BSD-3-Clause"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "Zlib"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

#: The texts of ``license_texts``, with the words at which they may begin, and those at which they may end
#: (the latter cut before or after).
PUBLISHED: list[tuple[str, list[str], list[str], list[str]]] = [
    ("Apache-2.0", ["Version 2.0, January 2004", "TERMS AND CONDITIONS FOR USE", "1. Definitions."], ["END OF TERMS AND CONDITIONS"], ["END OF TERMS AND CONDITIONS", "APPENDIX: How to apply"]),
    ("Artistic-1.0-Perl", ["Preamble"], [], []),
    ("BSD-3-Clause", [], [], []),
    ("BSL-1.0", ["Permission is hereby granted"], [], []),
    ("CC0-1.0", ["CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION IS NOT", "Statement of Purpose"], [], []),
    ("GFDL-1.2", ["Everyone is permitted", "0. PREAMBLE"], [], ["ADDENDUM: How to use"]),
    ("GFDL-1.3", ["Everyone is permitted", "0. PREAMBLE"], [], ["ADDENDUM: How to use"]),
    ("GPL-1.0", ["Everyone is permitted", "Preamble"], ["END OF TERMS AND CONDITIONS"], ["END OF TERMS AND CONDITIONS"]),
    ("GPL-2.0", ["Everyone is permitted", "Preamble"], ["END OF TERMS AND CONDITIONS"], ["END OF TERMS AND CONDITIONS"]),
    ("GPL-3.0", ["Everyone is permitted", "Preamble"], ["END OF TERMS AND CONDITIONS"], ["END OF TERMS AND CONDITIONS"]),
    ("LGPL-2.0", ["Everyone is permitted", "Preamble"], ["END OF TERMS AND CONDITIONS"], ["END OF TERMS AND CONDITIONS"]),
    ("LGPL-2.1", ["Everyone is permitted", "Preamble"], ["END OF TERMS AND CONDITIONS"], ["END OF TERMS AND CONDITIONS"]),
    ("LGPL-3.0", ["Everyone is permitted", "This version of the GNU Lesser"], [], []),
    ("MPL-1.1", ["1. Definitions"], [], ["EXHIBIT A"]),
    ("MPL-2.0", ["1. Definitions"], [], ["Exhibit A - Source Code"]),
    ("Unlicense", [], [], ["For more information, please refer"]),
    ("Zlib", [], [], []),
]

#: Wordings of the short texts that are published as well, as (id, from, to).
WORDINGS: list[tuple[str, str, str]] = [
    ("ISC", "use, copy, modify, and/or distribute", "use, copy, modify, and distribute"),
    ("MIT", "and this permission notice shall", "and this permission notice (including the next paragraph) shall"),
    ("BSD-2-Clause", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions"),
    ("GPL-3.0", "licenses/why-not-lgpl.html", "philosophy/why-not-lgpl.html"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its", "Neither the name of the University nor the names of its"),
]

COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$"
RESERVED_LINE = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: As OTHER, with punctuation, spaces and the byte order mark beyond ASCII.
OTHER_WIDE = r"[\p{P}\p{Z}\x{FEFF}[^a-z0-9\x{80}-\x{10FFFF}]]+"
#: Words after "copyright" in the licenses' own sentences: a line that begins so isn't a copyright line.
_SENTENCE = "also|and|are|disclaimers?|doctrines?|holders?|if|interests?|laws?|licenses?|like|lines?|notices?|of|on|or|owners?|ownership|patents?|permissions?|protection|resulting|rights?|statements?|the library|the software|those|treaty"
UNDATED_LINE = rf"(?m)^[^a-z0-9\n]*copyright[^a-z0-9\n\x{{80}}-\x{{10FFFF}}]++(?!(?:{_SENTENCE})\b)[^\n]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The digest of an empty form, which matches nothing.
EMPTY = hashlib.sha256(b"").hexdigest()
#: A known table over this size is joined by shuffling digests instead.
BROADCAST_BYTES = 16 << 20


def canonical(text: Column, undated: bool = False) -> Column:
    """The canonical form of a text; null stays null.  undated: without copyright lines that have neither sign nor year."""
    out = F.translate(text, _UPPER, _LOWER)
    for pattern in (COPYRIGHT_LINE, RESERVED_LINE, *[UNDATED_LINE] * undated):
        out = F.regexp_replace(out, pattern, "")
    out = F.trim(F.regexp_replace(out, OTHER_WIDE, " "))
    for a, b in [*SPELLINGS, ("https ", "http ")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _undated(text: Column) -> Column:
    """The second form of an entire text; null where no line says copyright."""
    return F.when(F.contains(F.translate(text, _UPPER, _LOWER), F.lit("copyright")), canonical(text, True))


def _forms(text: str, begins: list[str], after: list[str], before: list[str]) -> list[str]:
    """The text from each of the words (or all of it) to each of the words (or its end)."""
    starts = [0, *(text.index(x) for x in begins)]
    stops = [len(text), *(text.index(x) + len(x) for x in after), *(text.index(x) for x in before)]
    return [text[a:z] for a in starts for z in stops]


def stated_licenses() -> list[tuple[str, str]]:
    """Ids and texts of all forms of the licenses and notices that are stated here and in ``license_texts``."""
    folder = resources.files(__package__) / "license_texts"
    known = [*TEXTS, *((i, x) for i, *cuts in PUBLISHED for x in _forms((folder / f"{i}.txt").read_text("utf-8"), *cuts))]
    known += [(i, re.sub(r"\s+".join(map(re.escape, a.split())), lambda _: b, text)) for of, a, b in WORDINGS for i, text in known if i == of]
    known += [(i, re.sub(r"(?m)^[123]\. ", "", text)) for i, text in known if i == "BSD-3-Clause"]
    known += [(i, f"{title}\n{text}") for i, text in known for title in TITLES.get(i, [])]
    return [*known, *NOTICES]


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text of the licenses and notices stated here."""
    return spark.createDataFrame(stated_licenses(), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, license_id (of the entire text, or null), n_notices (lines that are a notice), licenses (ids, sorted, comma-joined)."""
    known = known_licenses(docs.sparkSession) if known is None else known
    stated = F.col("text").cast("string")
    form = known.select(F.col("license_id").cast("string").alias("license_id"), F.explode(F.array(canonical(stated), _undated(stated))).alias("form"))
    digests = form.where("form <> '' and license_id is not null").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    size = known.agg(F.sum(F.octet_length(stated) + 200)).first()[0] or 0
    digests = F.broadcast(digests) if size <= BROADCAST_BYTES else digests.hint("shuffle_hash")

    units = F.concat(F.array("text"), F.split("text", "\n", -1))
    forms = F.concat(F.array(F.sha2(_undated(F.col("text")), 256)), F.transform(units, lambda x: F.sha2(canonical(x), 256)))
    forms = F.transform(forms, lambda d: F.when(d != EMPTY, d))  # of digests: a form isn't made twice
    each = text_of(docs).select("doc_id", F.posexplode_outer(forms).alias("at", "digest"))
    if size > BROADCAST_BYTES:  # what has no form matches nothing, and mustn't meet in one task
        each = each.withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64("doc_id", "at", F.rand()).cast("string"))))
    found = each.join(digests, "digest", "left").groupBy("doc_id", "license_id").agg(
        F.max((F.col("at") <= 1) & F.col("license_id").isNotNull()).alias("whole"),
        F.count(F.when((F.col("at") > 1) & F.col("license_id").isNotNull(), 1)).alias("n"),
    )
    return found.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.sum("n").alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"),
    )


#: OTHER_WIDE without a class within a class.
_OTHER_FLAT = r"[\p{P}\p{Z}\x{FEFF}\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _undated_conditions() -> tuple[str, str]:
    """UNDATED_LINE of one line, without looking ahead: what it must match, and what it mustn't."""
    begin = r"^[^a-z0-9\n]*copyright[^a-z0-9\n\x{80}-\x{10FFFF}]+"
    return begin + r"[a-z0-9\x{80}-\x{10FFFF}]", rf"{begin}(?:{_SENTENCE})\b"


def _plain_forms(text: str) -> set[str]:
    """Both canonical forms of a stated text, in Python."""
    import regex

    in_python = lambda p: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", p)
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    must, mustnt = map(in_python, _undated_conditions())
    forms = set()
    for undated in (False, True) if "copyright" in low else (False,):
        out = low
        for p in (COPYRIGHT_LINE, RESERVED_LINE):
            out = regex.sub(in_python(p), "", out)
        if undated:
            out = "\n".join(x for x in out.split("\n") if not regex.search(must, x) or regex.search(mustnt, x))
        out = regex.sub(in_python(_OTHER_FLAT), " ", out).strip(" ")
        for a, b in [*SPELLINGS, ("https ", "http ")]:
            out = out.replace(a, b)
        forms.add(out)
    return forms - {""}


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``scan`` over the table documents and the licenses stated here."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    must, mustnt = _undated_conditions()

    def form(x: str, undated: bool = False) -> str:
        out = low(x)
        for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
            out = f"regexp_replace({out}, {quoted(pattern)}, '', 'g')"
        if undated:
            out = f"array_to_string(list_filter(string_split({out}, chr(10)), lambda l: NOT regexp_matches(l, {quoted(must)}) OR regexp_matches(l, {quoted(mustnt)})), chr(10))"
        out = f"trim(regexp_replace({out}, {quoted(_OTHER_FLAT)}, ' ', 'g'))"
        for a, b in [*SPELLINGS, ("https ", "http ")]:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return out

    known: dict[str, str] = {}
    for i, text in stated_licenses():
        for f in _plain_forms(text):
            digest = hashlib.sha256(f.encode()).hexdigest()
            known[digest] = min(i, known.get(digest, i))
    rows = ", ".join(f"({quoted(d)}, {quoted(i)})" for d, i in sorted(known.items()))
    return f"""
WITH k AS (SELECT * FROM (VALUES {rows}) v(digest, license_id)),
u AS (SELECT doc_id, true AS entire, {form("text")} AS f FROM documents
UNION ALL SELECT doc_id, true, {form("text", True)} FROM documents WHERE contains({low("text")}, 'copyright')
UNION ALL SELECT doc_id, false, {form("x")} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
g AS (SELECT doc_id, entire, license_id FROM u JOIN k ON sha256(u.f) = k.digest WHERE f <> ''),
m AS (SELECT doc_id, min(license_id) FILTER (entire) AS license_id, count(*) FILTER (NOT entire) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses FROM g GROUP BY doc_id)
SELECT d.doc_id, m.license_id, coalesce(m.n, 0) AS n_notices, coalesce(m.licenses, '') AS licenses FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN m ON d.doc_id IS NOT DISTINCT FROM m.doc_id
"""
