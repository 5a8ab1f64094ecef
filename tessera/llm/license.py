"""Licence scans by canonical digest lookup, in DataFrame functions only.

canonical() lower-cases a text, drops copyright lines (with a year or a sign: a line of the licence itself may begin with the
word), turns every run of punctuation and spaces into one space and evens out equivalent spellings, across line ends too. The digest of a whole canonical text is hash-joined to the digests of known licences; the lines of a text
are looked up in the same way among known one-line notices. Known texts are a parameter; a table of them is broadcast only
under KNOWN_LIMIT rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import narrow

KNOWN_LIMIT = 100_000
#: Spellings that count as equal, each replaced by the second.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("authorise", "authorize"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("https", "http"),
)
#: The word before a sign, a year or a place for one; a sign; the letter before a year.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright(ed)?( by)?[^\p{L}\p{N}\n(©]*(\(c\)|©|[0-9]{4}|[\[<{](yyyy|year))|©|\(c\)[^\p{L}\p{N}\n]*[0-9]{4})[^\n]*$"
NOT_WORDS = r"[^\p{L}\p{N}\n]+"
AROUND_LINE = r" ?\n ?"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    "\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    'under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MORE = ("", *(f"\n\nFor more information, please refer to <{x}>" for x in ("https://unlicense.org", "https://unlicense.org/", "http://unlicense.org/", "http://www.unlicense.org/")))
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_BSL = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining "
    "a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
    "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
    "so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this "
    "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
    "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
    'processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE "
    "SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and{}distribute this software for any purpose with or without fee is hereby granted"
_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies."


def _titled(name: str, titles: tuple[str, ...], *bodies: str) -> list[tuple[str, str]]:
    """Each body under each title and under none."""
    return [(name, f"{title}\n\n{body}") for body in bodies for title in (*titles, "")]


def _bsd(name: str, titles: tuple[str, ...], clauses: tuple[str, ...]) -> list[tuple[str, str]]:
    """Clauses with and without numbers, and with and without the line that follows the copyright line."""
    bodies = []
    for marks in (("1. ", "2. ", "3. "), ("* ",) * 3):
        body = "\n\n".join([_BSD[0], *(m + c for m, c in zip(marks, clauses, strict=False)), _BSD[-1]])
        bodies += [body, "All rights reserved.\n\n" + body]
    return _titled(name, titles, *bodies)


def _files() -> list[tuple[str, str]]:
    """The long texts, and those with an appendix on how to apply them without it too."""
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text("utf-8")
        out.append((path.stem, text))
        terms, end, appendix = text.partition("END OF TERMS AND CONDITIONS")
        if appendix.strip():
            out.append((path.stem, terms + end))
    return out


#: Public licence texts, without their copyright lines; a licence has an entry for each title and form it is found under.
LICENSES = (
    *_titled(
        "MIT",
        ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "MIT License", "MIT"),
        _MIT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    *_titled("MIT-0", ("MIT No Attribution",), _MIT + ".\n\n" + _WARRANTY),
    *_titled("ISC", ("The ISC License", "ISC License", "ISC License (ISC)"), *(_ISC.format(x) + _KEPT + "\n\n" + _ISC_WARRANTY for x in ("/or ", " "))),
    *_titled("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"), _ISC.format("/or ") + ".\n\n" + _ISC_WARRANTY),
    *_bsd("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), _BSD[1:3]),
    *_bsd("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"), _BSD[1:4]),
    *_titled("Unlicense", ("The Unlicense", "Unlicense"), *(_UNLICENSE + x for x in _MORE)),
    *_titled("Zlib", ("zlib License", "The zlib License", "The zlib/libpng License"), _ZLIB),
    *_titled("BSL-1.0", ("Boost Software License 1.0",), _BSL),
    *_files(),
)
_NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "MIT": ("MIT License", "MIT Licence"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0",),
    **{f"CC-{x}-{v}": (f"CC {x} {v}",) for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")},
}
#: One-line notices: the SPDX line of each licence, and its names after the usual openings.
NOTICES = tuple(
    (name, line)
    for name, names in _NAMES.items()
    for line in (
        *(f"SPDX-License-Identifier: {name}{x}" for x in (("", "-only", "-or-later") if "GPL" in name else ("",))),
        *(f"{x} {the}{y}." for x in ("Licensed under", "Released under", "This work is licensed under") for y in names for the in ("the ", "")),
    )
)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, joined by line ends; a null text is an empty one."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(F.regexp_replace(out, NOT_WORDS, " "), AROUND_LINE, "\n")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def whole(lines: Column) -> Column:
    """canonical_lines() as one line."""
    out = F.regexp_replace(lines, r"\n+", " ")
    for a, b in SPELLINGS:
        if " " in a:  # it may have been parted by a line end
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def canonical(text: Column) -> Column:
    return whole(canonical_lines(text))


def known_table(spark, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    """(license_id, digest) of known texts; of texts that are equal canonically the first id counts."""
    rows = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(texts)], "i long, license_id string, text string")
    rows = rows.select("i", "license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min_by("license_id", "i").alias("license_id")).select("license_id", "digest")


def scan(docs: DataFrame, known: DataFrame | None = None, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, canonical_sha256, license_id, n_notices, notices), a row for each input row.

    license_id: of the known licence whose canonical text is the document's whole one; null without one. n_notices: lines that
    are a known notice; notices: their ids, sorted and distinct, comma-joined. Null, empty and blank texts are an empty text.
    Null doc_ids and repeated rows stay. Extra columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    known = known_table(spark, LICENSES) if known is None else known.select("license_id", "digest").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.limit(KNOWN_LIMIT + 1).count() <= KNOWN_LIMIT:
        known = F.broadcast(known)
    names = {r.digest: r.license_id for r in known_table(spark, notices).collect()} or {"": ""}
    lookup = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    rows = narrow(docs, doc_id="long", text="string").select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select(
        "doc_id",
        F.sha2(whole(F.col("lines")), 256).alias("digest"),
        F.filter(F.transform(F.split("lines", "\n"), lambda x: F.element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull()).alias("found"),
    )
    out = rows.join(known, "digest", "left")
    return out.select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """canonical_lines() as DuckDB SQL."""
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace({out}, {sql_string(COPYRIGHT_LINE)}, '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {sql_string(NOT_WORDS.replace(chr(92) + 'n', chr(10)))}, ' ', 'g'), {sql_string(' ?' + chr(10) + ' ?')}, chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {sql_string(a)}, {sql_string(b)})"
    return f"trim({out}, ' ')"


def whole_sql(lines: str) -> str:
    out = f"regexp_replace({lines}, chr(10) || '+', ' ', 'g')"
    for a, b in SPELLINGS:
        if " " in a:
            out = f"replace({out}, {sql_string(a)}, {sql_string(b)})"
    return f"trim({out}, ' ')"


def oracle_sql() -> str:
    def table(name: str, texts: tuple[tuple[str, str], ...]) -> str:
        values = ", ".join(f"({i}, {sql_string(a)}, {sql_string(t)})" for i, (a, t) in enumerate(texts))
        return f"{name} AS (SELECT sha256({whole_sql(canonical_sql('t'))}) AS digest, min_by(id, i) AS id FROM (VALUES {values}) v(i, id, t) GROUP BY 1)"

    return f"""
WITH {table("known", LICENSES)},
{table("notice", NOTICES)},
d AS (SELECT row_number() OVER () AS r, doc_id, {canonical_sql("text")} AS lines FROM documents),
l AS (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM d),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM l JOIN notice ON notice.digest = sha256(line) GROUP BY r)
SELECT d.doc_id, sha256({whole_sql("d.lines")}) AS canonical_sha256, known.id AS license_id, coalesce(n.n, 0)::BIGINT AS n_notices, coalesce(n.ids, '') AS notices
FROM d LEFT JOIN known ON known.digest = sha256({whole_sql("d.lines")}) LEFT JOIN n USING (r)
"""
