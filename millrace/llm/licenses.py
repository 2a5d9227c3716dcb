"""License scans: canonical digests of entire texts against those of known licences.

A text is brought to a canonical form by SQL functions: lower case, no copyright notices (however
the text is wrapped; prose about copyright holders or notices stays), equivalent spellings made one, every run of punctuation and white space one space. The digest
of the whole canonical text is hash-joined to the digests of the known texts, brought to the
same form. A document is looked up as a whole and, since notices usually stand on a line of
their own, line by line, each line as an entire text.

The known texts are the only broadcast side: a list given by the caller, about a hundred bytes
per text once digested, and the join may choose another plan. Lines of a document are summed
before the shuffle, one row per document and task.

Defined cases: null and empty texts, and lines without letters or digits, match nothing; their
digest is that of the empty text. Rows of the same id count as one document (its licence is the
smallest name found); a null id is an id of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_FIRST = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:"""
_BSD_CLAUSES = (
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
    """Neither the name of the copyright {one} nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.""",
)
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {other} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_GPL_HEADER = """This {kind} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as
published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.
This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this {kind}. If not, see <https://www.gnu.org/licenses/>."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _bsd(clauses: int) -> list[str]:
    """A BSD text with numbered or bulleted clauses, holders or owners, with and without reserved rights."""
    texts = []
    for one in ("holder", "owner"):
        for other in ("HOLDER", "HOLDERS", "OWNER"):
            for numbered in (True, False):
                listed = [f"{k}. {c}" if numbered else f"* {c}" for k, c in enumerate(_BSD_CLAUSES[:clauses], 1)]
                text = "\n".join([_BSD_HEAD, *listed, _BSD_END]).format(one=one, other=other)
                texts += [text, "All rights reserved.\n" + text]
    return texts


def _gpl(name: str, version: str) -> list[str]:
    kinds = ("program", "library", "software", "file")
    return [_GPL_HEADER.format(kind=k, name=name, version=version, colon=":", comma=",") for k in kinds]


#: By licence: titles that may stand above the text, and its texts.
_FULL = {
    "BSD-2-Clause": (("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"), _bsd(2)),
    "BSD-3-Clause": (("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"), _bsd(3)),
    "Zlib": (("zlib License", "The zlib License", "The zlib/libpng License"), [_ZLIB]),
    "Unlicense": (
        ("The Unlicense", "Unlicense"),
        [_UNLICENSE + end for end in ("", *(f"\nFor more information, please refer to <http{x}://unlicense.org{y}>" for x in ("", "s") for y in ("", "/")))],
    ),
    "BSL-1.0": (("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"), [_BSL]),
    "Apache-2.0": ((), [_APACHE_HEADER]),
    "GPL-2.0": ((), _gpl("GNU General Public License", "2")),
    "GPL-3.0": ((), _gpl("GNU General Public License", "3")),
    "LGPL-2.1": ((), _gpl("GNU Lesser General Public License", "2.1")),
    "LGPL-3.0": ((), _gpl("GNU Lesser General Public License", "3")),
    "AGPL-3.0": ((), _gpl("GNU Affero General Public License", "3")),
    "MPL-2.0": ((), [_MPL_HEADER]),
}


def _gnu(short: str, name: str, version: str) -> tuple[str, ...]:
    return tuple(f"{name}{v}" for v in (f", version {version}", f" version {version}", f" v{version}")) + (
        f"{short}-{version}", f"{short} {version}", f"{short}v{version}", f"{short} v{version}",
    )


#: By licence: how notices name it.
_NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache 2.0 License"),
    "GPL-2.0": _gnu("GPL", "GNU General Public License", "2"),
    "GPL-3.0": _gnu("GPL", "GNU General Public License", "3"),
    "LGPL-2.1": _gnu("LGPL", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("LGPL", "GNU Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("AGPL", "GNU Affero General Public License", "3"),
    "BSD-2-Clause": ("2-Clause BSD License", "BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("3-Clause BSD License", "BSD 3-Clause License", "BSD-3-Clause", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "Zlib": ("zlib License", "zlib"),
    "Unlicense": ("Unlicense",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal"),
}
for _terms, _long in (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    _cc = f"Creative Commons {_long} 4.0"
    _NAMES[f"CC-{_terms}-4.0"] = (
        f"CC {_terms} 4.0", f"CC-{_terms}-4.0", _cc, f"{_cc} International", f"{_cc} License", f"{_cc} International License",
    )
#: Wordings of notices, to be followed by a name.
_WORDINGS = tuple(
    f"{what}{verb} under {article}"
    for what in ("", *(f"This {thing} is " for thing in ("work", "software", "project", "file", "code", "program")))
    for verb in ("licensed", "released", "distributed", "available")
    for article in ("", "the ", "a ", "the terms of the ")
)
#: SPDX identifiers that are not the licence's name here.
_SPDX = {name: tuple(f"{name}{end}" for end in ("", "-only", "-or-later", "+")) for name in _NAMES if "GPL" in name}

#: Known texts: licence name and entire text, a full licence, a standard header or a customary notice.
KNOWN = (
    *_FIRST,
    *((name, f"{title}\n{text}") for name, text, titles in (("MIT", _MIT, ("The MIT License", "Expat License")), ("ISC", _ISC, ("The ISC License",)))
      for title in titles),
    *((name, above + text) for name, (titles, texts) in _FULL.items() for text in texts
      for above in ("", *(f"{the}{title}\n" for title in titles for the in ("", "The ") if not title.startswith(the or "-")))),
    *((name, f"{wording}{called}") for name, names in _NAMES.items() for called in names for wording in _WORDINGS),
    *((name, f"SPDX-License-Identifier: {x}") for name in _NAMES for x in _SPDX.get(name, (name,))),
)

RESIDENT_TEXTS = 100_000

#: Spellings that mean the same; the second stands in the canonical form.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("and or", "and"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("copyright owners", "copyright holders"),
    ("http", "https"),
)

# A notice names a year, a (c), a holder ("by", "holder:", "the ... authors"); the word alone is prose.
_YEAR = r"[\[<{(]?(?:(?:19|20)[0-9]{2}|year|yyyy)\b"
SIGNS = ("copyright", "(c)", "©", "&copy;")  # one is in every notice
_SIGN = r"(?:\(c\)|©|&copy;)"
_HEAD = rf"\bcopyright[ \t:,]*(?:{_SIGN}|{_YEAR})|{_SIGN}[ \t]*(?:copyright\b[ \t:,]*)?{_YEAR}"
_HEAD_OF_LINE = (
    rf"{_HEAD}|{_SIGN}[ \t]*(?:copyright|by)\b|©|copyright[ \t]+(?:by\b|(?:holders?|owners?)[ \t]*:)"
    r"|copyright[ \t]+the[ \t][^\n]*\b(?:authors|contributors|developers|project|foundation)\b"
)
#: How licences and notices begin, lower case: a copyright notice on the same line ends before them.
OPENINGS = (
    "permission is hereby granted",
    "permission to use",
    "redistribution and use",
    "redistributions? of source code",
    "this is free and unencumbered",
    "boost software licen[sc]e",
    "(?:th(?:is|e) (?:software|work|program|project|file|library|code) (?:is|may|can)\\b)",
    "this source code form",
    "licen[sc]ed (?:under|to)",
    "released under",
    "distributed under",
    "available under",
    "spdx-licen[sc]e-identifier",
)
_OPENING = "\\b(?:" + "|".join(OPENINGS).replace(" ", "[ \\t]+") + ")"
# Every opening is marked first, before the blanks that lead to it, so that the patterns below pass
# a text once: each takes all up to the next mark or the line's end, possessively.
_MARK = "\x01"
_TO_OPENING = rf"(?<!\s)\s*+(?={_OPENING})"
#: Lines of a notice block that is followed by an opening.
NOTICE_LINES = 20
_PROSE = r"(?![ \t]*\n?[ \t]*(?:holders?|owners?|notices?|laws?|licen[sc]es?|statements?|interests?|and|or|in)\b(?!:))"
# A block begins a text, below up to three lines of title, or a paragraph: no prose that wraps does.
_BLOCK = (
    r"(\A(?:[^\n\x01]*\n){0,3}?|\n[^\S\n]*+\n)"
    rf"[^0-9a-z\n\x01]*(?:copyright\b{_PROSE}|{_SIGN}|©)[^\n\x01]*+"
    rf"(?:\n(?![^\S\n]*\n)[^\n\x01]*+){{0,{NOTICE_LINES}}}+(?=\x01)"
)
# At the head of a line a notice reaches to an opening or the line's end; within a line, to an
# opening: where none follows, the rest of the line is taken as group 1 and stays.
_LINE = rf"(?m)^[^0-9a-z\n]*(?:{_HEAD_OF_LINE})[^\n\x01]*+"
_WITHIN = rf"((?:{_HEAD})[^\n\x01]*+(?!\x01))|(?:{_HEAD})[^\n\x01]*+"
_BETWEEN = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}-\x{bf}\x{2010}-\x{2027}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    without = F.replace(plain, F.lit(_MARK), F.lit(" "))
    for pattern, instead in ((_TO_OPENING, _MARK), (_BLOCK, "$1"), (_LINE, ""), (_WITHIN, "$1")):
        without = F.regexp_replace(without, F.lit(pattern), F.lit(instead))
    noticed = F.lit(False)
    for sign in SIGNS:
        noticed = noticed | plain.contains(sign)
    plain = F.when(noticed, without).otherwise(plain)  # most lines have no notice
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, F.lit(_BETWEEN), F.lit(" ")), F.lit(" "))
    for spelling, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(plain)


def digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """Columns digest, licence: one row per known canonical text."""
    texts = spark.createDataFrame(list(known), "licence string, text string")
    form = canonical(F.col("text"))
    return texts.where(form != "").groupBy(F.sha2(form, 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", known=KNOWN) -> DataFrame:
    """Columns ``key``, text_sha256, licence (of the entire text), notices (of lines), n_notices.

    The known digests go to every task while there are at most ``RESIDENT_TEXTS``, some 10 MB;
    more are joined by a shuffle.
    """
    whole = F.struct(F.lit(True).alias("whole"), F.col("text").alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(F.lit(False).alias("whole"), line.alias("text")))
    units = (
        docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        .select("key", F.explode(F.concat(F.array(whole), lines)).alias("u"))
        .select("key", "u.whole", F.sha2(canonical(F.col("u.text")), 256).alias("digest"))
    )
    names = digests(docs.sparkSession, known)
    found = units.join(F.broadcast(names) if len(known) <= RESIDENT_TEXTS else names, "digest", "left")
    whole, line = F.col("whole"), ~F.col("whole")
    return found.groupBy("key").agg(
        F.max(F.when(whole, F.col("digest"))).alias("text_sha256"),
        F.min(F.when(whole, F.col("licence"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("licence")))), ",").alias("notices"),
        F.count(F.when(line, F.col("licence"))).alias("n_notices"),
    ).withColumnRenamed("key", key)


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every document, by its entire text and by its lines."""
    return scan_licenses(table(spark, folder, "documents"))


# The SQL drops whole lines that begin with the word and knows the first texts only: the same on
# tables without such prose and with no other licences.
_SQL_COPYRIGHT = r"(?m)^[^0-9a-z\n]*(copyright|\(c\)|©)[^\n]*$"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    plain = f"regexp_replace(lower(coalesce({text}, '')), '{_SQL_COPYRIGHT}', '', 'g')"
    plain = f"' ' || regexp_replace({plain}, '{_BETWEEN}', ' ', 'g') || ' '"
    for spelling, usual in SPELLINGS:
        plain = f"replace({plain}, ' {spelling} ', ' {usual} ')"
    return f"trim({plain}, ' ')"


_SQL_KNOWN = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in _FIRST)

QUERIES = {"op8_licenses": op8_licenses}
ORACLE = {
    "op8_licenses": f"""
        WITH k AS (SELECT sha256({_sql_canonical('text')}) AS digest, min(licence) AS licence
                   FROM (VALUES {_SQL_KNOWN}) AS t(licence, text) GROUP BY 1),
             u AS (SELECT doc_id, true AS whole, text AS x FROM documents
                   UNION ALL SELECT doc_id, false, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
             f AS (SELECT doc_id, whole, d.digest, licence
                   FROM (SELECT doc_id, whole, sha256({_sql_canonical('x')}) AS digest FROM u) d
                   LEFT JOIN k ON d.digest = k.digest)
        SELECT doc_id, max(digest) FILTER (whole) AS text_sha256, min(licence) FILTER (whole) AS licence,
               coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (NOT whole), '') AS notices,
               count(licence) FILTER (NOT whole) AS n_notices
        FROM f GROUP BY doc_id"""
}
