"""Licence scans by canonical digest.

A text is brought to a canonical form (case, punctuation, white space and line ends, copyright lines and
equivalent spellings), and the SHA-256 of that form is looked up among the digests of whole licences with a
hash join.  Licences within a longer text are found by the same digests: where the first ``ANCHOR`` words of a known
licence stand, the digest of as many words as it has is compared.  Whole lines that are known notices tell which
licences a text names.  All that is known is a constant of this module and what the caller adds,
so its broadcast is bounded; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

ANCHOR = 8

# The texts of short licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

LICENSE_TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("Apache-2.0", _APACHE_HEADER),
]

# Licence, first words, number of words and SHA-256 of the canonical form of long licences: the whole file, and its
# part from the preamble or first section to the end of the terms.
FULL_TEXTS = [
    ("Apache-2.0", "apache license version 2 0 january 2004 http", 1601, "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "terms and conditions for use reproduction and distribution", 1418, "fc9db7a0164e7200da89e02c3227560cc6bf5b50226261135c541f76ac8098f9"),
    ("GPL-1.0", "gnu general public license version 1 february 1989", 2067, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "preamble the license agreements of most software companies", 1604, "018aaaf7231e8a3c8e8a0800c7e593914a330040252f5dc554e1817d1a27f2d4"),
    ("GPL-2.0", "gnu general public license version 2 june 1991", 2975, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "preamble the licenses for most software are designed", 2467, "98e760555ff723908d803b23140ebd264fee15e7615bf9486faa0f8f6596c34f"),
    ("GPL-3.0", "gnu general public license version 3 29 june", 5684, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "preamble the gnu general public license is a", 5213, "fad6d14122ae5943ea05f9e4d48194524a0b701f034fd22c7dded3e6c296c742"),
    ("LGPL-2.0", "gnu library general public license version 2 june", 4200, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "preamble the licenses for most software are designed", 3803, "d4689245f0c71022ce729821274153c787fdebe2e92f0de1f6d3c23326a5f619"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1", 4401, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "preamble the licenses for most software are designed", 3996, "73ac55304afe4c219acdd0cb7683daf4fe3772c9b493da4a095d93a7789311d5"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0", "this version of the gnu lesser general public", 1202, "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a"),
    ("MPL-1.1", "mozilla public license version 1 1 1 definitions", 3786, "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-1.1", "1 definitions 1 0 1 commercial use means", 3520, "4fbf4b1f3d8cf5d05e627fcb1b0dded60f72dbb2e5c2bc5bb929a8db71982f2d"),
    ("MPL-2.0", "mozilla public license version 2 0 1 definitions", 2426, "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
    ("MPL-2.0", "1 definitions 1 1 contributor means each individual", 2293, "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3"),
    ("CC0-1.0", "creative commons legal code cc0 1 0 universal", 1087, "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2"),
    ("CC0-1.0", "statement of purpose the laws of most jurisdictions", 1007, "d2a0e8643f417d50c7bf4049f5661babb5b1acc53d65ea59bd4ea37099993468"),
    ("GFDL-1.2", "gnu free documentation license version 1 2 november", 3315, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.2", "0 preamble the purpose of this license is", 3073, "da4c85448f47d22603d951c573ac545a667904a5f6eab0104964d422566c7ed2"),
    ("GFDL-1.3", "gnu free documentation license version 1 3 3", 3732, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GFDL-1.3", "0 preamble the purpose of this license is", 3496, "1fdd53f1ef0ad288d6e9388b799ce36ae0484d524c9a2d2408a6f2f8e6dc5cef"),
    ("Artistic-1.0", "the artistic license preamble the intent of this", 983, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
]

# Names under which notices give a licence.
LICENSE_NAMES = [
    ("MIT", ["MIT License", "MIT licence terms", "MIT"]),
    ("ISC", ["ISC License", "ISC"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "LGPL-3.0"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "AGPL-3.0"]),
    ("CC0-1.0", ["CC0 1.0", "CC0-1.0"]),
    ("CC-BY-4.0", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-NC-SA-4.0", ["CC BY-NC-SA 4.0"]),
    ("CC-BY-ND-4.0", ["CC BY-ND 4.0"]),
    ("Unlicense", ["Unlicense"]),
]
NOTICE_VERBS = ["Licensed", "Released", "Distributed", "Available", "This work is licensed", "This software is licensed", "This project is licensed", "This file is licensed", "This software is released", "This work is released"]

# Equivalent spellings, as whole words of the canonical form.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("recognise", "recognize"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http"), ("v", "version"),
]

#: spellings of several words, which may stand on both sides of a line end
_PHRASES = [(old, new) for old, new in SPELLINGS if " " in old]

_YEAR = r"(19\d\d|20\d\d|<year>|\[year\]|\[yyyy\]|yyyy)"
#: a line of nothing but a copyright claim, with its sign or a year, or of "all rights reserved"
_COPYRIGHT = rf"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|{_YEAR})|(\(c\)|©)[^a-z0-9\n]*(copyright|{_YEAR}))[^\n]*"
_RESERVED = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)"
_BETWEEN = r"[^\p{L}\p{N}\n]+"


def _spelled(text, spellings, replace):
    for old, new in spellings:
        text = replace(text, f" {old} ", f" {new} ")
    return text


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line ends; lines begin and end with a blank."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, _COPYRIGHT, "\n"), _RESERVED, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, _BETWEEN, " "), F.lit(" "))
    out = F.regexp_replace(out, " ?\n ?", " \n ")
    return _spelled(out, SPELLINGS, lambda t, a, b: F.replace(t, F.lit(a), F.lit(b)))


def canonical(lines: Column) -> Column:
    """The canonical form of a whole text, from its ``canonical_lines``: words with single blanks."""
    out = F.concat(F.lit(" "), F.regexp_replace(lines, r"[ \n]+", " "), F.lit(" "))
    return F.trim(F.regexp_replace(_spelled(out, _PHRASES, lambda t, a, b: F.replace(t, F.lit(a), F.lit(b))), " +", " "))


def plain_canonical_lines(text: str | None) -> str:
    """``canonical_lines`` in plain Python, for the constants."""
    out = re.sub(_RESERVED, "\n", re.sub(_COPYRIGHT, "\n", (text or "").lower()))
    out = " " + re.sub(r"(?:(?!\n)[\W_])+", " ", out) + " "
    return _spelled(re.sub(" ?\n ?", " \n ", out), SPELLINGS, str.replace)


def plain_canonical(text: str | None) -> str:
    out = " " + re.sub(r"[ \n]+", " ", plain_canonical_lines(text)) + " "
    return " ".join(_spelled(out, _PHRASES, str.replace).split())


def _digest(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


def plain_digest(text: str | None) -> str:
    return _digest(plain_canonical(text))


def known_wholes(texts: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str, str, int]]:
    """(digest, licence, first ``ANCHOR`` words, number of words) of every known whole text."""
    found = {(digest, name, anchor, n) for name, anchor, n, digest in FULL_TEXTS}
    for name, text in [*LICENSE_TEXTS, *texts]:
        form = plain_canonical(text)
        words = form.split()
        found.add((_digest(form), name, " ".join(words[:ANCHOR]), len(words)))
    return sorted(found)


def known_notices() -> dict[str, str]:
    """Licence by the canonical form of every known one-line notice."""
    found = {}
    for name, spellings in LICENSE_NAMES:
        for s in spellings:
            found |= {plain_canonical(f"{verb} under {the}{s}"): name for verb in NOTICE_VERBS for the in ("", "the ", "the terms of the ")}
        found[plain_canonical(f"SPDX-License-Identifier: {name}")] = name
    return found


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """One row per row of ``docs``: id, digest of the canonical text, and the licences found.

    ``texts`` are (licence, whole text) of licences to know besides ``LICENSE_TEXTS`` and ``FULL_TEXTS``.

    ``license_id`` is the licence that the whole text is (null if none), ``contained`` the licences whose whole
    text stands in it, ``notices`` the licences that whole lines name, both sorted and joined by ``|``, and ``notice_lines``
    the number of such lines.

    Cases: null and empty texts have the digest of the empty string; repeated rows give a row each;
    other columns are ignored; very long texts are scanned whole; an empty input gives no rows.
    """
    wholes, notices = known_wholes(texts), known_notices()
    known = docs.sparkSession.createDataFrame([(d, n) for d, n, _, _ in wholes], "digest string, license_id string").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    by_line = F.create_map(*[F.lit(x) for item in notices.items() for x in item])
    candidates = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(n).alias("name"), F.lit(a).alias("anchor"), F.lit(size).alias("size")) for d, n, a, size in wholes if size >= ANCHOR])

    def stretch(start: Column, size) -> Column:
        return F.array_join(F.slice("words", start, size), " ")

    anchors = sorted({a for _, _, a, size in wholes if size >= ANCHOR})
    firsts = {a.split(" ")[0] for a in anchors}
    starts = F.filter(F.transform("words", lambda w, i: F.when(_isin(w, firsts) & _isin(stretch(i + 1, ANCHOR), anchors), i + 1)), lambda p: p.isNotNull())
    found = F.filter(candidates, lambda k: F.exists("starts", lambda p: (stretch(p, ANCHOR) == k.anchor) & (F.sha2(stretch(p, k.size), 256) == k.digest)))
    contained = F.when(F.size("starts") > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda k: k["name"]))), "|")).otherwise("")

    lines = F.transform(F.split("form", "\n"), lambda x: F.regexp_replace(F.trim(x), " +", " "))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("form"))
        .select("doc_id", canonical(F.col("form")).alias("whole"), F.filter(lines, lambda x: _isin(x, notices)).alias("named"))
        .select("doc_id", F.sha2("whole", 256).alias("text_digest"), F.split("whole", " ").alias("words"), "named")
        .select("doc_id", "text_digest", "words", starts.alias("starts"), "named")
    )
    names = F.array_sort(F.array_distinct(F.transform("named", lambda x: F.element_at(by_line, x))))
    scanned = rows.select(
        "doc_id", "text_digest", contained.alias("contained"), F.array_join(names, "|").alias("notices"), F.size("named").cast("long").alias("notice_lines")
    )
    return scanned.join(F.broadcast(known), F.col("text_digest") == F.col("digest"), "left").select("doc_id", "text_digest", "license_id", "contained", "notices", "notice_lines")


def _isin(value: Column, known: Iterable[str]) -> Column:
    return value.isin(sorted(known))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for ``op1_licenses``."""

    def replaced(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', {by}, 'g')"

    def spelled(text: str, spellings) -> str:
        return _spelled(text, spellings, lambda t, a, b: f"replace({t}, '{a}', '{b}')")

    lines = replaced(replaced("lower(coalesce(text, ''))", _COPYRIGHT, "chr(10)"), _RESERVED, "chr(10)")
    lines = spelled(replaced("' ' || " + replaced(lines, _BETWEEN, "' '") + " || ' '", r" ?\n ?", "' ' || chr(10) || ' '"), SPELLINGS)
    whole = "trim(" + replaced(spelled("' ' || " + replaced("form", r"[ \n]+", "' '") + " || ' '", _PHRASES), " +", "' '") + ")"
    wholes = ", ".join(f"('{d}', '{n}', '{a}', {size})" for d, n, a, size in known_wholes())
    notices = ", ".join(f"('{x}', '{n}')" for x, n in known_notices().items())
    return f"""
WITH known(digest, name, anchor, size) AS (VALUES {wholes}),
notice(line, name) AS (VALUES {notices}),
forms AS (SELECT doc_id, row_number() OVER () AS r, {lines} AS form FROM documents),
texts AS (SELECT doc_id, r, form, {whole} AS whole FROM forms),
words AS (SELECT r, string_split(whole, ' ') AS w FROM texts),
starts AS (SELECT r, w, p, array_to_string(w[p : p + {ANCHOR - 1}], ' ') AS anchor FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM words)),
inside AS (SELECT DISTINCT s.r, k.name FROM starts s JOIN known k ON s.anchor = k.anchor WHERE k.size >= {ANCHOR} AND sha256(array_to_string(s.w[s.p : s.p + k.size - 1], ' ')) = k.digest),
named AS (SELECT l.r, n.name FROM (SELECT r, regexp_replace(trim(unnest(string_split(form, chr(10)))), ' +', ' ', 'g') AS line FROM texts) l JOIN notice n ON l.line = n.line)
SELECT t.doc_id, sha256(t.whole) AS text_digest,
  (SELECT min(name) FROM known WHERE digest = sha256(t.whole)) AS license_id,
  coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM inside WHERE inside.r = t.r), '') AS contained,
  coalesce((SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM named WHERE named.r = t.r), '') AS notices,
  (SELECT count(*) FROM named WHERE named.r = t.r) AS notice_lines
FROM texts t"""
