"""Licence scans by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings don't count), and the
digest of the form, entire, is joined by hash to the digests of known licences. Each line is looked up in the same way
among the known notices. After the matching guidelines of the SPDX licence list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.llm.common import unused

# The public texts of licences, without their copyright lines, as in the SPDX licence list.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_MIT = (
    f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS} "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_0 = _MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NO = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_NO = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_UNLICENSE_MORE = f"{_UNLICENSE}\n\nFor more information, please refer to "
_BSL = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEXTS = [
    ("MIT", f"MIT License\n\n{_MIT}"), ("MIT", f"The MIT License (MIT)\n\n{_MIT}"), ("MIT", _MIT), ("MIT-0", f"MIT No Attribution\n\n{_MIT_0}"), ("MIT-0", _MIT_0),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_NO}"), ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_NO}"),
    ("0BSD", f"Zero-Clause BSD\n\n{_ISC_GRANT}.\n\n{_ISC_NO}"), ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_NO}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n{_BSD_NO}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n\n* {_BSD_1}\n\n* {_BSD_2}\n\n{_BSD_NO}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n3. {_BSD_3}\n\n{_BSD_NO}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}\n\n* {_BSD_1}\n\n* {_BSD_2}\n\n* {_BSD_3}\n\n{_BSD_NO}"),
    ("Zlib", f"zlib License\n\n{_ZLIB}"), ("Zlib", _ZLIB), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE), ("Unlicense", f"{_UNLICENSE_MORE}<https://unlicense.org>"), ("Unlicense", f"{_UNLICENSE_MORE}<https://unlicense.org/>"), ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{_BSL}"), ("BSL-1.0", _BSL),
]
NOTICES = [
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."), ("MPL-2.0", _MPL), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("ISC", "Licensed under the ISC License."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Of longer public licences the digests alone, by match_digest, of the whole text and, where they say where their
# terms end, of the text up to there.
DIGESTS = [
    ("Apache-2.0", "78595e4b5a47cff6ba1e5dc34a5c411a"), ("Apache-2.0", "3cd3d8b324695bb0e11ba22cfe0e57e5"), ("Artistic-1.0-Perl", "dc4a091dae3cbb0eaa99c7976db9c452"), ("CC0-1.0", "dda622f2a6954c3bec3a251c578f8583"),
    ("GFDL-1.2-only", "47db9266823a5d42ed2097c80082a819"), ("GFDL-1.3-only", "0525a14616519eaa74f74eac262327f5"),
    ("GPL-1.0-only", "29ed6cb03107176e9fb98a6de359a1cb"), ("GPL-1.0-only", "8cb2cbe82e8896025c30aab6cfa10a1f"), ("GPL-2.0-only", "26b2bfb32c731688a49c7316842df11c"), ("GPL-2.0-only", "fd91d034b9fea937f46ffc879550d057"),
    ("GPL-3.0-only", "4522322be58c62397949e6fa82486e8e"), ("GPL-3.0-only", "49410fec56a924c5dfc560fa7f487702"),
    ("LGPL-2.0-only", "a6c71e468cb3a74b32d790234a6b452d"), ("LGPL-2.0-only", "1fc26f8c34fe8d0366dbad7bd2b98085"), ("LGPL-2.1-only", "86d8dfebdf105230da0149a95ab44835"), ("LGPL-2.1-only", "cec1622275ab5e49efbec66d4548c0d6"),
    ("LGPL-3.0-only", "45ec14853d944805ef573d0b3a40cda3"), ("MPL-1.1", "93f4493bc3cc4c7562da7311a9ec89ef"), ("MPL-2.0", "7af35977b8ca802e2f909e41d737a587"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUOTES = ("‘’“”–— ", "''\"\"-- ")
#: Lines that don't count: what begins them.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/]*(copyright |copyright$|\(c\) |© ?|all rights reserved)[^\n]*"
#: What licences are found by: lines of a notice, not wrapped lines of the licence ("copyright notice ..."), and marks of lists.
NOTICE_LINE = r"(^|\n)[ \t#*/]*(copyright(?![ \t]+(notice|holder|owner|statement|license|licence|law|interest|and|or|in|to|under)s?([^a-z]|$))([ \t][^\n]*|$)|(\(c\)|© ?|all rights reserved)[^\n]*)"
LIST_MARK = r"(^|\n)[ \t#*/]*([-*•]|\(?[0-9]{1,2}[.)]|\(?[a-z]\))[ \t]+"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Spellings that count as one, with single spaces between words.
SPELLINGS = [(" licence", " license"), (" sub license", " sublicense"), (" sublicence", " sublicense"), (" non commercial", " noncommercial"), (" non infringement", " noninfringement"), (" copyright owner", " copyright holder"), (" acknowledgement", " acknowledgment"), (" merchantibility", " merchantability"), (" https ", " http ")]


def _plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER + QUOTES[0], LOWER + QUOTES[1])


def _words(out: Column) -> Column:
    out = F.concat(F.lit(" "), F.regexp_replace(out, PUNCTUATION, " "), F.lit(" "))
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.trim(out)


def canonical(text: Column) -> Column:
    """The canonical form: words with single spaces between; null as empty."""
    return _words(F.regexp_replace(_plain(text), COPYRIGHT_LINE, "$1"))


def match_digest(text: Column) -> Column:
    """The digest that licences are found by: as :func:`canonical`, but lines may be wrapped anywhere and list marks don't count."""
    out = F.regexp_replace(_plain(text), NOTICE_LINE, "$1")
    return F.md5(_words(F.regexp_replace(out, LIST_MARK, "$1")).cast("binary"))


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known(spark: SparkSession, texts: list[tuple[str, str]], by: Callable[[Column], Column] = digest) -> DataFrame:
    """(license_id, digest) of known texts, once for each digest."""
    rows = spark.createDataFrame(texts, "license_id string, text string")
    return rows.select("license_id", by(F.col("text")).alias("digest")).dropDuplicates(["digest"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] = TEXTS, notices: list[tuple[str, str]] = NOTICES, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(id, text_digest, license_id, notice_ids) for every row of ``docs``.

    ``license_id``: the licence that the entire text is, or null. ``notice_ids``: those of lines that are known notices, each
    once, in order and joined by commas; empty if there are none. A null text is empty and no licence; an empty table gives an
    empty one. The known texts are parameters, as are ``digests`` of others by :func:`match_digest`, so the broadcast is of their number.
    """
    spark = docs.sparkSession
    match = unused("_match", docs)
    listed = known(spark, texts, match_digest).unionByName(spark.createDataFrame(digests, "license_id string, digest string"))
    licences = F.broadcast(listed.dropDuplicates(["digest"]).withColumnRenamed("digest", match))
    # digests of lines are looked up in the row: it has them all, and nothing is shuffled
    named = {r["digest"]: r["license_id"] for r in known(spark, notices).collect()}
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.transform(F.split(text, "\n"), lambda line: table[digest(line)])
    ids = F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",")
    rows = docs.select(F.col(id_col).alias(id_col), digest(text).alias("text_digest"), match_digest(text).alias(match), ids.alias("notice_ids"))
    return rows.join(licences, match, "left").select(id_col, "text_digest", "license_id", "notice_ids")


def oracle_sql() -> str:
    """The scan of ``documents`` as DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"translate(coalesce({x}, ''), {quote(UPPER + QUOTES[0])}, {quote(LOWER + QUOTES[1])})"
        out = f"regexp_replace({out}, {quote(COPYRIGHT_LINE)}, '\\1', 'g')"
        out = f"(' ' || regexp_replace({out}, {quote(PUNCTUATION)}, ' ', 'g') || ' ')"
        for spelling, one in SPELLINGS:
            out = f"replace({out}, {quote(spelling)}, {quote(one)})"
        return f"md5(trim({out}))"

    values = lambda rows: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    return f"""
WITH licences AS (SELECT {form('t')} AS digest, min(i) AS license_id FROM (VALUES {values(TEXTS)}) v(i, t) GROUP BY 1),
notices AS (SELECT {form('t')} AS digest, min(i) AS license_id FROM (VALUES {values(NOTICES)}) v(i, t) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids FROM lines JOIN notices ON digest = {form('line')} GROUP BY doc_id)
SELECT d.doc_id, {form('d.text')} AS text_digest, license_id, coalesce(notice_ids, '') AS notice_ids
FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN licences l ON l.digest = {form('d.text')}
"""
