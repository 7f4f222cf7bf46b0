"""License scans by canonical digests: normalise a text until trivial variants agree, then hash-join it to known ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: The licences whose identifier line is known.
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so"
)
_MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_WARRANTY = (
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
)


def _gnu(kind: str, version: str, later: bool) -> str:
    """The notice that the GNU licences ask for in each source file, in its usual wording."""
    of = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    what = "library" if kind == "Lesser " else "program"
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, {of}.\n\n" + _WARRANTY.format(what, kind)


#: Short notices, notices of source files and licences in full, by identifier.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("0BSD", f"BSD Zero Clause License\n\nCopyright (C) YEAR by AUTHOR EMAIL\n\n{_ISC_GRANT}.\n\n{_ISC_END}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"ISC License\n\nCopyright (c) <year> <owner>\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("MIT", f"MIT License\n\nCopyright (c) <year> <copyright holders>\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_END}"),
    ("MIT-0", f"MIT No Attribution\n\nCopyright <YEAR> <COPYRIGHT HOLDER>\n\n{_MIT_GRANT}.\n\n{_MIT_END}"),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) <year>, <owner>\n\n" + _BSD_CONDITIONS + _BSD_END),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) <year>, <owner>\n\n" + _BSD_CONDITIONS + _BSD_THIRD + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((f"{name}-{version}.0-{'or-later' if later else 'only'}", _gnu(kind, version, later)) for name, kind, versions in (("GPL", "", "23"), ("AGPL", "Affero ", "3"), ("LGPL", "Lesser ", "3")) for version in versions for later in (True, False)),
    *((i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS),
)
#: Spellings that count as equal, as words after lower-casing (from, to).
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("merchantibility", "merchantability"), ("noninfringment", "noninfringement"), ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("whilst", "while"), ("v2.0", "version 2.0"), ("v3", "version 3"),
)
_BEFORE, _YEAR = "^[^\\p{L}\\p{N}\\n(\u00a9&]*", "\\b(?:19|20)[0-9]{2}\\b"
#: A line, of lower-cased text and after marks of comments, that states a copyright: with a year, a mark, or a place for them.
COPYRIGHT_LINE = (
    f"(?m){_BEFORE}(?:\u00a9|&copy;|\\(c\\)[ \\t]*(?:copyright\\b|{_YEAR})|copyright by\\b|copyright\\b[^\\n]*?(?:{_YEAR}|\u00a9|&copy;|\\(c\\)|<year>|\\[year\\]|\\[yyyy\\]))[^\\n]*$"
    f"|{_BEFORE}all rights reserved" "[^\\p{L}\\p{N}\\n]*$"
)
ANY_SPELLING = "\\b(?:" + "|".join(one.replace(".", "\\.") for one, _ in SPELLINGS) + ")\\b"
#: Runs of what is no letter, digit or combining mark of any script, but for ends of lines; blank lines; white space.
OTHER, BLANK, SPACE = "[^\\p{L}\\p{N}\\p{M}\\n]+", "\\n ?(?:\\n ?)+", "[\\n ]+"


def by_line(text: Column) -> Column:
    """Lower case; copyright lines dropped; equivalent spellings joined; punctuation folded to one space within each line."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    joined = out
    for one, other in SPELLINGS:
        joined = F.regexp_replace(joined, "\\b" + one.replace(".", "\\.") + "\\b", other)
    return F.regexp_replace(F.when(out.rlike(ANY_SPELLING), joined).otherwise(out), OTHER, " ")


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def canonical(text: Column) -> Column:
    """by_line(), with its lines joined."""
    return _one_line(by_line(text))


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """digest, license, size (characters of the canonical text) from a list, or a table (license, text), of known texts:
    one row per distinct canonical text, with the first identifier of equal texts in order. Texts without a letter or
    digit are left out."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    form = rows.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.md5("form").alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("form")).alias("size"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, digest of its canonical whole text, license if the whole text is a known one
    (else null), and notices, the sorted distinct licences of which it holds an entire known text as a line or as a
    paragraph between blank lines (else empty).

    Null and empty texts have the digest of the empty text and no licence, repeated rows give repeated results, an empty
    table gives an empty result, and other columns are dropped. Lines and paragraphs meet the known digests in a join;
    only those as long as some known text are hashed, which loses none, and the rows that the join finds go back to
    their documents by doc_id and digest of the raw text, so neither texts nor lines are shuffled.
    """
    form = by_line(F.coalesce(F.col("text"), F.lit("")))
    raw = F.md5(F.coalesce(F.col("text"), F.lit("")))
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # whole numbers up to the longest known text
    units = F.concat(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), F.transform(F.split("form", BLANK), _one_line))
    held = F.array_distinct(F.filter(units, lambda x: F.length(x).isin(sizes)))
    whole = docs.select("doc_id", raw.alias("raw"), form.alias("form"))
    each = cut(whole.select("doc_id", "raw", F.md5(_one_line(F.col("form"))).alias("digest"), F.transform(held, lambda x: F.md5(x)).alias("held")), "forms")
    notices = (
        each.where(F.size("held") > 0).select("doc_id", "raw", F.explode("held").alias("part")).distinct()
        .join(known.select(F.col("digest").alias("part"), F.col("license").alias("notice")), "part")
        .groupBy("doc_id", "raw").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    )
    # a null doc_id meets a null one
    found = each.join(notices.withColumnsRenamed({"doc_id": "d", "raw": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("raw") == F.col("r")), "left")
    return found.join(known.select("digest", "license"), "digest", "left").select(
        "doc_id", "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
