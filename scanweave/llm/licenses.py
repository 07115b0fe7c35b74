"""Licence scans by canonical digest.

A licence text is known by the SHA-256 of its canonical form: lower case, words
of equivalent spelling made equal, copyright lines and punctuation gone, white
space made single blanks.  Entire texts are looked up: a document, and each of
its paragraphs and lines by itself (the notices that name a licence).  The
look-up is an equi-join of digests with the table of known licences, which has
each text with and without its usual titles and list numbers.

Only documents and parts that hold a stem which every known text has (``stems``
derives them from the table) are split and put into canonical form, which
loses no match.

All of it is DataFrame work.  Defined results: a null or empty text has the
digest of the empty text and no licence; a very long text is put into canonical
form as a whole; repeated rows are looked up each, and rows of one id with
different texts keep their own notices; a licence that is named several times
is given once; of two licences of equal text the first by name counts; an empty
table gives no rows; no column of the input but id and text is read, so other
names can't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm.common import table

# Spellings that mean the same, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("non-commercial", "noncommercial"),
    ("non commercial", "noncommercial"),
    ("sub-license", "sublicense"),
    ("per cent", "percent"),
    ("&", " and "),
    ("https://", " "),
    ("http://", " "),
)
#: A line that starts by naming a holder: the word alone may start a line of a wrapped licence text.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright *(\(c\)|[0-9©])|\(c\) *[0-9]|© *[0-9]|all rights reserved)[^\n]*$"
#: The same without a year or sign, where the line is a paragraph of its own, as no line of a wrapped licence text is.
COPYRIGHT_PARAGRAPH = r"(^|\n[ \t\r]*\n)[^a-z0-9\n]*copyright [^\n]*(\n[ \t\r]*\n|\n?\z)"
#: What such a line holds, one of them at least.
HOLDER_WORDS = ("copyright", "(c)", "©", "all rights reserved")
#: Punctuation and white space: ASCII's, no-break spaces, dashes, curly quotes, bullets and ellipses.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2026}\x{202F}]+"
#: Between paragraphs, and between clauses.
PARAGRAPHS = r"\n[ \t\r]*\n"
CLAUSES = r"[.;!?]+[ \t\r\n]+|[ \t]+[-–—]+[ \t]+"

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_HOPE = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."

# Texts of known licences and the notices that name them.
KNOWN = (
    ("MIT", _GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("MIT-0", _GRANT + ". " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAME + _BSD_AS_IS),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0-or-later", _FREE.replace("software:", "software;").format("General Public License", "2")),
    ("GPL-2.0-or-later", _FREE.replace("software:", "software;").format("General Public License", "2") + _HOPE.format("General Public License")),
    ("GPL-3.0-or-later", _FREE.format("General Public License", "3")),
    ("GPL-3.0-or-later", _FREE.format("General Public License", "3") + _HOPE.format("General Public License")),
    ("AGPL-3.0-or-later", _FREE.format("Affero General Public License", "3")),
    ("LGPL-3.0-or-later", _FREE.format("Lesser General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0-or-later", _FREE.format("Affero General Public License", "3") + _HOPE.format("Affero General Public License")),
    ("LGPL-3.0-or-later", _FREE.format("Lesser General Public License", "3") + _HOPE.format("Lesser General Public License")),
    ("LGPL-2.1-or-later", _FREE.replace("This program", "This library").replace("software:", "software;").format("Lesser General Public License", "2.1")),
)

# Names of licences as notices have them.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0 License", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0 License", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "Unlicense": ("Unlicense",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
}
#: Subjects and verbs of notices; "the" may stand before a name.
SUBJECTS = ("", "This project is ", "This software is ", "This work is ", "This code is ", "This program is ", "This file is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "available under ", "licensed under the terms of ", "released under the terms of ", "distributed under the terms of ")

# Digests of the canonical forms of long texts, each whole and up to its last term.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "4a0b5a7831e63e1ffbd7a198ec456bccf641ded314e1fac6acdf940a4e7b13ed"),
    ("Apache-2.0", "e97ca4bf9c5da617e106b78ef392942804a5a9b4f89e4c95b5afa136a38391ac"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "d0d142139ba117e0fbb63d29df37776bc9c765c015720dc0ed43bceea6416494"),
    ("GFDL-1.3", "2cdb48855af1603586f28b20f0095e588a4bd77ee484d2c3b89bc3b1f0b61da5"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "24cd241e223e73eb1af195b9e4c0baf03a79bbbb39987eca0e347c1e490442aa"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "e4d7347f1855f056365c08ad8030307f5cda3d38c9658d4f4db9a7c0aaac6c53"),
    ("MPL-2.0", "b59ad31436b35a95a00cff48e84c1f014339f59fac784c1935fc6f7dc34abf70"),
)

# Titles that stand over these texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution",),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: Stems that a known text's raw forms share whatever their spelling.
_STEMS = ("licen", "permi", "redistribut", "released", "distributed", "available")


def notices() -> list[tuple[str, str]]:
    """(license, text) of the lines that name a licence: by subject, verb and name, and by identifier."""
    out = [(license_, f"{subject}{verb}{the}{name}") for license_, names in NAMES.items() for name in names for subject in SUBJECTS for verb in VERBS for the in ("", "the ")]
    return out + [(license_, f"SPDX-License-Identifier: {license_}{more}") for license_ in NAMES for more in ("", "-only", "-or-later") if not more or "GPL" in license_]


def variants(known: tuple[tuple[str, str], ...] = KNOWN) -> list[tuple[str, str]]:
    """(license, text) with and without list numbers and titles."""
    out = []
    for name, text in known:
        for body in dict.fromkeys((text, re.sub(r"(?<=[:.] )\d\. ", "", text))):
            out += [(name, body), *((name, f"{title}\n\n{body}") for title in TITLES.get(name, ()) if len(text) > 300)]
    return out + (notices() if known is KNOWN else [])


def stems(known: list[tuple[str, str]]) -> list[str]:
    """Stems of _STEMS such that every known text holds one; other texts bring a word of theirs that no spelling touches."""
    out: list[str] = []
    for _, text in known:
        low = text.lower()
        if not any(s in low for s in out):
            words = [s for s in _STEMS if s in low] or sorted((w for w in re.findall(r"[a-z]{5,}", low) if not any(w in a or w in b or a in w or b in w for a, b in SPELLINGS)), key=len)[-1:]
            out.append(words[0] if words else "")
    return out


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def without_holders(low: Column) -> Column:
    """Lower-case text without its copyright lines; texts that can't have one aren't searched for lines."""
    may = F.lit(False)
    for w in HOLDER_WORDS:
        may = may | F.contains(low, F.lit(w))
    return F.when(may, F.regexp_replace(F.regexp_replace(low, "(?d)" + COPYRIGHT_LINE, " "), "(?d)" + COPYRIGHT_PARAGRAPH, "\n\n")).otherwise(low)


def even(low: Column) -> Column:
    """One spelling for all, and single blanks between words."""
    for spelling, same in SPELLINGS:
        low = F.replace(low, F.lit(spelling), F.lit(same))
    return F.btrim(F.regexp_replace(low, GAPS, " "))


def digest(low: Column) -> Column:
    """SHA-256 of the canonical form of a lower-case text."""
    return F.sha2(even(without_holders(low)).cast("binary"), 256)


#: Where the last term of a long text ends.
LAST_TERM = "end of terms and conditions"


def digests_of(texts: DataFrame) -> DataFrame:
    """(license, digest) of texts (license, text): whole, and up to the line that ends the terms where there is one."""
    low = lowered(F.col("text"))
    forms = F.array(low, F.when(F.contains(low, F.lit(LAST_TERM)), F.concat(F.substring_index(low, LAST_TERM, 1), F.lit(LAST_TERM))))
    each = texts.select("license", F.explode(forms).alias("low")).filter("low IS NOT NULL")
    return each.select("license", digest(F.col("low")).alias("digest")).distinct()


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest) of known texts: those given, or all of this module."""
    rows = spark.createDataFrame(texts or variants(), "license string, text string").select("license", digest(lowered(F.col("text"))).alias("digest"))
    return (rows if texts else rows.unionByName(spark.createDataFrame([*DIGESTS], "license string, digest string"))).distinct()


def found(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", held: list[str] | None = None) -> DataFrame:
    """(key, digest, license, notices) of every document: the licence whose text it is, and those that its paragraphs, lines and clauses name.

    held: stems of which each known text has one; those of KNOWN by default.
    """
    table_ = F.broadcast(known.groupBy("digest").agg(F.min("license").alias("license")))  # one row for each known text
    held = stems(variants()) if held is None else held

    def may(column: Column) -> Column:
        out = F.lit(False)
        for s in held:
            out = out | F.contains(column, F.lit(s))
        return out

    low = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"), lowered(F.col(text)).alias("low"))
    whole = low.select("key", "hash", digest(F.col("low")).alias("digest"))
    parts = F.concat(F.split("low", "\n", -1), F.split("low", PARAGRAPHS, -1), F.split("low", CLAUSES, -1))
    lines = low.filter(may(F.col("low"))).select("key", "hash", F.explode(F.array_distinct(F.filter(parts, may))).alias("line"))
    named = lines.select("key", "hash", digest(F.col("line")).alias("digest")).join(table_, "digest")
    named = named.groupBy("key", "hash").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices")).select(F.col("key").alias("named"), F.col("hash").alias("in"), "notices")
    rows = whole.join(table_, "digest", "left")
    same = F.col("key").eqNullSafe(F.col("named")) & (F.col("hash") == F.col("in"))
    return rows.join(named, same, "left").select("key", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(table(spark, sf_dir, "documents"), known_licenses(spark))
    return rows.withColumnRenamed("key", "doc_id")
