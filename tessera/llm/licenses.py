"""Licence scan by canonical digest: normalise, digest, hash-join to the digests of known licences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.url_filter import LOWER, UPPER

# Short notices and licence texts as published, with their SPDX names.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    (
        "MIT",
        'MIT License\n\nCopyright (c) <year> <holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        'ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
]
_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN += [
    ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n{_CONDITIONS}\n\n1. {_SOURCE}\n\n2. {_BINARY}\n\n{_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n{_CONDITIONS}\n\n1. {_SOURCE}\n\n2. {_BINARY}\n\n3. {_NAMES}\n\n{_AS_IS}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Texts with a title are often found without it.
KNOWN += [(name, text.partition("\n\n")[2]) for name, text in KNOWN if text.startswith(("MIT License", "ISC License", "BSD "))]
# Full texts as published, by the length and SHA-256 of their canonical form.
DIGESTS: list[tuple[str, int, str]] = [
    ("Apache-2.0", 9700, "6ab5deeb4b2c14f4681b97d03ec0d6cf046968b552bd6e2efe1721910b2e5e9e"),
    ("Artistic-1.0-Perl", 5710, "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", 19515, "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86"),
    ("GFDL-1.3-only", 21884, "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb"),
    ("GPL-1.0-only", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", 17053, "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0-only", 33277, "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("LGPL-2.0-only", 23999, "e2c319279ddf282349927826fd110bdb5b471edc3a726a66fe333c8184a4b135"),
    ("LGPL-2.1-only", 25086, "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70"),
    ("LGPL-3.0-only", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22340, "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", 14283, "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61"),
]
# Spellings that count as equal, as (pattern, replacement), on lower-case words.
EQUIVALENT = [
    (r"\blicence(s|d|e|es)?\b", "license$1"),
    (r"\bsub license\b", "sublicense"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bv(?:er)? ?([0-9])", "version $1"),
]
#: Lines that state whose copyright it is; they differ from copy to copy.
COPYRIGHT_LINE = r"(?m)^[\t ]*(?:copyright\b|\(c\)|©).*$"


#: Rows of a registry at most.
MOST_KNOWN = 100_000


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, only words and line ends, equivalent spellings made equal."""
    text = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    text = F.regexp_replace(text, COPYRIGHT_LINE, "")
    text = F.regexp_replace(text, "[\\x00-\\x09\\x0B-\\x2F:-@\\[-`{-\\x7F]+", " ")
    for pattern, replacement in EQUIVALENT:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\n]+", " "))


def digests(spark: SparkSession, known: Iterable[tuple[str, str]]) -> DataFrame:
    """Licences ``(spdx, text)`` as ``(license, chars, digest)`` of their canonical form; this is how DIGESTS came about."""
    unit = one_line(canonical(F.col("text")))
    texts = spark.createDataFrame(list(known), "license string, text string")
    return texts.select("license", F.length(unit).alias("chars"), F.sha2(unit, 256).alias("digest")).distinct()


def registry(spark: SparkSession, known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """Known licences: the given ones and the full texts of DIGESTS, as ``(license, chars, digest)``."""
    return digests(spark, known).unionByName(spark.createDataFrame(DIGESTS, "license string, chars int, digest string")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Licences that whole texts, or whole lines of texts, of ``docs(doc_id, text)`` equal canonically.

    ``known(license, chars, digest)`` comes from :func:`registry`; more than MOST_KNOWN rows are refused.
    Returns one row per doc_id: license (the whole text's; the smallest name of several; else null),
    licenses (sorted names over the text and its lines, comma-joined, empty for none) and n_lines
    (lines that equal a licence; each repeat counts). A null or empty text has none. Repeated
    doc_ids, and null ones, are judged together as one document. Other columns are ignored.

    Only units as long as a known text are digested. The digests meet the known ones in a broadcast
    hash join in the task that read the text; partial aggregation leaves one small row per document
    to shuffle.
    """
    lengths = sorted(r["chars"] for r in known.select("chars").distinct().limit(MOST_KNOWN + 1).collect())
    if known.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        raise ValueError("the registry is too large to be sent to every task")
    normal = canonical(F.col("text"))
    parts = (
        docs.select("doc_id", normal.alias("normal"))
        .select(
            "doc_id",
            F.posexplode(
                F.concat(
                    F.array(one_line(F.col("normal"))),
                    F.transform(F.split("normal", "\\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))),
                )
            ).alias("part", "unit"),
        )
        .select("doc_id", "part", F.when(F.length("unit").isin(lengths), F.sha2("unit", 256)).alias("digest"))
    )
    found = parts.join(F.broadcast(known.select("license", "digest")), "digest", "left")
    return (
        found.groupBy("doc_id")
        .agg(
            F.min(F.when(F.col("part") == 0, F.col("license"))).alias("license"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
            F.count(F.when((F.col("part") > 0) & F.col("license").isNotNull(), 1)).alias("n_lines"),
        )
        .select("doc_id", "license", "licenses", "n_lines")
    )
