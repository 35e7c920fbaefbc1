"""Operator 2: license scans by MinHash bands over overlapping text windows.

A text is read in windows of WINDOW shingles of five tokens; windows overlap by the four
tokens that neighbouring shingles share, so every shingle lies in one window. For each of
BANDS bands a window gives its MinHash (the smallest hash of its shingles under the band's
seed). A template gives the MinHashes of its windows at every offset and of every length
up to WINDOW, so a text window whose template shingles are some of its shingles meets the
template in each band in which one of these is the smallest: a window of two shingles, one
of which is the template's, is missed with a probability of 2^-BANDS (1e-6), and one that
lies within the template never. Retrieved windows are then compared shingle by shingle, as
text, and a license is reported where the document holds at least CONTAINED of the
distinct shingles of its template, exactly counted.

Only DataFrame and SQL functions run. The template tables have a size that does not
depend on the data, so broadcasting them is bounded; texts are never shuffled, only the
shingles of windows that met a template.

Defined results: a null, empty or short text has no match and no row; a license that a
text repeats is reported once; rows with equal doc_id and equal text (or both null) are
one document, rows that share a doc_id but not the text are documents of their own; a
very long text is scanned whole; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import let

SHINGLE, WINDOW, BANDS, CONTAINED = 5, 2, 20, 0.8

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str, version: str) -> str:
    """The notice that GNU licenses ask to put at the head of a file."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _commons(kind: str) -> str:
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License."


# Public license texts, and notices as they stand at the head of works.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS,
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": f"{_BSD_CONDITIONS} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0": _commons("Attribution"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": _commons("Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _commons("Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _commons("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _commons("Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _commons("Attribution-ShareAlike"),
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "GPL-3.0": _gnu("GNU General Public License", "3"),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS,
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3"),
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def tokens(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def grams(text: str) -> list[str]:
    """The distinct shingles of a template, in order; one of fewer tokens has none and never matches."""
    t = tokens(text)
    return list(dict.fromkeys(" ".join(t[i : i + SHINGLE]) for i in range(len(t) - SHINGLE + 1)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, n_shingles, first_token, containment) for each license a document holds."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(n, g) for n, t in templates.items() for g in grams(t)], "license string, gram string")
    total = spark.createDataFrame([(n, len(grams(t))) for n, t in templates.items()], "license string, total long")
    # MinHashes of windows of one shingle, which those of longer windows are among.
    words = F.split("gram", " ")
    low = F.xxhash64(*[words[i] for i in range(SHINGLE)])
    bands = wanted.select(low.alias("g")).select(F.explode(F.array(*[F.xxhash64("g", F.lit(b)) for b in range(BANDS)])).alias("low")).distinct()

    # In each row the shingle hashes of all windows; the bands are taken outside of it, where Spark compiles them.
    shingle = f"xxhash64({', '.join(f'k[i + {j}]' for j in range(SHINGLE))})"
    hashes = ", ".join(f"'g{i}', g[least({WINDOW} * j + {i}, size(g) - 1)]" for i in range(WINDOW))
    window = f"named_struct('at', {WINDOW} * j, 'own', array_join(slice(k, {WINDOW} * j + 1, {WINDOW + SHINGLE - 1}), ' '), {hashes})"
    body = let(f"transform(sequence(0, size(k) - {SHINGLE}), i -> {shingle})", "g", f"transform(sequence(0, (size(g) - 1) div {WINDOW}), j -> {window})")
    none = f"cast(array() AS array<struct<at: int, own: string, {', '.join(f'g{i}: bigint' for i in range(WINDOW))}>>)"
    windows = let(f"regexp_extract_all(lower(coalesce(`{text}`, '')), '[a-z0-9]+', 0)", "k", f"if(size(k) >= {SHINGLE}, {body}, {none})")

    win = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.explode(F.expr(windows)).alias("w")).select("doc_id", "mark", "w.*")
    lows = F.array(*[F.least(*[F.xxhash64(f"g{i}", F.lit(b)) for i in range(WINDOW)]) for b in range(BANDS)])  # the seed is part of the hash, so bands don't mix
    met = win.select("doc_id", "mark", "at", "own", F.explode(lows).alias("low")).join(F.broadcast(bands), "low", "left_semi")
    own = F.expr(f"transform(sequence(0, size(k) - {SHINGLE}), i -> named_struct('gram', array_join(slice(k, i + 1, {SHINGLE}), ' '), 'at', cast(at + i AS bigint)))")
    shown = met.withColumn("k", F.split("own", " ")).select("doc_id", "mark", F.explode(own).alias("s")).select("doc_id", "mark", "s.gram", "s.at")
    held = shown.join(F.broadcast(wanted), "gram").groupBy("doc_id", "mark", "license", "gram").agg(F.min("at").alias("at"))
    found = held.groupBy("doc_id", "mark", "license").agg(F.count("*").alias("n_shingles"), F.min("at").alias("first_token"))
    share = F.col("n_shingles").cast("double") / F.col("total").cast("double")
    return found.join(F.broadcast(total), "license").withColumn("containment", share).where(F.col("containment") >= CONTAINED).select("doc_id", "license", "n_shingles", "first_token", "containment")


def oracle() -> str:
    """The same in DuckDB, without hashes: each template shingle against each text position."""
    rows = ", ".join(f"('{n}', {len(grams(t))}, '{g}')" for n, t in TEMPLATES.items() for g in grams(t))
    return f"""
WITH tpl(license, total, gram) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS k FROM documents),
g AS (SELECT doc_id, p, array_to_string(k[p + 1 : p + {SHINGLE}], ' ') AS gram FROM (SELECT doc_id, k, unnest(range(0, len(k) - {SHINGLE - 1})) AS p FROM d WHERE len(k) >= {SHINGLE}))
SELECT doc_id, license, count(DISTINCT gram)::BIGINT AS n_shingles, min(p)::BIGINT AS first_token, count(DISTINCT gram)::DOUBLE / max(total)::DOUBLE AS containment
FROM g JOIN tpl USING (gram) GROUP BY doc_id, license HAVING count(DISTINCT gram)::DOUBLE / max(total)::DOUBLE >= {CONTAINED}"""
