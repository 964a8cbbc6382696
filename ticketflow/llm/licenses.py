"""Licence scans by canonical digest: whole texts, normalised and hashed, joined with known licence texts."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts as published, without their copyright lines.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_0 = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
BSL_1 = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEXTS = Path(__file__).with_name("license_texts")
END = "END OF TERMS AND CONDITIONS"


def _published(name: str) -> list[str]:
    """A long licence as published, and without the advice that some have after their terms."""
    text = (TEXTS / f"{name}.txt").read_text()
    return [text, *([text[: text.index(END)], text[: text.index(END) + len(END)]] if END in text else [])]


KNOWN = {
    "MIT": [MIT, "Released under the MIT License."],
    "ISC": [ISC, ISC.replace("and/or distribute", "and distribute")],
    "0BSD": [BSD_0, BSD_0.replace("and/or distribute", "and distribute")],
    "BSL-1.0": [BSL_1],
    "BSD-2-Clause": [BSD_2],
    "BSD-3-Clause": [BSD_3],
    "Apache-2.0": [APACHE_NOTICE, "Licensed under the Apache License, Version 2.0.", *_published("Apache-2.0")],
    "Unlicense": [UNLICENSE],
    "Zlib": [ZLIB],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *_published("GPL-3.0")],
    **{name: _published(name) for name in ("GPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "GFDL-1.3")},
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}

#: How license_passages splits texts.
SPLITS = {"paragraph": r"\n[\t\r ]*\n", "line": r"\n"}

# Fixed values: (pattern, replacement), applied in this order to the text with A-Z lower-cased.
#: Copyright lines: those that begin with the word and a sign, year or placeholder, or with a sign and a year; not sentences about copyright. List marks.
LINES = [
    (r"(^|\n)[\t #*/;.-]*(copyright[\t :]*(by[\t ]|\(c\)|©|&copy;|[0-9]{4}|[<\[{](yyyy|year))|(\(c\)|©)[\t ]*(copyright|[0-9]{4}|[<\[{](yyyy|year))|all rights reserved)[^\n]*", "\n"),
    (r"(^|\n)[\t #*/;]*(\(?([0-9]{1,2}|[a-z]|i{1,3}|iv|vi?)[.)]|[*•+-])[\t ]+", "\n"),
]
#: What separates words.
MARKS = [
    (r"https?://", " "),
    (r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2022}]+", " "),
]
#: A title before the text; then the published list of equivalent spellings.
WORDS = [
    (r"^ (the )?((mit|expat|x11|isc|zlib|libpng|0bsd|bsd|new|revised|modified|simplified|zero|clause|[0-4]) ){1,6}license ((mit|expat|x11|isc|zlib|libpng|0bsd|bsd|clause|[0-4]) ){0,4}", " "),
    (r" (sub ?licence|sub license)", " sublicense"),
    (r" licence", " license"),
    (r" non commercial", " noncommercial"),
    (r" copyright owner", " copyright holder"),
    (r" per cent ", " percent "),
    (r" (acknowledg|judg)ement", " $1ment"),
    (r" (author|capital|categor|emphas|initial|maxim|minim|optim|organ|real|recogn|util|summar)is(e|es|ed|ing|ation|ations) ", " $1iz$2 "),
    (r" (fav|hon|lab|behavi|col)our", " $1or"),
    (r" (cancel|label|model|signal)l(ed|ing) ", " $1$2 "),
    (r" (cent|calib)re ", " $1er "),
    (r" (analog|catalog)ue", " $1"),
    (r" (off|def)ence", " $1ense"),
    (r" practise", " practice"),
    (r" artefact", " artifact"),
    (r" analyse", " analyze"),
    (r" (program)me ", " $1 "),
    (r" (fulfil|wilful) ", " $1l "),
    (r" whilst ", " while "),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """A text's canonical form: lower case, no copyright lines, title, list marks and punctuation, one spelling, single spaces."""
    c = F.translate(text, UPPER, LOWER)
    for pattern, to in LINES + MARKS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    c = F.concat(F.lit(" "), F.trim(c), F.lit(" "))
    for pattern, to in WORDS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return F.trim(c)


def canonical_text(text: str) -> str:
    """The same for one known text, while the digests are made."""
    c = text.translate(str.maketrans(UPPER, LOWER))
    here = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", p)
    for pattern, to in LINES + MARKS:
        c = re.sub(here(pattern), to, c)
    c = f" {c.strip(' ')} "
    for pattern, to in WORDS:
        c = re.sub(pattern, re.sub(r"\$([0-9])", r"\\\1", to), c)
    return c.strip(" ")


def digests(known: dict[str, list[str]] = KNOWN) -> list[tuple[str, str]]:
    """(digest, licence) of each known text."""
    out = {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, texts in known.items() for t in texts}
    return sorted(out.items())


def license_scan(docs: DataFrame, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """documents -> doc_id, digest, license_id; one row per row of documents, over its whole text.

    A document is a licence if its canonical form has the digest of a known text's; license_id is null otherwise. The
    digest is null for null texts and for those of which nothing is left, which match nothing.
    All of it is DataFrame functions; the known digests, whose number does not depend on the
    data, are broadcast, so there is no shuffle. Repeated rows are answered alike; extra columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(digests(known), "known string, license_id string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text").cast("string")).alias("c"))
    rows = rows.select("doc_id", F.when(F.col("c") != "", F.sha2(F.encode("c", "UTF-8"), 256)).alias("digest"))
    return rows.join(table, F.col("digest") == F.col("known"), "left").select("doc_id", "digest", "license_id")


def _passage_table(known: dict[str, list[str]]) -> list[tuple[str, str, str, int, int, int]]:
    """(unit, digest, licence, text, number of the part, parts) of each part of each known text, split as texts are."""
    out = []
    for text_no, (name, text) in enumerate((n, t) for n, texts in known.items() for t in texts):
        for unit, split in {"text": None, **SPLITS}.items():
            parts = [c for c in map(canonical_text, re.split(split, text) if split else [text]) if c]
            out += [(unit, hashlib.sha256(c.encode()).hexdigest(), name, text_no, k, len(parts)) for k, c in enumerate(parts)]
    return out


def license_passages(docs: DataFrame, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """documents -> doc_id, license_id, places; a row for each licence that a text holds, alone or among other text, and in how many places.

    A licence is held if the text, or lines or paragraphs in a row, have the digests of all lines or paragraphs of a
    known text; parts of which the canonical form leaves nothing, as copyright lines, don't count. The known digests are broadcast; only hits are
    shuffled. Rows that share doc_id and text count once. Null and empty texts give nothing; extra columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(_passage_table(known), "known_unit string, known string, license_id string, text_no int, k int, n int"))
    text = F.col("text")
    units = F.array(*[F.struct(F.lit(unit).alias("unit"), F.filter(F.transform(F.split(text, split) if split else F.array(text), canonical), lambda c: c != "").alias("parts")) for unit, split in {"text": None, **SPLITS}.items()])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.inline(units)).select("doc_id", "h", "unit", F.posexplode("parts").alias("pos", "c"))
    rows = rows.select("doc_id", "h", "unit", "pos", F.sha2(F.encode("c", "UTF-8"), 256).alias("digest"))
    hits = rows.join(table, (F.col("digest") == F.col("known")) & (F.col("unit") == F.col("known_unit")))
    whole = hits.groupBy("doc_id", "h", "unit", "license_id", "text_no", "n", (F.col("pos") - F.col("k")).alias("first")).agg(F.count_distinct("k").alias("found")).filter("found = n")
    places = whole.groupBy("doc_id", "license_id", "unit").agg(F.count_distinct("h", "first").alias("places"))
    return places.groupBy("doc_id", "license_id").agg(F.max("places").alias("places"))


def license_oracle(known: dict[str, list[str]] = KNOWN) -> str:
    """DuckDB SQL with the result of license_scan over documents."""
    c = f"translate(text, '{UPPER}', '{LOWER}')"
    for pattern, to in LINES + MARKS:
        to = "chr(10)" if to == "\n" else f"'{to}'"
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    c = f"' ' || trim({c}, ' ') || ' '"
    for pattern, to in WORDS:
        c = f"regexp_replace({c}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in digests(known))
    return f"""WITH known(known, license_id) AS (VALUES {rows}),
c AS (SELECT doc_id, trim({c}, ' ') AS c FROM documents),
d AS (SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM c)
SELECT doc_id, digest, license_id FROM d LEFT JOIN known ON digest = known"""
