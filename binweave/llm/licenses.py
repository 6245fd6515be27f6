"""Licence scan: canonical digests of entire texts, looked up among those of known licences.

Canonical form: lower case; copyright and rights notices dropped; everything but letters
and digits becomes one space; equivalent spellings become one. The form doesn't depend on
where lines break: a notice is known by its own shape, a copyright sign with a year (or the
word and the sign together) and the holder after it, up to the sentence's end, the next
notice or a word with which licences begin, within HOLDER characters; where none of these
comes, the sign and years alone go. Text that merely speaks of copyright stays. The whole
text of a document is looked up by the SHA-256 of that form in a hash join with the
known digests (a fixed table of some dozens of rows, so it may be broadcast: NOTICES,
license_texts, and license_digests for the long texts).

Two more looks find licences within a document, in the row itself: each line as a text
of its own, if its canonical length is that of a known text; and blocks of any lines,
wherever the opening of a known full text stands in the canonical form, cut to the
lengths of the texts that open so. Both are checked by the same digests.

Defined results: null and empty texts match nothing and have the digest of the empty
text; repeated rows give repeated rows, and rows with null or equal ids each their own;
an empty table gives no rows; very long texts are taken whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole
from .license_texts import TEXTS

# Spellings taken as equal (the second is kept), and the texts of known licences and notices.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("version 2 0", "version 2"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("fulfil", "fulfill"), ("analyse", "analyze"), ("favour", "favor"), ("modelled", "modeled"), ("programme", "program")]
_YEAR = r"(?:(?:19|20)[0-9][0-9]|19yy|<year>|\[year\]|\[yyyy\]|\{yyyy\}|yyyy)"
_YEARS = rf"{_YEAR}(?:[ ,/–-]+(?:{_YEAR}|present|[0-9][0-9]))*"
#: How a notice begins, in lower case with single spaces.
NOTICE = rf"(?:portions )?(?:(?:\(c\)|©) ?)?(?:copyright[ :,]*(?:\(c\)|©)(?:[ :,]*{_YEARS})?|(?:copyright|\(c\)|©)[ :,]*{_YEARS})"
#: Abbreviations in holders' names that end no sentence, and words with which a licence begins, or goes on after a notice.
SHORT = r"([ ,])(inc|ltd|corp|co|llc|jr|sr|dr|st)\."
BEGINS = "this permission redistribution everyone licensed released license licence copying preamble version distributed unless".split() + [
    "all rights reserved", "apache license", "gnu general", "gnu lesser", "gnu library", "gnu affero", "gnu free", "mozilla public", "creative commons", "boost software", "the artistic", "the mit", "mit license", "isc license", "bsd license", "do what", "statement of purpose",
]
HOLDER = 200
#: The holder: up to a sentence's end (initials end none) or a beginning, which stays.
HELD = rf"^.{{0,{HOLDER}}}?(?:[^ .][^ .]\.(?: |$)|( (?:{'|'.join(BEGINS)})[ ,.:]))"
RIGHTS = "all rights reserved"
NOTICES = {
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        "Released under the ISC License.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License.", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["Released under the Unlicense."],
}

# Titles that may stand above a full text.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"]}


#: Words of which every known text has one, lines without are passed over; characters of a full text's opening, and from which length a text counts as full.
TELLING = r"licen[cs]e|permi"
OPENING, FULL_LENGTH = 24, 150


def _spelled(padded: Column) -> Column:
    for a, b in SPELLINGS:
        for _ in range(2):  # neighbours share a space
            padded = F.replace(padded, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(padded)


def _plain(lowered: Column) -> Column:
    return _spelled(F.concat(F.lit(" "), F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form of a whole text."""
    lowered = F.lower(text)
    flat = F.regexp_replace(F.regexp_replace(lowered, r"[ \t\n\x0B\f\r]+", " "), SHORT, "$1$2")
    cut = lambda x: F.when(x.rlike(HELD), F.regexp_replace(x, HELD, "$1")).when(F.length(x) <= HOLDER, "").otherwise(x)
    kept = F.transform(F.split(flat, NOTICE), lambda x, i: F.when(i == 0, x).otherwise(cut(x)))
    marked = F.contains(lowered, F.lit("copyright")) | F.contains(lowered, F.lit("(c)")) | F.contains(lowered, F.lit("©")) | F.contains(lowered, F.lit("reserved"))
    return _plain(F.when(marked, F.replace(F.array_join(kept, " "), F.lit(RIGHTS), F.lit(" "))).otherwise(lowered))


def canonical_text(text: str) -> str:
    """The same form in Python, for the known texts and for tests."""
    flat = re.sub(SHORT, r"\1\2", re.sub(r"[ \t\n\x0B\f\r]+", " ", text.lower()))
    first, *rest = re.split(NOTICE, flat)
    kept = [re.sub(HELD, r"\1", x) if re.search(HELD, x) else "" if len(x) <= HOLDER else x for x in rest]
    out = " " + re.sub(r"[\W_]+", " ", " ".join([first, *kept]).replace(RIGHTS, " ")) + " "
    for a, b in SPELLINGS:
        for _ in range(2):
            out = out.replace(f" {a} ", f" {b} ")
    return out.strip(" ")


def known_rows(texts: dict[str, list[str]] = NOTICES) -> list[tuple[str, str, int, str | None]]:
    """(digest, license, canonical length, opening) of all known texts; short notices have no opening."""
    from .license_digests import FULL

    rows = set()
    for name, own in [*texts.items(), *((k, [v]) for k, v in TEXTS.items())]:
        for x in own:
            titled = [f"{t}\n{x}" for t in TITLES.get(name, [])] if len(x) > 500 else []
            for c in map(canonical_text, [x, *titled]):
                rows.add((hashlib.sha256(c.encode()).hexdigest(), name, len(c), c[:OPENING] if len(c) >= FULL_LENGTH else None))
    return sorted(rows | set(FULL), key=str)


def _blocks(form: Column, openings: dict[str, list[int]]) -> Column:
    """Digests of the blocks of a canonical form that open as a full text does and are as long."""
    table = F.array(*(F.struct(F.lit(o).alias("opening"), F.array(*map(F.lit, lengths)).alias("lengths")) for o, lengths in sorted(openings.items())))

    def of(o: Column) -> Column:
        parts = F.split(form, o["opening"])
        starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(1), lambda n, x: n + F.length(x)) + (i - 1) * OPENING)
        return F.flatten(F.transform(starts, lambda at: F.transform(o["lengths"], lambda n: F.when(at + n - 1 <= F.length(form), F.sha2(F.substring(form, at, n).cast("binary"), 256)))))

    return F.flatten(F.transform(F.filter(table, lambda o: F.contains(form, o["opening"])), of))


def scan_documents(docs: DataFrame, texts: dict[str, list[str]] = NOTICES) -> DataFrame:
    """One row per document: doc_id, text_digest, license (of the whole text, else null), line_licenses and block_licenses (sorted)."""
    rows = known_rows(texts)
    table = F.broadcast(docs.sparkSession.createDataFrame(sorted({r[:2] for r in rows}), "digest string, license string"))
    names = F.create_map(*(F.lit(x) for d, name in sorted({r[:2] for r in rows}) for x in (d, name)))
    lengths, openings = sorted({r[2] for r in rows}), {}
    for _, _, n, opening in rows:
        if opening:
            openings.setdefault(opening, set()).add(n)
    # spellings can only change a line's length by so much, which spares the others the replacements
    change = 2 * max(len(b) - len(a) for a, b in SPELLINGS) + 8
    lines = F.filter(F.split(F.lower("text"), "\r\n|\n|\r"), lambda x: (F.length(x) >= min(lengths) - change) & x.rlike(TELLING))
    forms = F.filter(F.transform(F.array_distinct(lines), _plain), lambda x: F.length(x).isin(lengths))
    named = lambda digests: F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.transform(digests, lambda d: F.try_element_at(names, d))))), ",")
    base = docs.select("doc_id", whole("text").alias("text")).withColumn("form", canonical(F.col("text")))
    found = base.select(
        "doc_id", F.sha2(F.col("form").cast("binary"), 256).alias("digest"), named(F.transform(forms, lambda x: F.sha2(x.cast("binary"), 256))).alias("line_licenses"),
        named(_blocks(F.col("form"), {o: sorted(n) for o, n in openings.items()})).alias("block_licenses"),
    )
    return found.join(table, "digest", "left").select("doc_id", F.col("digest").alias("text_digest"), "license", "line_licenses", "block_licenses")
