"""License scan: passages against license templates by the Dice coefficient of word bigrams.

A text's passages are its lines, its blocks (lines between blank ones), the whole, and its spans:
all runs of words, across lines and blocks, of up to ``(2 - least) / least`` times a template's number
of words. Texts and templates are normalised alike: A-Z lower-cased, words are runs of letters and
digits, ``licence`` is spelled ``license``. A passage matches a template if twice the number of their
common bigrams is at least ``LEAST`` times the sum of both numbers of distinct bigrams. Of a template's
matching spans that overlap, the best one counts (then the shorter, then the earlier), and only where
it is better than each line, block or whole text with the same template that has a line in common with
it, than each that holds all its lines and matches another template, and not within a better span. A template
is a candidate only if the text has enough of its bigrams for that coefficient; texts without a
candidate are done after one set intersection.

Texts are read in one pass without a shuffle; templates are a parameter that goes to every task.
Null and empty texts match nothing. Equal coefficients go to the smaller kind of passage, then to
the earlier one, then to the template first in the alphabet. Repeated rows are judged each. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from importlib.resources import files
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.tables import table
from .common import ship
from .registry import register

LEAST = 0.8
#: Public license texts and the usual short notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE '
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "MIT": "Released under the MIT License.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"].replace(
    "distribution. THIS", "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may "
    "be used to endorse or promote products derived from this software without specific prior written permission. THIS")
TEMPLATES["LGPL-3.0-notice"] = TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Lesser General")
TEMPLATES["LGPL-2.1-notice"] = TEMPLATES["LGPL-3.0-notice"].replace("version 3", "version 2.1").replace("program", "library")
TEMPLATES["AGPL-3.0-notice"] = TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Affero General")
TEMPLATES["GPL-2.0-notice"] = TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2")
TEMPLATES["Unlicense-full"] = TEMPLATES["Unlicense"] + (
    " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
    "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain. We make this dedication for the benefit of the public at large and to the "
    "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
    "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
    '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please "
    "refer to <https://unlicense.org>")
#: Full texts, one file each, as Debian ships them; templates with the ending ``-full``.
FULL_TEXTS = ("Apache-2.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
#: Usual names of each license, for the notices below; templates ``<id>-notice-<number>``.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 Universal"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GNU GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GNU GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "GNU LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "Unlicense": ("Unlicense",),
}
NOTICES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "Available under the {}.",
           "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the {}.",
           "This software is released under the {}.", "Distributed under the terms of the {}.", "Licensed under {}.",
           "Released under {}.", "Subject to the terms of the {}.")
TEMPLATES |= {f"{n}-full": (files(__package__) / "license_texts" / f"{n}.txt").read_text("utf-8") for n in FULL_TEXTS}
KINDS = ("line", "block", "text", "span")
CLEAN = bytes(b if b == 10 or b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
OUT = ("doc_id long, n_matches long, license string, dice double, kind string, first_line long, last_line long, "
       "matches array<struct<license string, dice double, kind string, first_line long, last_line long>>")
ship(__name__)


def normalised(text: bytes) -> bytes:
    """Lower-cased words with blanks between; line ends stay."""
    return text.translate(CLEAN).replace(b"licence", b"license")


def bigrams(words: list[bytes]) -> set:
    return set(zip(words, words[1:]))


def coefficient(common: int, size: int, other: int) -> float:
    return 2 * common / (size + other)


def add_notices() -> None:
    """The usual notices of each license's names and its SPDX line, but for those that are there."""
    known = {frozenset(bigrams(normalised(t.encode()).split())) for t in TEMPLATES.values()}
    for license, names in NAMES.items():
        texts = [notice.format(name) for name in names for notice in NOTICES] + [f"SPDX-License-Identifier: {license}"]
        for text in texts:
            grams = frozenset(bigrams(normalised(text.encode()).split()))
            if grams not in known:
                known.add(grams)
                TEMPLATES[f"{license}-notice-{sum(n.startswith(f'{license}-notice-') for n in TEMPLATES) + 1}"] = text


add_notices()


class Index:
    """Templates by their bigrams."""

    def __init__(self, templates: dict[str, str]):
        words = {n: normalised(t.encode()).split() for n, t in templates.items()}
        self.grams = {n: bigrams(w) for n, w in words.items()}
        self.places = {n: len(w) - 1 for n, w in words.items()}
        self.having = defaultdict(set)
        for n, found in self.grams.items():
            for g in found:
                self.having[g].add(n)
        self.known = frozenset(self.having)

    def candidates(self, grams: set, least: float) -> list[str]:
        """The templates that some passage of a text with these bigrams can match: at best the
        passage has the bigrams in common and no other."""
        counts: Counter = Counter(chain.from_iterable(self.having[g] for g in self.known & grams))
        return sorted(n for n, c in counts.items() if coefficient(c, c, len(self.grams[n])) >= least)

    def matches(self, words: list[bytes], names: list[str], least: float) -> list[tuple[str, float]]:
        grams = bigrams(words)
        out = []
        for name in names:
            own = self.grams[name]
            if grams and coefficient(min(len(grams), len(own)), len(grams), len(own)) >= least:  # the sizes allow it
                dice = coefficient(len(grams & own), len(grams), len(own))
                if dice >= least:
                    out.append((name, dice))
        return out


def passages(text: bytes) -> list[tuple[int, int, int, list[bytes]]]:
    """``(kind, first line, last line, words)``."""
    lines = [(i, words) for i, words in enumerate(x.split() for x in text.split(b"\n")) if words]
    blocks: list[list] = []
    for i, words in lines:
        if blocks and blocks[-1][-1][0] == i - 1:
            blocks[-1].append((i, words))
        else:
            blocks.append([(i, words)])
    joined = lambda kind, some: (kind, some[0][0], some[-1][0], [w for _, words in some for w in words])
    return [(0, i, i, words) for i, words in lines] + [joined(1, b) for b in blocks] + ([joined(2, lines)] if lines else [])


def scan(text: bytes | None, index: Index, least: float) -> list[tuple[str, float, str, int, int]]:
    """All matches of lines, blocks and the whole, best first."""
    clean = normalised(text or b"")
    names = index.candidates(bigrams(clean.split()), least)
    found = [(-dice, kind, first, name, last) for kind, first, last, some in (passages(clean) if names else [])
             for name, dice in index.matches(some, names, least)]
    return [(name, -dice, KINDS[kind], first, last) for dice, kind, first, name, last in sorted(found)]


def best_spans(hits, before, size: int, longest: int, least: float) -> list[tuple[float, int, int]]:
    """``(dice, first, last)`` of the best spans of bigrams that do not overlap, for a template of
    ``size`` bigrams: ``hits`` marks the places with one of them, ``before`` has the previous place of
    each place's bigram. The best span from a place starts and ends with a hit; a start is tried only
    if enough hits follow it."""
    import numpy as np

    sums = np.concatenate(([0], np.cumsum(hits)))
    starts = np.flatnonzero(hits)
    follow = sums[np.minimum(starts + longest, len(hits))] - sums[starts]
    found = []
    for i in starts[coefficient(follow, follow, size) >= least].tolist():
        new = before[i:i + longest] < i  # the first place of a bigram within the span
        dice = coefficient(np.cumsum(new & hits[i:i + longest]), np.cumsum(new), size)
        n = int(dice.argmax())
        if dice[n] >= least:
            found.append((-float(dice[n]), n, i))
    used, out = np.zeros(len(hits), bool), []
    for dice, n, i in sorted(found):
        if not used[i:i + n + 1].any():
            used[i:i + n + 1] = True
            out.append((-dice, i, i + n))
    return out


def scan_spans(text: bytes | None, index: Index, least: float,
               others: list[tuple[str, float, str, int, int]]) -> list[tuple[str, float, str, int, int]]:
    """The matching spans that are better than the matches ``others`` they share a line with."""
    import numpy as np

    clean = normalised(text or b"")
    words = clean.split()
    names = index.candidates(bigrams(words), least)
    if not names:
        return []
    line = [i for i, x in enumerate(clean.split(b"\n")) for _ in x.split()]
    places, latest, before = defaultdict(list), {}, np.empty(len(words) - 1, np.int64)
    for i, g in enumerate(zip(words, words[1:])):
        before[i] = latest.get(g, -1)
        latest[g] = i
        for n in index.having.get(g, ()):
            places[n].append(i)
    spans = []
    for name in names:
        hits = np.zeros(len(before), bool)
        hits[places[name]] = True
        longest = max(int(index.places[name] * (2 - least) / least), 1)
        for dice, i, j in best_spans(hits, before, len(index.grams[name]), longest, least):
            first, last = line[i], line[j + 1]
            if not any(d >= dice and (a <= last and first <= z if n == name else a <= first and last <= z)
                       for n, d, _, a, z in others):
                spans.append((-dice, i, j, name))
    out: list = []
    better: dict = defaultdict(list)  # those that touch each 1024 places
    for dice, i, j, name in sorted(spans):
        if not any(d < dice and a <= i and j <= z for a, z, d in better[i >> 10]):
            for at in range(i >> 10, (j >> 10) + 1):
                better[at].append((i, j, dice))
            out.append((name, -dice, KINDS[3], line[i], line[j + 1]))
    return out


def scan_all(text: bytes | None, index: Index, least: float) -> list[tuple[str, float, str, int, int]]:
    """All matches, best first."""
    found = scan(text, index, least)
    found += scan_spans(text, index, least, found)
    return sorted(found, key=lambda m: (-m[1], KINDS.index(m[2]), m[3], m[0], m[4]))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_matches, license, dice, kind, first_line, last_line, matches)`` of every row: the
    best match (null if there is none) and all of them. Lines count from 0."""
    texts = dict(TEMPLATES if templates is None else templates)
    schema = to_arrow_schema(StructType.fromDDL(OUT))

    def run(batches):
        import pyarrow as pa

        index = Index(texts)
        names = ("license", "dice", "kind", "first_line", "last_line")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = scan_all(text.as_py(), index, least)
                best = found[0] if found else (None,) * 5
                rows.append((doc_id, len(found), *best, [dict(zip(names, m)) for m in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")
                       ).mapInArrow(run, OUT)


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    clean = lambda c: (f"replace(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "  # noqa: E731
                       "'abcdefghijklmnopqrstuvwxyz'), 'licence', 'license')")
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
with t as (select name, {pairs} as g from (select name, {words.format(clean('body'))} as w from (values {rows}) as t(name, body))),
tg as (select name, len(g) as m, unnest(g) as g from t),
d as (select doc_id, string_split({clean('text')}, chr(10)) as l from documents),
l as (select doc_id, i, {words.format('x')} as w from (select doc_id, unnest(range(0, len(l))) as i, unnest(l) as x from d)),
f as (select *, i - row_number() over (partition by doc_id order by i) as b from l where len(w) > 0),
p as (select doc_id, 0 as kind, i as a, i as z, w from f
    union all select doc_id, 1, min(i), max(i), flatten(list(w order by i)) from f group by doc_id, b
    union all select doc_id, 2, min(i), max(i), flatten(list(w order by i)) from f group by doc_id),
q as (select doc_id, kind, a, z, {pairs} as g from p),
u as (select doc_id, kind, a, z, len(g) as n, unnest(g) as g from q),
m as (select doc_id, kind, a, z, name, cast(2 * count(*) as double) / (n + m) as dice from u join tg using (g)
    group by doc_id, kind, a, z, n, name, m),
r as (select *, row_number() over (partition by doc_id order by dice desc, kind, a, name) as rank,
    count(*) over (partition by doc_id) as n_matches from m where dice >= {LEAST})
select d.doc_id, coalesce(n_matches, 0) as n_matches, name as license, round(dice, 6) as dice,
    case kind when 0 then 'line' when 1 then 'block' when 2 then 'text' end as kind,
    a as first_line, z as last_line
from d left join (select * from r where rank = 1) r using (doc_id)
"""


@register("op7_license_scan", _sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_matches", "license", F.round("dice", 6).alias("dice"), "kind", "first_line", "last_line")
