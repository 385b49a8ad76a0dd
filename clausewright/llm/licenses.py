"""Licence scan: Dice coefficient over word bigrams against licence templates.

Texts are normalised to lower-case words, so line breaks, comment marks and punctuation don't part a
licence. Any run of consecutive words may be the licence, at any place of a text. Two sets of ``a``
and ``b`` bigrams can only reach a coefficient ``t`` if ``a * t / (2 - t) <= b <= a * (2 - t) / t``:
templates whose bigrams a text lacks are never compared, and runs are tried within these sizes only.
Sizes are of sets: a run of many words with few different bigrams is a small one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .common import read, text_or_empty

THRESHOLD = 0.9

# The names under which notices mention a licence, in the usual spellings.
_NAMES = (
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", "the Apache License 2.0"),
    ("Apache-2.0", "the Apache 2.0 License"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-ND-4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("ISC", "the ISC License"),
    ("MIT", "the MIT License"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "the Mozilla Public License 2.0"),
)

# The sentences around these names.
_NOTICES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is released under {}.")

_GNU = (
    "This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License "
    "as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
    "governing permissions and limitations under the License.",
)
#: What the long licences are known by, in texts of their own as in the files they cover: standard headers and clauses that name the licence.
_HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", _APACHE[0]),
    ("Apache-2.0", " ".join(_APACHE[:2])),
    ("Apache-2.0", " ".join(_APACHE)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *(
        (f"{name}-{version if '.' in version else version + '.0'}", _GNU.format(what=what, stop=stop, kind=kind, comma=comma, version=version))
        for name, kind, version, stop, comma in (("GPL", "", "1", ";", ";"), ("LGPL", "Library ", "2", ";", ";"), ("GPL", "", "2", ";", ";"), ("GPL", "", "3", ":", ","), ("LGPL", "Lesser ", "2.1", ";", ";"), ("LGPL", "Lesser ", "3", ":", ","), ("AGPL", "Affero ", "3", ":", ","))
        for what in (("library", "program") if name == "LGPL" else ("program",))
    ),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    *((key, name.removeprefix("a ").removesuffix("License") + "Public License") for key, name in _NAMES if name.startswith("a ")),
)

# Notices, headers, and the short licences' full texts, whole and by those paragraphs that no other licence has.
TEMPLATES = (
    *((key, notice.format(name)) for key, name in _NAMES for notice in _NOTICES),
    *_HEADERS,
    ("BSD-2-Clause", " ".join(_BSD[:3])),
    ("BSD-2-Clause", " ".join((*_BSD[:3], _BSD[4]))),
    ("BSD-3-Clause", _BSD[3]),
    ("BSD-3-Clause", " ".join(_BSD[:4])),
    ("BSD-3-Clause", " ".join(_BSD)),
    ("ISC", _ISC[0]),
    ("ISC", _ISC[1]),
    ("ISC", " ".join(_ISC)),
    ("MIT", _MIT[0]),
    ("MIT", _MIT[1]),
    ("MIT", _MIT[2]),
    ("MIT", " ".join(_MIT)),
    ("MIT", " ".join(_MIT[:2])),
    ("0BSD", " ".join((_ISC[0].split(", provided that")[0] + ".", _ISC[1]))),
    ("Zlib", " ".join(license_texts.ZLIB)),
    ("Zlib", " ".join(license_texts.ZLIB[1:])),
    ("BSL-1.0", license_texts.BOOST[0]),
    ("BSL-1.0", " ".join(license_texts.BOOST)),
    ("Unlicense", " ".join(license_texts.UNLICENSE[:3])),
    ("Unlicense", " ".join(license_texts.UNLICENSE)),
    ("Apache-2.0", " ".join(license_texts.APACHE_TERMS)),
)

_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(tokens: list[str]) -> set[tuple[str, str]]:
    return set(zip(tokens, tokens[1:]))  # noqa: B905


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        made = [(key, b) for key, b in ((k, bigrams(words(t))) for k, t in templates) if b]
        self.keys, self.sets = [key for key, _ in made], [b for _, b in made]
        self.threshold = threshold
        self.least = [math.ceil(len(b) * threshold / (2 - threshold) - 1e-9) for b in self.sets]
        self.most = [math.floor(len(b) * (2 - threshold) / threshold + 1e-9) for b in self.sets]
        self.owners: dict[tuple[str, str], list[int]] = {}
        for k, b in enumerate(self.sets):
            for pair in b:
                self.owners.setdefault(pair, []).append(k)
        self.known = frozenset(self.owners)

    def scan(self, text: str) -> tuple[str | None, float]:
        """The licence and coefficient of the run that explains most: by shared bigrams times coefficient, then coefficient, then name."""
        tokens = words(text)
        pairs = list(zip(tokens, tokens[1:]))  # noqa: B905
        present = self.known.intersection(pairs)
        shared = Counter(k for pair in present for k in self.owners[pair])
        # What a template can explain at most: a run of nothing but the bigrams it shares with the text.
        likely = sorted(((2.0 * n * n / (n + len(self.sets[k])), k) for k, n in shared.items() if n >= self.least[k]), reverse=True)
        best: tuple[float, float, str] | None = None
        places: _Places | None = None
        for most, k in likely:
            if best is not None and most < best[0] - 1e-9:
                break
            places = places or _Places(pairs)
            found = self._runs(places, k)
            if found and (best is None or (-found[0], -found[1], self.keys[k]) < (-best[0], -best[1], best[2])):
                best = *found, self.keys[k]
        return (best[2], best[1]) if best else (None, 0.0)

    def _runs(self, places: _Places, k: int) -> tuple[float, float] | None:
        """The best run for a template. Among the best ones is one that begins with a bigram of the template
        which the run has only there, and ends so too: other ends can go without a shared bigram going.

        So a start only reaches to the next place of its bigram, and all starts together look at each
        place once for each bigram of the template at most. A run's bigrams are the places whose last
        place lies before its start; it has ``most`` of them at most.
        """
        size, least, most = len(self.sets[k]), self.least[k], self.most[k]
        before, after, ids = places.before, places.after, places.ids
        wanted = np.zeros(places.distinct, bool)
        wanted[[i for i in map(places.number.get, self.sets[k]) if i is not None]] = True
        hit = wanted[ids]
        starts = np.flatnonzero(hit)
        best = None
        for start in starts[: len(starts) - least + 1].tolist():
            end = int(after[start])
            new = np.flatnonzero(before[start : min(end, start + 2 * most)] < start)[:most]
            if len(new) < most and end > start + 2 * most:
                new = np.flatnonzero(before[start:end] < start)[:most]
            n = np.flatnonzero(hit[start + new])  # the run's shared bigrams, by how many bigrams it has before them
            if len(n) < least:
                continue
            x = np.arange(least, len(n) + 1)
            d = 2.0 * x / (n[least - 1 :] + 1 + size)
            score = np.where(d >= self.threshold - 1e-9, x * d, -1.0)
            at = int(score.argmax())
            if score[at] > 0:
                top = float(score[at])
                ties = np.flatnonzero(score == top)
                got = top, float(d[ties].max())
                if best is None or got > best:
                    best = got
                if x[at] == size and got[1] == 1.0:
                    break  # the template itself
        return best


class _Places:
    """Where the bigrams of a text stand: each place's bigram as a number, and the bigram's last place before and next one after it."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.number: dict[tuple[str, str], int] = {}
        number = self.number
        self.ids = np.fromiter((number.setdefault(p, len(number)) for p in pairs), np.int64, len(pairs))
        self.distinct = len(number)
        order = np.argsort(self.ids, kind="stable")
        same = self.ids[order][1:] == self.ids[order][:-1]
        self.before = np.full(len(pairs), -1, np.int64)
        self.after = np.full(len(pairs), len(pairs), np.int64)
        self.before[order[1:][same]] = order[:-1][same]
        self.after[order[:-1][same]] = order[1:][same]


@lru_cache(maxsize=4)
def _templates(templates: tuple[tuple[str, str], ...], threshold: float) -> Templates:
    return Templates(templates, threshold)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license and dice of every whole text: of all runs of words that reach the threshold with a template, the one that explains most.

    That is the one with the most shared bigrams times coefficient: a licence's full text comes
    before a part of it that another licence shares, and before a mention of another one.

    Defined results: license is null and dice 0 without such a run, as for a null or empty
    text; of equal ones the name first in the alphabet wins; repeated rows each get their
    row; an empty table gives an empty result; other columns are not read.
    """
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    id_type = source.schema.fields[0].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(templates, threshold)
        for batch in it:
            got = [known.scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([round(g[1], 6) for g in got], pa.float64())], names=[id_col, "license", "dice"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, license string, dice double")


def op2_license_scan(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))


_VALUES = ",\n".join("  ('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES)
SQL = f"""
WITH template(license, body) AS (VALUES
{_VALUES}),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT r, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM doc),
own AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM worded WHERE len(w) >= 2),
known AS (
  SELECT row_number() OVER () AS k, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT license, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM template)),
part AS (SELECT k, len(b) AS size, unnest(b) AS gram FROM known),
hit AS (
  SELECT r, k, size, gram, p, lag(p) OVER w AS before, lead(p) OVER w AS after
  FROM (SELECT r, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS p FROM own) JOIN part USING (gram) WINDOW w AS (PARTITION BY r, k, gram ORDER BY p)),
likely AS (SELECT r, k FROM hit GROUP BY r, k HAVING count(DISTINCT gram) >= any_value(size) * {THRESHOLD / (2 - THRESHOLD)} - 1e-9),
-- a run whose first or last bigram it has twice scores the same without it
run AS (
  SELECT a.r, a.k, a.p AS first, z.p AS last FROM hit a JOIN likely USING (r, k) JOIN hit z ON a.r = z.r AND a.k = z.k
  AND z.p - a.p + 1 >= a.size * {THRESHOLD / (2 - THRESHOLD)} - 1e-9 AND (a.after IS NULL OR z.p < a.after) AND (z.before IS NULL OR z.before < a.p)),
counted AS (
  SELECT r, license, len(b) AS size, len(list_distinct(g[first:last])) AS n, len(list_intersect(list_distinct(g[first:last]), b)) AS x
  FROM run JOIN own USING (r) JOIN known USING (k)),
scored AS (SELECT r, license, x, 2.0::DOUBLE * x / (n + size) AS dice FROM counted WHERE 2 * x >= {THRESHOLD} * (n + size) - 1e-9),
best AS (SELECT r, license, dice FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY x * dice DESC, dice DESC, license) = 1)
SELECT doc_id, license, coalesce(round(CAST(dice AS DOUBLE), 6), 0.0) AS dice FROM doc LEFT JOIN best USING (r)
"""
