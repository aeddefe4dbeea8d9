"""License scans by patience alignment.

Words that occur once in the template and once in the text are anchors; the longest run of anchors that
rises in both (longest increasing subsequence) is kept; the gaps between them are aligned alike, and a
gap without anchors by its common start and end. A template's coverage is the share of its words that
the alignment matches; it is found in a text at `least` or more.

No alignment matches more words than text and template have in common (as multisets), so templates
under that bound are not aligned; the result is the same. A text that holds a template more than once
has few unique words, so it is split at the template's rarest word first: see `regions`.

Defined cases: null and empty texts match nothing; templates without words are ignored; each row of
the text table is scanned by itself; rows without any license give no row in `license_scan`, and one
with null license in the query.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, strings, table

LEAST = 0.9
#: The public wording of common notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
}
_WORD = re.compile(r"[0-9a-z.+-]*[0-9a-z]", re.ASCII)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (in order of the first) whose second part rises (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect.bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
        back[k] = at[pile - 1] if pile else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), rising in both. A work list takes the place of recursion."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w for w, n in in_a.items() if n == 1 and in_b.get(w) == 1}
        if not once:
            continue
        where = {b[j]: j for j in range(b0, b1) if b[j] in once}
        kept = rising([(i, where[a[i]]) for i in range(a0, a1) if a[i] in once])
        out += kept
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            if i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def regions(text: list[str], template: list[str], seen: Counter) -> list[tuple[int, int]]:
    """Where the template may stand: around each occurrence of its word that is rarest in the text, as wide
    as the template on either side, overlapping ones joined at most up to the next occurrence."""
    rare = min((w for w in set(template) if w in seen), key=lambda w: (seen[w], w), default=None)
    if rare is None:
        return []
    own, n = template.index(rare), len(template)
    at = [i for i, w in enumerate(text) if w == rare]
    return sorted({(max(0, i - own - n // 2), min(len(text), i - own + n + n // 2 + 1)) for i in at})


class Scanner:
    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.least = least
        self.of = {k: words(v) for k, v in sorted(templates.items()) if words(v)}
        self.counts = {k: Counter(v) for k, v in self.of.items()}
        self.vocabulary = {w for v in self.of.values() for w in v}

    def scan(self, text: str) -> list[dict]:
        """The licenses found, each with its best coverage and the span of words it matches there."""
        w = words(text)
        seen = Counter(x for x in w if x in self.vocabulary)
        out = []
        for name, t in self.of.items():
            need = self.least * len(t)
            if sum(min(n, seen[x]) for x, n in self.counts[name].items()) < need:
                continue
            best = None
            spans = [(0, len(w)), *regions(w, t, seen)]
            for s, e in spans:
                got = align(t, w[s:e])
                if len(got) >= need and (best is None or len(got) > best[0]):
                    best = len(got), s + got[0][1], s + got[-1][1] + 1
            if best:
                out.append({"license": name, "coverage": best[0] / len(t), "start": best[1], "stop": best[2]})
        return out


SCAN = "doc_id long, license string, coverage double, start int, stop int"


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col="doc_id", text_col="text", keep_clean: bool = False) -> DataFrame:
    """One row for each document and license found: (doc_id, license, coverage, start, stop), positions in
    words; with keep_clean also one row (null license) for each document without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        none = [{"license": None, "coverage": None, "start": None, "stop": None}] if keep_clean else []
        for b in batches:
            rows = [(i, x) for i, t in zip(b.column(0).to_pylist(), strings(b), strict=True) for x in scanner.scan(t) or none]
            kinds = {"license": pa.string(), "coverage": pa.float64(), "start": pa.int32(), "stop": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), *(pa.array([x[k] for _, x in rows], v) for k, v in kinds.items())], names=["doc_id", *kinds])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCAN)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), keep_clean=True).select("doc_id", "license", F.round("coverage", 6).alias("coverage"), "start", "stop")
