"""License scans by conditional compression.

Candidate blocks are runs of lines with license words, grown over neighbouring lines and runs where these complete the
wording of a template, however it is wrapped.  Each block is compressed alone and with every template as a
zstandard raw-content dictionary; templates are ranked by how much smaller the dictionary makes the block (ties:
template name), and the winners, those within ``MARGIN`` of the best, are confirmed by the exact differences in wording.

Texts without a license word never leave the JVM; the rest is scanned row by row in the task that reads it, so nothing
shuffles.  Templates are a parameter of bounded size (``MAX_TEMPLATE_BYTES``, checked) and travel with the function.

Defined cases: null or empty texts have no block; a block that no template makes smaller gets a null license and the
verdict ``none``; repeated rows and null keys each keep rows of their own; other columns are dropped; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that make a line a candidate.
CUES = r"licen[cs]|copyright|spdx|warrant|redistribut|permission is|public domain|all rights reserved|creative commons|\bcc[- ]by\b|\bcc0\b"
#: Lines without a cue that may stand between two lines of one block.
MAX_GAP = 2
MAX_TEMPLATE_BYTES = 4 << 20
#: Templates whose size reduction is this close to the best one are compared by wording.
MARGIN = 0.15
#: Share of a template's words that must stand in the block in order.
MIN_WORDING = 0.8

#: Public wording of common notices, (name, wording).  Fixed values.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "All rights reserved": "All rights reserved.",
}

WORD = re.compile(r"\w+(?:[.-]\w+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def blocks(text: str, cue: re.Pattern, gap: int = MAX_GAP) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each candidate block."""
    lines = text.split("\n")
    hits = [i for i, line in enumerate(lines) if cue.search(line)]
    runs: list[list[int]] = []
    for i in hits:
        if runs and i - runs[-1][1] <= gap + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return [(a, z, "\n".join(lines[a:z + 1])) for a, z in runs]


def differences(template: list[str], block: list[str]) -> tuple[float, list[str]]:
    """Share of the template's words found in order, and what differs between its first and its last found word, as
    ``-old +new``.  What surrounds the wording in the block is not a difference."""
    matcher = SequenceMatcher(None, template, block, autojunk=False)
    found = [m for m in matcher.get_matching_blocks() if m.size]
    if not found:
        return 0.0, [f"-{' '.join(template)}"]
    out = []
    for kind, a1, a2, b1, b2 in matcher.get_opcodes():
        if kind == "equal" or kind == "insert" and a1 in (0, len(template)):
            continue
        if kind == "replace" and (a1 == 0 or a2 == len(template)):
            b1, b2 = (max(b1, b2 - (a2 - a1)), b2) if a1 == 0 else (b1, min(b2, b1 + (a2 - a1)))
        out.append(" ".join(([f"-{' '.join(template[a1:a2])}"] if a2 > a1 else []) + ([f"+{' '.join(block[b1:b2])}"] if b2 > b1 else [])))
    return sum(m.size for m in found) / len(template), out


class Scanner:
    """Templates ready for compression and comparison."""

    def __init__(self, templates: Mapping[str, str], level: int = 19):
        self.names = sorted(templates)
        self.words = {n: words_of(templates[n]) for n in self.names}
        options = dict(write_checksum=0, write_content_size=0, write_dict_id=0)
        self.alone = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(level, **options))
        self.given = {n: zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(self._text(templates[n]), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            compression_params=zstandard.ZstdCompressionParameters.from_level(level, **options)) for n in self.names}

    @staticmethod
    def _text(text: str) -> bytes:
        data = " ".join(text.lower().split()).encode()
        return data.ljust(8)  # the library takes no shorter dictionary

    def rank(self, block: str) -> list[tuple[float, str]]:
        """(size reduction, template) from the greatest reduction on."""
        data = self._text(block)
        plain = len(self.alone.compress(data))
        return sorted(((1 - len(self.given[n].compress(data)) / plain, n) for n in self.names), key=lambda x: (-x[0], x[1]))

    def scan(self, block: str, min_wording: float) -> tuple[str | None, float, str, float, list[str], str | None]:
        """(license, reduction, verdict, wording, differences, runner-up)"""
        ranked = self.rank(block)
        if not ranked or ranked[0][0] <= 0:
            return None, 0.0, "none", 0.0, [], None
        text = words_of(block)
        # Templates that save almost as much as the best are told apart by their exact wording: the share of it that is
        # there, then its length.
        close = [x for x in ranked if x[0] >= ranked[0][0] - MARGIN]
        compared = [(*differences(self.words[n], text), r, n) for r, n in close]
        share, diff, reduction, name = max(compared, key=lambda x: (x[0], len(self.words[x[3]]), x[2]))
        verdict = "exact" if not diff else "variant" if share >= min_wording else "unconfirmed"
        other = next((n for _, n in ranked if n != name), None)
        return name, round(reduction, 6), verdict, round(share, 6), diff, other

    def grown(self, text: str, runs: list[tuple[int, int, str]], min_wording: float) -> list[tuple[int, int, str]]:
        """The blocks, each with the lines around it that belong to a template's wording; blocks that meet become one."""
        lines = text.split("\n")
        known: dict[int, list[str]] = {}
        spans = sorted(self._span(lines, known, first, last, min_wording) for first, last, _ in runs)
        out: list[list[int]] = []
        for a, z in spans:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], z)
            else:
                out.append([a, z])
        return [(a, z, "\n".join(lines[a:z + 1])) for a, z in out]

    def _span(self, lines: list[str], known: dict[int, list[str]], first: int, last: int, min_wording: float) -> tuple[int, int]:
        """[first, last] and the lines that hold the best confirmed template's wording, if it reaches beyond them."""
        def words(i: int) -> list[str]:
            if i not in known:
                known[i] = words_of(lines[i])
            return known[i]

        best, span = (0.0, 0), (first, last)
        for n in self.names:
            template = self.words[n]
            reach = len(template) * 5 // 4  # a variant may have some more words
            lo, hi = first, last
            for step in (-1, 1):
                at, held = (first if step < 0 else last) + step, 0
                while 0 <= at < len(lines) and held < reach:
                    held += len(words(at))
                    lo, hi = min(lo, at), max(hi, at)
                    at += step
            around = [(w, i) for i in range(lo, hi + 1) for w in words(i)]
            if not template or (Counter(template) & Counter(w for w, _ in around)).total() < min_wording * len(template):
                continue
            found = [m for m in SequenceMatcher(None, template, [w for w, _ in around], autojunk=False).get_matching_blocks() if m.size]
            share = sum(m.size for m in found) / len(template)
            runs = [m for m in found if m.size > 1]
            own = any(around[m.b][1] <= last and around[m.b + m.size - 1][1] >= first for m in runs)  # else of another block
            if own and share >= min_wording and (share, len(template)) > best:
                best = share, len(template)
                span = min(first, around[runs[0].b][1]), max(last, around[runs[-1].b + runs[-1].size - 1][1])
        return span


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES,
                 cues: str = CUES, min_wording: float = MIN_WORDING) -> DataFrame:
    """(key, block, first_line, last_line, license, reduction, verdict, wording, differences, runner_up): a row for each
    candidate block.  Verdicts: exact, variant (wording above the limit), unconfirmed, none."""
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_BYTES} bytes")
    templates = dict(templates)
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), *T._parse_datatype_string(
        "block int, first_line int, last_line int, license string, reduction double, verdict string, wording double, "
        "differences array<string>, runner_up string").fields])
    arrow = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string()]
    candidates = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").rlike(f"(?i){cues}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, cue, memo = Scanner(templates), re.compile(cues, re.IGNORECASE), {}
        for b in batches:
            owner, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, (first, last, block) in enumerate(scanner.grown(t, blocks(t, cue), min_wording)):
                    if block not in memo:
                        if len(memo) > 10_000:
                            memo.clear()
                        memo[block] = scanner.scan(block, min_wording)
                    owner.append(i)
                    rows.append((n, first, last, *memo[block]))
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, arrow)]],
                                             names=schema.fieldNames())

    return candidates.mapInArrow(run, schema).withColumnRenamed("_key", key)
