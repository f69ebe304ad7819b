"""Operator 5: license scans by patience alignment.

A text's words are aligned with each license template: words unique to both (within the part at hand) are anchors, the
longest increasing subsequence of their places is kept, and the gaps between anchors are aligned in the same way; where
no anchor is left, equal beginnings and ends of the gap are matched. Coverage is the share of the template's words that
are matched. Only templates of which the text holds enough words, counted with repetition, are aligned at all, which is
an upper bound of the coverage and so loses none; in long texts that holds for each window of twice the template's
length, every half window, and of four times its length for texts with gaps, so a license is found wherever it stands
and however often. The words that tell a template from others like it (`KEYS`: name, version, conditions) must be matched
side by side. Of templates that match the same words only the best is reported: that with most words matched.

Null texts and texts without words have no licenses. Repeated rows give repeated results, an empty table an empty one;
columns other than the key and the text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.llm.common import read

#: Public license texts and notices; years and holders are left out.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
}
TEMPLATES |= {
    "AGPL-3.0-header": TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Affero General"),
    "AGPL-3.0-notice": TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Affero General"),
    "BSD-notice": "Released under the BSD License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-header": TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
    "GPL-2.0-notice": TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2"),
    "LGPL-3.0-header": TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Lesser General"),
    "LGPL-3.0-notice": TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Lesser General"),
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
}
#: Words of a template that a text must have side by side, each phrase at one of its places at least.
KEYS = {
    "Apache-2.0-notice": ["apache license", "2.0"],
    "Apache-2.0-header": ["apache license", "2.0"],
    "BSD-notice": ["bsd license"],
    "CC-BY-4.0": ["commons attribution 4.0"],
    "CC-BY-4.0-notice": ["cc by 4.0"],
    "CC-BY-NC-4.0": ["by-nc 4.0"],
    "CC-BY-SA-4.0": ["attribution-sharealike 4.0"],
    "CC-BY-SA-4.0-notice": ["by-sa 4.0"],
    "MIT-notice": ["mit license"],
    "MPL-2.0": ["mozilla public license"],
    "MPL-2.0-notice": ["mozilla public license", "2.0"],
} | {f"{n}-{v}.0-{k}": [f"gnu{w} general public license", f"version {v}"] for n, v, w in (("AGPL", 3, " affero"), ("GPL", 2, ""), ("GPL", 3, ""), ("LGPL", 3, " lesser")) for k in ("notice", "header")}
_EDGES = ".,;:()[]\"'*#/-"


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


_version = re.compile(r"v?([0-9]+)(?:\.0)?").fullmatch


def normal(word: str) -> str:
    """The word without marks at its ends; version 2.0 is 2."""
    word = word.strip(_EDGES)
    m = _version(word)
    return m[1] if m else word


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose second ones increase (patience sorting)."""
    tops, piles, back = [], [], [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[at], piles[at] = y, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (i, j) with a[i] == b[j], both increasing, by patience alignment; None in b matches nothing."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        mine, other = {}, {}
        for k in range(i, p):
            mine[a[k]] = -1 if a[k] in mine else k
        for k in range(j, q):
            if b[k] in mine:
                other[b[k]] = -1 if b[k] in other else k
        anchors = _increasing(sorted((mine[w], k) for w, k in other.items() if k >= 0 and mine[w] >= 0))
        if not anchors:
            continue
        out += anchors
        for (x, y), (u, v) in zip([(i - 1, j - 1), *anchors], [*anchors, (p, q)], strict=True):
            todo.append((x + 1, u, y + 1, v))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.names, self.least = list(templates), least
        self.templates = [[x for x in map(normal, words(t)) if x] for t in templates.values()]
        vocabulary = sorted({w for t in self.templates for w in t})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.templates = [[self.ids[w] for w in t] for t in self.templates]
        self.bags = np.array([np.bincount(t, minlength=len(vocabulary)) for t in self.templates])
        self.keys = []  # for each template and phrase, the places of the phrase
        for name, t in zip(self.names, self.templates, strict=True):
            phrases = [[self.ids.get(normal(w), -1) for w in p.split()] for p in KEYS.get(name, ())] if templates.get(name) == TEMPLATES.get(name) else []
            self.keys.append([[range(i, i + len(p)) for i in range(len(t)) if t[i : i + len(p)] == p] for p in phrases])
        self.needed = np.array([least * len(t) for t in self.templates])

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, after the last word) of every template covered enough; the best place of each.

        The template with most words matched comes first, and its words are out of the others' reach.
        """
        raw = words(text)
        seen = {}
        for w in set(raw):
            i = self.ids.get(normal(w))
            if i is not None:
                seen[w] = i
        if not seen:
            return []
        some = np.unique(list(seen.values()))
        todo = np.flatnonzero(self.bags[:, some].sum(axis=1) >= self.needed).tolist()
        if not todo:
            return []
        get = seen.get
        ids = np.array([get(w, -1) for w in raw], np.int64)
        filled = np.concatenate(([0], np.cumsum([normal(w) != "" for w in raw])))
        places = {k: best for k in todo if (best := self._place(k, ids, filled))}
        out = {}
        while places:
            k = max(places, key=lambda k: (round(places[k][0] * len(self.templates[k])), places[k][0], -k))
            out[k] = _, start, end = places.pop(k)
            ids[start:end] = -1
            for x in [x for x, (_, a, b) in places.items() if a < end and start < b]:
                if best := self._place(x, ids, filled):
                    places[x] = best
                else:
                    del places[x]
        return [(self.names[k], *out[k]) for k in sorted(out)]

    def _told(self, k: int, pairs: list[tuple[int, int]], start: int, filled: np.ndarray) -> bool:
        """Whether each key phrase is matched somewhere without other words in between."""
        at = dict(pairs)
        side_by_side = lambda p: all(i in at for i in p) and filled[start + at[p[-1]]] - filled[start + at[p[0]]] == len(p) - 1
        return all(any(map(side_by_side, phrase)) for phrase in self.keys[k])

    def _place(self, k: int, ids: np.ndarray, filled: np.ndarray) -> tuple[float, int, int] | None:
        template, bag, n = self.templates[k], self.bags[k], len(self.templates[k])
        mine = (ids >= 0) & (bag[ids] > 0)
        before = np.concatenate(([0], np.cumsum(mine)))
        # windows of 2 n and of 4 n, every n
        starts = [np.arange(0, max(1, len(ids) - n), n), np.arange(0, max(1, len(ids) - 3 * n), n)]
        ends = [np.minimum(s + width * n, len(ids)) for s, width in zip(starts, (2, 4), strict=True)]
        for e in ends:
            e[-1] = len(ids)
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        best = None
        for s in np.flatnonzero(before[ends] - before[starts] >= self.needed[k]).tolist():
            window = ids[starts[s] : ends[s]]
            held = np.bincount(window[mine[starts[s] : ends[s]]], minlength=len(bag))
            if np.minimum(held, bag).sum() < self.needed[k]:
                continue
            pairs = align(template, [x if x >= 0 else None for x in window.tolist()])
            if len(pairs) >= self.needed[k] and (best is None or len(pairs) / n > best[0]) and self._told(k, pairs, int(starts[s]), filled):
                best = (len(pairs) / n, int(starts[s]) + pairs[0][1], int(starts[s]) + pairs[-1][1] + 1)
        return best


def license_scan(docs: DataFrame, least: float = 0.8, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, licenses: array of name, coverage, start and end in words) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, least)
        for b in batches:
            found = [[dict(zip(("name", "coverage", "start", "end"), x, strict=True)) for x in s.scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(struct))], [key, "licenses"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, licenses array<struct<name: string, coverage: double, start: int, end: int>>")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, the best coverage, and name:coverage:start:end of each license, of every document."""
    out = license_scan(read(spark, sf_dir, "documents"))
    each = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], F.format_number(x["coverage"], 4), x["start"], x["end"]))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"), F.array_join(each, ",").alias("licenses"))
