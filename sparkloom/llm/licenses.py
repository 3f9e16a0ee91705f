"""Licence scans by patience alignment.

Text and licence template are lower-cased words.  Words that occur once in both are
anchors; the longest increasing run of them, in template order, is kept, and the gaps
between are aligned the same way, after equal words at their ends.  Coverage is the
share of the template's words that align.

Templates named ``-text`` are whole licences (MIT, ISC, BSD, Unlicense, zlib).  The others are
fragments: notices, file headers and the sentences that licences begin with; there,
coverage 1.0 means that the fragment stands in the text, not the whole licence.  A text that
holds less than LEAST of any template, or a licence without one, gives nothing.

A text is searched wherever it could hold a template: a window around each place
where a word of the template stands that is rare in prose, so that repeated notices
are found too.  A wide window may hold two copies and then has few words that occur once;
so windows of the template's own length, laid by where the word stands in it, are also
aligned where the wide one doesn't give the whole template in one piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common

_WORD = re.compile(r"[a-z0-9]+")
#: Words of templates that are no sign of one.
_COMMON = frozenset("a an and any are as at be by for from in is it its may no not of on or that the this to under with without you your work above all copy file free have if more other see set shall such they use version 0 1 2 3 4".split())

#: Share of a template's words that must align.
LEAST = 0.8
#: The licences' own words, without punctuation.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2.0",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4.0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "epl-2.0-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    # whole licences
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
}


def words_at(text: str) -> list[tuple[str, int, int]]:
    """Words with their places in the text.  Lower-casing that changes a text's length
    (a few letters do) is of ASCII letters alone."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a and b that patience aligns, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append((j, n))
        if i == j or k == n:
            continue
        seen_a, seen_b = Counter(a[i:j]), Counter(b[k:n])
        where = {w: x for x, w in enumerate(a[i:j], i) if seen_a[w] == 1 and seen_b[w] == 1}
        anchors = [(where[w], y) for y, w in enumerate(b[k:n], k) if w in where]
        if not anchors:
            continue
        kept = [anchors[x] for x in longest_increasing([p for p, _ in anchors])]
        out += kept
        for (x, y), (u, v) in zip([(i - 1, k - 1), *kept], [*kept, (j, n)], strict=True):
            todo.append((x + 1, u, y + 1, v))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> None:
        self.least = least
        self.templates = {k: _WORD.findall(v) for k, v in templates.items()}
        self.vocabulary = {k: Counter(v) for k, v in self.templates.items()}
        self.all = frozenset(w for v in self.templates.values() for w in v)
        self.signs = {k: frozenset(v) - _COMMON or frozenset(v) for k, v in self.templates.items()}
        self.any_sign = frozenset().union(*self.signs.values())

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of coverage ``least`` or more, by start; spans of
        one template don't overlap, the better covered going first."""
        if not text:
            return []
        present = self.all.intersection(_WORD.findall(text.lower()))
        if present.isdisjoint(self.any_sign):
            return []
        likely = [k for k, v in self.vocabulary.items() if sum(n for w, n in v.items() if w in present) >= self.least * len(self.templates[k])]
        if not likely:
            return []
        at = words_at(text)
        words = [w for w, *_ in at]
        out = []
        for name in likely:
            template, signs = self.templates[name], self.signs[name]
            reach = 2 * len(template)
            need, own = self.least * len(template), frozenset(template)
            spots = {w: [p for p, x in enumerate(template) if x == w] for w in signs}
            places = [i for i, w in enumerate(words) if w in signs]
            found = []
            done: set[tuple[int, int]] = set()
            for i in places:
                a, z = max(0, i - reach), min(len(words), i + reach)
                # align what lies between the first and the last sign near this one
                pairs = align(words[a:z], template)
                # a window may hold words of a neighbouring notice: keep the densest stretch around i
                pairs = self._around(pairs, i - a, len(template))
                at_words = [(a + x, y) for x, y in pairs]
                if len(pairs) < len(template) or pairs[-1][0] - pairs[0][0] >= len(template):
                    tries = [at_words] if len(pairs) >= need else []
                    for first in (i - p for p in spots[words[i]]):
                        for slack in (0, len(template) // 5):
                            a, z = max(0, first - slack), min(len(words), first + len(template) + slack)
                            if sum(w in own for w in words[a:z]) < need:
                                continue
                            pairs = self._around(align(words[a:z], template), i - a, len(template))
                            if len(pairs) >= need:
                                tries.append([(a + x, y) for x, y in pairs])
                    # the most words aligned, less the words between that aren't
                    at_words = max(tries, key=lambda t: 2 * len(t) - (t[-1][0] - t[0][0]), default=[])
                if len(at_words) < need:
                    continue
                pairs, s, e = at_words, at_words[0][0], at_words[-1][0]
                if (s, e) not in done:
                    done.add((s, e))
                    found.append((len(pairs) / len(template), s, e))
            taken: list[tuple[int, int]] = []
            for cover, s, e in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
                if all(e < x or y < s for x, y in taken):
                    taken.append((s, e))
                    out.append((name, at[s][1], at[e][2], round(cover, 6)))
        return sorted(out, key=lambda f: (f[1], f[0], f[2]))

    @staticmethod
    def _around(pairs: list[tuple[int, int]], i: int, size: int) -> list[tuple[int, int]]:
        """The pairs around place i without gaps of over half the template (8 words at least)."""
        gap = max(8, size // 2)
        mid = next((k for k, (x, _) in enumerate(pairs) if x == i), None)
        if mid is None:
            return []
        lo = hi = mid
        while lo and pairs[lo][0] - pairs[lo - 1][0] <= gap:
            lo -= 1
        while hi + 1 < len(pairs) and pairs[hi + 1][0] - pairs[hi][0] <= gap:
            hi += 1
        return pairs[lo : hi + 1]


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_licenses, coverage (the best, 0.0 if none), licenses (template:start:end:coverage,
    comma-joined; code points, end exclusive) of every row.

    A null or empty text has none.  Repeated rows give repeated results, an empty table an empty
    one.  Very long texts are scanned whole, and time grows with their length.  Of spans of one
    template that tie, the first is taken.  Reads doc_id and text alone."""
    common.bounded_batches(docs.sparkSession)
    scanner = scanner or Scanner()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for i, t in zip(x["doc_id"], x["text"], strict=True):
                found = scanner.scan(t)
                rows.append((i, len(found), max((f[3] for f in found), default=0.0), ",".join(f"{k}:{a}:{b}:{c:g}" for k, a, b, c in found)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_licenses", "coverage", "licenses"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_licenses long, coverage double, licenses string")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
