"""License scans by conditional compression: a window that a template explains shrinks when the template is the raw
dictionary of its compression. Templates are ranked by these reductions and confirmed by their wording.

Candidates lose nothing that could be confirmed: wording confirms a template only if at most a tenth of its words are missing,
so of any words that make up more than a tenth of it one is there. The longest ones, which are rare, are a template's
anchors, and the words around their places in a text, as many as the template may take, are where it is looked for.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, utf8, word_spans

# Texts, parts and notices of widely used public licenses.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software.""",
    "MIT-statement": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version.""",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
this work.""",
    "MIT-warranty": """The software is provided "as is", without warranty of any kind, express or implied, including but not limited
to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or
copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise,
arising from, out of or in connection with the software or the use or other dealings in the software.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so.""",
    "X11-advertising": """Except as contained in this notice, the name of the X Consortium shall not be used in advertising or
otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X
Consortium.""",
    "ISC-warranty": """The software is provided "as is" and the author disclaims all warranties with regard to this software including
all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct,
indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an
action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of
this software.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.""",
    "BSD-warranty": """This software is provided by the copyright holders and contributors "as is" and any express or implied
warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose
are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental,
special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services;
loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract,
strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if
advised of the possibility of such damage.""",
    "BSD-4-Clause-advertising": """All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor.""",
    "BSL-1.0-statement": "Distributed under the Boost Software License, Version 1.0.",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it
is allowed as long as the name is changed.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee,
and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the
following two paragraphs appear in all copies.""",
    "HPND": """Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is
hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and
this permission notice appear in supporting documentation.""",
    "curl": """Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to
promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.""",
    "Apache-1.1-acknowledgment": """The end-user documentation included with the redistribution, if any, must include the following
acknowledgment: This product includes software developed by the Apache Software Foundation.""",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Apache-2.0-grant": """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of,
publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object
form.""",
    "GPL-2.0-title": "GNU General Public License Version 2, June 1991",
    "GPL-3.0-title": "GNU General Public License Version 3, 29 June 2007",
    "LGPL-2.1-title": "GNU Lesser General Public License Version 2.1, February 1999",
    "LGPL-3.0-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "AGPL-3.0-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "GFDL-1.3-title": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "GPL-only-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License version 2 as published by the Free Software Foundation.""",
    "GPL-warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.""",
    "GFDL-1.3": """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation
License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no
Front-Cover Texts, and no Back-Cover Texts.""",
    "MPL-1.1": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/""",
    "EPL-1.0": """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse
Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CDDL-1.0": """The contents of this file are subject to the terms of the Common Development and Distribution License (the
"License"). You may not use this file except in compliance with the License.""",
    "EUPL-1.2": """Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions
of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.""",
    "Artistic-2.0": """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not
allowed.""",
    "OFL-1.1": """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also
available with a FAQ at: https://scripts.sil.org/OFL""",
    "Python-2.0": """This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization
("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated
documentation.""",
    "Ms-PL": """This license governs use of the accompanying software. If you use the software, you accept this license. If you do not
accept the license, do not use the software.""",
    "Unlicense-dedication": """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and
all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large
and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.""",
    "CC0-1.0-title": "Creative Commons Legal Code CC0 1.0 Universal",
}
#: The Creative Commons licenses by name and version, and what a source file's first line says of a license.
_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _name, _words in _COMMONS.items():
    TEMPLATES[f"CC-{_name}-4.0"] = f"This work is licensed under a Creative Commons {_words} 4.0 International License."
    TEMPLATES[f"CC-{_name}-3.0"] = f"This work is licensed under a Creative Commons {_words} 3.0 Unported License."
_IDENTIFIED = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES |= {f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in _IDENTIFIED}
#: A template's windows, in its lengths; share of a template's words that must stand there in order.
LENGTHS, CONFIRMED = 4, 0.9
#: ASCII letters and digits make words, in lower case.
_WORD = re.compile(r"[a-z0-9]+")
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Match:
    license: str
    reduction: float  # share of the compressed size that the template saves
    similarity: float  # share of the template's words that stand in the text in order
    missing: int  # words of the template that don't
    added: int  # words of the text between those that do


def reach(n: int) -> int:
    """Words that n of a template may stand among: a tenth may be added, and others only in the place of missing ones."""
    return n + n // 10


def plain(text: str | bytes) -> bytes:
    """Lower-cased (A-Z), with single blanks between what white space parts."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return b" ".join(raw.translate(_LOWER).split())


def words(text: str | bytes) -> list[str]:
    return _WORD.findall(plain(text).decode("latin-1"))


def windows(part: Sequence, size: int, shared: int) -> list[Sequence]:
    """Parts of `size`, of which the next one shares `shared`."""
    if len(part) <= size:
        return [part]
    return [part[a : a + size] for a in range(0, len(part) - shared, size - shared)]


def _hashes(parts: list[str]) -> np.ndarray:
    """As word_spans gives them."""
    raw = " ".join(parts).encode()
    return word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _BETWEEN)[0]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = list(templates)
        self.words = {k: words(t) for k, t in templates.items()}
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = {}
        for k, t in templates.items():
            dictionary = zstandard.ZstdCompressionDict(plain(t), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=3)
            self.given[k] = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False)
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.known = {k: np.unique(_hashes(w)) for k, w in self.words.items()}
        found = [(h, i) for i, k in enumerate(self.names) for h in _hashes(self.anchors(k)).tolist()]
        self.anchor = np.array(sorted({h for h, _ in found}), np.uint64)
        self.of = {h: sorted({i for g, i in found if g == h}) for h in self.anchor.tolist()}

    def least(self, name: str) -> int:
        """Words of the template that must be there."""
        return math.ceil(CONFIRMED * len(self.words[name]))

    def anchors(self, name: str) -> list[str]:
        """Of the template's words the longest, so many that all of them can't be missing."""
        out, held = [], 0
        for word, n in sorted(self.counts[name].items(), key=lambda x: (-len(x[0]), x[0])):
            if held > len(self.words[name]) - self.least(name):
                break
            out.append(word)
            held += n
        return out

    def saved(self, name: str, text: bytes) -> float:
        """Share of the text's compressed size that the template saves."""
        return 1 - len(self.given[name].compress(text)) / len(self.alone.compress(text))

    def possible(self, name: str, there: Counter) -> bool:
        """Whether enough of the template's words are there in any order."""
        return sum(min(n, there[w]) for w, n in self.counts[name].items()) >= self.least(name)

    def wording(self, name: str, have: list[str]) -> tuple[int, int, int, int, bool]:
        """Where the template's words stand among `have`, from and to; missing and added words; whether that confirms it. A
        run of words at either end that is further off than it is long goes where it is in the way."""
        want = self.words[name]
        same = [m for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        while same:
            begin, end, held = same[0].b, same[-1].b + same[-1].size, sum(m.size for m in same)
            missing, added = len(want) - held, end - begin - held
            if held < self.least(name) or added <= missing + len(want) // 10:
                return begin, end, missing, added, held >= self.least(name)
            far = [(y.b - x.b - x.size - (y.a - x.a - x.size) - m.size, k) for k, m, x, y in ((0, same[0], *same[:2]), (-1, same[-1], *same[-2:]))] if len(same) > 1 else []
            if not far or max(far)[0] <= 0:
                return begin, end, missing, added, False
            del same[max(far)[1]]
        return 0, 0, len(want), 0, False

    def places(self, name: str, have: list[str], begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """From, to, missing and added words of each time that the template stands in have[begin:end]."""
        parts = [(begin, end)]
        while parts:
            begin, end = parts.pop()
            if begin < end and self.possible(name, Counter(have[begin:end])):
                a, b, missing, added, confirmed = self.wording(name, have[begin:end])
                if confirmed:
                    yield begin + a, begin + b, missing, added
                else:  # what stands there may keep another from being seen
                    m = difflib.SequenceMatcher(None, self.words[name], have[begin:end], autojunk=False).find_longest_match()
                    a, b = m.b, m.b + m.size
                parts += [(begin, begin + a), (begin + b, end)]

    def scan(self, text: bytes, begin: np.ndarray, size: np.ndarray, areas: list[tuple[str, int, int]]) -> list[Match]:
        """Each time that a template stands in one of its areas (name, from word, to word) of a text whose words begin at
        `begin`: by reduction, ties by name, then place. The reduction is that of a window of a few times the template's
        length, so that its size says something. Windows that lack too many of a template's words to be confirmed are not
        compressed with it. Of what overlaps for one template, the best counts."""
        ranked = []
        for name, first, last in areas:
            have = [text[a : a + n].translate(_LOWER).decode() for a, n in zip(begin[first:last].tolist(), size[first:last].tolist(), strict=True)]
            for w in windows(range(len(have)), LENGTHS * len(self.words[name]), reach(len(self.words[name]))):
                if self.possible(name, Counter(have[w.start : w.stop])):
                    part = text[begin[first + w.start] : begin[first + w.stop - 1] + size[first + w.stop - 1]]
                    ranked.append((-self.saved(name, plain(part)), name, first, have, w))
        ranked.sort(key=lambda x: (x[0], x[1], x[2] + x[4].start))
        found = [(missing, added, less, name, first + a, first + b) for less, name, first, have, w in ranked for a, b, missing, added in self.places(name, have, w.start, w.stop)]
        taken: dict[str, list[tuple[int, int]]] = {}
        matches = []
        for missing, added, less, name, a, b in sorted(found):
            others = taken.setdefault(name, [])
            k = bisect_left(others, (a, b))
            if (k == 0 or others[k - 1][1] <= a) and (k == len(others) or b <= others[k][0]):
                others.insert(k, (a, b))
                matches.append((Match(name, -less, 1 - missing / len(self.words[name]), missing, added), a))
        return [m for m, _ in sorted(matches, key=lambda x: (-x[0].reduction, x[0].license, x[1]))]

    def areas(self, hashes: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """For texts whose words are offsets[i] to offsets[i + 1] of `hashes`: (name, from, to) in words of the text, around the
        anchors of each template; what meets is one area, and what holds too few of the template's words is none."""
        out: dict[int, list[tuple[str, int, int]]] = {}
        if not len(hashes):
            return out
        at = np.minimum(np.searchsorted(self.anchor, hashes), len(self.anchor) - 1)
        hit = np.flatnonzero(self.anchor[at] == hashes)
        document = np.searchsorted(offsets, hit, "right") - 1
        open_: dict[tuple[int, int], list[list[int]]] = {}
        for place, doc in zip(hit.tolist(), document.tolist(), strict=True):
            for i in self.of[int(hashes[place])]:
                more = reach(len(self.words[self.names[i]]))
                first, last = max(int(offsets[doc]), place - more), min(int(offsets[doc + 1]), place + more + 1)
                own = open_.setdefault((doc, i), [])
                if own and first <= own[-1][1]:
                    own[-1][1] = last
                else:
                    own.append([first, last])
        for (doc, i), own in open_.items():
            name = self.names[i]
            for first, last in own:
                if np.isin(hashes[first:last], self.known[name]).sum() >= self.least(name):
                    out.setdefault(doc, []).append((name, first - int(offsets[doc]), last - int(offsets[doc])))
        return out

    def scan_all(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[Match]]]:
        """Areas and matches of each text."""
        hashes, begin, size = word_spans(data, offsets, _BETWEEN)
        at = np.searchsorted(begin, offsets)
        areas, out = self.areas(hashes, at), []
        for doc in range(len(offsets) - 1):
            mine = areas.get(doc, [])
            own = slice(at[doc], at[doc + 1])
            out.append((len(mine), self.scan(data[offsets[doc] : offsets[doc + 1]].tobytes(), begin[own] - offsets[doc], size[own], mine) if mine else []))
        return out

    def scan_text(self, text: str) -> list[Match]:
        raw = text.encode("utf-8", "surrogatepass")
        return self.scan_all(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][1]


_FOUND = "uid long, doc_id long, n_areas int, matches array<struct<license:string,reduction:double,similarity:double,missing:int,added:int>>"


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """uid, doc_id, n_areas, matches for each row of `documents` (doc_id, text; nothing else is read), from its whole text.
    n_areas: places where enough of some template's words stand near each other; one that its wording doesn't confirm has
    no match. Null and empty texts have none. Matches come by reduction, ties by name, then place. Rows are scanned each by
    itself: repeated ones get equal answers, null ids stay null; uid numbers them in the order read. An empty table gives
    an empty result. templates: name and text; without, TEMPLATES. Words are ASCII letters and digits."""
    chosen = TEMPLATES if templates is None else templates
    if not all(map(words, chosen.values())):
        raise ValueError("a template has no words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        kind = pa.list_(pa.struct([("license", pa.string()), ("reduction", pa.float64()), ("similarity", pa.float64()), ("missing", pa.int32()), ("added", pa.int32())]))
        for batch in batches:
            found = scanner.scan_all(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array([n for n, _ in found], pa.int32()), pa.array([[vars(m) for m in matches] for _, matches in found], kind)], names=["uid", "doc_id", "n_areas", "matches"])

    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(in_parts(run), _FOUND)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_areas, n_matches, licenses (sorted names, comma-joined), best (largest reduction; null without a match), exact
    (some match lacks no word and adds none)."""
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["reduction"]).alias("r"), m["license"].alias("license"))))
    return found.select("doc_id", "n_areas", F.size("matches").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"), best["license"].alias("best"), F.exists("matches", lambda m: (m["missing"] == 0) & (m["added"] == 0)).alias("exact"))
