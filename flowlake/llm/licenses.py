"""License scans: MinHash bands over overlapping text windows, verified by exact containment.

Texts and templates are words (0-9, a-z after lowering A-Z, and characters from U+0080 on)
and their `n`-word shingles.  For a template of m shingles, documents are cut into windows
of 2s shingles that start every s, s the least power of two that isn't below m: each run of
m shingles lies in some window.  A template and a window that holds it have a Jaccard
similarity of 1/4 at least, so a band of one minimum agrees with probability 1/4 and at
least one of 32 with 1 - (3/4)^32 > 0.9998.  A window that agrees in any band is verified:
it matches if it holds `containment` of the template's shingles, exactly counted.  Templates of
fewer than `whole_words` words must be held whole: in a sentence the version is one word.

A template with fewer words than a shingle is one shingle of its own length, a set whose
minimum is itself, and its windows are single runs of that length.

Templates are whole licence texts, the notices that licences ask for in files, and the usual
sentences that name a licence, built from NAMES and LEADS; a name may have several templates
("MIT#2" is a further one of MIT).  The long bodies of the Apache, GPL, MPL and Creative Commons
licences aren't templates; callers hand in what else they look for.

Windows of a document never leave its task.  Templates are held by every task; their list
is a parameter of the caller's, checked against `most_words`.

Results for odd input: null, empty and wordless texts match nothing; texts of any length are
cut whole; templates without words are left out; matches of one licence that overlap are one
match, with the larger containment; of overlapping matches of one family (a name up to its
first digit, and FAMILIES) only those of the largest containment stay, all where they tie; a containment of exactly `containment` matches; rows that
repeat a doc_id are scanned each; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm import windows
from flowlake.llm.common import texts
from flowlake.llm.decontaminate import FOLD
from flowlake.llm.windows import U, mixed

BANDS = 32
FIRST_DIGIT = re.compile(r"-?[0-9]")
FACTORS = mixed(np.arange(1, BANDS + 1, dtype=U)) | U(1)

# Texts of short licences, and the notices that others ask for in files.
WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
CONDITIONS_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
NOTICE_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or "
    "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
)
TEXTS = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT#permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "BSD-2-Clause": f"{CONDITIONS_BSD} {WARRANTY_BSD}",
    "BSD-3-Clause": (
        f"{CONDITIONS_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        f"prior written permission. {WARRANTY_BSD}"
    ),
    "BSD": CONDITIONS_BSD,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to "
        "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished "
        "to do so, all subject to the following:"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0": NOTICE_GNU.format("GNU General Public License", 2),
    "GPL-3.0": NOTICE_GNU.format("GNU General Public License", 3),
    "GPL": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-2.1": NOTICE_GNU.format("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": NOTICE_GNU.format("GNU Lesser General Public License", 3),
    "LGPL": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": NOTICE_GNU.format("GNU Affero General Public License", 3),
    "AGPL": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MPL-2.0#form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
}

# How sentences call licences, and how they begin.
NAMES = {
    "MIT": ("MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "ISC": ("ISC License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal",),
}
LEADS = ("licensed under", "released under", "distributed under", "published under", "available under")


def notices() -> dict[str, str]:
    """Sentences that name a licence: every lead with every name, with and without an article."""
    out = {}
    for licence, names in NAMES.items():
        for name in names:
            for lead in LEADS:
                for article in ("", "the ", "a "):
                    out[f"{licence}#{lead} {article}{name}"] = f"{lead} {article}{name}"
    return out


TEMPLATES = TEXTS | notices()


class Folded(windows.Chunk):
    """Documents of a block as hashed words; punctuation divides words."""

    def __init__(self, rows: pa.Table):
        super().__init__(rows, windows.Spec("words", 1, 1))

    def folded(self, text: bytes) -> bytes:
        return text.translate(FOLD)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    return mixed(windows.Runs(0, words).of(n))


class Template:
    def __init__(self, name: str, words: np.ndarray, n: int, containment: float, whole_words: int):
        self.name, self.words, self.n = name, len(words), min(n, len(words))
        self.set = np.unique(shingles(words, self.n))
        self.m = len(words) - self.n + 1
        self.needed = int(np.ceil(containment * len(self.set) - 1e-9)) if self.words >= whole_words else len(self.set)
        self.stride = 1 << (self.m - 1).bit_length()
        self.minima = (self.set[None, :] * FACTORS[:, None]).min(axis=1)


def templates_of(named: dict[str, str], n: int, containment: float, most_words: int, whole_words: int = 20) -> list[Template]:
    chunk = Folded(pa.table({"doc_id": pa.array(range(len(named)), pa.int64()), "text": pa.array([t.encode() for t in named.values()], pa.binary())}))
    if len(chunk.words[0]) > most_words:
        raise ValueError(f"templates of {len(chunk.words[0])} words; every task holds them, so they may have {most_words}")
    names = list(named)
    parts = [(names[i], chunk.words[0][a:b]) for i, a, b in zip(chunk.doc_id, chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
    return [Template(name, words, n, containment, whole_words) for name, words in parts if len(words)]


def matched(chunk: Folded, templates: list[Template]) -> list[tuple[int, str, int, int, float]]:
    """(document, licence, first word, end word, containment) of all matches, from windows that agree in a band."""
    out = []
    doc_of = np.repeat(np.arange(len(chunk.offsets) - 1), np.diff(chunk.offsets))
    for n in sorted({t.n for t in templates}):
        own = [t for t in templates if t.n == n]
        hashes = shingles(chunk.words[0], n)
        if not len(hashes):
            continue
        inside = doc_of[: len(hashes)] == doc_of[n - 1 :]  # others cross into the next document
        found: dict[str, set[tuple[int, int]]] = {t.name: set() for t in own}
        strides = sorted({t.stride for t in own})
        for factor_at in range(BANDS):
            value = np.where(inside, hashes * FACTORS[factor_at], np.iinfo(U).max)
            for s in strides:
                group = [t for t in own if t.stride == s]
                if s == 1 and all(t.m == 1 for t in group):
                    least = value
                else:
                    least = np.minimum.reduceat(value, np.arange(0, len(value), s))
                    least = np.minimum(least, np.append(least[1:], np.iinfo(U).max))
                wanted = np.unique([t.minima[factor_at] for t in group])
                for w in np.flatnonzero(np.isin(least, wanted)).tolist():
                    for t in group:
                        if t.minima[factor_at] == least[w]:
                            found[t.name].add((w * s, min(len(hashes), w * s + (1 if least is value else 2 * s))))
            if all(s == 1 for s in strides) and all(t.m == 1 for t in own):
                break  # sets of one: every band is alike
        for t in own:
            best: dict[tuple[int, int], tuple[int, float]] = {}
            for a, b in sorted(found[t.name]):
                at = np.flatnonzero(np.isin(hashes[a:b], t.set) & inside[a:b]) + a
                for d in np.unique(doc_of[at]).tolist():
                    mine = at[doc_of[at] == d]
                    share = len(np.unique(hashes[mine]))
                    if share >= t.needed:
                        key = (d, int(mine[0]))
                        best[key] = max(best.get(key, (0, 0.0)), (int(mine[-1]) + n, share / len(t.set)))
            out += [(d, t.name.partition("#")[0], a, b, share) for (d, a), (b, share) in best.items()]
    joined: list[list] = []
    for d, name, a, b, share in sorted(out):
        last = joined[-1] if joined else None
        if last and last[:2] == [d, name] and a < last[3]:
            last[3], last[4] = max(last[3], b), max(last[4], share)
        else:
            joined.append([d, name, a, b, share])
    by_document: dict[int, list[list]] = {}
    for match in joined:
        by_document.setdefault(match[0], []).append(match)
    kept = [m for own in by_document.values() for m in own if not any(surpasses(x, m) for x in own)]
    return [(d, name, int(a - chunk.offsets[d]), int(b - chunk.offsets[d]), share) for d, name, a, b, share in kept]


#: Licences whose notices differ in a word.
FAMILIES = {"LGPL": "GPL", "AGPL": "GPL"}


def family(name: str) -> str:
    own = FIRST_DIGIT.split(name)[0]
    return FAMILIES.get(own, own)


def surpasses(x: list, m: list) -> bool:
    """Whether match x of m's family overlaps m and holds more of its template."""
    return x[4] > m[4] and x[2] < m[3] and m[2] < x[3] and family(x[1]) == family(m[1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, n: int = 5, containment: float = 0.8, most_words: int = 200_000, whole_words: int = 20, lot: int = 1024) -> DataFrame:
    """doc_id, n_words, matches: array of (license, first word, end word, containment), by license and place."""
    index = docs.sparkSession.sparkContext.broadcast(templates_of(TEMPLATES if templates is None else templates, n, containment, most_words, whole_words))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, lot):
                chunk = Folded(pa.Table.from_batches([whole.slice(at, lot)]))
                found: list[list] = [[] for _ in chunk.doc_id]
                for d, name, a, b, share in matched(chunk, index.value):
                    found[d].append({"license": name, "start": a, "end": b, "containment": share})
                for x in found:
                    x.sort(key=lambda m: (m["license"], m["start"]))
                yield pa.RecordBatch.from_arrays([pa.array(chunk.doc_id, pa.int64()), pa.array(np.diff(chunk.offsets)), pa.array(found, kind)], ["doc_id", "n_words", "matches"])

    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, matches array<struct<license:string,start:long,end:long,containment:double>>")
