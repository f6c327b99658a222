"""Licence scans through a positional index of rare licence words.

The index holds, for each word of the licence texts and notices, the postings
(template, position) and the word's inverse document frequency among them.  A
file looks up its own highest-IDF words of each template; each posting names a
relative position, file position minus template position.  A template matches
where enough of those words agree on one relative position (within a drift, as
names and years differ in length) and all its mandatory key phrases occur.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_NOTICE = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}."
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: name: (label, public licence text or notice, mandatory key phrases)
TEMPLATES = {
    "mit": ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', ("permission is hereby granted", "free of charge")),
    "mit-grant": ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software", ("permission is hereby granted", "free of charge")),
    "mit-notice": ("mit", "This software is released under the MIT license.", ("mit license",)),
    "apache-2.0-notice": ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ("apache license version 2 0",)),
    "apache-2.0-line": ("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0",)),
    "gpl-2.0-notice": ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license", "version 2")),
    "gpl-3.0-notice": ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    "gpl-2.0-or-later": ("gpl-2.0", _NOTICE.format(what="program", mark=";", name="General Public License", version="2"), ("gnu general public license", "either version 2 of the license")),
    "gpl-3.0-or-later": ("gpl-3.0", _NOTICE.format(what="program", mark=":", name="General Public License", version="3"), ("gnu general public license", "either version 3 of the license")),
    "lgpl-2.1-or-later": ("lgpl-2.1", _NOTICE.format(what="library", mark=";", name="Lesser General Public License", version="2.1"), ("gnu lesser general public license", "either version 2 1 of the license")),
    "lgpl-3.0-or-later": ("lgpl-3.0", _NOTICE.format(what="library", mark=":", name="Lesser General Public License", version="3"), ("gnu lesser general public license", "either version 3 of the license")),
    "agpl-3.0-or-later": ("agpl-3.0", _NOTICE.format(what="program", mark=":", name="Affero General Public License", version="3"), ("gnu affero general public license", "either version 3 of the license")),
    "bsd-2-clause": ("bsd-2-clause", f"{_TWO} {_DISCLAIMER}", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    "bsd-3-clause": ("bsd-3-clause", f"{_TWO} 3. {_ENDORSE} {_DISCLAIMER}", ("redistribution and use in source and binary forms", "endorse or promote products derived")),
    "mpl-2.0-notice": ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    "isc": ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.', ("permission to use copy modify",)),
    "zlib": ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("the origin of this software must not be misrepresented",)),
    "boost-1.0": ("bsl-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so', ("person or organization obtaining a copy",)),
    "cc-by-4.0-notice": ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    "cc-by-sa-4.0-notice": ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike 4 0",)),
    "unlicense": ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software released into the public domain",)),
}

#: Words too common in any prose to be postings, however rare among templates.
COMMON = frozenset(b"a an and any are as at be by for from in is it its may not of on or that the this to under use with you your".split())


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and all characters beyond ASCII; A-Z lower-cased."""
    return _WORD.findall(text.lower())


class RareTokenIndex:
    """Postings of the templates' words, weighed by inverse document frequency."""

    def __init__(self, templates: dict = TEMPLATES, rare: int = 8, drift: int = 6, agree: float = 0.6):
        self.rare, self.drift, self.agree = rare, drift, agree
        texts = {name: words_of(t.encode()) for name, (_, t, _) in templates.items()}
        df = Counter(w for t in texts.values() for w in set(t) - COMMON)
        self.idf = {w: math.log((1 + len(texts)) / n) for w, n in df.items()}
        self.label = {name: label for name, (label, _, _) in templates.items()}
        self.keys = {name: [tuple(words_of(k.encode())) for k in keys] for name, (_, _, keys) in templates.items()}
        self.postings: dict[bytes, dict[str, list[int]]] = defaultdict(dict)
        for name, text in texts.items():
            for i, w in enumerate(text):
                if w in self.idf:
                    self.postings[w].setdefault(name, []).append(i)
        #: a template's own rarest words: what a file that holds it looks up
        self.weight = {name: sum(sorted((self.idf[w] for w in set(text) if w in self.idf), reverse=True)[:rare]) for name, text in texts.items()}

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Template -> the share of its rarest words' IDF that the file's agree on at one place, for templates whose key phrases occur."""
        where: dict[bytes, list[int]] = defaultdict(list)
        for at, w in enumerate(words):
            if w in self.postings:
                where[w].append(at)
        shared: dict[str, list[bytes]] = defaultdict(list)
        for w in sorted(where, key=lambda w: (-self.idf[w], w)):
            for name in self.postings[w]:
                if len(shared[name]) < self.rare:
                    shared[name].append(w)
        out = {}
        for name, own in shared.items():
            if sum(self.idf[w] for w in own) < self.agree * self.weight[name] - 1e-9 or not all(self._occurs(k, words, where) for k in self.keys[name]):
                continue
            found = sorted((at - i, w) for w in own for i in self.postings[w][name] for at in where[w])
            best, low, held, total = 0.0, 0, Counter(), 0.0  # words inside the window, each counted once
            for place, w in found:
                while found[low][0] < place - self.drift:
                    gone = found[low][1]
                    held[gone] -= 1
                    total -= self.idf[gone] if not held[gone] else 0
                    low += 1
                total += self.idf[w] if not held[w] else 0
                held[w] += 1
                best = max(best, total)
            share = min(1.0, best / self.weight[name])
            if share >= self.agree - 1e-9:
                out[name] = share
        return out

    @staticmethod
    def _occurs(key: tuple[bytes, ...], words: list[bytes], where: dict[bytes, list[int]]) -> bool:
        """Whether a phrase's words stand one behind the other, looked for at its rarest indexed word."""
        k, at = min(((k, where.get(w, [])) for k, w in enumerate(key) if w not in COMMON), key=lambda x: len(x[1]), default=(0, []))
        return any(i >= k and tuple(words[i - k : i - k + len(key)]) == key for i in at)


def scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: dict = TEMPLATES, rare: int = 8, drift: int = 6, agree: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, matches, labels, score) of every row.

    n_base counts the places where a phrase's words stand consecutively,
    first_word and last_word are the smallest and largest of their starts (null
    without any).  base_labels and labels are sorted distinct arrays, matches
    maps templates to the share of rare words that agree, score is the largest
    share, 1 where a phrase stands, else 0.  Null text counts as empty.
    Repeated rows repeat, null ids stay, other columns are ignored.  No rows
    give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareTokenIndex(templates, rare, drift, agree)
        starts = defaultdict(list)
        for phrase, label in phrases:
            p = words_of(phrase.encode())
            starts[p[0]].append((p, label))
        known = index.postings.keys() | starts.keys()
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches", "labels", "score"]
        types = [pa.int64()] * 5 + [pa.list_(pa.string()), pa.map_(pa.string(), pa.float64()), pa.list_(pa.string()), pa.float64()]
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                if known.isdisjoint(words):
                    out.append((doc, len(words), 0, None, None, [], [], [], 0.0))
                    continue
                places = [(at, label) for at, w in enumerate(words) if w in starts for p, label in starts[w] if words[at : at + len(p)] == p]
                base = {label for _, label in places}
                found = index.match(words)
                score = 1.0 if places else max(found.values(), default=0.0)
                out.append((doc, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, sorted(base), sorted(found.items()), sorted(base | {index.label[n] for n in found}), score))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 9, types)], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches map<string,double>, labels array<string>, score double"
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)
