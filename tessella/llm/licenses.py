"""Licences of files: sparse TF-IDF cosine of headers and licence texts to templates, then inheritance from the nearest directory.

Templates are full licence texts, standard headers and one-line notices. Each is compared with every group of
successive lines of a text that is about as long, full texts also with the whole file: weights are one plus the log of
term counts, times inverse document frequency over all lines of the corpus. A group's licence is the most similar template
at ``least`` or above; full texts go before headers, headers before notices. A notice also needs all the words that name
its licence. A file without a licence takes that of the nearest directory above it that holds a licence file (LICENSE,
COPYING, NOTICE, with any ending) with a licence: each file is joined with its ancestor directories by equality of
paths, and the deepest wins.

No text is left out by its words alone: a cosine is at most the share of the template's weight that the text's terms
have (Cauchy-Schwarz), so only texts that can't reach ``least`` aren't cut into groups.

Templates are a fixed list, so each text's comparison is a row-wise expression in the worker; only counts and
licences move. Depth bounds a file's ancestors.

Edge cases: null texts have no lines; null paths inherit nothing; ties go to the alphabetically first licence; rows with
one path are returned each, and a directory's licence is the first of its licence files' by name.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, materialise, texts

#: Licences and what their headers say.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted BSD License",
    "CC-BY-4.0": "Licensed under CC BY 4.0 Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
_GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation{1}either version {2} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_LESSER = _GPL.replace("GNU General", "GNU Lesser General").replace("This program", "This library").replace("this program", "this library")
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Standard headers, and licences that are no longer than one.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause": f"{_BSD} {_ENDORSE} {_AS_IS}",
    "GPL-2.0": _GPL.format(";", "; ", 2),
    "GPL-3.0": _GPL.format(":", ", ", 3),
    "LGPL-2.1": _LESSER.format(";", "; ", "2.1"),
    "LGPL-3.0": _LESSER.format(":", ", ", 3),
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: What names a licence in one line; GPL and LGPL stand for those without a version.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "GPL": ("GNU General Public License",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL": ("GNU Lesser General Public License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT License", "The MIT License (MIT)", "MIT"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
}
FULL = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
PHRASES = ("{}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "SPDX-License-Identifier: {}")
#: Words of notices that don't name a licence.
GENERIC = set("a and distributed form identifier is license licensed of released source spdx subject terms the this to under v version work".split())
LEAST = 0.75
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$"
TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)?")


def terms(line: str) -> Counter:
    return Counter(TERM.findall(line.lower()))


def _templates() -> list[tuple[int, str, str]]:
    """(3 for full texts, 2 for headers, 1 for notices, 0 for those without a version; licence; text) of all templates."""
    notices = {(n, TEMPLATES[n]) for n in TEMPLATES if n not in ("BSD-3-Clause", "MPL-2.0", "CC-BY-4.0")}
    # A bare identifier is too short to be told from other words.
    notices |= {(n, p.format(x)) for n, xs in NAMES.items() for x in xs for p in (PHRASES if " " in x else PHRASES[1:])}
    full = [(3, n, pkgutil.get_data("tessella.llm", f"licence_texts/{n}.txt").decode()) for n in FULL]
    return full + [(2, n, t) for n, t in sorted(HEADERS.items())] + [(int(n not in ("GPL", "LGPL")), n, t) for n, t in sorted(notices)]


ALL = _templates()
VOCABULARY = sorted({t for _, _, text in ALL for t in terms(text)} | {t for text in TEMPLATES.values() for t in terms(text)})


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """Of the templates' terms, over all lines of the corpus: a row for each term reaches the driver."""
    known = set(VOCABULARY)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = Counter()
        for text in texts(rows.column(0)):
            for line in text.lower().split("\n"):
                if found := set(TERM.findall(line)):
                    n[""] += 1
                    n.update(known & found)
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    rows = map_batches(docs.select("text"), batch, "term string, n bigint", rows=2000).groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r.term: r.n for r in rows}
    total = counts.get("", 0)
    idf = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in VOCABULARY}
    # Terms of no template aren't counted: they weigh as the templates' terms do in the mean.
    return idf | {"": sum(idf.values()) / len(idf)}


def weights(line: str, idf: dict[str, float]) -> dict[str, float]:
    return {t: (1 + math.log(n)) * idf.get(t, idf[""]) for t, n in terms(line).items()}


def cosine(x: dict[str, float], y: dict[str, float]) -> float:
    dot = sum(w * y[t] for t, w in x.items() if t in y)
    return dot / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values())) if dot else 0.0


class Matcher:
    """Finds the group of lines of a text that is most like a template."""

    def __init__(self, idf: dict[str, float], least: float = LEAST) -> None:
        self.idf, self.least = idf, least
        self.at = {t: k for k, t in enumerate(VOCABULARY)}
        self.templates = []
        self.share = np.zeros((len(VOCABULARY), len(ALL)), np.float32)
        for k, (tier, name, text) in enumerate(ALL):
            w, counts = weights(text, idf), terms(text)
            whole = sum(x * x for x in w.values())
            for t, x in w.items():
                self.share[self.at[t], k] = x * x / whole
            self.templates.append((tier, name, w, whole, sum(counts.values()), set(counts) - GENERIC if tier < 2 else set()))

    def __call__(self, text: str) -> tuple[str | None, float, int]:
        """Licence, similarity and number of lines of the best group; the similarity is 0 if no template can be reached."""
        low = text.lower()
        known = [self.at[t] for t in set(TERM.findall(low)) if t in self.at]
        # 0.001: for the rounding of 32-bit sums.
        able = np.flatnonzero(self.share[known].sum(0) >= self.least**2 - 0.001) if known else []
        if not len(able):
            return None, 0.0, 0
        # Sentences of long lines are compared one by one.
        lines = [TERM.findall(part.lower()) for line in text.split("\n") for part in re.split(r"(?<=[.;])\s+(?=[A-Z])", line)]
        lines = [x for x in lines if x]
        best = (-1, 0.0, 0, None)
        for k in able:
            tier, name, w, whole, size, needs = self.templates[k]
            if tier < best[0]:  # a better kind was found
                continue
            for like, n in self.groups(lines, w, whole, size, needs, tier == 3):
                place = (tier if like >= self.least else -1, like, n, name)
                if place[:3] > best[:3] or (place[:3] == best[:3] and best[3] is not None and name < best[3]):
                    best = place
        tier, like, n, name = best
        return (name, min(1.0, like), n) if tier >= 0 else (None, min(1.0, like), n)

    def groups(self, lines: list[list[str]], w: dict[str, float], whole: float, size: int, needs: set[str], long: bool) -> list[tuple[float, int]]:
        """(cosine, number of lines) of the groups of up to about twice a template's terms, the best one only."""
        idf, other = self.idf, self.idf[""]
        step, best, since = max(1, size // 8) if long else 0, (0.0, 0), None
        for i, first in enumerate(lines):
            if long:
                # Full texts: groups of a template's length that start an eighth of it apart, and the whole file.
                since = step if since is None else since + len(lines[i - 1])
                if since < step:
                    continue
                since = 0
            elif w.keys().isdisjoint(first):
                continue  # without this line the group is more alike
            counts, dot, norm, terms_in = Counter(), 0.0, 0.0, 0
            for j in range(i, len(lines)):
                if terms_in and terms_in + len(lines[j]) > (size * 9 // 8 if long else 2 * size + 8):
                    if not (long and i == 0):
                        break
                terms_in += len(lines[j])
                for t in lines[j]:
                    counts[t] = n = counts[t] + 1
                    x = idf.get(t, other)
                    old, new = ((1 + math.log(n - 1)) * x if n > 1 else 0.0), (1 + math.log(n)) * x
                    norm += new * new - old * old
                    if t in w:
                        dot += (new - old) * w[t]
                if dot and needs <= counts.keys():
                    best = max(best, (dot / math.sqrt(norm * whole), j - i + 1))
        return [best] if best[0] else []


def own_licences(docs: DataFrame, idf: dict[str, float], least: float = LEAST) -> DataFrame:
    """doc_id, path, own, similarity, n_lines of ``docs(doc_id, path, text)``: the licence of the best group of lines, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(idf, least)
        for b in batches:
            found = [match(text) for text in texts(b.column(2))]
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "path", "own", "similarity", "n_lines"])

    return docs.select("doc_id", "path", "text").mapInArrow(run, "doc_id bigint, path string, own string, similarity double, n_lines bigint")


def licences(docs: DataFrame, path: Column, least: float = LEAST) -> DataFrame:
    """doc_id, path, own_license, similarity, license, inherited_from of every row of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text")
    own = materialise(own_licences(rows, inverse_frequencies(rows), least), "licences")
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    holders = own.where(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy(directory.alias("dir")).agg(F.min_by("own", "path").alias("given"))
    # Every directory above a file that lacks a licence; files of one directory ask once.
    asking = own.where(F.col("own").isNull() & F.col("path").isNotNull()).select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = asking.select(F.col("dir").alias("asks"), F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    nearest = above.join(holders, "dir").groupBy("asks").agg(F.max_by(F.struct("given", "dir"), F.length("dir")).alias("g")).select(F.col("asks").alias("at"), "g.given", F.col("g.dir").alias("from"))
    out = own.withColumn("at", F.when(F.col("own").isNull(), directory)).join(nearest, "at", "left")
    return out.select("doc_id", "path", F.col("own").alias("own_license"), "similarity", F.coalesce("own", "given").alias("license"), F.col("from").alias("inherited_from"))
