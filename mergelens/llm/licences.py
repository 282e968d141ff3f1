"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of a text that holds a licence word is compared with each template, as are the paragraph around it, however
wrapped, every run of adjacent paragraphs with licence words (a text's headers and notices) and the text's first paragraph;
of a licence file (by its name) the whole text is, too. Paragraphs end at lines without letters or digits, and where line
comments begin or end. Lines next to each other in a paragraph are compared as a run only if the paragraph is like no
template, as part of a header can be like another licence. An SPDX line is its licence by its identifier, the first that
has templates. Term weights are (1 + log count) times the
inverse document frequency, counted over all texts for the templates' words; other words weigh as much as the rarest
one, so a line that only mentions a licence stays far from it. The best cosine of at least `least` is the file's own licence.

A directory's licence is that of its licence files (the best score; ties to the smaller path). A file without
a licence of its own takes that of the nearest directory at or above it: distinct directories are exploded into their
ancestors, joined with the directories that have one, and the deepest wins, so no join sees a file's siblings.

Null and empty texts have no licence of their own. A null path has no directory and inherits nothing. Repeated
paths are separate files. Extra columns are kept, but for the names that the operator makes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, read, slices, table, widen

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NO_WARRANTY = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
#: Notices of common licences, in the words that their texts prescribe or that are usual for them, and the short licences as a whole.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", _APACHE],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", _MIT],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 2 of the License, or any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 3 of the License, or any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 3 of the License, or any later version."],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, either version 3 of the License, or any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the copyright holder nor the names of its contributors may be used to endorse.", "Released under the BSD 3-Clause License.", _BSD + _BSD_NAMES, _BSD + _BSD_NAMES + _NO_WARRANTY],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD, _BSD + _NO_WARRANTY],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", _ISC],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
TRIGGER = re.compile(r"(?i)licen[sc]|copyright|spdx|redistribut|public[\s/*#;%-]+domain|hereby[\s/*#;%-]+granted|cc0|\bcc[ ]by")
SPDX = re.compile(r"(?i)spdx-license-identifier:([^\n]*)")
LINE_COMMENT = re.compile(r"\s*(//|#|;|--|%)")
TOKEN = re.compile(r"[a-z]+|[0-9]+")
WORD = re.compile(r"[A-Za-z0-9]")
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|copyright|notice)([.-][^/]*)?$"


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def paragraphs(text: str):
    """Lists of lines: each with whether a licence word begins in it."""
    hits = [m.start() for m in TRIGGER.finditer(text)]
    part, mark, at, k = [], None, 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        hit = k < len(hits) and hits[k] <= end
        while k < len(hits) and hits[k] <= end:
            k += 1
        at = end + 1
        blank, comment = not WORD.search(line), bool(LINE_COMMENT.match(line))
        if part and (blank or comment != mark):
            yield part
            part = []
        if not blank:
            part.append((line, hit))
            mark = comment
    if part:
        yield part


class Scanner:
    def __init__(self, templates: dict[str, list[str]], idf: dict[str, float]):
        self.idf, self.rarest = idf, max(idf.values(), default=1.0)
        self.names, self.vectors = [], []
        for name, texts in sorted(templates.items()):
            for text in texts:
                self.names.append(name)
                self.vectors.append(self.vector(text))
        self.by_identifier = {name.lower(): name for name in templates}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for i, v in enumerate(self.vectors):
            for term, w in v.items():
                self.by_term.setdefault(term, []).append((i, w))

    def vector(self, text: str) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.idf.get(t, self.rarest) for t, n in Counter(tokens(text)).items()}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    def best(self, text: str) -> tuple[float, str | None]:
        scores = [0.0] * len(self.names)
        for term, w in self.vector(text).items():
            for i, u in self.by_term.get(term, ()):
                scores[i] += w * u
        top = max(scores, default=0.0)
        return (top, self.names[scores.index(top)]) if top > 0 else (0.0, None)

    def paragraph(self, part: list[tuple[str, bool]], least: float) -> list[tuple[float, str | None]]:
        """The scores of its lines with licence words, and of the whole or else of runs of such lines."""
        found = [self.best(line) for line, hit in part if hit]
        if len(part) == 1:
            return found
        found.append(self.best("\n".join(line for line, _ in part)))
        if found[-1][0] < least:
            for hit, run in groupby(part, lambda x: x[1]):
                if hit and len(lines := [line for line, _ in run]) > 1:
                    found.append(self.best("\n".join(lines)))
        return found

    def scan(self, text: str | None, whole: bool, least: float) -> tuple[str | None, float | None]:
        found = [(0.0, None)]
        if text:
            for m in SPDX.finditer(text):
                for word in re.findall(r"[a-z0-9.+-]+", m[1].lower()):
                    if name := self.by_identifier.get(re.sub(r"(-only|-or-later|\+)$", "", word)):
                        return name, 1.0
            run: list[str] = []
            for i, part in enumerate(paragraphs(text)):
                if any(hit for _, hit in part):
                    found += self.paragraph(part, least)
                    run.append("\n".join(line for line, _ in part))
                    continue
                if not i:
                    found.append(self.best("\n".join(line for line, _ in part)))
                if len(run) > 1:
                    found.append(self.best("\n".join(run)))
                run = []
            if len(run) > 1:
                found.append(self.best("\n".join(run)))
            if whole:
                found.append(self.best(text))
        score, name = max(found, key=lambda x: x[0])
        return (name, score) if name and score >= least else (None, None)


def frequencies(texts: DataFrame, templates: dict[str, list[str]]) -> dict[str, float]:
    """Smoothed inverse document frequencies of the templates' words over all texts; their number is the templates'."""
    words = sorted({t for group in templates.values() for text in group for t in tokens(text)})
    known = frozenset(words)

    def run(batches):
        seen, n = Counter(), 0
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                n += 1
                if text:
                    seen.update(known.intersection(TOKEN.findall(text.lower())))
        yield pa.RecordBatch.from_pydict({"term": ["", *words], "n": [n, *(seen[w] for w in words)]})

    counts = dict(map(tuple, texts.transform(mapped, run, "term string, n long").groupBy("term").agg(F.sum("n")).collect()))
    total = counts.get("", 0) or 0
    return {w: math.log((total + 1) / ((counts.get(w) or 0) + 1)) + 1 for w in words}


def own_licences(files: DataFrame, templates=None, least: float = 0.6, path: str = "path", text: str = "text") -> DataFrame:
    """files without the text, with own_licence, own_score and is_licence_file."""
    templates = templates or TEMPLATES
    idf = frequencies(files.select(F.col(text).cast("string")), templates)
    rows = files.drop("own_licence", "own_score", "is_licence_file").withColumn(text, F.col(text).cast("string")).withColumn("is_licence_file", F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False)))
    at, flag = rows.columns.index(text), len(rows.columns) - 1
    names = [c for c in rows.columns if c != text]
    schema = widen(rows.drop(text), own_licence="string", own_score="double")

    def run(batches):
        scanner = Scanner(templates, idf)
        for batch in slices(batches, at):
            found = [scanner.scan(t, whole, least) for t, whole in zip(batch.column(at).to_pylist(), batch.column(flag).to_pylist(), strict=True)]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "own_licence", "own_score"])

    return rows.transform(mapped, run, schema)


def directory(path):
    """Everything before the last slash; the empty root without one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """files (from own_licences) with licence and inherited_from, the directory that gave it (null: its own, or none)."""
    files = files.drop("licence", "inherited_from").withColumn("_dir", directory(F.col(path)))
    given = (
        files.where("is_licence_file and own_licence is not null").groupBy(F.col("_dir").alias("_from"))
        .agg(F.min_by("own_licence", F.struct(-F.col("own_score"), F.col(path))).alias("_licence"))
    )
    dirs = files.where("own_licence is null and _dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))).alias("_from"))
    nearest = above.join(given, "_from").groupBy("_dir").agg(F.max_by(F.struct("_licence", "_from"), F.length("_from")).alias("_near"))
    joined = files.join(nearest, "_dir", "left")
    own = F.col("own_licence").isNotNull()
    return joined.withColumns({"licence": F.when(own, F.col("own_licence")).otherwise(F.col("_near._licence")), "inherited_from": F.when(~own, F.col("_near._from"))}).drop("_dir", "_near")


def document_path():
    """The documents have no paths: source, thousand and hundred are directories, and each directory's first document its licence file."""
    doc = F.col("doc_id")
    folder = F.concat_ws("/", F.col("source"), F.floor(doc / 1000).cast("string"))
    deeper = F.concat_ws("/", folder, F.floor(doc / 100).cast("string"))
    return F.when(doc % 1000 == 0, F.concat(folder, F.lit("/LICENSE"))).when(doc % 100 == 0, F.concat(deeper, F.lit("/LICENSE"))).otherwise(F.concat(deeper, F.lit("/"), doc.cast("string"), F.lit(".txt")))


def op3_licences(spark, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")
    return inherit(table(own_licences(files), "licences"))
