"""License scans by diagonal voting.

Every run of GRAM words of every document, hashed, is joined to the places where the templates have it. A hit votes for
the diagonal place - template place; an undamaged copy puts all its votes on one, an inserted or lost word moves the rest
to the next. Votes are counted by diagonal, diagonals at most SLACK apart are merged (a cluster spans no more than the words that COVER lets
a copy gain), and the votes of those that inserted or lost passages can still lead to are summed. Where the sum is enough, the diagonals with the most votes
around are verified against the document: the tightest longest common subsequence of template words and words of the
document, without stray words at its ends, must cover COVER of the template and of the span.

Result: doc_id, template, license, first_word, last_word (word numbers of the span, from 0), n_votes, similarity.

Edge cases: null, empty and wordless texts have no spans. Repeated rows (same doc_id and text) are one document; equal doc_ids
with different texts are scanned each for itself; a null doc_id is kept. A template that occurs more than once gives a span each;
spans of different templates may overlap (a long notice holds its short form), of overlapping spans of one template the most similar stands, then the first. Of equal templates each is reported. A template of
fewer than GRAM words has no run to vote and is refused. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

GRAM = 3
SLACK = 4
COVER = 0.8
#: Share of a template's runs that must vote: what a span of similarity COVER can still lose if every changed word breaks GRAM runs.
VOTES = 0.34
#: A candidate table of up to so many bytes is sent to every task; a larger one is joined by a shuffle.
BROADCAST = 32 << 20

TEMPLATES: dict[str, tuple[str, str]] = {
    "apache-2.0-line": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-2.0-notice": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "mit-line": ("MIT", "Released under the MIT License."),
    "mit-text": ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    "gpl-3.0-line": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl-notice": ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "cc-by-nc-4.0-line": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-4.0-line": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "bsd-conditions": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "bsd-3-text": ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    "isc-text": ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    "zlib-text": ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    "unlicense-text": ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "bsl-1.0-text": ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    "mpl-2.0-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
}


def word_hashes(text: str) -> np.ndarray:
    return C.words(*C.codepoints(pa.array([text], pa.string())))[0]


def grams(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """doc_id, the text's digest, and the hashes of all runs of n words in order."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in it:
            for b in C.slices(whole):
                text = b.column("text")
                h, at, _, _ = C.words(*C.codepoints(text))
                g, doc, _ = C.shingles(h, at, n)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(text) + 1)), pa.int32()), pa.array(g.view(np.int64)))
                digest = [xxhash.xxh3_128_digest(s.as_buffer()) if s.is_valid else None for s in text]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digest, pa.binary()), lists], names=["doc_id", "digest", "grams"])

    return C.mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batches, "doc_id long, digest binary, grams array<long>")


def template_grams(spark: SparkSession, templates: dict[str, tuple[str, str]], n: int = GRAM) -> DataFrame:
    rows = []
    for name, (_, text) in templates.items():
        h = word_hashes(text)
        if len(h) < n:
            raise ValueError(f"template {name} has fewer than {n} words")
        g, _, at = C.shingles(h, np.array([0, len(h)]), n)
        rows += [(int(x), name, int(i), len(g)) for x, i in zip(g.view(np.int64), at, strict=True)]
    return spark.createDataFrame(rows, "gram long, template string, t_pos int, n_grams int")


def candidates(docs: DataFrame, templates: dict[str, tuple[str, str]]) -> DataFrame:
    """doc_id, digest, template, first and last word of spans with enough votes, and the votes."""
    hit = grams(docs).select("doc_id", "digest", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram")  # templates are a fixed short list
    who = ["doc_id", "digest", "template", "n_grams"]
    votes = hit.groupBy(*who, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.countDistinct("t_pos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    by = Window.partitionBy(*who).orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > SLACK).cast("int"), F.lit(1))
    # passages between two diagonals of one copy have at most so many words
    far = F.greatest(F.lit(SLACK), F.ceil((F.col("n_grams") + GRAM - 1) * (1 / COVER - 1)))
    chained = votes.withColumn("new", new).withColumn("chain", F.sum("new").over(by))
    drift = F.col("diagonal") - F.min("diagonal").over(Window.partitionBy(*who, "chain"))
    merged = chained.withColumn("cluster", F.floor(drift / far)).groupBy(*who, "chain", "cluster").agg(F.sum("votes").alias("n_votes"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"), F.min("diagonal").alias("start"))
    around = Window.partitionBy(*who).orderBy(F.col("start") / far).rangeBetween(-1, 1)
    merged = merged.withColumn("most", F.max("n_votes").over(around)).withColumn("all", F.sum("n_votes").over(around)).where("n_votes = most").withColumn("n_votes", F.col("all"))
    return merged.where(F.col("n_votes") >= F.greatest(F.lit(1), F.floor(F.col("n_grams") * VOTES))).select("doc_id", "digest", "template", "first", "last", "start", "n_votes")


def common_length(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the first and last place in b of its tightest one; words at its ends that cost more cover than they give are left out.

    A row of the table at a time: each cell holds length and latest start, and a running maximum carries it along the row."""
    one, mask = np.int64(1) << 32, (1 << 32) - 1
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, x in enumerate(a):
        row = best[i, 1:].copy()
        at = np.flatnonzero(b == x)
        before = best[i, at]
        row[at] = np.maximum(row[at], np.where(before > 0, before + one, one + at))
        np.maximum.accumulate(row, out=best[i + 1, 1:])
    last = best[-1]
    longest = int(last[-1]) >> 32
    if not longest:
        return 0, -1, -1
    ends = np.flatnonzero(last >> 32 == longest)
    i, j = len(a), int(ends[np.argmin(ends - (last[ends] & mask))])
    places = []
    while i and j and best[i, j]:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            places.append(j)
    at = np.array(places[::-1])
    n = np.arange(len(at))
    size = n[None] - n[:, None] + 1  # words from x to y
    cover = np.where(size > 0, size / np.maximum(len(a), at[None] - at[:, None] + 1), -1)
    x, y = max(np.argwhere(cover == cover.max()).tolist(), key=lambda p: (p[1] - p[0], p[0]))
    return y - x + 1, int(at[x]), int(at[y])


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, cover: float = COVER) -> DataFrame:
    spark = docs.sparkSession
    found = C.written(candidates(docs, templates), "licenses")
    spans = found.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("template", "first", "last", "start", "n_votes")).alias("spans"))
    if C.table_bytes(spark, found.skein_path) <= BROADCAST:
        spans = F.broadcast(spans)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    met = texts.join(spans, texts.id.eqNullSafe(spans.doc_id)).select("id", "text", "digest", "spans")
    words_of = {k: (v[0], word_hashes(v[1])) for k, v in templates.items()}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in it:
            out = []
            for id_, text, digest, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if text is None or xxhash.xxh3_128_digest(text.encode()) != digest:
                    continue
                h, own = word_hashes(text), []
                for s in spans:
                    license_, t = words_of[s["template"]]
                    # all that the template could reach on these diagonals
                    far = max(SLACK, math.ceil(len(t) * (1 / COVER - 1)))
                    low, high = max(0, min(s["first"], s["start"]) - far), min(len(h), max(s["last"] + 1, s["start"] + len(t)) + far)
                    same, i, j = common_length(t, h[low:high])
                    if same and same >= cover * len(t) and same >= cover * (j - i + 1):
                        own.append((-round(same / max(len(t), j - i + 1), 6), low + i, low + j, s["template"], license_, -s["n_votes"]))
                stand: dict[str, list[tuple[int, int]]] = {}
                for like, i, j, name, license_, votes in sorted(own):  # of overlapping spans the most similar stands
                    if all(j < a or b < i for a, b in stand.setdefault(name, [])):
                        stand[name].append((i, j))
                        out.append((id_, name, license_, i, j, -votes, -like))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "template", "license", "first_word", "last_word", "n_votes", "similarity"])

    return C.mapped(met, batches, "doc_id long, template string, license string, first_word int, last_word int, n_votes long, similarity double").groupBy("doc_id", "template", "license", "first_word", "last_word", "similarity").agg(F.max("n_votes").alias("n_votes")).select("doc_id", "template", "license", "first_word", "last_word", "n_votes", "similarity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents"))
