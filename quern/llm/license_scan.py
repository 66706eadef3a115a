"""License scans with a positional index of rare licence words.

Every licence is a template of words with mandatory key phrases. Words are weighed by inverse
document frequency over the templates; of each template the rarest words enter a positional
index. A document's occurrences of indexed words, rarest first, post to (template, position in
the text minus position in the template); postings that meet at one relative position, within
the slack of an edited notice, are a candidate, and it counts when a mandatory phrase stands
where the alignment puts it. The base phrases are templates of two or three words that must
stand whole. Texts are read once, map-side; nothing is shuffled or cut short.

Defined cases: a null or empty text has no words, no places and score 0; equal scores name all
their labels; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import alnum_words, map_batches, texts_of

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices of public licences in common use, with the phrases of which one must stand whole.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0", "apache license")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3", "general public license version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2", "general public license version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Whole texts of short licences and the usual notices of long ones.
FULL_TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("permission is hereby granted free of charge", "furnished to do so subject to the following conditions")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("for any purpose with or without fee is hereby granted",)),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software")),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""", ("altered source versions must be plainly marked as such", "permission is granted to anyone to use this software for any purpose")),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ("free and unencumbered software",)),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("you may not use this file except in compliance with the license", "licensed under the apache license version 2 0")),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ("either version 3 of the license",)),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", ("either version 2 of the license",)),
)
RARE_WORDS = 6  #: of a template in the index, or one of each ten, if it is long
SLACK = 2  #: words by which an edited text may be off, and one more for each forty of its template
LEAST_SCORE = 0.6


class TemplateIndex:
    """Postings of each template's rarest words, and its mandatory phrases."""

    def __init__(self, templates=TEMPLATES + FULL_TEXTS, base=BASE, rare_words: int = RARE_WORDS) -> None:
        self.base = [(tuple(phrase.encode().split()), label) for phrase, label in base]
        texts = [(label, alnum_words(text.encode()), [tuple(p.encode().split()) for p in phrases]) for label, text, phrases in templates]
        within = Counter(w for words in [*(x[1] for x in texts), *(x[0] for x in self.base)] for w in set(words))
        total = len(texts) + len(self.base)
        self.idf = {w: math.log((1 + total) / (1 + n)) + 1 for w, n in within.items()}
        rarest = lambda words, most: sorted(set(words), key=lambda w: (-self.idf[w], w))[:most]
        self.labels, self.full, self.phrases, self.slack = [], [], [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (label, words, phrases) in enumerate(texts):
            self.labels.append(label)
            self.phrases.append([(p, self._at(words, p)) for p in phrases])
            self.slack.append(SLACK + len(words) // 40)
            kept = rarest(words, max(rare_words, len(words) // 10))
            self.full.append(sum(self.idf[w] for w in kept))
            for w in kept:
                self.postings[w] += [(k, at) for at, x in enumerate(words) if x == w]
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (phrase, _) in enumerate(self.base):
            w = rarest(phrase, 1)[0]
            self.anchors[w].append((k, phrase.index(w)))
        self.words = {*self.postings, *self.anchors}

    @staticmethod
    def _at(words: list[bytes], phrase: tuple[bytes, ...]) -> int:
        n = len(phrase)
        return next(k for k in range(len(words) - n + 1) if tuple(words[k : k + n]) == phrase)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[str, float]]:
        """(base phrase, start) of every place, and the verified templates' labels with their scores."""
        index = self.words
        if index.isdisjoint(words):
            return [], {}
        places, votes = [], defaultdict(dict)
        seen = [(at, w) for at, w in enumerate(words) if w in index]
        for at, w in seen:
            for k, offset in self.anchors.get(w, ()):
                phrase = self.base[k][0]
                if at >= offset and tuple(words[at - offset : at - offset + len(phrase)]) == phrase:
                    places.append((k, at - offset))
        for at, w in seen:
            for k, offset in self.postings.get(w, ()):
                votes[k, at - offset][w] = self.idf[w]
        scores: dict[str, float] = {}
        for k, start in votes:
            met: dict[bytes, float] = {}
            for near in range(start - self.slack[k], start + self.slack[k] + 1):
                met |= votes.get((k, near), {})
            score = sum(met.values()) / self.full[k]
            if score >= LEAST_SCORE and score > scores.get(self.labels[k], 0) and self._verified(words, k, start):
                scores[self.labels[k]] = min(1.0, score)
        return places, scores

    def _verified(self, words: list[bytes], k: int, start: int) -> bool:
        for phrase, offset in self.phrases[k]:
            for low in range(max(0, start + offset - self.slack[k]), start + offset + self.slack[k] + 1):
                if tuple(words[low : low + len(phrase)]) == phrase:
                    return True
        return False


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + FULL_TEXTS, base=BASE) -> DataFrame:
    """A row for each row: id, n_words, places (phrase, word) of the base phrases in order, base_labels and labels
    (sorted arrays; labels also name verified templates) and score: 1 with a base phrase, else the best alignment."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_words bigint, places array<struct<phrase:string,word:bigint>>, base_labels array<string>, labels array<string>, score double"
    shape = pa.list_(pa.struct([("phrase", pa.string()), ("word", pa.int64())]))

    def make():
        index = TemplateIndex(templates, base)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for raw in texts_of(batch, "text"):
                words = alnum_words(raw)
                places, scores = index.scan(words)
                named = {index.base[k][1] for k, _ in places}
                at = [{"phrase": base[k][0], "word": word} for word, k in sorted((word, k) for k, word in places)]
                out.append((len(words), at, sorted(named), sorted(named | scores.keys()), 1.0 if named else max(scores.values(), default=0.0)))
            n, at, named, labels, score = zip(*out)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(at, shape), pa.array(named, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())), pa.array(score, pa.float64())], names=["id", "n_words", "places", "base_labels", "labels", "score"])

        return work

    return map_batches(rows, make, schema)
