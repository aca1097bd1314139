"""License scans with a positional index of rare words.

A licence is paragraphs in order, some of which may be missing. The index holds, for the words of the highest IDF over
all files, in which paragraphs and at which places they stand. A file's licence words are looked up from the rarest on;
for each paragraph the lookups stop where what is left of its IDF weight could not lift it over the share that it
needs, so no place of a paragraph is missed, however many words a file or the index has. Each posting votes with its
weight for the paragraph at one relative position; places with the votes that the rest would need are opened and compared
word by word. Where the key phrase stands at its place in such a paragraph, the best chain of paragraphs through it
is a licence, if it holds its share of weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .words import Texts, grouped, word_hash

#: Bytes that no word has, after A-Z are lower-cased.
BLANK = np.ones(256, bool)
BLANK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


#: Share of the IDF weight that a paragraph, and of its needed paragraphs that a licence must have.
SHARE = 0.6
#: Share of a paragraph's weight whose words are not looked up; an open place has the votes for the difference to SHARE.
REST = 0.3
#: Words that may stand between two paragraphs of a licence.
GAP = 40


class Licence(NamedTuple):
    label: str
    key: str  # must stand in the first paragraph that holds it
    needed: tuple[str, ...]
    #: Paragraphs that may be missing, each with the number of needed ones in front of it.
    optional: tuple[tuple[int, str], ...] = ()


_AS_IS = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_HOLDERS = (
    "are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of"
    " substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise"
    " arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: Well-known licences and the notices of longer ones as published, lower-cased and without punctuation.
LICENCES = (
    Licence("mit", "mit license", ("released under the mit license",)),
    Licence(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
            " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
            " subject to the following conditions",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
            " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with"
            " the software or the use or other dealings in the software",
        ),
    ),
    Licence("apache", "apache license version 2", ("licensed under the apache license version 2 0",)),
    Licence(
        "apache",
        "apache license version 2",
        (
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
            "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
            " see the license for the specific language governing permissions and limitations under the license",
        ),
        ((1, "http www apache org licenses license 2 0"),),
    ),
    Licence("gpl", "gnu general public license", ("this work is licensed under the gnu general public license version 3",)),
    Licence(
        "gpl",
        "gnu general public license as published",
        (
            "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"
            " or at your option any later version",
            _AS_IS + " see the gnu general public license for more details",
        ),
        ((2, "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),),
    ),
    Licence(
        "lgpl",
        "gnu lesser general public license as published",
        (
            "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"
            " or at your option any later version",
            _AS_IS + " see the gnu lesser general public license for more details",
        ),
        ((2, "you should have received a copy of the gnu lesser general public license along with this library"),),
    ),
    Licence(
        "agpl",
        "gnu affero general public license as published",
        (
            "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"
            " or at your option any later version",
            _AS_IS + " see the gnu affero general public license for more details",
        ),
        ((2, "you should have received a copy of the gnu affero general public license along with this program"),),
    ),
    Licence("cc-by-nc", "cc by nc", ("licensed under cc by nc 4 0",)),
    Licence("cc-by-sa", "cc by sa", ("licensed under cc by sa 4 0",)),
    Licence("cc-by-nc", "creative commons attribution noncommercial", ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",)),
    Licence("cc-by-sa", "creative commons attribution sharealike", ("this work is licensed under a creative commons attribution sharealike 4 0 international license",)),
    Licence("cc-by", "creative commons attribution 4", ("this work is licensed under a creative commons attribution 4 0 international license",)),
    Licence("cc0", "waived all copyright and related or neighboring rights", ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",)),
    Licence(
        "bsd",
        "redistribution and use in source and binary forms",
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
            "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability"
            " and fitness for a particular purpose " + _HOLDERS,
        ),
        (
            (3, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
            (3, "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
        ),
    ),
    Licence(
        "mpl",
        "mozilla public license v 2 0",
        ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",),
        ((1, "http mozilla org mpl 2 0"),),
    ),
    Licence("epl", "eclipse public license", ("this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0",)),
    Licence(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        (
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
            "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable"
            " for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"
            " arising out of or in connection with the use or performance of this software",
        ),
    ),
    Licence(
        "unlicense",
        "free and unencumbered software released into the public domain",
        (
            "this is free and unencumbered software released into the public domain",
            "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ),
        (
            (
                2,
                "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit"
                " of the public at large and to the detriment of our heirs and successors",
            ),
            (2, "for more information please refer to http unlicense org"),
        ),
    ),
    Licence(
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications",
        (
            "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
            "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
            "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
            "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
            "this notice may not be removed or altered from any source distribution",
        ),
        ((3, "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),),
    ),
    Licence(
        "bsl",
        "boost software license",
        (
            "boost software license version 1 0",
            "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display"
            " distribute execute and transmit the software and to prepare derivative works of the software",
        ),
        ((2, "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software"),),
    ),
    Licence(
        "wtfpl",
        "do what the fuck you want to public license",
        ("do what the fuck you want to public license", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ),
)

#: Phrases whose places are counted whatever stands around them.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class Paragraph(NamedTuple):
    licence: int
    place: int  # in the licence's order
    needed: bool
    words: list[str]
    key: int  # where the licence's key phrase stands in it, or -1


def paragraphs(licences: tuple[Licence, ...] = LICENCES) -> list[Paragraph]:
    out = []
    for i, x in enumerate(licences):
        order = sorted([(k, 1, t) for k, t in enumerate(x.needed)] + [(k, 0, t) for k, t in x.optional], key=lambda y: y[:2])
        key, held = x.key.split(), False
        for place, (_, needed, text) in enumerate(order):
            words = text.split()
            at = next((p for p in range(len(words)) if words[p : p + len(key)] == key), -1)
            out.append(Paragraph(i, place, bool(needed), words, -1 if held else at))
            held = held or at >= 0
        if not held:
            raise ValueError(f"the key phrase of {x.label} stands in none of its paragraphs")
    return out


def licence_words(licences: tuple[Licence, ...] = LICENCES) -> list[str]:
    return sorted({w for p in paragraphs(licences) for w in p.words})


def _vocabulary(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.array([word_hash(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def _known(hashes: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each word's number in the vocabulary, or -1."""
    sorted_, order = vocabulary
    at = np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)
    return np.where(sorted_[at] == hashes, order[at], -1)


def word_idf(docs: DataFrame, words: list[str]) -> dict[str, float]:
    """The IDF of each of ``words`` over all texts, at least 1; what reaches the driver is a row per word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(words)
        df, n = np.zeros(len(words), np.int64), 0
        for b in grouped(batches):
            t = Texts(b.column(0), lower=True, blank=BLANK)
            known = _known(t.hashes(), vocabulary)
            at = np.flatnonzero(known >= 0)
            pairs = np.unique(np.repeat(np.arange(len(t)), t.counts)[at] * len(words) + known[at])
            df += np.bincount(pairs % len(words), minlength=len(words))
            n += len(t)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(words)), pa.int32()), pa.array([n, *df], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"]: r["n"] for r in rows}
    return {w: 1 + math.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) for i, w in enumerate(words)}


class Index:
    """Postings (paragraph, place) of the words that are looked up, by word, and what votes must reach."""

    def __init__(self, idf: dict[str, float], licences: tuple[Licence, ...] = LICENCES):
        words = licence_words(licences)
        number = {w: i for i, w in enumerate(words)}
        self.vocabulary = _vocabulary(words)
        self.weight = np.array([idf[w] for w in words])
        self.licences, self.own = licences, paragraphs(licences)
        self.laid = [np.array([number[w] for w in p.words]) for p in self.own]
        self.all = np.array([self.weight[x].sum() for x in self.laid])
        self.needed = np.zeros(len(licences))
        postings = []
        self.votes = np.zeros(len(self.own))
        for i, (p, x) in enumerate(zip(self.own, self.laid)):
            self.needed[p.licence] += self.all[i] * p.needed
            order = np.lexsort((np.arange(len(x)), -self.weight[x]))
            left = self.all[i] - np.cumsum(self.weight[x[order]])
            stop = int(np.argmax(left <= REST * self.all[i] + 1e-9))  # words behind this one are not looked up
            postings += [(x[q], i, q) for q in order[: stop + 1].tolist()]
            # a little less than exact, so that rounding closes no place
            self.votes[i] = SHARE * self.all[i] - max(0.0, left[stop]) - 1e-6
        postings.sort()
        word, self.paragraph, self.place = (np.array(c, np.int64) for c in zip(*postings))
        self.first = np.searchsorted(word, np.arange(len(words) + 1))
        self.reach = max(len(x) for x in self.laid)

    def found(self, known: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, paragraph, place in the text, matched weight) of paragraphs that have their share; first: of each text."""
        at = np.flatnonzero(known >= 0)
        n = self.first[known[at] + 1] - self.first[known[at]]
        at, n = at[n > 0], n[n > 0]
        if not len(at):
            return []
        word = np.repeat(known[at], n)
        posting = np.repeat(self.first[known[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = np.repeat(np.searchsorted(first, at, "right") - 1, n)
        place = np.repeat(at, n) - self.place[posting] + self.reach  # relative position, not below 0
        span = len(known) + self.reach + 1
        keys, of = np.unique((doc * len(self.own) + self.paragraph[posting]) * span + place, return_inverse=True)
        votes = np.bincount(of, self.weight[word])
        out = []
        paragraph = keys // span % len(self.own)
        for j in np.flatnonzero(votes >= self.votes[paragraph]).tolist():
            d, i, p = int(keys[j]) // span // len(self.own), int(paragraph[j]), int(keys[j]) % span - self.reach
            x = self.laid[i]
            lo, hi = max(first[d], p), min(first[d + 1], p + len(x))
            same = known[lo:hi] == x[lo - p : hi - p]
            matched = float(self.weight[x[lo - p : hi - p][same]].sum())
            if matched >= SHARE * self.all[i] - 1e-9:
                out.append((d, i, int(p - first[d]), matched))
        return out

    def hits(self, found: list[tuple[int, int, float]], known: np.ndarray) -> list[dict]:
        """Licences that (paragraph, place, matched weight) of one text make, one for each place of a key phrase; known: its words' numbers.

        A key phrase's paragraph takes the paragraphs before and behind it that hold the most weight, in their order and
        at most ``GAP`` words from the last one's end; of equal ones those that begin first.
        """
        out = []
        by_licence: dict[int, list[tuple[int, int, float]]] = {}
        for i, p, matched in sorted(found, key=lambda x: (x[1], x[0])):
            by_licence.setdefault(self.own[i].licence, []).append((i, p, matched))
        for licence, some in by_licence.items():
            value = [m if self.own[i].needed else 0.0 for i, _, m in some]
            links = [[] for _ in some]  # what may stand before
            near = 0
            for k, (i, p, _) in enumerate(some):
                while p - some[near][1] > self.reach + GAP:
                    near += 1
                for j in range(near, k):
                    before, q, _ = some[j]
                    if q < p <= q + len(self.laid[before]) + GAP and self.own[before].place < self.own[i].place:
                        links[k].append(j)
            up = [(0.0, 0)] * len(some)  # weight up to and with each one, minus its first place
            for k, (_, p, _) in enumerate(some):
                best = max((up[j] for j in links[k]), default=(0.0, -p))
                up[k] = (value[k] + best[0], best[1])
            down = list(value)
            for k in range(len(some) - 1, -1, -1):
                for j in links[k]:
                    down[j] = max(down[j], value[j] + down[k])
            for k, (i, p, _) in enumerate(some):
                share = (up[k][0] + down[k] - value[k]) / self.needed[licence]
                if share >= SHARE - 1e-9 and self._stands(licence, i, p, known):
                    out.append({"label": self.licences[licence].label, "first_word": max(0, -up[k][1]), "matched": min(1.0, share)})
        return sorted(out, key=lambda x: (x["first_word"], x["label"], x["matched"]))

    def _stands(self, licence: int, i: int, p: int, known: np.ndarray) -> bool:
        at, n = self.own[i].key, len(self.licences[licence].key.split())
        return at >= 0 and p + at >= 0 and np.array_equal(known[p + at : p + at + n], self.laid[i][at : at + n])


HIT = "struct<label:string,first_word:bigint,matched:double>"
SCAN = f"n_words bigint, places array<struct<label:string,first_word:bigint>>, hits array<{HIT}>"


def scan(
    docs: DataFrame,
    idf: dict[str, float],
    licences: tuple[Licence, ...] = LICENCES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
) -> DataFrame:
    """(doc_id, text) to doc_id, n_words, places (of the phrases) and hits (of the licences).

    A hit's matched is the share of the IDF weight of the licence's needed paragraphs that stands in the text, its
    first_word where the first paragraph begins. Null and empty texts have no words and no hits; repeated rows give
    repeated rows; other columns are left out. A text's cost grows with its words, and no text is cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, licences)
        spoken = [([word_hash(w) for w in phrase.split()], label) for phrase, label in phrases]
        for b in grouped(batches):
            t = Texts(b.column(1), lower=True, blank=BLANK)
            h = t.hashes()
            doc = np.repeat(np.arange(len(t)), t.counts)
            places: list[list[dict]] = [[] for _ in range(len(t))]
            for hashes, label in spoken:
                n = len(hashes)
                if len(h) >= n:
                    same = doc[: len(h) - n + 1] == doc[n - 1 :]
                    for i, x in enumerate(hashes):
                        same &= h[i : len(h) - n + 1 + i] == np.uint64(x)
                    for w in np.flatnonzero(same):
                        places[doc[w]].append({"label": label, "first_word": int(w - t.first[doc[w]])})
            known = _known(h, index.vocabulary)
            found: dict[int, list[tuple[int, int, float]]] = {}
            for d, i, p, matched in index.found(known, t.first):
                found.setdefault(d, []).append((i, p, matched))
            hits = [index.hits(found[d], known[t.first[d] : t.first[d + 1]]) if d in found else [] for d in range(len(t))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(t.counts, pa.int64()),
                    pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))),
                    pa.array(hits, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("matched", pa.float64())]))),
                ],
                ["doc_id", "n_words", "places", "hits"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, {SCAN}")


def op8_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's base phrases and licences."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, word_idf(docs, licence_words()))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"),
        F.array_max("places.first_word").alias("last_word"),
        joined("places.label").alias("base_labels"),
        joined(F.concat("places.label", "hits.label")).alias("labels"),
        F.coalesce(F.array_max("hits.matched"), F.lit(0.0)).alias("score"),
    )
