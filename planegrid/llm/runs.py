"""Periodic runs of a text's words, after Kolpakov and Kucherov.

A run is a longest stretch of words with a period that fits in it twice. A text is cut into Lempel-Ziv factors,
each the longest piece that also starts earlier, found with a suffix automaton. A run that touches a border of
two factors comes out of Main's comparison of what stands left and right of the border; it reaches no further left
than twice the factor before and once the one behind. A run inside a factor is a copy of one where the factor
occurred before.

A run of LEAST words or more repeats at least LEAST // 2 words in a row, so all its words are covered by windows of
so many words that occur twice inside one stretch of covered words. Only these stretches are factorised; most texts have
none. A window's hash only picks stretches: one that two windows share makes a stretch longer than needed.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents
from .words import grouped, mixed, window_hashes

#: Words of the shortest run that is told.
LEAST = 12
#: Bytes of text handled together.
GROUP = 1 << 20


class Automaton:
    """The suffix automaton of a sequence of numbers from 0 on.

    Nearly every state has one way on, which lies in two flat arrays; the ways of the others are in ``more``.
    ``first`` is where the first occurrence of a state's strings ends.
    """

    def __init__(self, word: list[int]):
        self.sign, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.first = array("i", [-1])
        length, link = array("i", [0]), array("i", [-1])
        sign, to, more, first = self.sign, self.to, self.more, self.first
        last = 0
        for i, c in enumerate(word):
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            first.append(i)
            sign.append(-1)
            to.append(-1)
            p, last = last, new
            while p >= 0:
                if sign[p] == -1:
                    sign[p], to[p] = c, new
                elif sign[p] == c:
                    break
                else:
                    ways = more.setdefault(p, {})
                    if c in ways:
                        break
                    ways[c] = new
                p = link[p]
            if p < 0:
                continue
            q = to[p] if sign[p] == c else more[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
                continue
            twin = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            first.append(first[q])
            sign.append(sign[q])
            to.append(to[q])
            if q in more:
                more[twin] = dict(more[q])
            while p >= 0:
                if sign[p] == c:
                    if to[p] != q:
                        break
                    to[p] = twin
                else:
                    ways = more.get(p)
                    if ways is None or ways.get(c) != q:
                        break
                    ways[c] = twin
                p = link[p]
            link[q] = link[new] = twin

    def factors(self, word: list[int]) -> list[tuple[int, int, int]]:
        """(begin, length, place of an earlier occurrence or -1) of the Lempel-Ziv factors; occurrences may overlap."""
        sign, to, more, first = self.sign, self.to, self.more, self.first
        out, i, n = [], 0, len(word)
        while i < n:
            state, j = 0, i
            while j < n:
                c = word[j]
                after = to[state] if sign[state] == c else more.get(state, {}).get(c, -1)
                if after < 0 or first[after] >= j:
                    break
                state, j = after, j + 1
            out.append((i, 1, -1) if j == i else (i, j - i, first[state] - (j - i) + 1))
            i = max(j, i + 1)
        return out


def _prefixes(s: list[int]) -> list[int]:
    """How many items from each place on equal the items from the start on."""
    n = len(s)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _touching(word: list[int], b: int, before: int, behind: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Main's step: runs that touch the border in front of place b, of the factors of these lengths, into ``found``."""
    left, right = word[max(0, b - 2 * before - behind) : b], word[b : b + behind]
    n, m = len(left), len(right)
    if n + m < least:
        return
    back = left[::-1]
    same_back = _prefixes([*back, -1, *right[::-1], *back])
    same_on = _prefixes([*right, -1, *left, *right])
    ends = [(b - same_back[n + 1 + m - p], b + p + (same_on[p] if p < m else 0) - 1, p) for p in range(1, m + 1)]
    ends += [(b - p - (same_back[p] if p < n else 0), b + same_on[m + 1 + n - p] - 1, p) for p in range(1, n + 1)]
    for s, f, p in ends:
        size = f - s + 1
        if size < least or size < 2 * p:
            continue
        # what goes on beyond the compared words belongs to another border
        if (f + 1 < len(word) and word[f + 1] == word[f + 1 - p]) or (s and word[s - 1] == word[s - 1 + p]):
            continue
        if p < found.get((s, f), p + 1):
            found[s, f] = p


def runs(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least so many items, by start, then period."""
    factors = Automaton(word).factors(word)
    found: dict[tuple[int, int], int] = {}
    before = 0
    for b, size, _ in factors:
        _touching(word, b, before, size, least, found)
        before = size
    _touching(word, len(word), before, 0, least, found)
    at: dict[int, dict[int, int]] = defaultdict(dict)
    for (s, f), p in found.items():
        at[s][f] = p
    for b, size, source in factors:
        if source < 0 or size < least + 2:
            continue
        far = b - source
        for s in range(source + 1, source + size - least):
            for f, p in list(at[s].items()) if s in at else ():
                if f < source + size - 1:
                    at[s + far].setdefault(f + far, p)
    return sorted((s, f - s + 1, p) for s, ends in at.items() for f, p in ends.items())


def stretches(codes: np.ndarray, of: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [begin, end) of items that can hold a run; of: the text of each item.

    The items that windows of least // 2 cover which occur twice in their stretch, again and again until none goes.
    """
    width = least // 2
    if len(codes) < least:
        return []
    hashes = window_hashes(mixed(codes.astype(np.uint64) + np.uint64(1)), width)
    part = of.astype(np.int64)
    size = -1
    at = np.flatnonzero(part[: len(hashes)] == part[width - 1 :])
    while len(at) and len(at) != size:
        size = len(at)
        key = hashes[at] ^ mixed(part[at].astype(np.uint64))
        _, number, times = np.unique(key, return_inverse=True, return_counts=True)
        at = at[times[number] > 1]
        # windows that meet or overlap, in one text, are a stretch
        new = np.r_[True, (np.diff(at) > width) | (of[at[1:]] != of[at[:-1]])] if len(at) else np.zeros(0, bool)
        part[at] = np.cumsum(new)
    if not len(at):
        return []
    begin = at[new]
    end = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + width
    return [(a, z) for a, z in zip(begin.tolist(), end.tolist()) if z - a >= least]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text) to doc_id, n_words, runs (by start, then period) and text, its words without what runs repeat.

    A word goes when a run holds it behind the run's first period; the others are joined by one blank. Null and
    empty texts have no words, no runs and an empty text; repeated rows give repeated rows; other columns are left
    out; an empty table stays empty. Texts are taken whole; a task's memory follows its longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, size=GROUP):
            texts = [(t.as_py() or b"").split() for t in b.column(1).cast(pa.large_binary())]
            counts = np.array([len(w) for w in texts])
            first = np.cumsum(counts) - counts
            codes = pa.array([x for w in texts for x in w], pa.large_binary()).dictionary_encode().indices.to_numpy()
            of = np.repeat(np.arange(len(texts)), counts)
            own: list[list[dict]] = [[] for _ in texts]
            gone: dict[int, np.ndarray] = {}
            for begin, end in stretches(codes, of, least):
                d = int(of[begin])
                shift = begin - int(first[d])
                for s, size, p in runs(codes[begin:end].tolist(), least):
                    own[d].append({"start": s + shift, "length": size, "period": p})
                    steps = gone.setdefault(d, np.zeros(counts[d] + 1, np.int64))
                    steps[s + shift + p] += 1
                    steps[s + shift + size] -= 1
            for d, steps in gone.items():
                stays = np.cumsum(steps[:-1]) == 0
                texts[d] = [texts[d][i] for i in np.flatnonzero(stays).tolist()]
            kept = pa.array([b" ".join(w) for w in texts], pa.binary()).cast(pa.string())
            lists = pa.array(own, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), lists, kept], ["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{RUN}>, text string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of each tenth document by the checksum of its id with its words repeated from some place on.

    A row without doc_id keeps its text.
    """
    h = F.crc32(doc_id.cast("string")).cast("long")
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    # an array's only item is worked out once, however often a lambda looks at it
    given = F.transform(F.array(F.struct(words.alias("w"))), lambda x: F.struct(x["w"].alias("w"), F.pmod(g, F.size(x["w"])).alias("a")))
    given = F.transform(given, lambda x: F.struct(x["w"].alias("w"), x["a"].alias("a"), (1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + F.pmod(g, F.lit(8))))).alias("p")))
    place = lambda x, i: F.when(i < x["a"], i).otherwise(x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")
    made = F.transform(given, lambda x: F.array_join(F.transform(x["w"], lambda _, i: F.get(x["w"], place(x, i))), " "))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.get(made, F.lit(0))).otherwise(text)


def op13_kolpakov_kucherov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents' words; of each tenth document, words from some place on are repeated first."""
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    found = collapsed(docs).withColumn("told", F.concat(F.array_join(told, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.l") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("told", 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
        "n_words",
    )
