"""Periodic runs against trying all periods at all places."""

import random
import zlib

import numpy as np
import plain
import pytest

from planegrid.llm import runs


def brute(w, least):
    """Runs by start, then period: the longest stretches of each period, each with its smallest one."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(d, w):
    if d is None or not w:
        return w
    h = zlib.crc32(str(d).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def want(d, text):
    w = planted(d, plain.words(text))
    told = brute(w, 12)
    gone = {i for s, n, p in told for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in told), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (d, len(told), *first, plain.sha("".join(f"{s},{n},{p}\n" for s, n, p in told)), plain.sha(" ".join(x for i, x in enumerate(w) if i not in gone)), len(w))


def words_like(rng):
    """Sequences of few signs, powers, Fibonacci words and copies of parts."""
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randrange(60))]
    if kind == 1:
        u = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        return [rng.randrange(3) for _ in range(rng.randrange(8))] + u * rng.randint(1, 8) + u[: rng.randrange(len(u) + 1)] + [rng.randrange(3) for _ in range(rng.randrange(8))]
    if kind == 2:
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(8)):
            a, b = b, b + a
        return b[rng.randrange(3) :]
    w = [rng.randrange(2 if kind == 3 else 5) for _ in range(rng.randint(1, 30))]
    for _ in range(rng.randrange(6)):
        i = rng.randrange(len(w))
        w += w[i : i + rng.randint(1, 25)]
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.randrange(5)
    return w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_sequences(least):
    rng = random.Random(least)
    for _ in range(4000):
        w = words_like(rng)
        assert runs.runs(w, least) == brute(w, least), w


def test_factors_are_the_longest_seen_before():
    rng = random.Random(4)
    for _ in range(500):
        w = words_like(rng)
        at = 0
        for b, n, source in runs.Automaton(w).factors(w):
            assert b == at
            seen = [k for k in range(len(w) - b + 1) if any(w[i : i + k] == w[b : b + k] for i in range(b))]
            assert n == max(1, max(seen, default=0))
            assert source < b and (source < 0 or w[source : source + n] == w[b : b + n])
            at += n
        assert at == len(w)


def test_stretches_hold_all_runs():
    rng = random.Random(5)
    for _ in range(300):
        texts = [words_like(rng) for _ in range(6)]
        codes, of = np.array([c for t in texts for c in t], np.int64), np.repeat(np.arange(6), [len(t) for t in texts])
        found = runs.stretches(codes, of, 12)
        at = 0
        for t in texts:
            for s, n, _ in brute(t, 12):
                assert any(a <= at + s and at + s + n <= z for a, z in found)
            at += len(t)
        assert all(len(set(of[a:z])) == 1 for a, z in found)


def test_one_word_over_and_over():
    assert runs.runs([0] * 50_000) == [(0, 50_000, 1)]


def test_query_on_edge_cases(spark, docs, rows, none, tmp_path):
    rng = random.Random(6)
    more = [(500 + i, " \n".join(str(x) for x in words_like(rng)) + rng.choice(["", " ", "\t"])) for i in range(150)]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    some.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in runs.op13_kolpakov_kucherov(spark, str(tmp_path)).collect()]
    expected = [want(d, t) for d, t in [*((r[0], r[1]) for r in rows), *more]]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert runs.collapsed(docs).columns == ["doc_id", "n_words", "runs", "text"]
    assert runs.collapsed(none).count() == 0
