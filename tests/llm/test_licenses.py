"""Licences found through the index against laying every paragraph over every place."""

import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest

from planegrid.llm import licenses
from planegrid.llm.licenses import GAP, LICENCES, PHRASES, SHARE, Licence, licence_words, paragraphs, scan, word_idf


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_idf(texts):
    df = Counter(w for t in texts for w in set(words(t)))
    return {w: 1 + log((1 + len(texts)) / (1 + df[w])) for w in licence_words()}


def brute(text, idf):
    """Every paragraph at every place, then paragraphs one behind the other."""
    w, out = words(text), []
    for number, licence in enumerate(LICENCES):
        own = [p for p in paragraphs() if p.licence == number]
        needed = sum(idf[x] for p in own if p.needed for x in p.words)
        found = []
        for p in own:
            for at in range(-len(p.words) + 1, len(w)):
                same = sum(idf[x] for j, x in enumerate(p.words) if 0 <= at + j < len(w) and w[at + j] == x)
                if same >= SHARE * sum(idf[x] for x in p.words) - 1e-9:
                    found.append((at, p.place, p, same))
        key = licence.key.split()

        def chains(x, step):
            """(weight, minus the first place) of the best chain before or behind x, x included."""
            own = x[3] if x[2].needed else 0.0
            best = []
            for y in found:
                a, z = (y, x) if step < 0 else (x, y)
                if a[1] < z[1] and a[0] < z[0] <= a[0] + len(a[2].words) + GAP:
                    best.append(chains(y, step))
            weight, first = max(best, default=(0.0, -x[0]))
            return own + weight, first

        for x in found:
            at, _, p, same = x
            if p.key >= 0 and at + p.key >= 0 and w[at + p.key : at + p.key + len(key)] == key:
                (up, first), (down, _) = chains(x, -1), chains(x, 1)
                share = (up + down - (same if p.needed else 0.0)) / needed
                if share >= SHARE - 1e-9:
                    out.append((licence.label, max(0, -first), round(min(1.0, share), 9)))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    """Whole licences, without optional paragraphs, with words changed, left out and put between; licence words in any order."""
    rng = random.Random(8)
    filler = [*licence_words(), *(f"w{i}" for i in range(60))]
    noise = lambda n: [rng.choice(filler) for _ in range(n)]
    out = []
    for k in range(90):
        parts = []
        for x in rng.sample(LICENCES, rng.randint(1, 4)):
            own = [p for p in paragraphs() if LICENCES[p.licence] == x and (p.needed or rng.random() < 0.5)]
            for p in own:
                if k % 3 == 2 and rng.random() < 0.3:
                    continue
                w = list(p.words)
                for _ in range(rng.choice([0, 0, 1, len(w) // 6, len(w) // 3])):
                    w[rng.randrange(len(w))] = rng.choice(filler)
                parts += [*w[rng.choice([0, 0, 0, 2]) :], *noise(rng.choice([0, 0, 5, 45]))]
            parts += noise(rng.randint(0, 60))
        out.append(" ".join(parts))
    out += [" ".join(x.needed) for x in LICENCES] + [x.key for x in LICENCES] + ["license " * 50, "plain words", "", " ".join(noise(3000))]
    out += ["prose of no licence " * 20 + str(i) for i in range(120)]
    return out


def test_same_as_laying_paragraphs_everywhere(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    idf = word_idf(df, licence_words())
    assert {w: round(x, 9) for w, x in idf.items()} == {w: round(x, 9) for w, x in plain_idf(texts).items()}
    labels = Counter()
    for r in scan(df, idf).collect():
        got = sorted((h["label"], h["first_word"], round(h["matched"], 9)) for h in r["hits"])
        assert got == brute(texts[r["doc_id"]], idf), r["doc_id"]
        labels.update(h["label"] for h in r["hits"])
    assert set(labels) == {x.label for x in LICENCES}


def test_index_and_phrase_disagree(spark):
    """A key phrase alone is no licence, nor is a licence without its key phrase or a paragraph that others use too."""
    mit, bsd = LICENCES[1], next(x for x in LICENCES if x.label == "bsd")
    lgpl = next(x for x in LICENCES if x.label == "lgpl")
    rows = [
        mit.key,
        " ".join(mit.needed).replace("any person obtaining", "any people obtaining"),
        bsd.optional[0][1],
        " ".join(bsd.needed[:1]),
        " ".join(lgpl.needed),
        " ".join(mit.needed[:2]) + " word" * (GAP + 1) + " " + mit.needed[2],
        " ".join(bsd.needed[::-1]),
        " ".join([*bsd.needed[:3], bsd.optional[0][1], bsd.needed[3]]),
    ]
    df = spark.createDataFrame([*enumerate(rows), *((100 + i, f"words of prose {i}") for i in range(50))], "doc_id long, text string")
    got = {r["doc_id"]: {h["label"] for h in r["hits"]} for r in scan(df, word_idf(df, licence_words())).collect()}
    assert [got[i] for i in range(5)] == [set(), set(), set(), set(), {"lgpl"}]
    assert got[6] == set() and got[7] == {"bsd"}
    assert got[100] == set()


def test_lookups_stop_where_the_rest_cannot_decide():
    idf = {w: 1.0 + len(w) for w in licence_words()}
    index = licenses.Index(idf)
    for i, x in enumerate(index.laid):
        looked = index.place[index.paragraph == i]
        rest = index.all[i] - index.weight[x[looked]].sum()
        assert rest <= licenses.REST * index.all[i] + 1e-9
        assert abs(index.votes[i] + rest + 1e-6 - SHARE * index.all[i]) < 1e-6
        assert index.weight[x[looked]].min() >= max([index.weight[w] for q, w in enumerate(x) if q not in set(looked.tolist())], default=0)


def test_own_licences(spark):
    own = (Licence("house", "house rules", ("you may read these house rules aloud", "but never sing them at night")),)
    rows = [(0, "You may read these house rules aloud, but never sing them at night."), (1, "house rules"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan(df, word_idf(df, licence_words(own)), own, ()).collect()}
    assert [h["label"] for h in got[0]["hits"]] == ["house"] and not got[1]["hits"] and got[2]["n_words"] == 0


def test_query_columns(spark, texts, docs, rows, tmp_path):
    own = [*((r[0], r[1]) for r in rows), *((1000 + i, t) for i, t in enumerate(texts[:130])), (2000, "MIT License mit-license APACHE license"), (2000, "General\nPublic  License")]
    spark.createDataFrame(own, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    idf = plain_idf([t for _, t in own])
    want = []
    for d, t in own:
        w = words(t)
        places = sorted((i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        hits = brute(t, idf)
        base = {x for _, x in places}
        at = [i for i, _ in places]
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[0] for h in hits})), round(max((h[2] for h in hits), default=0.0), 6)))
    got = [(*r[:7], round(r[7], 6)) for r in map(tuple, licenses.op8_rare_token_index(spark, str(tmp_path)).collect())]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert np.isfinite([r[7] for r in got]).all()
