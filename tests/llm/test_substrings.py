"""The graph of substring dedup: what its paths show by themselves, and random texts against a plain version."""

import random

import plain
import pytest

from planegrid.llm import substrings


def passage_corpus(spark):
    """A passage of 900 words in three texts, a part of it in a fourth, and texts of their own."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(900)
    texts = [text(50) + passage + text(40), passage + text(80), text(70) + passage, text(30) + passage[300:500] + text(30), text(400), text(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return df.selectExpr("doc_id AS key", "text"), texts, passage


def graph(docs):
    spans = substrings.graph_spans(docs)
    shown = {r["key"]: {i for x in r["removed"] for i in range(x["from"], x["to"])} for r in spans.collect()}
    ends = substrings.end_windows(docs, spans.drop("removed")).where("kind <> 2").selectExpr("sum(upto - at + 1) AS n")
    return shown, ends.first()["n"]


def test_paths_show_the_passage(spark):
    docs, texts, passage = passage_corpus(spark)
    shown, hashed = graph(docs)
    for key, begin in ((0, 50), (1, 0), (2, 70)):
        inner = set(range(begin + 26, begin + len(passage) - 26))
        assert inner <= shown[key] <= set(range(begin, begin + len(passage)))
    assert set(range(30 + 26, 230 - 26)) <= shown[3] <= set(range(30, 230))
    # the stretch once, and at most a window's words at either end of each of four places
    assert hashed < len(passage) + 8 * substrings.WINDOW


def test_nothing_is_shown_without_compaction(spark, monkeypatch):
    """Each node by itself: no path reaches over a window, so the graph shows nothing and all is left to hashes."""
    whole = substrings.paths

    def alone(nodes, often):
        placed, on = whole(nodes, often)
        return placed, on.where("false")

    docs, _, passage = passage_corpus(spark)
    monkeypatch.setattr(substrings, "paths", alone)
    shown, hashed = graph(docs)
    assert not any(shown.values()) and hashed > 2.5 * len(passage)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_random_mosaics(spark, seed):
    """Texts put together of pieces of a few sources, with edits, repeats inside a text, circles and copies."""
    rng = random.Random(seed)
    sources = [[f"s{j}w{rng.randrange(60 if j == 0 else 5000)}" for _ in range(400)] for j in range(4)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(sources)
            i = rng.randrange(len(s))
            t += s[i : i + rng.randint(5, 150)]
            if rng.random() < 0.4:
                t += [f"own{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))]
            if t and rng.random() < 0.3:
                t[rng.randrange(len(t))] = "edit"
        texts.append(" ".join(t))
    texts += [texts[0]] * 3 + [" ".join(sources[1][:50] * 4), " ".join(sources[2][100:130] * 3), " ".join(["same"] * 90), " ".join(sources[1][20:50] * 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substrings.without_repeats(df, joined=True).collect()}
    for i, (w, keep) in enumerate(plain.repeats(texts)):
        assert got[i] == (" ".join(x for x, k in zip(w, keep) if k), keep.count(False)), i
