"""Resampling against counting every n-gram, and numbering over ranges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from planegrid.llm import oracles, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, most=1, buckets=10_000, least=20, share=10, seed=2024):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    own = [features(t, most) for _, t in rows]
    s = Counter(bucket(x) for _, f in own for x in f)
    t = Counter(bucket(x) for text in target for x in features(text, most)[1])
    n_s, n_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for (d, _), (w, f) in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0]))
    for i, x in enumerate(may[: share * len(may) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.fixture(scope="module")
def target(rows):
    rng = random.Random(2)
    some = [r[1].split() for r in rows[:20]]
    return [" ".join(rng.sample(w, len(w) // 2)) for w in some] + ["", None, "Ünïcode and 123 numbers_with-marks", rows[3][1]]


@pytest.mark.parametrize(("most", "buckets", "share"), [(1, 10_000, 10), (3, 500, 40), (2, 10_000, 100)])
def test_same_as_counting(spark, docs, rows, target, most, buckets, share):
    other = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(docs, other, most, buckets, share=share).collect()
    # rows that share score and doc_id may change places
    assert sorted(map(tuple, got), key=str) == brute([(r[0], r[1]) for r in rows], target, most, buckets, share=share)


def test_blocks_do_not_matter(spark, docs, rows, target):
    other = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").repartition(3)
    got = resampling.weights(docs.repartition(9), other, 2).select("doc_id", "n_features", "weight").collect()
    assert sorted(map(tuple, got), key=str) == sorted((x[:3] for x in brute([(r[0], r[1]) for r in rows], target, 2)), key=str)


def test_no_row_holds_a_block(spark, docs, target, monkeypatch):
    tables, saved = [], resampling.saved

    def sized(df):
        out = saved(df)
        tables.append(out.agg(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] or 0)
        return out

    # a block of 1000 texts, about 400 KB of words
    some = docs.where("length(text) between 100 and 1000").crossJoin(spark.range(40)).select("doc_id", "text").coalesce(1)
    assert some.count() > 1000
    monkeypatch.setattr(resampling, "saved", sized)
    resampling.weights(some, spark.createDataFrame([(t,) for t in target], "text string"))
    assert max(tables) < 30_000


@pytest.mark.parametrize("bits", [4, 9])
def test_words_that_share_their_ids_bits(spark, docs, rows, target, bits):
    other = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.weights(docs, other, 2, bits=bits).select("doc_id", "n_features", "weight").collect()
    assert sorted(map(tuple, got), key=str) == sorted((x[:3] for x in brute([(r[0], r[1]) for r in rows], target, 2)), key=str)


def test_too_many_shared_bits(spark, docs, monkeypatch):
    monkeypatch.setattr(resampling, "CLASHES", 10)
    with pytest.raises(ValueError, match="share"):
        resampling.weights(docs, docs, bits=3)


def test_empty_tables(spark, docs, none):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resampled(none, docs).count() == 0
    assert resampling.resampled(none, nothing).count() == 0
    assert resampling.weights(docs, nothing).count() == docs.count()


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").withColumn("place", F.lit("clash"))
    got = {(r["a"], r["b"]): r["place"] for r in resampling.numbered(df.drop("place"), [F.col("a").desc(), F.col("b").asc()]).collect()}
    want = sorted(rows, key=lambda x: (-x[0], x[1]))
    assert [got[x] for x in want] == list(range(1, 3001))


def test_query_and_its_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, resampling.op12_word_dictionary(spark, sf).collect()))
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert got == sorted(duckdb.sql(oracles.OP12).select("doc_id, n_features, weight, score, rank").fetchall())
