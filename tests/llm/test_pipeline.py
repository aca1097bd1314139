"""The pipeline's stages against plain versions, each on its own input."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from planegrid.llm.common import DOCUMENT, saved

STAGES = dict(corpus_pipeline.STAGES)


def canon(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def results(spark, docs):
    out, own = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        done = saved(stage(spark, own, ""))
        out[name] = (own, done)
        own = done
    return out


def test_stages_keep_the_columns(results):
    for name, (_, done) in list(results.items())[:-1]:
        assert done.columns == DOCUMENT, name


def test_quality_stage(results):
    before, after = results["quality rules"]
    kept = Counter(map(str, canon(after.select(DOCUMENT).collect())))
    for r in canon(before.select(DOCUMENT).collect()):
        if plain.quality(r[1])[-1]:
            assert not kept[str(r)]
        else:  # plain prose: no document of this corpus lies apart
            assert kept[str(r)]


def kept_of_groups(before, after):
    """One row of each group stays, of its smallest doc_id; rows without words all stay."""
    left = Counter(canon(after))
    members = {}
    for r, g in zip(before, plain.groups([r[:2] for r in before])):
        if plain.shingles(r[1]):
            members.setdefault(g, []).append(r)
        else:
            assert left[r] == before.count(r)
    for own in members.values():
        low = min((r[0] for r in own if r[0] is not None), default=None)
        stays = [r for r in set(own) if left[r]]
        assert len(stays) == 1 and left[stays[0]] == 1 and stays[0][0] == low
    assert sum(left.values()) == len(members) + sum(not plain.shingles(r[1]) for r in before)


def test_near_duplicate_stage(results):
    before, after = results["n-gram Jaccard join"]
    kept_of_groups([tuple(r) for r in before.select(DOCUMENT).collect()], after.collect())


#: Unlike texts of one doc_id, rows that differ in one column only, and rows without ids.
CLASHES = [
    (1, "one text of several words that stands for itself here", "en", "a", 53),
    (1, "quite another thing under the same number as before", "en", "a", 51),
    (2, "a third text which several languages claim to own now", "en", "a", 53),
    (2, "a third text which several languages claim to own now", "en", "a", 53),
    (2, "a third text which several languages claim to own now", "fr", "a", 53),
    (2, "a third text which several languages claim to own now", None, "a", 53),
    (None, "a third text which several languages claim to own now", "en", "a", 53),
    (None, "nobody numbered this one at all but it is a text", "en", None, 48),
    (None, "nobody numbered this one at all but it is a text", "en", "", 48),
    (None, None, None, None, None),
    (None, None, None, None, None),
    (3, "", None, None, 0),
    (3, None, None, None, 0),
]


def test_near_duplicates_of_clashing_rows(spark):
    own = spark.createDataFrame(CLASHES, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept_of_groups(CLASHES, STAGES["n-gram Jaccard join"](spark, own, "").collect())


def test_mixture_of_clashing_rows(spark):
    """Each row comes as often as its own copies say: what differs in any column is not mixed up."""
    own = spark.createDataFrame(CLASHES, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter(map(tuple, STAGES["mixing sources"](spark, own, "").collect()))
    have = Counter(CLASHES)
    assert all(r in have and n <= 2 * have[r] for r, n in got.items())
    for s in ("a", None, ""):
        size = sum(len(plain.words(r[1])) for r in CLASHES if r[3] == s)
        taken = sum(n * len(plain.words(r[1])) for r, n in got.items() if r[3] == s)
        want = plain.fill({x: sum(len(plain.words(r[1])) for r in CLASHES if r[3] == x) for x in ("a", None, "")})[s]
        assert abs(taken - want) <= 6, (s, size, taken, want)
    assert sum(got[r] > 0 for r in have if r[3] == "a" and r[0] is not None) >= 5


def test_quality_of_clashing_rows(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [*CLASHES, (1, long, "en", "a", 1), (1, long, "fr", "a", 1), (1, long, None, "a", 1), (1, long, "a", None, 1)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert canon(STAGES["quality rules"](spark, own, "").collect()) == canon(rows[-4:])


def test_substring_stage(results):
    before, after = results["substring dedup"]
    rows = before.select("doc_id", "text").collect()
    want = [(r["doc_id"], " ".join(x for x, k in zip(w, keep) if k)) for r, (w, keep) in zip(rows, plain.repeats([r["text"] for r in rows]))]
    got = [(r["doc_id"], " ".join(plain.words(r["text"]))) for r in after.collect()]
    assert canon(got) == canon(want)
    assert after.where("n_chars <> char_length(text)").count() == 0


def test_mixing_stage(results):
    before, after = results["mixing sources"]
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in before.collect():
        sizes[r["source"]] += len(plain.words(r["text"]))
        largest[r["source"]] = max(largest[r["source"]], len(plain.words(r["text"])))
    for r in after.collect():
        taken[r["source"]] += len(plain.words(r["text"]))
    for s, t in plain.fill(sizes).items():
        assert abs(taken[s] - t) <= 0.5 * largest[s] + 1e-6
    rows = {str(tuple(r)) for r in before.select(DOCUMENT).collect()}
    assert all(n <= 2 and r in rows for r, n in Counter(str(tuple(r)) for r in after.select(DOCUMENT).collect()).items())


def test_packing_stage(results):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = results["best-fit packing"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        cuts = [0, *range(n % 2048 or min(n, 2048), n + 1, 2048)]
        want.update((r["doc_id"], a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:]))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in after.collect()) == want
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_nothing(spark, none, name):
    assert STAGES[name](spark, none, "").count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and max(r["offset"] + r["length"] for r in got) <= 2048
