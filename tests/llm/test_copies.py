"""Blocks and places where many rows hold one text."""

import random

import plain

from planegrid.llm import jaccard
from planegrid.llm.substrings import places, without_repeats


def test_blocks_of_copies(spark):
    """No group holds several blocks, and no window sees a text's copies."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    one, other = text(200), text(90)
    texts = [one] * 80 + [" ".join([other, *one.split(" ")[50:120]]), text(60), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    copies = df.where("doc_id < 80").repartition(4)
    keyed = copies.selectExpr("xxhash64(text) AS key", "text")
    packed = copies.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS own", "doc_id AS row").mapInArrow(jaccard._scatter(8), jaccard._PACKED)
    named = packed.where("part < 0").groupBy("block").count().collect()
    assert len(named) == 4 and all(r["count"] == 1 for r in named)
    at = places(keyed).collect()
    assert len({r["at"] for r in at}) == len(at) > 5 and all(r["copies"] == 80 for r in at)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in without_repeats(df.repartition(4), joined=True).collect()}
    for i, (w, keep) in enumerate(plain.repeats(texts)):
        assert got[i] == (" ".join(x for x, k in zip(w, keep) if k), keep.count(False))
