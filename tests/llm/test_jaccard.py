"""The token-group matrix by itself, and blocks of copies."""

import random

import plain
import pyarrow as pa
import pytest

from planegrid.llm import jaccard


@pytest.mark.parametrize("seed", [1, 2])
def test_short_texts_without_groups(spark, seed, monkeypatch):
    """Each class its own unit: the matrix alone must find all links of short texts, of odd shingles too."""

    def alone(classes, keep):
        def run(batches):
            for b in batches:
                sets = jaccard.shingle_sets(b.column(2))
                halves = [jaccard.half(s) for s in sets]
                need = [len(h) - jaccard.lacking(len(s)) for h, s in zip(halves, sets)]
                tokens = pa.array([h.view("int64") for h in halves], pa.list_(pa.int64()))
                columns = [b.column(0), b.column(0), pa.array([True] * len(sets)), b.column(1), b.column(2), pa.array(need, pa.int64()), tokens]
                yield pa.RecordBatch.from_arrays(columns, jaccard._UNIT.names)

        return keep(classes.mapInArrow(run, jaccard._UNIT)), None

    monkeypatch.setattr(jaccard, "_units", alone)
    rng = random.Random(seed)
    rows = []
    for i in range(0, 400, 2):
        w = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([7, 7, 7, 8, 9, 11, 15]))]
        rows += [(i, " ".join(w)), (i + 1, " ".join([*w, "more"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == plain.components(rows)


def test_links_through_a_row_without_id(spark):
    """A chain whose middle has no doc_id, and a chain that has none at all."""
    rng = random.Random(3)
    a = [f"w{rng.randrange(5000)}" for _ in range(60)]
    b = [*a[:-6], *(f"x{i}" for i in range(6))]
    c = [*(f"y{i}" for i in range(6)), *b[6:]]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (3, " ".join(c)), (None, " ".join([*c, "z"])), (9, "no link here at all"), (None, "alone " * 9)]
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_components(own).collect()), key=str)
    want = plain.components(rows)
    assert got == sorted(((d, want[i]) for i, (d, _) in enumerate(rows)), key=str)
    assert (3, 1) in got


def test_packed_rows_follow_the_ranges_alone(spark):
    """Rows a block sends out are bounded by the ranges, and the ranges do not follow the corpus."""
    rng = random.Random(5)
    own = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(300)), None, i) for i in range(200)], "doc_id long, text string, own string, row long")
    for n in (1, 4):
        copies = own
        for _ in range(n - 1):
            copies = copies.unionByName(own)
        packed = copies.coalesce(1).mapInArrow(jaccard._scatter(8), jaccard._PACKED)
        blocks, rows = packed.select("block").distinct().count(), packed.count()
        assert rows <= 9 * blocks
    assert jaccard.ranges(spark) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_unlike_texts_of_one_id(spark):
    """Texts under one doc_id meet no more rows than texts of their own ids, and no table stays behind."""
    from pathlib import Path

    rng = random.Random(11)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    texts = []
    for i in range(240):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)] + texts[:5]
    for one in (7, None):
        rows = [(one if i % 8 else i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        before = set(folder.glob("table-*"))
        got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_components(df).collect()), key=str)
        want = plain.components(rows)
        assert got == sorted(((d, want[i]) for i, (d, _) in enumerate(rows)), key=str)
        assert set(folder.glob("table-*")) == before


def test_one_row_of_a_class_goes_on(spark, monkeypatch):
    """Of unlike texts under one doc_id, each class takes the rows of one name only."""
    seen = []
    real = jaccard._units

    def counting(classes, keep):
        seen.append((classes.count(), classes.select("cls").distinct().count()))
        return real(classes, keep)

    monkeypatch.setattr(jaccard, "_units", counting)
    texts = [f"a b c d e f g h i j k l m n o p {i}" for i in range(50)]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.near_components(df).collect()} == {1}
    assert seen == [(50, 50)]
