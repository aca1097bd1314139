"""Interval joins and release orders against trying everything."""

import random

import pytest
from pyspark.sql import functions as F

from planegrid.operators.intervals import interval_join, pieces
from planegrid.operators.release import released


def test_pieces_of_intervals(spark):
    rng = random.Random(1)
    spans = [(0, 0), (5, 3), (0, 1), (7, 8), (0, 2**61), (2**61 - 1, 2**61 + 5)] + [(a, a + rng.randrange(300)) for a in (rng.randrange(1000) for _ in range(200))]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, a long, b long").select("i", pieces(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        a, b = spans[r["i"]]
        own = sorted((p["piece"] << p["level"], (p["piece"] + 1) << p["level"]) for p in r["p"])
        assert all(x[1] == y[0] for x, y in zip(own, own[1:]))
        assert (own[0][0], own[-1][1]) == (a, b) if a < b else not own
        assert len(own) <= 2 * max(1, (b - a).bit_length())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_points_in_intervals(spark, how):
    """Overlapping, nested, repeated, empty and endless intervals, and nulls on both sides."""
    rng = random.Random(2)
    points = [(rng.choice([1, 2, None]), rng.choice([rng.randrange(200), None]), i) for i in range(400)] + [(1, 5, 0), (1, 2**40, 900)]
    spans = [(rng.choice([1, 2, 3, None]), a, a + rng.choice([0, 1, 3, 60, 200]), i) for i, a in enumerate(rng.randrange(200) for _ in range(60))]
    spans += [(1, 10, 20, 100), (1, 10, 20, 100), (1, 30, None, 101), (1, None, 30, 102), (1, 0, 2**50, 103), (2, 50, 40, 104)]
    p = spark.createDataFrame(points, "k int, at long, p int").repartition(3)
    i = spark.createDataFrame(spans, "k int, start long, stop long, i int").repartition(2)
    got = sorted(map(tuple, interval_join(p, i, ["k"], how=how).select("k", "at", "p", "start", "stop", "i").collect()), key=str)
    want = []
    for k, at, n in points:
        held = [(k, at, n, a, b, j) for key, a, b, j in spans if None not in (k, at, a, b) and key == k and a <= at < b]
        want += held or ([(k, at, n, None, None, None)] if how == "left" else [])
    assert got == sorted(want, key=str)
    assert interval_join(p, i.limit(0), ["k"], how=how).count() == (len(points) if how == "left" else 0)


def plain_release(nodes, needs):
    """Levels by going over the graph until nothing changes, then what the others wait for."""
    needs = {n: {b for a, b in needs if a == n} for n in nodes}
    level, changed = {}, True
    while changed:
        changed = False
        for n in nodes:
            if n not in level and all(b in level for b in needs[n]):
                level[n] = max((level[b] + 1 for b in needs[n]), default=0)
                changed = True

    def reach(n):
        seen, todo = set(), list(needs[n])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += needs.get(b, ())
        return seen

    rings = [n for n in nodes if n in reach(n)]
    out = {}
    for n in nodes:
        r = reach(n)
        between = n in r or any(n in reach(m) for m in rings if not any(b not in nodes for b in reach(m)))
        out[n] = (level.get(n), "released" if n in level else "missing" if any(b not in nodes for b in r) else "cycle" if between else "behind")
    return out


def test_release_of_any_graph(spark):
    """Chains, trees, cycles inside and behind others, self-references, repeated and foreign edges, lost nodes."""
    rng = random.Random(3)
    nodes, needs, want = [], [], {}
    for g in range(14):
        n = rng.randrange(1, 14)
        own = sorted(rng.sample(range(20), n))
        edges = [(rng.choice(own), rng.choice(own if rng.random() < 0.97 else [99])) for _ in range(rng.randrange(2 * n))]
        if g % 2:
            edges = [(a, b) for a, b in edges if b < a or b == 99]
        edges += edges[:1] + [(77, own[0])]  # a node that is not there needs nothing
        nodes += [(g, x) for x in own + own[:1]]
        needs += [(g, a, b) for a, b in edges]
        want |= {(g, k): v for k, v in plain_release(own, edges).items()}
    got = released(spark.createDataFrame(nodes, "g int, node int"), spark.createDataFrame(needs, "g int, node int, need int"), ["g"]).collect()
    assert {(r["g"], r["node"]): (r["level"], r["state"]) for r in got} == want and len(got) == len(want)
    assert {"released", "missing", "cycle"} <= {s for _, s in want.values()}
    assert released(spark.createDataFrame([], "g int, node int"), spark.createDataFrame(needs, "g int, node int, need int"), ["g"]).count() == 0


def test_intervals_are_cut_at_the_lengths_that_places_have(spark):
    """Intervals are made once, and no length above their last place is tried."""
    from planegrid.operators.intervals import interval_join

    points = spark.createDataFrame([(k, i) for k in "ab" for i in range(20)], "k string, at long")
    rows = [("a", 0, 1), ("a", 3, 17), ("a", 5, 5), ("a", 9, 2), ("b", 0, 16), ("b", 19, 400), ("b", None, 4)]
    made = spark.sparkContext.accumulator(0)
    seen = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(lambda r: made.add(1) or r), "k string, start long, stop long")
    got = interval_join(points, seen, ["k"]).collect()
    assert sorted((r["k"], r["at"], r["start"], r["stop"]) for r in got) == sorted((k, i, a, z) for k, a, z in rows if a is not None for i in range(20) if a <= i < z)
    assert made.value == len(rows)
