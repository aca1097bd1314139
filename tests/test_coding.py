"""Decisions of coding against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planegrid.operators import coding
from planegrid.operators.filters import LUMA
from planegrid.operators.intra import ANGLES, INVERSES, predicted


def test_every_mode_is_written_and_read(spark):
    rows = [(m, a, b) for m in range(35) for a in (None, 0, 1, 2, 10, 26, 33, 34) for b in (None, 0, 1, 3, 10, 26, 34)]
    df = spark.createDataFrame(rows, "m int, a int, b int").withColumn("k", coding.likely_modes(F.col("a"), F.col("b"))).withColumn("c", coding.mode_code(F.col("m"), F.col("k")))
    for r in df.withColumn("again", coding.coded_mode(F.col("c"), F.col("k"))).collect():
        a, b = (1 if x is None else x for x in (r["a"], r["b"]))
        if a != b:
            want = [a, b, next(x for x in (0, 1, 26) if x not in (a, b))]
        else:
            want = [0, 1, 26] if a < 2 else [a, 2 + (a - 2 - 1) % 32, 2 + (a - 2 + 1) % 32]
        assert r["k"] == want and len(set(want)) == 3
        assert r["again"] == r["m"]
        assert r["c"]["index"] == (want.index(r["m"]) if r["m"] in want else None)
        assert r["c"]["rest"] == (None if r["m"] in want else r["m"] - sum(x < r["m"] for x in want))
        assert r["c"]["rest"] is None or 0 <= r["c"]["rest"] < 32


def test_marks_by_five_lists(spark):
    rng = random.Random(1)
    sets, held, want = [], [], {}
    for k in range(40):
        some = rng.sample(range(20), 10)
        cuts = sorted(rng.sample(range(11), 4))
        lists = [some[i:j] for i, j in zip([0, *cuts], [*cuts, 10])]
        if k % 10:
            sets.append((k, *[x if x or rng.random() < 0.5 else None for x in lists]))
        for p in range(20):
            held.append((k, p))
            kind = next((i for i, x in enumerate(lists) if p in x), None) if k % 10 else None
            want[k, p] = ("unused" if kind is None else "long" if kind > 2 else "short", kind in (0, 1, 3))
    s = spark.createDataFrame(sets, "k int, " + ", ".join(f"{n} array<int>" for n in coding.LISTS))
    got = coding.marked(spark.createDataFrame(held, "k int, poc int"), s, ["k"]).collect()
    assert {(r["k"], r["poc"]): (r["mark"], r["used"]) for r in got} == want


def plain_between(ref, fx, fy):
    """A sample after the other, as the text of the standard goes."""
    at = lambda x, y: int(ref[min(7, max(0, y)), min(7, max(0, x))])
    along = lambda x, y: sum(t * at(x + k - 3, y) for k, t in enumerate(LUMA[fx]))
    out = np.zeros((8, 8), int)
    for y in range(8):
        for x in range(8):
            if not fx and not fy:
                out[y, x] = at(x, y)
                continue
            if not fy:
                v = along(x, y)
            elif not fx:
                v = sum(t * at(x, y + k - 3) for k, t in enumerate(LUMA[fy]))
            else:
                v = sum(t * along(x, min(7, max(0, y + k - 3))) for k, t in enumerate(LUMA[fy])) >> 6
            out[y, x] = max(0, min(255, (v + 32) >> 6))
    return out


def test_moves_by_quarters(spark):
    rng = np.random.default_rng(2)
    ref = rng.integers(0, 256, (6, 8, 8))
    for fy in range(4):
        for fx in range(4):
            assert all((a == plain_between(b, fx, fy)).all() for a, b in zip(coding.between(ref, fx, fy), ref))
    rows, moves = [], []
    for i in range(30):
        fx, fy = (int(v) for v in rng.integers(0, 4, 2))
        y, x = np.mgrid[:8, :8]
        block = np.clip(128 + 60 * np.sin(x / 2 + i) + 50 * np.cos(y / 2.5 + i), 0, 255).astype(int)
        rows.append((i, plain_between(block, fx, fy).ravel().tolist(), block.ravel().tolist()))
        moves.append((fx, fy))
    got = {r["block"]: (r["fx"], r["fy"]) for r in coding.refined(spark.createDataFrame(rows, "block long, src array<int>, ref array<int>"), lagrangian=0).collect()}
    assert [got[i] for i in range(30)] == moves


def test_presets(spark):
    rows = {r["preset"]: r for r in coding.preset_table(spark).collect()}
    assert set(rows) == {"slow", "medium", "fast"} and len(coding.PRESETS) >= 20
    assert (rows["slow"]["rqt"], rows["medium"]["rqt"], rows["fast"]["sao"], rows["fast"]["merge_candidates"]) == (True, False, False, 2)


def plain_prediction(mode, top, left, n):
    """One block, a sample after the other; top and left run from the corner on."""
    out, log = np.zeros((n, n), int), int(np.log2(n))
    for y in range(n):
        for x in range(n):
            if mode == 0:
                out[y, x] = ((n - 1 - x) * left[y + 1] + (x + 1) * top[n + 1] + (n - 1 - y) * top[x + 1] + (y + 1) * left[n + 1] + n) >> (log + 1)
            elif mode == 1:
                dc = (sum(top[1 : n + 1]) + sum(left[1 : n + 1]) + n) >> (log + 1)
                if n == 32 or (x and y):
                    out[y, x] = dc
                elif x or y:
                    out[y, x] = ((top[x + 1] if x else left[y + 1]) + 3 * dc + 2) >> 2
                else:
                    out[y, x] = (left[1] + 2 * dc + top[1] + 2) >> 2
            else:
                upright = mode >= 18
                main, side = (top, left) if upright else (left, top)
                angle = ANGLES[mode - 2]
                i, j = (x, y) if upright else (y, x)  # along and away from the main line
                at, part = i + ((j + 1) * angle >> 5) + 1, (j + 1) * angle & 31
                value = lambda k: int(main[k]) if k >= 0 else int(side[(k * INVERSES[mode - 11] + 128) >> 8])  # noqa: E731, B023
                v = ((32 - part) * value(at) + part * value(at + 1) + 16) >> 5 if part else value(at)
                if angle == 0 and i == 0 and n < 32:
                    v = max(0, min(255, v + ((int(side[j + 1]) - int(side[0])) >> 1)))
                out[y, x] = v
    return out


@pytest.mark.parametrize("n", [4, 8, 16, 32])
def test_intra_prediction_of_all_sizes(n):
    rng = np.random.default_rng(n)
    top, left = rng.integers(0, 256, (3, 2 * n + 1)), rng.integers(0, 256, (3, 2 * n + 1))
    left[:, 0] = top[:, 0]
    for mode in range(35):
        got = predicted(mode, top, left)
        for k in range(3 if n < 16 else 1):
            assert (got[k] == plain_prediction(mode, top[k].tolist(), left[k].tolist(), n)).all(), mode
