"""Operators over whole planes against plain versions that walk over the samples."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_files import plain_edge

from planegrid.operators import loopfilter, planes


def cut_up(plane, number):
    """(plane, tx, ty, px) of a picture's blocks."""
    h, w = plane.shape
    return [(number, x // 8, y // 8, plane[y : y + 8, x : x + 8].ravel().tolist()) for y in range(0, h, 8) for x in range(0, w, 8)]


def put_together(rows, w, h):
    out = np.zeros((h, w), int)
    for r in rows:
        out[8 * r["ty"] : 8 * r["ty"] + 8, 8 * r["tx"] : 8 * r["tx"] + 8] = np.array(r["px"]).reshape(8, 8)
    return out


@pytest.mark.parametrize(("reach", "columns", "rows"), [(64, 10, 9), (3, 3, 2), (17, 20, 4)])
def test_search_over_block_borders(spark, reach, columns, rows):
    """The same as trying every displacement, for noise, smooth pictures and moved ones; most are never compared."""
    rng = np.random.default_rng(reach)
    w, h = 8 * columns, 8 * rows
    y, x = np.mgrid[:h, :w]
    pictures = [(rng.integers(0, 256, (h, w)), rng.integers(0, 256, (h, w))), ((x * 2 + y) % 256, np.roll((x * 2 + y) % 256, (5, -7), (0, 1))), (np.full((h, w), 7), np.full((h, w), 7))]
    base = np.clip(128 + np.cumsum(np.cumsum(rng.integers(-2, 3, (h, w)), 0), 1) // 8, 0, 255)
    pictures.append((np.roll(base, (2, 3), (0, 1)), base))
    frame = lambda k: spark.createDataFrame([r for i, p in enumerate(pictures) for r in cut_up(p[k], i)], "plane long, tx int, ty int, px array<int>").repartition(3)
    got = {(r["plane"], r["tx"], r["ty"]): r for r in planes.plane_search(frame(0), frame(1), columns, rows, reach).collect()}
    assert len(got) == len(pictures) * columns * rows
    bits = 2 * (np.array([[abs(dx).bit_length() + abs(dy).bit_length() for dx in range(-reach, reach + 1)] for dy in range(-reach, reach + 1)]) + 1)
    for i, (src, ref) in enumerate(pictures):
        wide = np.pad(ref, reach, mode="edge")
        for ty in range(0, rows, 2 if reach > 9 else 1):
            for tx in range(0, columns, 3 if reach > 9 else 1):
                block = src[8 * ty : 8 * ty + 8, 8 * tx : 8 * tx + 8]
                seen = np.lib.stride_tricks.sliding_window_view(wide[8 * ty : 8 * ty + 8 + 2 * reach, 8 * tx : 8 * tx + 8 + 2 * reach], (8, 8))
                cost = np.abs(seen - block).sum((2, 3)) + 4 * bits
                k = int(cost.argmin())
                r = got[i, tx, ty]
                assert (r["dx"], r["dy"], r["cost"]) == (k % (2 * reach + 1) - reach, k // (2 * reach + 1) - reach, cost.ravel()[k])
    if reach == 64:
        assert sum(r["compared"] for k, r in got.items() if k[0] == 3) < 0.1 * columns * rows * (2 * reach + 1) ** 2


def test_search_in_a_plane_with_holes(spark):
    rows = cut_up(np.zeros((16, 16), int), 0)
    df = spark.createDataFrame(rows, "plane long, tx int, ty int, px array<int>")
    with pytest.raises(PySparkException, match="missing"):
        planes.plane_search(df, df.where("tx < 1"), 2, 2, 4).count()
    assert planes.plane_search(df, df.where("plane > 0"), 2, 2, 4).count() == 0


def strength(a, b):
    if a["intra"] or b["intra"]:
        return 2
    moved = a["dpb"] != b["dpb"] or abs(a["mvx"] - b["mvx"]) >= 4 or abs(a["mvy"] - b["mvy"]) >= 4
    return int(a["coded"] or b["coded"] or moved)


def plain_planes(picture, blocks, chroma, offset):
    """Both passes over a picture, an edge after the other; each pass reads what the one before gave."""
    h, w = picture.shape
    for horizontal in (False, True):
        source = picture.T.copy() if horizontal else picture.copy()
        out = source.copy()
        for k in range(8, source.shape[1], 8):
            for line in range(0, source.shape[0], 4):
                here = (line // 8, k // 8) if horizontal else (k // 8, line // 8)
                before = (here[0], here[1] - 1) if horizontal else (here[0] - 1, here[1])
                a, b = blocks[before], blocks[here]
                bs, qp = strength(a, b), (a["qp"] + b["qp"] + 1) >> 1
                if chroma:
                    q = qp + offset
                    q = q if q < 30 else q - 6 if q >= 43 else loopfilter.CHROMA_QP[q - 30]
                    tc = loopfilter.TC[min(53, q + 2)]
                    for y in range(line, line + 4) if bs == 2 else ():
                        p1, p0, q0, q1 = (int(v) for v in source[y, k - 2 : k + 2])
                        d = max(-tc, min(tc, (4 * (q0 - p0) + p1 - q1 + 4) >> 3))
                        out[y, k - 1], out[y, k] = max(0, min(255, p0 + d)), max(0, min(255, q0 - d))
                else:
                    p, q, _ = plain_edge(source[line : line + 4, k - 4 : k][:, ::-1].tolist(), source[line : line + 4, k : k + 4].tolist(), qp, bs)
                    out[line : line + 4, k - 3 : k] = np.array(p)[:, 2::-1]
                    out[line : line + 4, k : k + 3] = np.array(q)[:, :3]
        picture = out.T if horizontal else out
    return picture


@pytest.mark.parametrize("chroma", [False, True])
def test_deblocking_of_planes(spark, chroma):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(3):
        w, h = 8 * (3 + i), 8 * (2 + i)
        y, x = np.mgrid[:h, :w]
        picture = np.clip(100 + 10 * ((x // 8 + y // 8) % 2) + rng.integers(-3 * i, 3 * i + 1, (h, w)) + x // 4, 0, 255)
        blocks = {}
        for n, tx, ty, px in cut_up(picture, i):
            m = {"intra": bool(rng.random() < 0.3), "coded": bool(rng.random() < 0.3), "dpb": int(rng.integers(2)), "mvx": int(rng.integers(-4, 5)), "mvy": int(rng.integers(-4, 5))}
            blocks[tx, ty] = m | {"qp": int(rng.integers(15, 52))}
            rows.append((n, tx, ty, px, blocks[tx, ty]["qp"], m))
        want[i] = plain_planes(picture, blocks, chroma, 3)
    df = spark.createDataFrame(rows, "plane long, tx int, ty int, px array<int>, qp int, motion struct<intra:boolean,coded:boolean,dpb:int,mvx:int,mvy:int>").repartition(4)
    got = planes.deblocked_planes(df, chroma, 3).collect()
    for i, picture in want.items():
        assert (put_together([r for r in got if r["plane"] == i], picture.shape[1], picture.shape[0]) == picture).all(), i


def test_what_stands_around(spark):
    df = spark.createDataFrame([(0, x, y, 10 * y + x) for x in range(4) for y in range(3)], "plane long, tx int, ty int, v int")
    got = {(r["tx"], r["ty"]): r for r in planes.around(df, {"left": (-1, 0), "corner": (1, -1)}, F.col("v")).collect()}
    assert len(got) == 12
    for (x, y), r in got.items():
        assert r["v"] == 10 * y + x
        assert r["left"] == (10 * y + x - 1 if x else None)
        assert r["corner"] == (10 * (y - 1) + x + 1 if x < 3 and y else None)
