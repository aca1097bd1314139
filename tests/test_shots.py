"""The shot rule and vector predictors against versions that go through pictures and blocks one by one."""

import numpy as np
import pytest

from planegrid.operators import predictors, shots


def plain_likelihood(before, own):
    grid = lambda p: [[p[4 * j : 4 * j + 4, 4 * i : 4 * i + 4] for i in range(8)] for j in range(8)]
    a, b, total = grid(before), grid(own), 0.0
    for j in range(2, 6):
        for i in range(2, 6):
            least = shots.UNLIKE
            for y in range(j - 1, j + 2):
                for x in range(i - 1, i + 2):
                    m, v = a[y][x].mean(), a[y][x].var()
                    n, w = b[j][i].mean(), b[j][i].var()
                    if v * w > 0:
                        least = min(least, (((n - m) / 2) ** 2 + (v + w) / 2) ** 2 / (v * w))
            total += least
    return total / 16


def plain_rule(pictures):
    """A queue of ten differences; each new picture first settles the one five before it, then may end a fade."""
    hist = [np.bincount(p.ravel() >> 2, minlength=64) for p in pictures]
    plain = [h[:9].sum() == h.sum() or h[-9:].sum() == h.sum() for h in hist]
    d = [None] + [int(np.abs(a - b).sum()) for a, b in zip(hist, hist[1:])]
    out, last, fade = [], 0, bool(plain[0])
    for i in range(1, len(pictures)):
        if i >= 11:
            c = i - 5
            left, right = d[c - 5 : c], d[c + 1 : c + 5]
            ml, mr = sum(left) / 5, sum(right) / 5
            dl, dr = (sum((x - ml) ** 2 for x in left) / 5) ** 0.5, (sum((x - mr) ** 2 for x in right) / 5) ** 0.5
            if d[c] >= max([*left, *right]) and c - 1 - last > 5:
                if d[c] > max(ml + 45 * dl, mr + 45 * dr):
                    last = c
                    out.append((c, "strong"))
                elif d[c] > max(ml + 7 * dl, mr + 7 * dr) and plain_likelihood(pictures[c - 1], pictures[c]) < 1.7:
                    last = c
                    out.append((c, "weak"))
        if plain[i]:
            fade = True
        elif fade and i + 1 - last > 5:
            last, fade = i, False
            out.append((i, "fade"))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_the_whole_rule(spark, seed):
    rng = np.random.default_rng(seed)
    films, rows = {}, []
    for s in range(5):
        base, pictures = rng.integers(40, 200, (32, 32)), []
        for k in range(int(rng.integers(3, 90))):
            if rng.random() < 0.12:
                kind = rng.integers(3)
                base = rng.integers(40, 200, (32, 32)) if kind == 0 else np.clip(base + int(rng.integers(-60, 60)), 0, 255) if kind == 1 else np.sort(base, axis=None).reshape(32, 32)
            picture = np.clip(base + rng.integers(-1, 2, (32, 32)) * (rng.random((32, 32)) < 0.05), 0, 255)
            black = rng.random()
            if black < 0.06:
                picture = np.full((32, 32), 3 if black < 0.03 else 250)
            pictures.append(picture)
            for y in range(4):
                for x in range(4):
                    rows.append((s, k, x, y, picture[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].ravel().tolist()))
        films[s] = pictures
    df = spark.createDataFrame(rows, "stream long, frame long, tx int, ty int, px array<int>").repartition(4).cache()
    found = shots.candidates(shots.differences(df))
    got = shots.changes(found, shots.likelihoods(shots.cells(df), found.where("weak"))).collect()
    for s, pictures in films.items():
        assert sorted((r["frame"], r["what"]) for r in got if r["stream"] == s) == sorted(plain_rule(pictures)), s


def test_likelihood_of_pictures(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (32, 32)), rng.integers(0, 256, (32, 32))
    b[8:12, 8:12] = 7  # a flat cell compares with none
    rows = [(0, k, x, y, p[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].ravel().tolist()) for k, p in enumerate((a, b)) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "stream long, frame long, tx int, ty int, px array<int>")
    got = shots.likelihoods(shots.cells(df), df.where("frame = 1").select("stream", "frame").distinct()).first()
    assert abs(got["likelihood"] / plain_likelihood(a, b) - 1) < 1e-9


def plain_scaled(mv, tb, td):
    clip = lambda lo, hi, v: max(lo, min(hi, v))
    tb, td = clip(-128, 127, tb), clip(-128, 127, td)
    whole = int((16384 + abs(td) // 2) / td)
    product = clip(-4096, 4095, (tb * whole + 32) >> 6) * mv
    return clip(-32768, 32767, (1 if product > 0 else -1 if product < 0 else 0) * ((abs(product) + 127) >> 8))


def plain_predictors(blocks, plane, x, y, unit_rows):
    b = blocks[plane, x, y]
    at = lambda p, i, j: blocks.get((p, i, j)) if blocks.get((p, i, j), {}).get("inter") else None

    def seen(m):
        if m["ref"] == b["ref"]:
            return m["mvx"], m["mvy"]
        return tuple(plain_scaled(m[n], b["poc"] - b["ref"], b["poc"] - m["ref"]) for n in ("mvx", "mvy"))

    left = [m for m in (at(plane, x - 1, y + 1), at(plane, x - 1, y)) if m]
    above = [m for m in (at(plane, x + 1, y - 1), at(plane, x, y - 1), at(plane, x - 1, y - 1)) if m]
    same = lambda some: next((seen(m) for m in some if m["ref"] == b["ref"]), None)
    first = lambda some: seen(some[0]) if some else None
    if left:
        a, c = same(left) or first(left), same(above)
    else:
        a, c = same(above), first(above)
    out = [v for v in (a, c) if v is not None]
    out = out[:1] if len(out) == 2 and out[0] == out[1] else out
    if len(out) < 2:
        late = (at(plane - 1, x + 1, y + 1) if (y + 1) % unit_rows else None) or at(plane - 1, x, y)
        if late:
            span, own = late["poc"] - late["ref"], b["poc"] - b["ref"]
            out.append((late["mvx"], late["mvy"]) if span == own else tuple(plain_scaled(late[n], own, span) for n in ("mvx", "mvy")))
    return (out + [(0, 0), (0, 0)])[:2]


@pytest.mark.parametrize("unit_rows", [8, 2])
def test_vector_predictors(spark, unit_rows):
    rng = np.random.default_rng(unit_rows)
    blocks = {}
    for plane in range(4):
        for x in range(6):
            for y in range(5):
                poc = 2 * plane
                blocks[plane, x, y] = {"poc": poc, "ref": poc - int(rng.integers(1, 3)), "mvx": int(rng.integers(-3, 4)) * 40, "mvy": int(rng.integers(-2, 3)), "inter": bool(rng.random() < 0.6)}
    del blocks[1, 3, 3], blocks[2, 0, 0]
    rows = [(*k, *v.values()) for k, v in blocks.items()]
    df = spark.createDataFrame(rows, "plane long, tx int, ty int, poc int, ref int, mvx int, mvy int, inter boolean").repartition(3)
    got = {(r["plane"], r["tx"], r["ty"]): [tuple(p) for p in r["predictors"]] for r in predictors.predictor_lists(df, unit_rows).collect()}
    assert set(got) == set(blocks)
    for k in blocks:
        assert got[k] == plain_predictors(blocks, *k, unit_rows), k
