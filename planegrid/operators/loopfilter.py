"""Deblocking of luma edges: thresholds by QP and strength, the on/off and strong/normal decisions, and the filters.

Edges are rows (block, src, ref, qp, strength): src lies before the edge, ref behind it, both 8x8 in raster order.
All edges of a batch are filtered as one NumPy stack, in segments of four lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.plans.registry import PAIRS, query
from planegrid.sources.tables import block_pairs, blocks

#: Fixed values of the H.265 text (table 8-12): beta by QP 0 to 51, tC by QP 0 to 53.
BETA = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 6, 7,
    8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 22, 24, 26, 28, 30, 32,
    34, 36, 38, 40, 42, 44, 46, 48, 50, 52, 54, 56, 58, 60, 62, 64,
)
TC = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4,
    4, 4, 5, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 22, 24,
)
#: Fixed values of the H.265 text (table 8-10): chroma QP of luma QP 30 to 42.
CHROMA_QP = (29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37)


def filtered(p: np.ndarray, q: np.ndarray, qp: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sides of edges, [edge, line, distance from the edge], to both filtered and dE by segment (0 off, 1 normal, 2 strong)."""
    edges, lines, _ = p.shape
    p, q = (v.astype(np.int64).reshape(edges, lines // 4, 4, 4) for v in (p[..., :4], q[..., :4]))
    beta = np.array(BETA)[np.clip(qp, 0, 51)][:, None]
    tc = np.array(TC)[np.clip(qp + 2 * (strength - 1), 0, 53)][:, None]
    bend = lambda v, k: np.abs(v[:, :, k, 2] - 2 * v[:, :, k, 1] + v[:, :, k, 0])
    dp0, dp3, dq0, dq3 = bend(p, 0), bend(p, 3), bend(q, 0), bend(q, 3)

    def smooth(k: int, d: np.ndarray) -> np.ndarray:
        flat = np.abs(p[:, :, k, 3] - p[:, :, k, 0]) + np.abs(q[:, :, k, 0] - q[:, :, k, 3])
        return (2 * d < beta >> 2) & (flat < beta >> 3) & (np.abs(p[:, :, k, 0] - q[:, :, k, 0]) < 5 * tc + 1 >> 1)

    on = (dp0 + dq0 + dp3 + dq3 < beta) & (strength[:, None] > 0)
    strong = on & smooth(0, dp0 + dq0) & smooth(3, dp3 + dq3)
    side = beta + (beta >> 1) >> 3
    wide = {id(p): (dp0 + dp3 < side)[..., None], id(q): (dq0 + dq3 < side)[..., None]}
    t = tc[..., None]
    delta = 9 * (q[..., 0] - p[..., 0]) - 3 * (q[..., 1] - p[..., 1]) + 8 >> 4
    small = np.abs(delta) < 10 * t
    delta = np.clip(delta, -t, t)

    def one(a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
        """Side a, whose opposite is b."""
        a0, a1, a2, a3 = (a[..., i] for i in range(4))
        near = lambda v, old: np.clip(v, old - 2 * t, old + 2 * t)
        s0 = near(a2 + 2 * a1 + 2 * a0 + 2 * b[..., 0] + b[..., 1] + 4 >> 3, a0)
        s1 = near(a2 + a1 + a0 + b[..., 0] + 2 >> 2, a1)
        s2 = near(2 * a3 + 3 * a2 + a1 + a0 + b[..., 0] + 4 >> 3, a2)
        n0 = np.clip(a0 + sign * delta, 0, 255)
        n1 = np.clip(a1 + np.clip((a2 + a0 + 1 >> 1) - a1 + sign * delta >> 1, -(t >> 1), t >> 1), 0, 255)
        yes, hard = on[..., None] & small, strong[..., None]
        return np.stack([np.where(hard, s0, np.where(yes, n0, a0)), np.where(hard, s1, np.where(yes & wide[id(a)], n1, a1)), np.where(hard, s2, a2), a3], -1)

    return one(p, q, 1).reshape(edges, lines, 4), one(q, p, -1).reshape(edges, lines, 4), on.astype(np.int32) + strong


def chroma_filtered(p: np.ndarray, q: np.ndarray, qp: np.ndarray, strength: np.ndarray, offset: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sides of chroma edges, as ``filtered`` takes them, to both filtered: one sample on either side, where the strength is 2."""
    q_i = qp + offset
    own = np.where(q_i < 30, q_i, np.where(q_i >= 43, q_i - 6, np.array(CHROMA_QP)[np.clip(q_i - 30, 0, 12)]))
    tc = np.array(TC)[np.clip(own + 2, 0, 53)][:, None]
    p, q = (v[..., :4].astype(np.int64).copy() for v in (p, q))
    delta = np.clip(((q[..., 0] - p[..., 0] << 2) + p[..., 1] - q[..., 1] + 4) >> 3, -tc, tc)
    delta = np.where(strength[:, None] == 2, delta, 0)
    p[..., 0], q[..., 0] = np.clip(p[..., 0] + delta, 0, 255), np.clip(q[..., 0] - delta, 0, 255)
    return p, q


def deblocked(edges: DataFrame, horizontal: bool = False) -> DataFrame:
    """(block, src, ref, qp, strength) to (block, src, ref, decisions) filtered across the edge.

    The edge is vertical, ref to the right of src, or ``horizontal``, ref below it; decisions are dE of both segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, ref = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8).copy() for i in (1, 2))
            s, r = (src.transpose(0, 2, 1), ref.transpose(0, 2, 1)) if horizontal else (src, ref)
            p, q, decided = filtered(s[:, :, ::-1], r, np.array(b.column(3)), np.array(b.column(4)))
            s[:, :, 4:], r[:, :, :4] = p[:, :, ::-1], q
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * v[0].size if len(b) else [0], pa.int32()), pa.array(v.ravel().astype(np.int32))) for v in (src, ref, decided)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["block", "src", "ref", "decisions"])

    own = edges.select(F.col("block").cast("long"), F.col("src").cast("array<int>"), F.col("ref").cast("array<int>"), F.col("qp").cast("int"), F.col("strength").cast("int"))
    return own.mapInArrow(run, "block long, src array<int>, ref array<int>, decisions array<int>")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block and the next, smoothed towards each other so that all decisions occur; strength by label, QP by number."""
    pairs = block_pairs(spark, sf_dir).join(blocks(spark, sf_dir).select("block", "label"), "block")
    soft = lambda c: F.transform(c, lambda v: F.expr("128L") + F.floor((v - 128) / F.when(F.col("block") % 3 == 0, 32).when(F.col("block") % 3 == 1, 8).otherwise(1)))
    return pairs.select("block", soft("src").alias("src"), soft("ref").alias("ref"), (20 + F.col("block") % 32).cast("int").alias("qp"), F.when(F.col("label") == 0, 2).when(F.col("label") % 3 == 1, 1).otherwise(0).alias("strength"))


_VALUES = lambda t: ", ".join(f"({i}, {v})" for i, v in enumerate(t))
_SIDES = ", ".join(f"max(CASE WHEN x = {7 - i} THEN s END) AS p{i}, max(CASE WHEN x = {i} THEN r END) AS q{i}" for i in range(4))
_SMOOTH = "2 * dpq{k} < b >> 2 AND flat{k} < b >> 3 AND step{k} < (5 * t + 1) >> 1"
_STRONG = "greatest({a}0 - 2 * t, least({a}0 + 2 * t, ({a}2 + 2 * {a}1 + 2 * {a}0 + 2 * {b}0 + {b}1 + 4) >> 3)), greatest({a}1 - 2 * t, least({a}1 + 2 * t, ({a}2 + {a}1 + {a}0 + {b}0 + 2) >> 2)), greatest({a}2 - 2 * t, least({a}2 + 2 * t, (2 * {a}3 + 3 * {a}2 + {a}1 + {a}0 + {b}0 + 4) >> 3))"
_NORMAL = "greatest(0, least(255, {a}0 {s} delta)), CASE WHEN d{a} < (b + (b >> 1)) >> 3 THEN greatest(0, least(255, {a}1 + greatest(-(t >> 1), least(t >> 1, (((({a}2 + {a}0 + 1) >> 1) - {a}1) {s} delta) >> 1)))) ELSE {a}1 END, {a}2"
_SIDE = "CASE WHEN de = 2 THEN [{strong}] WHEN de = 1 AND small THEN [{normal}] ELSE [{a}0, {a}1, {a}2] END"


def _side(a: str, b: str, sign: str) -> str:
    return _SIDE.format(a=a, strong=_STRONG.format(a=a, b=b), normal=_NORMAL.format(a=a, s=sign))


@query(
    "deblock_luma",
    f"""WITH {PAIRS}, beta(i, b) AS (VALUES {_VALUES(BETA)}), tcs(i, t) AS (VALUES {_VALUES(TC)}),
f AS (SELECT block, x, y, 20 + block % 32 AS qp, CASE WHEN label = 0 THEN 2 WHEN label % 3 = 1 THEN 1 ELSE 0 END AS bs, CASE block % 3 WHEN 0 THEN 32 WHEN 1 THEN 8 ELSE 1 END AS soft, src, ref FROM pairs),
g AS (SELECT block, x, y, qp, bs, 128 + floor((src - 128) / soft)::INT AS s, 128 + floor((ref - 128) / soft)::INT AS r FROM f),
l AS (SELECT block, y, qp, bs, {_SIDES} FROM g GROUP BY block, y, qp, bs),
k AS (SELECT l.*, b, t FROM l JOIN beta ON beta.i = least(51, qp) JOIN tcs ON tcs.i = greatest(0, least(53, qp + 2 * (bs - 1)))),
d AS (SELECT block, y // 4 AS seg, any_value(b) AS b, any_value(t) AS t, any_value(bs) AS bs, {', '.join(f"sum(CASE WHEN y % 4 = {k} THEN abs(p2 - 2 * p1 + p0) + abs(q2 - 2 * q1 + q0) END) AS dpq{k}, sum(CASE WHEN y % 4 = {k} THEN abs(p3 - p0) + abs(q0 - q3) END) AS flat{k}, sum(CASE WHEN y % 4 = {k} THEN abs(p0 - q0) END) AS step{k}" for k in (0, 3))},
sum(CASE WHEN y % 4 IN (0, 3) THEN abs(p2 - 2 * p1 + p0) END) AS dp, sum(CASE WHEN y % 4 IN (0, 3) THEN abs(q2 - 2 * q1 + q0) END) AS dq FROM k GROUP BY ALL),
e AS (SELECT block, seg, dp, dq, CASE WHEN bs = 0 OR dpq0 + dpq3 >= b THEN 0 WHEN {_SMOOTH.format(k=0)} AND {_SMOOTH.format(k=3)} THEN 2 ELSE 1 END AS de FROM d),
n AS (SELECT k.*, e.dp, e.dq, e.de, greatest(-t, least(t, (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4)) AS delta, abs((9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4) < 10 * t AS small FROM k JOIN e ON e.block = k.block AND e.seg = k.y // 4)
SELECT block, y::INT AS y, de::INT AS de, array_to_string({_side('p', 'q', '+')}, ',') AS p, array_to_string({_side('q', 'p', '-')}, ',') AS q FROM n""",
)
def deblock_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples on either side of each vertical edge, line by line, with the decision on their segment."""
    own = deblocked(edges(spark, sf_dir)).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    side = lambda c, xs: F.array_join(F.array(*[F.get(c, F.col("y") * 8 + x) for x in xs]), ",")
    return own.select("block", "y", F.get("decisions", F.expr("y div 4").cast("int")).alias("de"), side("src", (7, 6, 5)).alias("p"), side("ref", (0, 1, 2)).alias("q"))
