"""Operators over whole planes: blocks at places (plane, tx, ty) see the blocks around them.

A plane is 8x8 blocks in rows; what lies beyond its border repeats the border's samples. Two ways lead to neighbours: blocks are
sent to the places that need them and grouped there, so a neighbourhood costs one shuffle; and for wide windows blocks are
put together in cells of 64x64 samples first, which go to the nine cells around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.operators.loopfilter import BETA, CHROMA_QP, TC, chroma_filtered, filtered
from planegrid.plans.registry import BLOCKS, query
from planegrid.sources.tables import blocks

#: Blocks of a plane of the queries, in a row and in a column.
COLUMNS, ROWS = 12, 8
#: Blocks of a cell, on a side.
CELL = 8

_PLACED = f"""{BLOCKS}, placed AS MATERIALIZED (SELECT block, label, block // {COLUMNS * ROWS} AS plane, (block % {COLUMNS * ROWS} % {COLUMNS})::INT AS tx, (block % {COLUMNS * ROWS} // {COLUMNS})::INT AS ty, px, count(*) OVER (PARTITION BY block // {COLUMNS * ROWS}) AS n FROM blocks),
tiles AS MATERIALIZED (SELECT block, label, plane, tx, ty, px FROM placed WHERE n = {COLUMNS * ROWS})"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plane, tx, ty, block, label, px): embeddings as planes of 12 x 8 blocks; a last plane with blocks missing is left out."""
    size = COLUMNS * ROWS
    own = blocks(spark, sf_dir).withColumn("plane", F.expr(f"block div {size}"))
    own = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("plane"))).where(F.col("n") == size)
    inside = F.col("block") % size
    return own.select("plane", (inside % COLUMNS).cast("int").alias("tx"), F.floor(inside / COLUMNS).cast("int").alias("ty"), "block", "label", "px")


def around(own: DataFrame, offsets: dict[str, tuple[int, int]], value: Column) -> DataFrame:
    """(plane, tx, ty, ...) with ``value`` of the blocks at the offsets, by name; null where there is none.

    Each block goes to the places that see it, itself included, and meets the others there: one shuffle for any number of
    offsets, and no group has more rows than there are offsets, and one.
    """
    goes = F.array(
        F.struct(F.lit("").alias("name"), F.col("tx").alias("tx"), F.col("ty").alias("ty")),
        *[F.struct(F.lit(n).alias("name"), (F.col("tx") - dx).alias("tx"), (F.col("ty") - dy).alias("ty")) for n, (dx, dy) in offsets.items()],
    )
    rest = F.struct(*[c for c in own.columns if c not in ("plane", "tx", "ty")])
    sent = own.select("plane", F.explode(goes).alias("to"), value.alias("value"), rest.alias("own"))
    sent = sent.select("plane", F.col("to.tx").alias("tx"), F.col("to.ty").alias("ty"), F.col("to.name").alias("name"), "value", "own")
    seen = sent.groupBy("plane", "tx", "ty").agg(
        F.first(F.when(F.col("name") == "", F.col("own")), ignorenulls=True).alias("own"), *[F.first(F.when(F.col("name") == n, F.col("value")), ignorenulls=True).alias(n) for n in offsets]
    )
    return seen.where("own IS NOT NULL").select("plane", "tx", "ty", "own.*", *offsets)


def _mosaic(table: pa.Table, x0: int, y0: int, columns: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of (tx, ty, px) as one picture of so many blocks from (x0, y0) on, and which blocks are there."""
    out, there = np.zeros((rows, columns, 8, 8), np.int32), np.zeros((rows, columns), bool)
    tx, ty = (np.array(table.column(c)) for c in ("tx", "ty"))
    px = table.column("px").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8)
    out[ty - y0, tx - x0], there[ty - y0, tx - x0] = px, True
    return out.transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns), there


def _bits(reach: int) -> np.ndarray:
    """Bits of every displacement in reach, [dy][dx]."""
    one = np.array([abs(d).bit_length() for d in range(-reach, reach + 1)])
    return 2 * (one[:, None] + one[None, :] + 1)


def nearest(block: np.ndarray, window: np.ndarray, reach: int, lagrangian: int, bits: np.ndarray) -> tuple[int, int, int, int]:
    """(cost, dx, dy, displacements compared) of the best place of a block in the window of ``reach`` around it; the first of equals.

    No displacement costs less than its bits and the differences of the sums of the block's quarters. In the order of
    these bounds displacements are compared, a front of them at a time, until a bound is above the best cost so far.
    """
    n, side = len(block), 2 * reach + 1
    half = n // 2
    total = np.zeros((window.shape[0] + 1, window.shape[1] + 1), np.int64)
    total[1:, 1:] = window.cumsum(0).cumsum(1)
    parts = total[half:, half:] - total[:-half, half:] - total[half:, :-half] + total[:-half, :-half]
    bound = lagrangian * bits.astype(np.int64)
    for y in (0, half):
        for x in (0, half):
            bound = bound + np.abs(parts[y : y + side, x : x + side] - block[y : y + half, x : x + half].sum())
    seen = np.lib.stride_tricks.sliding_window_view(window, (n, n))
    flat = bound.ravel()
    order = np.argsort(flat, kind="stable")
    best, at, done = np.iinfo(np.int64).max, 0, 0
    while done < len(order) and flat[order[done]] <= best:
        front = order[done : done + 64]
        cost = np.abs(seen[front // side, front % side] - block).sum((1, 2), dtype=np.int64) + lagrangian * bits.ravel()[front]
        k = np.lexsort((front, cost))[0]
        if (int(cost[k]), int(front[k])) < (best, at) or best == np.iinfo(np.int64).max:
            best, at = int(cost[k]), int(front[k])
        done += len(front)
    return best, at % side - reach, at // side - reach, done


def plane_search(src: DataFrame, ref: DataFrame, columns: int, rows: int, reach: int = 64, lagrangian: int = 4) -> DataFrame:
    """Blocks (plane, tx, ty, px) of ``src`` to (plane, tx, ty, dx, dy, cost, compared): their best place in the plane ``ref`` of the same number.

    Every displacement in ``reach`` is looked at, over the borders of blocks; samples beyond a plane of ``columns`` x ``rows``
    blocks repeat its border. Cost is the sum of absolute differences and the vector's bits times ``lagrangian``. A task's group
    is a cell of ``src`` and the cells of ``ref`` in reach. Blocks without a plane to look in are left out.
    """
    ring = -(-reach // (8 * CELL))
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    own = src.select("plane", cell("tx").alias("cx"), cell("ty").alias("cy"), F.col("tx").cast("int"), F.col("ty").cast("int"), F.col("px").cast("array<int>"))
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in range(-ring, ring + 1) for dx in range(-ring, ring + 1)])
    sent = ref.select("plane", F.explode(near).alias("d"), F.col("tx").cast("int"), F.col("ty").cast("int"), F.col("px").cast("array<int>"))
    sent = sent.select("plane", (cell("tx") + F.col("d.dx")).alias("cx"), (cell("ty") + F.col("d.dy")).alias("cy"), "tx", "ty", "px")
    inside = (F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < -(-columns // CELL)) & (F.col("cy") < -(-rows // CELL))
    bits = _bits(reach)

    def run(key: tuple, mine: pa.Table, others: pa.Table) -> pa.Table:
        names = ["plane", "tx", "ty", "dx", "dy", "cost", "compared"]
        out: list[tuple] = []
        if len(mine) and len(others):
            cx, cy = key[1].as_py(), key[2].as_py()
            x0, y0 = max(0, (cx - ring) * CELL), max(0, (cy - ring) * CELL)
            x1, y1 = min(columns, (cx + ring + 1) * CELL), min(rows, (cy + ring + 1) * CELL)
            picture, there = _mosaic(others, x0, y0, x1 - x0, y1 - y0)
            if not there.all():
                raise ValueError("blocks of a plane are missing")
            wide = np.pad(picture, reach, mode="edge")
            px = mine.column("px").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8)
            for tx, ty, block in zip(mine.column("tx").to_pylist(), mine.column("ty").to_pylist(), px):
                x, y = 8 * (tx - x0), 8 * (ty - y0)
                cost, dx, dy, compared = nearest(block, wide[y : y + 8 + 2 * reach, x : x + 8 + 2 * reach], reach, lagrangian, bits)
                out.append((key[0].as_py(), tx, ty, dx, dy, cost, compared))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, types)], names=names)

    keys = ("plane", "cx", "cy")
    left, right = own.withColumn("plane", F.col("plane").cast("long")), sent.where(inside).withColumn("plane", F.col("plane").cast("long"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda k, a, b: run(k, a, b), "plane long, tx int, ty int, dx int, dy int, cost long, compared int")


REACH = 9


@query(
    "plane_motion",
    f"""WITH {_PLACED}, whole AS MATERIALIZED (SELECT plane, list(px ORDER BY ty, tx) AS p FROM tiles GROUP BY plane),
o AS (SELECT dx, dy, (dy + {REACH}) * {2 * REACH + 1} + dx + {REACH} AS seq, 2 * (CASE WHEN dx = 0 THEN 0 ELSE length(bin(abs(dx))) END + CASE WHEN dy = 0 THEN 0 ELSE length(bin(abs(dy))) END + 1) AS bits FROM range({-REACH}, {REACH + 1}) a(dx), range({-REACH}, {REACH + 1}) b(dy)),
c AS (SELECT t.plane, tx, ty, dx, dy, seq, 4 * bits + list_sum(list_transform(range(64), lambda i: abs(px[i + 1] - p[(greatest(0, least({8 * ROWS - 1}, 8 * ty + i // 8 + dy)) // 8 * {COLUMNS} + greatest(0, least({8 * COLUMNS - 1}, 8 * tx + i % 8 + dx)) // 8 + 1)::BIGINT][(greatest(0, least({8 * ROWS - 1}, 8 * ty + i // 8 + dy)) % 8 * 8 + greatest(0, least({8 * COLUMNS - 1}, 8 * tx + i % 8 + dx)) % 8 + 1)::BIGINT]))) AS cost
FROM tiles t JOIN whole w ON w.plane = t.plane + 1, o)
SELECT plane, tx, ty, arg_min(dx, cost * 1000 + seq)::INT AS dx, arg_min(dy, cost * 1000 + seq)::INT AS dy, min(cost)::BIGINT AS cost FROM c GROUP BY plane, tx, ty""",
)
def plane_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place of each block in the next plane, over block borders, by a search with bounds."""
    own = tiles(spark, sf_dir)
    return plane_search(own, own.withColumn("plane", F.col("plane") - 1), COLUMNS, ROWS, REACH).drop("compared")


def strength(p: str, q: str) -> Column:
    """Boundary strength between motions ``p`` and ``q``, structs of intra, coded, dpb, mvx and mvy.

    2 at an intra block; 1 where a side has coefficients, the references differ, or a part of the vectors differs by four or
    more; else 0. Null where there is no block before the edge.
    """
    a, b = F.col(p), F.col(q)
    moved = (a["dpb"] != b["dpb"]) | (F.abs(a["mvx"] - b["mvx"]) >= 4) | (F.abs(a["mvy"] - b["mvy"]) >= 4)
    return F.when(a.isNull(), None).when(a["intra"] | b["intra"], 2).when(a["coded"] | b["coded"] | moved, 1).otherwise(0)


def _pass(own: DataFrame, horizontal: bool, chroma: bool, offset: int) -> DataFrame:
    """One pass over all edges of a plane: (plane, tx, ty, px, qp, motion) with px filtered at vertical edges, or ``horizontal`` ones.

    A block sees the blocks before and behind it and filters both its edges; what it changes lies on its own side, so no
    block is written twice. Each edge is worked out by both its blocks.
    """
    step = (0, 1) if horizontal else (1, 0)
    value = F.struct("px", "qp", "motion")
    seen = around(own, {"before": (-step[0], -step[1]), "behind": step}, value)
    near = seen.select("plane", "tx", "ty", "px", "qp", "motion", "before", "behind")
    near = near.withColumn("mb", F.col("before.motion")).withColumn("ma", F.col("behind.motion"))
    s1, s2 = strength("mb", "motion"), F.when(F.col("ma").isNotNull(), strength("motion", "ma"))
    given = near.select("plane", "tx", "ty", "qp", "motion", "px", F.col("before.px").alias("pb"), F.col("behind.px").alias("pa"), F.coalesce("before.qp", "qp").alias("qb"), F.coalesce("behind.qp", "qp").alias("qa"), F.coalesce(s1, F.lit(0)).alias("sb"), F.coalesce(s2, F.lit(0)).alias("sa"))
    names = [*given.columns[:5], "px"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            mine = b.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8).astype(np.int64)
            out = mine.transpose(0, 2, 1).copy() if horizontal else mine.copy()
            was = out.copy()
            qp = np.array(b.column(3))
            for side, other, q, bs in ((0, 6, 8, 10), (1, 7, 9, 11)):
                there = b.column(other).is_valid().to_numpy(zero_copy_only=False)
                if not there.any():
                    continue
                px = b.column(other).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8).astype(np.int64)
                px = px.transpose(0, 2, 1) if horizontal else px
                mean = (qp[there] + np.array(b.column(q))[there] + 1) >> 1
                power = np.array(b.column(bs))[there]
                first, second = (px, was[there]) if side == 0 else (was[there], px)
                p, r = first[:, :, ::-1], second
                if chroma:
                    a, z = chroma_filtered(p, r, mean, power, offset)
                else:
                    a, z, _ = filtered(p, r, mean, power)
                if side == 0:
                    out[there, :, :4] = z[..., :4]
                else:
                    out[there, :, 4:] = a[..., :4][:, :, ::-1]
            out = out.transpose(0, 2, 1) if horizontal else out
            px = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * 64), pa.array(out.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], px], names)

    return given.mapInArrow(run, given.select(*names).schema)


def deblocked_planes(own: DataFrame, chroma: bool = False, offset: int = 0) -> DataFrame:
    """Blocks (plane, tx, ty, px, qp, motion) after deblocking: first at all vertical edges of the 8x8 grid, then, on what this gives, at all horizontal ones.

    motion is a struct of intra, coded (has coefficients), dpb (its reference), mvx and mvy. With ``chroma`` the blocks are
    chroma samples, their edges are filtered where the strength is 2, and ``offset`` is added to their QP.
    """
    own = own.select("plane", F.col("tx").cast("int"), F.col("ty").cast("int"), F.col("px").cast("array<int>"), F.col("qp").cast("int"), "motion")
    return _pass(_pass(own, False, chroma, offset), True, chroma, offset)


def coded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with QP and motion made of their number and samples, smoothed so that all decisions occur."""
    own = tiles(spark, sf_dir)
    soft = F.when(F.col("block") % 3 == 0, 32).when(F.col("block") % 3 == 1, 8).otherwise(2)
    px = F.transform("px", lambda v: F.lit(128) + F.floor((v - 128) / soft).cast("int"))
    motion = F.struct(
        (F.col("label") == 0).alias("intra"),
        (F.col("label") % 4 == 1).alias("coded"),
        (F.col("block") % 2).cast("int").alias("dpb"),
        F.get("px", F.lit(9)).alias("mvx"),
        F.get("px", F.lit(18)).alias("mvy"),
    )
    return own.select("plane", "tx", "ty", px.alias("px"), (20 + F.col("block") % 32).cast("int").alias("qp"), motion.alias("motion"))


def _values(t: tuple[int, ...]) -> str:
    return ", ".join(f"({i}, {v})" for i, v in enumerate(t))


_SMOOTH = "2 * dpq{k} < b >> 2 AND flat{k} < b >> 3 AND step{k} < (5 * t + 1) >> 1"
_STRONG = "[greatest({a}0 - 2 * t, least({a}0 + 2 * t, ({a}2 + 2 * {a}1 + 2 * {a}0 + 2 * {b}0 + {b}1 + 4) >> 3)), greatest({a}1 - 2 * t, least({a}1 + 2 * t, ({a}2 + {a}1 + {a}0 + {b}0 + 2) >> 2)), greatest({a}2 - 2 * t, least({a}2 + 2 * t, (2 * {a}3 + 3 * {a}2 + {a}1 + {a}0 + {b}0 + 4) >> 3))]"
_NORMAL = "[greatest(0, least(255, {a}0 {s} delta)), CASE WHEN d{a} < (b + (b >> 1)) >> 3 THEN greatest(0, least(255, {a}1 + greatest(-(t >> 1), least(t >> 1, (((({a}2 + {a}0 + 1) >> 1) - {a}1) {s} delta) >> 1)))) ELSE {a}1 END, {a}2]"


def _sql_pass(k: int, source: str, horizontal: bool) -> str:
    """Common tables of one luma pass, from ``source`` (plane, x, y, v) to p<k>."""
    u, w = ("y", "x") if horizontal else ("x", "y")  # across and along the edges
    bu, bw = ("ty", "tx") if horizontal else ("tx", "ty")
    samples = ", ".join(f"max(CASE WHEN s.{u} = 8 * e.{bu} - {i + 1} THEN v END) AS p{i}, max(CASE WHEN s.{u} = 8 * e.{bu} + {i} THEN v END) AS q{i}" for i in range(4))
    sums = ", ".join(f"sum(CASE WHEN w % 4 = {j} THEN abs(p2 - 2 * p1 + p0) + abs(q2 - 2 * q1 + q0) END) AS dpq{j}, sum(CASE WHEN w % 4 = {j} THEN abs(p3 - p0) + abs(q0 - q3) END) AS flat{j}, sum(CASE WHEN w % 4 = {j} THEN abs(p0 - q0) END) AS step{j}" for j in (0, 3))
    side = lambda a, b, s: f"CASE WHEN de = 2 THEN {_STRONG.format(a=a, b=b)} WHEN de = 1 AND small THEN {_NORMAL.format(a=a, s=s)} ELSE [{a}0, {a}1, {a}2] END"
    return f"""e{k} AS MATERIALIZED (SELECT b.plane, b.tx, b.ty, (a.qp + b.qp + 1) >> 1 AS qp, CASE WHEN a.intra OR b.intra THEN 2 WHEN a.coded OR b.coded OR a.dpb <> b.dpb OR abs(a.mvx - b.mvx) >= 4 OR abs(a.mvy - b.mvy) >= 4 THEN 1 ELSE 0 END AS bs
  FROM motion b JOIN motion a ON a.plane = b.plane AND a.{bu} = b.{bu} - 1 AND a.{bw} = b.{bw}),
l{k} AS (SELECT e.plane, e.tx, e.ty, s.{w} AS w, any_value(bs) AS bs, any_value(b) AS b, any_value(t) AS t, {samples} FROM e{k} e JOIN beta ON beta.i = least(51, qp) JOIN tcs ON tcs.i = greatest(0, least(53, qp + 2 * (bs - 1)))
  JOIN {source} s ON s.plane = e.plane AND s.{w} // 8 = e.{bw} AND s.{u} BETWEEN 8 * e.{bu} - 4 AND 8 * e.{bu} + 3 GROUP BY e.plane, e.tx, e.ty, s.{w}),
d{k} AS (SELECT plane, tx, ty, w // 4 AS seg, any_value(bs) AS bs, any_value(b) AS b, any_value(t) AS t, {sums}, sum(CASE WHEN w % 4 IN (0, 3) THEN abs(p2 - 2 * p1 + p0) END) AS dp, sum(CASE WHEN w % 4 IN (0, 3) THEN abs(q2 - 2 * q1 + q0) END) AS dq FROM l{k} GROUP BY plane, tx, ty, w // 4),
f{k} AS (SELECT plane, tx, ty, seg, dp, dq, CASE WHEN bs = 0 OR dpq0 + dpq3 >= b THEN 0 WHEN {_SMOOTH.format(k=0)} AND {_SMOOTH.format(k=3)} THEN 2 ELSE 1 END AS de FROM d{k}),
n{k} AS (SELECT l.*, f.dp, f.dq, f.de, greatest(-t, least(t, (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4)) AS delta, abs((9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4) < 10 * t AS small FROM l{k} l JOIN f{k} f ON f.plane = l.plane AND f.tx = l.tx AND f.ty = l.ty AND f.seg = l.w // 4),
c{k} AS (SELECT plane, 8 * {bu} - 1 - unnest([0, 1, 2]) AS {u}, w AS {w}, unnest({side('p', 'q', '+')}) AS v FROM n{k} UNION ALL SELECT plane, 8 * {bu} + unnest([0, 1, 2]), w, unnest({side('q', 'p', '-')}) FROM n{k}),
p{k} AS MATERIALIZED (SELECT s.plane, s.x, s.y, coalesce(c.v, s.v) AS v FROM {source} s LEFT JOIN c{k} c ON c.plane = s.plane AND c.x = s.x AND c.y = s.y)"""


_CODED = f"""{_PLACED}, beta(i, b) AS (VALUES {_values(BETA)}), tcs(i, t) AS (VALUES {_values(TC)}),
motion AS MATERIALIZED (SELECT plane, tx, ty, (20 + block % 32)::INT AS qp, label = 0 AS intra, label % 4 = 1 AS coded, block % 2 AS dpb, px[10] AS mvx, px[19] AS mvy FROM tiles),
p0 AS MATERIALIZED (SELECT plane, (8 * tx + i % 8)::INT AS x, (8 * ty + i // 8)::INT AS y, 128 + floor((px[i + 1] - 128) / CASE block % 3 WHEN 0 THEN 32 WHEN 1 THEN 8 ELSE 2 END)::INT AS v FROM tiles, range(0, 64) r(i))"""


@query("deblock_plane", f"WITH {_CODED}, {_sql_pass(1, 'p0', False)}, {_sql_pass(2, 'p1', True)} SELECT plane, (x // 8)::INT AS tx, (y // 8)::INT AS ty, string_agg(v, ',' ORDER BY y, x) AS px FROM p2 GROUP BY 1, 2, 3")
def deblock_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma planes after both passes of deblocking, with strengths from motion and coefficients."""
    found = deblocked_planes(coded_tiles(spark, sf_dir))
    return found.select("plane", "tx", "ty", F.array_join("px", ",").alias("px"))


def _sql_chroma(k: int, source: str, horizontal: bool) -> str:
    u, w = ("y", "x") if horizontal else ("x", "y")
    bu, bw = ("ty", "tx") if horizontal else ("tx", "ty")
    samples = ", ".join(f"max(CASE WHEN s.{u} = 8 * e.{bu} - {i + 1} THEN v END) AS p{i}, max(CASE WHEN s.{u} = 8 * e.{bu} + {i} THEN v END) AS q{i}" for i in range(2))
    mapped = "CASE WHEN q < 30 THEN q WHEN q >= 43 THEN q - 6 ELSE list_extract([" + ", ".join(map(str, CHROMA_QP)) + "], q - 29) END"
    return f"""e{k} AS MATERIALIZED (SELECT plane, tx, ty, {mapped} AS qc FROM (SELECT b.plane, b.tx, b.ty, ((a.qp + b.qp + 1) >> 1) + 2 AS q FROM motion b JOIN motion a ON a.plane = b.plane AND a.{bu} = b.{bu} - 1 AND a.{bw} = b.{bw} WHERE a.intra OR b.intra)),
l{k} AS (SELECT e.plane, e.tx, e.ty, s.{w} AS w, any_value(t) AS t, {samples} FROM e{k} e JOIN tcs ON tcs.i = greatest(0, least(53, qc + 2)) JOIN {source} s ON s.plane = e.plane AND s.{w} // 8 = e.{bw} AND s.{u} BETWEEN 8 * e.{bu} - 2 AND 8 * e.{bu} + 1 GROUP BY e.plane, e.tx, e.ty, s.{w}),
n{k} AS (SELECT *, greatest(-t, least(t, ((q0 - p0) * 4 + p1 - q1 + 4) >> 3)) AS delta FROM l{k}),
c{k} AS (SELECT plane, 8 * {bu} - 1 AS {u}, w AS {w}, greatest(0, least(255, p0 + delta)) AS v FROM n{k} UNION ALL SELECT plane, 8 * {bu}, w, greatest(0, least(255, q0 - delta)) FROM n{k}),
p{k} AS MATERIALIZED (SELECT s.plane, s.x, s.y, coalesce(c.v, s.v) AS v FROM {source} s LEFT JOIN c{k} c ON c.plane = s.plane AND c.x = s.x AND c.y = s.y)"""


@query("deblock_chroma", f"WITH {_CODED}, {_sql_chroma(1, 'p0', False)}, {_sql_chroma(2, 'p1', True)} SELECT plane, (x // 8)::INT AS tx, (y // 8)::INT AS ty, string_agg(v, ',' ORDER BY y, x) AS px FROM p2 GROUP BY 1, 2, 3")
def deblock_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same planes as chroma samples, with an offset of 2 to their QP: only edges at intra blocks are filtered."""
    found = deblocked_planes(coded_tiles(spark, sf_dir), chroma=True, offset=2)
    return found.select("plane", "tx", "ty", F.array_join("px", ",").alias("px"))
