"""Filters over blocks: interpolation, weighted prediction, sample offsets, smoothing and edge strength.

Blocks are arrays in raster order, so a neighbour is an index, and a border is a clamped index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.functions.scalar import clip3
from planegrid.plans.registry import BLOCKS, PAIRS, SAMPLES, query
from planegrid.sources.tables import block_pairs, blocks

#: Interpolation taps in 1/64 by quarter and eighth sample, fixed values of the H.265 text (tables 8-11 and 8-12).
LUMA = ((0, 0, 0, 64, 0, 0, 0, 0), (-1, 4, -10, 58, 17, -5, 1, 0), (-1, 4, -11, 40, 40, -11, 4, -1), (0, 1, -5, 17, 58, -10, 4, -1))
CHROMA = ((0, 64, 0, 0), (-2, 58, 10, -2), (-4, 54, 16, -2), (-6, 46, 28, -4), (-4, 36, 36, -4), (-4, 28, 46, -6), (-2, 16, 54, -4), (-2, 10, 58, -2))


def at(px: Column, x: Column, y: Column) -> Column:
    """The sample at (x, y) of an 8x8 block, borders repeated."""
    return F.get(px, clip3(0, 7, y) * 8 + clip3(0, 7, x))


def along_x(px: Column, taps: tuple[int, ...]) -> Column:
    """The taps' sums along each row, not yet scaled."""

    def one(_: Column, i: Column) -> Column:
        x, y = i % 8, F.floor(i / 8).cast("int")
        total = F.lit(0)
        for k, t in enumerate(taps):
            if t:
                total = total + at(px, x + (k - len(taps) // 2 + 1), y) * t
        return total

    return F.transform(px, one)


def along_y(px: Column, taps: tuple[int, ...]) -> Column:
    def one(_: Column, i: Column) -> Column:
        x, y = i % 8, F.floor(i / 8).cast("int")
        total = F.lit(0)
        for k, t in enumerate(taps):
            if t:
                total = total + at(px, x, y + (k - len(taps) // 2 + 1)) * t
        return total

    return F.transform(px, one)


def joined(px: Column) -> Column:
    """An array as text, one form for both engines."""
    return F.array_join(px, ",")


def _tap_sql(taps: tuple[int, ...], axis: str, source: str = "v", table: str = "samples") -> str:
    """Sums along an axis as a join of every sample with its clamped neighbours."""
    weights = ", ".join(f"({k - len(taps) // 2 + 1}, {t})" for k, t in enumerate(taps) if t)
    other = "y" if axis == "x" else "x"
    return f"(SELECT a.block, a.x, a.y, sum(b.{source} * w.t) AS s FROM {table} a CROSS JOIN (VALUES {weights}) w(d, t) JOIN {table} b ON b.block = a.block AND b.{other} = a.{other} AND b.{axis} = greatest(0, least(7, a.{axis} + w.d)) GROUP BY ALL)"


def _list(expr: str) -> str:
    return f"string_agg(({expr})::INT, ',' ORDER BY y, x)"


def taps(blocks_: np.ndarray, weights: tuple[int, ...], axis: int) -> np.ndarray:
    """Blocks [block, y, x] weighted by taps along an axis, three samples before each to four behind; borders are repeated."""
    n = blocks_.shape[axis]
    wide = np.pad(blocks_, [(3, 4) if a == axis else (0, 0) for a in range(3)], mode="edge")
    return sum(t * np.take(wide, np.arange(k, k + n), axis) for k, t in enumerate(weights))


@query("interp_luma", f"WITH {SAMPLES}, h AS {_tap_sql(LUMA[1], 'x')}, hv AS {_tap_sql(LUMA[2], 'y', 's', 'h')} SELECT block, {_list('greatest(0, least(255, (s + 2048)::BIGINT >> 12))')} AS pred FROM hv GROUP BY block")
def interp_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter sample to the right and half a sample down, 8 taps each way."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8).astype(np.int64)
            out = np.clip(taps(taps(px, LUMA[1], 2), LUMA[2], 1) + 2048 >> 12, 0, 255).astype(np.int32)
            offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * 64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))], ["block", "s"])

    own = blocks(spark, sf_dir).select(F.col("block").cast("long"), F.col("px").cast("array<int>"))
    return own.mapInArrow(run, "block long, s array<int>").select("block", joined(F.col("s")).alias("pred"))


@query("interp_chroma", f"WITH {SAMPLES}, h AS {_tap_sql(CHROMA[3], 'x')} SELECT block, {_list('greatest(0, least(255, (s + 32)::BIGINT >> 6))')} AS pred FROM h GROUP BY block")
def interp_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three eighths of a sample to the right, 4 taps."""
    h = blocks(spark, sf_dir).select("block", along_x(F.col("px"), CHROMA[3]).alias("s"))
    return h.select("block", joined(F.transform("s", lambda s: clip3(0, 255, F.shiftright(s + 32, 6)))).alias("pred"))


@query(
    "interp_bi",
    f"WITH {PAIRS}, a AS {_tap_sql(LUMA[1], 'x', 'src', 'pairs')}, b AS {_tap_sql(LUMA[3], 'y', 'ref', 'pairs')} SELECT block, {_list('greatest(0, least(255, (a.s + b.s + 64)::BIGINT >> 7))')} AS pred FROM a JOIN b USING (block, x, y) GROUP BY block",
)
def interp_bi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of two references at 14 bits, each with its own fraction."""
    own = block_pairs(spark, sf_dir).select("block", along_x(F.col("src"), LUMA[1]).alias("a"), along_y(F.col("ref"), LUMA[3]).alias("b"))
    return own.select("block", joined(F.zip_with("a", "b", lambda x, y: clip3(0, 255, F.shiftright(x + y + 64, 7)))).alias("pred"))


@query("weighted_pred", f"WITH {PAIRS} SELECT block, {_list('greatest(0, least(255, ((src * 40 + 32) >> 6) + 3))')} AS uni, {_list('greatest(0, least(255, (src * 40 + ref * 24 + ((3 - 2 + 1) << 5)) >> 6))')} AS bi FROM pairs GROUP BY block")
def weighted_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit weights 40/64 and 24/64 with offsets 3 and -2, from one reference and from two."""
    uni = F.transform("src", lambda v: clip3(0, 255, F.shiftright(v * 40 + 32, 6) + 3))
    bi = F.zip_with("src", "ref", lambda a, b: clip3(0, 255, F.shiftright(a * 40 + b * 24 + ((3 - 2 + 1) << 5), 6)))
    return block_pairs(spark, sf_dir).select("block", joined(uni).alias("uni"), joined(bi).alias("bi"))


@query("sao_band_filter", f"WITH {SAMPLES} SELECT block, {_list('greatest(0, least(255, v + CASE WHEN (v >> 3) BETWEEN 12 AND 15 THEN list_extract([3, -2, 1, -4], ((v >> 3) - 11)::INT) ELSE 0 END))')} AS out FROM samples GROUP BY block")
def sao_band_filter(spark: SparkSession, sf_dir: str, position: int = 12, offsets: tuple[int, ...] = (3, -2, 1, -4)) -> DataFrame:
    """Offsets for four neighbouring bands of eight levels."""
    table = F.array(*map(F.lit, offsets))
    return blocks(spark, sf_dir).select("block", joined(F.transform("px", lambda v: clip3(0, 255, v + F.coalesce(F.get(table, F.shiftright(v, 3) - position), F.lit(0))))).alias("out"))


@query(
    "sao_edge_filter",
    f"""WITH {SAMPLES}, e AS (SELECT a.block, a.x, a.y, a.v, CASE WHEN a.x IN (0, 7) THEN 2 ELSE 2 + sign(a.v - l.v) + sign(a.v - r.v) END AS c FROM samples a LEFT JOIN samples l ON l.block = a.block AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN samples r ON r.block = a.block AND r.y = a.y AND r.x = a.x + 1)
SELECT block, {_list('greatest(0, least(255, v + list_extract([2, 1, 0, -1, -2], (c + 1)::INT)))')} AS out FROM e GROUP BY block""",
)
def sao_edge_filter(spark: SparkSession, sf_dir: str, offsets: tuple[int, ...] = (2, 1, 0, -1, -2)) -> DataFrame:
    """Offsets by the signs against the left and right neighbour; columns at the border stay."""
    table, px = F.array(*map(F.lit, offsets)), F.col("px")

    def one(v: Column, i: Column) -> Column:
        sign = lambda d: F.signum((v - F.get(px, i + d)).cast("double")).cast("int")
        return F.when((i % 8 == 0) | (i % 8 == 7), v).otherwise(clip3(0, 255, v + F.get(table, 2 + sign(-1) + sign(1))))

    return blocks(spark, sf_dir).select("block", joined(F.transform(px, one)).alias("out"))


@query(
    "intra_smooth",
    f"""WITH {SAMPLES}, n AS (SELECT block, v, row_number() OVER (PARTITION BY block ORDER BY CASE WHEN x = 0 THEN -y ELSE x END) - 1 AS i FROM samples WHERE x = 0 OR y = 0),
s AS (SELECT block, i, CASE WHEN i IN (0, 14) THEN v ELSE (lag(v) OVER w + 2 * v + lead(v) OVER w + 2) >> 2 END AS v FROM n WINDOW w AS (PARTITION BY block ORDER BY i)) SELECT block, string_agg(v::INT, ',' ORDER BY i) AS smooth FROM s GROUP BY block""",
)
def intra_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(1, 2, 1) / 4 along a block's left column from the bottom and its top row; the ends stay."""
    order = [8 * y for y in range(7, -1, -1)] + list(range(1, 8))
    edge = F.transform(F.array(*map(F.lit, order)), lambda i: F.get("px", i))
    own = blocks(spark, sf_dir).select("block", edge.alias("e"))
    e = F.col("e")
    smooth = F.transform(e, lambda v, i: F.when((i == 0) | (i == 14), v).otherwise(F.shiftright(F.get(e, i - 1) + 2 * v + F.get(e, i + 1) + 2, 2)))
    return own.select("block", joined(smooth).alias("smooth"))


@query(
    "intra_strong_smooth",
    f"""WITH {BLOCKS}, c AS (SELECT block, px[57] AS bl, px[1] AS tl, px[8] AS tr, px[29] AS l, px[5] AS t FROM blocks) SELECT block, abs(bl + tl - 2 * l) < 64 AND abs(tl + tr - 2 * t) < 64 AS flat, string_agg((((8 - i) * tl + i * tr + 4) >> 3)::INT, ',' ORDER BY i) AS top FROM c, range(0, 8) r(i) GROUP BY ALL""",
)
def intra_strong_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both edges are nearly straight lines, and the line that would stand in for the top row."""
    v = lambda i: F.get("px", i)
    own = blocks(spark, sf_dir).select("block", v(F.lit(56)).alias("bl"), v(F.lit(0)).alias("tl"), v(F.lit(7)).alias("tr"), v(F.lit(28)).alias("l"), v(F.lit(4)).alias("t"))
    flat = (F.abs(F.expr("bl + tl - 2 * l")) < 64) & (F.abs(F.expr("tl + tr - 2 * t")) < 64)
    top = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.shiftright((8 - i) * F.col("tl") + i * F.col("tr") + 4, 3))
    return own.select("block", flat.alias("flat"), joined(top).alias("top"))


@query(
    "deblock_strength",
    f"""WITH {PAIRS}, e AS (SELECT block, label, sum(CASE WHEN x = 7 THEN src END) AS p, sum(CASE WHEN x = 0 THEN ref END) AS q FROM pairs GROUP BY ALL)
SELECT block, (CASE WHEN label = 0 THEN 2 WHEN abs(p - q) // 8 >= 4 THEN 1 ELSE 0 END)::INT AS strength FROM e""",
)
def deblock_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 at an intra block (label 0), 1 where motion (here the mean step at the edge) differs by 4 or more, else 0."""
    column = lambda c, x: F.aggregate(F.array(*[F.get(c, F.lit(8 * y + x)) for y in range(8)]), F.lit(0), lambda a, v: a + v)
    own = blocks(spark, sf_dir).select("block", "label").join(block_pairs(spark, sf_dir), "block")
    step = F.floor(F.abs(column("src", 7) - column("ref", 0)) / 8)
    return own.select("block", F.when(F.col("label") == 0, 2).when(step >= 4, 1).otherwise(0).alias("strength"))


_DEBLOCK = f"""WITH {PAIRS}, p AS (SELECT block, y, max(CASE WHEN x = 4 THEN src END) AS p3, max(CASE WHEN x = 5 THEN src END) AS p2, max(CASE WHEN x = 6 THEN src END) AS p1, max(CASE WHEN x = 7 THEN src END) AS p0,
max(CASE WHEN x = 0 THEN ref END) AS q0, max(CASE WHEN x = 1 THEN ref END) AS q1, max(CASE WHEN x = 2 THEN ref END) AS q2, max(CASE WHEN x = 3 THEN ref END) AS q3 FROM pairs GROUP BY ALL),
d AS (SELECT *, (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4 AS delta FROM p)
SELECT block, y, CASE WHEN abs(delta) < 10 * 12 THEN greatest(0, least(255, p0 + greatest(-12, least(12, delta)))) ELSE p0 END::INT AS p0, CASE WHEN abs(delta) < 10 * 12 THEN greatest(0, least(255, q0 - greatest(-12, least(12, delta)))) ELSE q0 END::INT AS q0 FROM d"""


@query("deblock_normal", _DEBLOCK)
def deblock_normal(spark: SparkSession, sf_dir: str, tc: int = 12) -> DataFrame:
    """The normal luma filter across the edge between a block and the next, row by row, clipped to tc."""
    own = block_pairs(spark, sf_dir).select("block", "src", "ref", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
    v = lambda c, x: F.get(c, F.col("y") * 8 + x)
    own = own.select("block", "y", v("src", 6).alias("p1"), v("src", 7).alias("p0"), v("ref", 0).alias("q0"), v("ref", 1).alias("q1"))
    delta = F.shiftright(F.expr("9 * (q0 - p0) - 3 * (q1 - p1) + 8"), 4)
    cut = clip3(-tc, tc, delta)
    on = F.abs(delta) < 10 * tc
    return own.select("block", "y", F.when(on, clip3(0, 255, F.col("p0") + cut)).otherwise(F.col("p0")).alias("p0"), F.when(on, clip3(0, 255, F.col("q0") - cut)).otherwise(F.col("q0")).alias("q0"))


@query("padding", f"WITH {SAMPLES} SELECT block, string_agg(v::INT, ',' ORDER BY py, px) AS padded FROM (SELECT a.block, px, py, a.v FROM range(-2, 10) r(px), range(-2, 10) s(py), samples a WHERE a.x = greatest(0, least(7, px)) AND a.y = greatest(0, least(7, py))) GROUP BY block")
def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of repeated border on every side."""
    places = F.array(*[F.lit(8 * min(7, max(0, y)) + min(7, max(0, x))) for y in range(-2, 10) for x in range(-2, 10)])
    return blocks(spark, sf_dir).select("block", joined(F.transform(places, lambda i: F.get("px", i))).alias("padded"))


#: The 8-point integer cosine transform of the H.265 text (8.6.4.2): rows of the matrix, fixed values.
DCT8 = (
    (64, 64, 64, 64, 64, 64, 64, 64),
    (89, 75, 50, 18, -18, -50, -75, -89),
    (83, 36, -36, -83, -83, -36, 36, 83),
    (75, -18, -89, -50, 50, 89, 18, -75),
    (64, -64, -64, 64, 64, -64, -64, 64),
    (50, -89, 18, 75, -75, -18, 89, -50),
    (36, -83, 83, -36, -36, 83, -83, 36),
    (18, -50, 75, -89, 89, -75, 50, -18),
)


_DCT_VALUES = ", ".join(f"({u}, {k}, {v})" for u, r in enumerate(DCT8) for k, v in enumerate(r))


@query(
    "dct8",
    f"""WITH {PAIRS}, m(u, k, t) AS (VALUES {_DCT_VALUES}), h AS (SELECT block, y, u, (sum((src - ref) * t) + 2)::BIGINT >> 2 AS s FROM pairs JOIN m ON k = x GROUP BY ALL),
c AS (SELECT block, h.u AS x, m.u AS y, (sum(s * t) + 256)::BIGINT >> 9 AS s FROM h JOIN m ON k = y GROUP BY ALL) SELECT block, {_list('s')} AS coefficients FROM c GROUP BY block""",
)
def dct8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward transform of the residual: rows, then columns, each with its rounding shift."""
    from planegrid.operators.transforms import residuals, transformed

    return transformed(residuals(spark, sf_dir), 8).select("block", joined(F.col("values")).alias("coefficients"))
