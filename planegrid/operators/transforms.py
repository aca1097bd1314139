"""Integer cosine and sine transforms of square residual blocks, forward and inverse, 4 to 32 points.

A batch's blocks are one NumPy stack, so a transform is two products by one matrix with a rounding shift behind
each; the matrices follow from the 31 values of the 32-point one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.plans.registry import PAIRS, query
from planegrid.sources.tables import block_pairs

#: Fixed values of the H.265 text (8.6.4.2): round 64 sqrt(2) cos(j pi / 64) for j = 1 to 31, as tuned there.
COSINES = (90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4)
#: Fixed values of the same text: the 4-point sine transform.
DST4 = ((29, 55, 74, 84), (74, 74, 0, -74), (84, -29, -74, 55), (55, -84, 74, -29))


def cosine_matrix(n: int) -> np.ndarray:
    """Rows are the basis functions of the n-point transform: every 32 / n th row of the 32-point one, cut to n."""

    def value(j: int) -> int:
        j %= 128
        j = min(j, 128 - j)
        return COSINES[j - 1] if 0 < j < 32 else -COSINES[63 - j] if 32 < j < 64 else 0

    step = 32 // n
    return np.array([[64 if k == 0 else value((2 * i + 1) * k * step) for i in range(n)] for k in range(n)], np.int64)


def _matrix(n: int, sine: bool) -> np.ndarray:
    return np.array(DST4, np.int64) if sine else cosine_matrix(n)


def forward(x: np.ndarray, sine: bool = False, bit_depth: int = 8) -> np.ndarray:
    """[block, y, x] residuals to coefficients: rows, then columns."""
    n = x.shape[-1]
    m, log = _matrix(n, sine), n.bit_length() - 1
    first, second = log + bit_depth - 9, log + 6
    rows = x.astype(np.int64) @ m.T
    rows = rows + (1 << first >> 1) >> first
    return m @ rows + (1 << second >> 1) >> second


def inverse(c: np.ndarray, sine: bool = False, bit_depth: int = 8) -> np.ndarray:
    """[block, y, x] coefficients to residuals: columns, clipped to 16 bits, then rows."""
    m = _matrix(c.shape[-1], sine)
    columns = np.clip(m.T @ c.astype(np.int64) + 64 >> 7, -32768, 32767)
    second = 20 - bit_depth
    return columns @ m + (1 << second >> 1) >> second


def transformed(df: DataFrame, n: int, back: bool = False, sine: bool = False, bit_depth: int = 8) -> DataFrame:
    """(block, values of n x n samples in raster order) to (block, values) transformed, forward or ``back``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n, n)
            out = (inverse if back else forward)(x, sine, bit_depth).reshape(len(b), -1)
            offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * n * n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["block", "values"])

    return df.select(F.col("block").cast("long"), F.col("values").cast("array<long>")).mapInArrow(run, "block long, values array<long>")


def residuals(spark: SparkSession, sf_dir: str, side: int = 1) -> DataFrame:
    """The difference of each block and the next one; ``side`` by ``side`` neighbours make one block of 8 * side samples a row."""
    own = block_pairs(spark, sf_dir).select("block", F.zip_with("src", "ref", lambda a, b: a - b).alias("values"))
    if side == 1:
        return own
    n = side * side
    parts = own.groupBy(F.expr(f"block div {n}").alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("block") % n).alias("i"), "values"))).alias("p")).where(F.size("p") == n)
    row = lambda y, x: F.slice(F.get("p", F.lit(y // 8 * side + x))["values"], y % 8 * 8 + 1, 8)
    return parts.select("block", F.concat(*[row(y, x) for y in range(8 * side) for x in range(side)]).alias("values"))


def _values(m: np.ndarray) -> str:
    return ", ".join(f"({k}, {i}, {v})" for k, r in enumerate(m.tolist()) for i, v in enumerate(r))


def _sql(n: int, back: bool = False, sine: bool = False) -> str:
    """The transform as two joins with its matrix."""
    side, log = max(1, n // 8), n.bit_length() - 1
    tall = f"x + 8 * (block % {side * side} % {side})"
    group = f"block // {side * side}"
    low = f"y + 8 * (block % {side * side} // {side})"
    if n < 8:
        group, tall, low = f"4 * block + 2 * (y // {n}) + x // {n}", f"x % {n}", f"y % {n}"
    r = f"r AS (SELECT ({group})::BIGINT AS block, ({tall})::INT AS x, ({low})::INT AS y, (src - ref)::BIGINT AS v FROM pairs), w AS (SELECT * FROM r WHERE block IN (SELECT block FROM r GROUP BY block HAVING count(*) = {n * n}))"
    m = f"m(u, k, t) AS MATERIALIZED (VALUES {_values(_matrix(n, sine))})"
    if back:
        h = "h AS (SELECT block, x, m.k AS y, greatest(-32768, least(32767, (sum(v * t) + 64)::BIGINT >> 7)) AS s FROM w JOIN m ON m.u = w.y GROUP BY ALL)"
        c = "c AS (SELECT block, m.k AS x, y, (sum(s * t) + 2048)::BIGINT >> 12 AS s FROM h JOIN m ON m.u = h.x GROUP BY block, m.k, y)"
    else:
        first, second = log - 1, log + 6
        h = f"h AS (SELECT block, y, m.u, (sum(v * t) + {1 << first >> 1})::BIGINT >> {first} AS s FROM w JOIN m ON m.k = w.x GROUP BY ALL)"
        c = f"c AS (SELECT block, h.u AS x, m.u AS y, (sum(s * t) + {1 << second >> 1})::BIGINT >> {second} AS s FROM h JOIN m ON m.k = h.y GROUP BY block, h.u, m.u)"
    return f"WITH {PAIRS}, {m}, {r}, {h}, {c} SELECT block, string_agg(s::BIGINT, ',' ORDER BY y, x) AS coefficients FROM c GROUP BY block"


def _named(own: DataFrame) -> DataFrame:
    return own.select("block", F.array_join("values", ",").alias("coefficients"))


@query("idct8", _sql(8, back=True))
def idct8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse 8-point transform, residuals standing in for coefficients."""
    return _named(transformed(residuals(spark, sf_dir), 8, back=True))


@query("dct16", _sql(16))
def dct16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward 16-point transform of four blocks' residuals."""
    return _named(transformed(residuals(spark, sf_dir, 2), 16))


@query("dct32", _sql(32))
def dct32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward 32-point transform of sixteen blocks' residuals."""
    return _named(transformed(residuals(spark, sf_dir, 4), 32))


def quarters(own: DataFrame) -> DataFrame:
    """8x8 blocks to their four 4x4 blocks, numbered 4 * block + quarter."""
    part = lambda q: F.concat(*[F.slice("values", 8 * (4 * (q // 2) + y) + 4 * (q % 2) + 1, 4) for y in range(4)])
    each = own.select("block", F.posexplode(F.array(*[part(q) for q in range(4)])).alias("q", "values"))
    return each.select((4 * F.col("block") + F.col("q")).alias("block"), "values")


@query("dct4", _sql(4))
def dct4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward 4-point transform of each quarter."""
    return _named(transformed(quarters(residuals(spark, sf_dir)), 4))


@query("dst4", _sql(4, sine=True))
def dst4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward sine transform of each quarter, which intra luma of this size takes."""
    return _named(transformed(quarters(residuals(spark, sf_dir)), 4, sine=True))


@query("idst4", _sql(4, back=True, sine=True))
def idst4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(transformed(quarters(residuals(spark, sf_dir)), 4, back=True, sine=True))
