"""Intra prediction of square luma blocks in all 35 modes, and the search for the best ones.

Blocks are rows (block, src, top, left): the samples, and what lies above and to the left, both beginning with the
corner and twice as long as a side behind it. A mode predicts all blocks of a batch as one NumPy stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.plans.registry import BLOCKS, query
from planegrid.sources.tables import block_pairs

PLANAR, DC, HORIZONTAL, VERTICAL, MODES = 0, 1, 10, 26, 35
#: Fixed values of the H.265 text (tables 8-5 and 8-6): 32nds of a sample that modes 2 to 34 move a line, and the inverses of modes 11 to 25.
ANGLES = (32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32)
INVERSES = (-4096, -1638, -910, -630, -482, -390, -315, -256, -315, -390, -482, -630, -910, -1638, -4096)


def predicted(mode: int, top: np.ndarray, left: np.ndarray) -> np.ndarray:
    """[block, y, x] of one mode; top and left are [block, 2 n + 1] from the corner on."""
    n = (top.shape[1] - 1) // 2
    top, left = top.astype(np.int64), left.astype(np.int64)
    if mode == PLANAR:
        x, y = np.arange(n)[None, None, :], np.arange(n)[None, :, None]
        across = (n - 1 - x) * left[:, 1 : n + 1, None] + (x + 1) * top[:, n + 1, None, None]
        down = (n - 1 - y) * top[:, None, 1 : n + 1] + (y + 1) * left[:, n + 1, None, None]
        return across + down + n >> n.bit_length()
    if mode == DC:
        dc = (top[:, 1 : n + 1].sum(1) + left[:, 1 : n + 1].sum(1) + n >> n.bit_length())[:, None]
        out = np.repeat(dc, n * n, 1).reshape(-1, n, n)
        if n < 32:
            out[:, 0, :] = top[:, 1 : n + 1] + 3 * dc + 2 >> 2
            out[:, :, 0] = left[:, 1 : n + 1] + 3 * dc + 2 >> 2
            out[:, 0, 0] = left[:, 1] + 2 * dc[:, 0] + top[:, 1] + 2 >> 2
        return out
    upright = mode >= 18
    main, side = (top, left) if upright else (left, top)
    angle = ANGLES[mode - 2]
    low = min(0, (n * angle >> 5) + 1)
    if low < 0:
        back = np.arange(low, 0) * INVERSES[mode - 11] + 128 >> 8
        main = np.concatenate([side[:, back], main], 1)
    out = np.empty((len(main), n, n), np.int64)  # [block, away from main, along it]
    for d in range(n):
        step, part = (d + 1) * angle >> 5, (d + 1) * angle & 31
        at = np.arange(n) + step + 1 - low
        out[:, d] = (32 - part) * main[:, at] + part * main[:, at + (part > 0)] + 16 >> 5
    if angle == 0 and n < 32:
        out[:, :, 0] = np.clip(main[:, 1, None] + (side[:, 1 : n + 1] - side[:, :1] >> 1), 0, 255)
    return out if upright else out.transpose(0, 2, 1)


def mode_costs(df: DataFrame, n: int = 8) -> DataFrame:
    """(block, src, top, left) to a row per block and mode: sad, and check, the sum of the samples times their numbers from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, top, left = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for i in (1, 2, 3))
            weights = np.arange(1, n * n + 1)
            sad, check = np.empty((len(b), MODES), np.int64), np.empty((len(b), MODES), np.int64)
            for mode in range(MODES):
                own = predicted(mode, top, left).reshape(len(b), -1)
                sad[:, mode], check[:, mode] = np.abs(src - own).sum(1), own @ weights
            ids = pa.array(np.repeat(np.array(b.column(0), np.int64), MODES))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(MODES, dtype=np.int32), len(b))), pa.array(sad.ravel()), pa.array(check.ravel())], ["block", "mode", "sad", "check"])

    own = df.select(F.col("block").cast("long"), *[F.col(c).cast("array<int>") for c in ("src", "top", "left")])
    return own.mapInArrow(run, "block long, mode int, sad long, check long")


def bordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the next one's lowest row and right column as neighbours, its own behind them."""
    line = lambda c, at: F.array(*[F.get(c, F.lit(at(i))) for i in range(8)])
    around = lambda at: F.concat(F.array(F.get("ref", F.lit(63))), line("ref", at), line("src", at))
    return block_pairs(spark, sf_dir).select("block", "src", around(lambda i: 56 + i).alias("top"), around(lambda i: 8 * i + 7).alias("left"))


_MODES = ", ".join(f"({m}, {a}, {INVERSES[m - 11] if 11 <= m <= 25 else 0})" for m, a in enumerate(ANGLES, 2))
_REF = "CASE WHEN {i} >= 0 THEN main[{i} + 1] ELSE side[(({i} * inv + 128) >> 8) + 1] END"
_COSTS = f"""{BLOCKS}, n AS MATERIALIZED (SELECT a.block, a.px AS src, list_concat([b.px[64]], b.px[57:64], a.px[57:64]) AS top, list_concat([b.px[64]], list_transform(range(1, 9), lambda i: b.px[(8 * i)::INT]), list_transform(range(1, 9), lambda i: a.px[(8 * i)::INT])) AS lft FROM blocks a JOIN blocks b ON b.block = a.block + 1),
modes(mode, angle, inv) AS (VALUES {_MODES}), grid AS (SELECT x::INT AS x, y::INT AS y FROM range(8) r(x), range(8) s(y)),
dcs AS (SELECT *, (list_sum(top[2:9]) + list_sum(lft[2:9]) + 8)::BIGINT >> 4 AS dc FROM n),
turned AS (SELECT block, src, mode, angle, inv, CASE WHEN mode >= 18 THEN top ELSE lft END AS main, CASE WHEN mode >= 18 THEN lft ELSE top END AS side FROM n, modes),
placed AS (SELECT *, CASE WHEN mode >= 18 THEN x ELSE y END AS a, CASE WHEN mode >= 18 THEN y ELSE x END AS d FROM turned, grid),
stepped AS (SELECT *, a + (((d + 1) * angle) >> 5) + 1 AS i, ((d + 1) * angle) & 31 AS f FROM placed),
angular AS (SELECT block, src, mode, x, y, CASE WHEN angle = 0 AND a = 0 THEN greatest(0, least(255, main[2] + ((side[d + 2] - side[1]) >> 1))) ELSE ((32 - f) * ({_REF.format(i='i')}) + f * coalesce({_REF.format(i='(i + 1)')}, 0) + 16) >> 5 END AS p FROM stepped),
plain AS (SELECT block, src, 0 AS mode, x, y, ((7 - x) * lft[y + 2] + (x + 1) * top[10] + (7 - y) * top[x + 2] + (y + 1) * lft[10] + 8) >> 4 AS p FROM n, grid
UNION ALL SELECT block, src, 1, x, y, CASE WHEN x = 0 AND y = 0 THEN (lft[2] + 2 * dc + top[2] + 2) >> 2 WHEN y = 0 THEN (top[x + 2] + 3 * dc + 2) >> 2 WHEN x = 0 THEN (lft[y + 2] + 3 * dc + 2) >> 2 ELSE dc END FROM dcs, grid),
costs AS (SELECT block, mode::INT AS mode, sum(abs(src[8 * y + x + 1] - p))::BIGINT AS sad, sum(p * (8 * y + x + 1))::BIGINT AS "check" FROM (SELECT * FROM angular UNION ALL SELECT * FROM plain) GROUP BY block, mode)"""


@query("intra_predictions", f'WITH {_COSTS} SELECT block, mode, sad, "check" FROM costs')
def intra_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block predicted in every mode."""
    return mode_costs(bordered(spark, sf_dir))


@query(
    "intra_search",
    f"WITH {_COSTS}, r AS (SELECT block, mode, sad + 4 * CASE WHEN mode = 0 THEN 2 WHEN mode IN (1, 26) THEN 3 ELSE 6 END AS cost FROM costs), k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY cost, mode) AS rank FROM r) SELECT block, rank, mode, cost FROM k WHERE rank <= 8",
)
def intra_search(spark: SparkSession, sf_dir: str, lagrangian: int = 4, best: int = 8) -> DataFrame:
    """The eight candidates of least SAD and mode bits, with planar, DC and vertical as the probable modes: what a full search refines."""
    bits = F.when(F.col("mode") == PLANAR, 2).when(F.col("mode").isin(DC, VERTICAL), 3).otherwise(6)
    own = mode_costs(bordered(spark, sf_dir)).select("block", "mode", (F.col("sad") + lagrangian * bits).alias("cost"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("cost", "mode"))
    return own.select("block", rank.alias("rank"), "mode", "cost").where(F.col("rank") <= best)
