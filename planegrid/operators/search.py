"""Candidate searches: motion, intra modes, splits, merge lists; each a ranked table of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.functions.scalar import bit_length
from planegrid.operators.distortion import sad
from planegrid.operators.filters import at
from planegrid.plans.registry import BLOCKS, PAIRS, SAMPLES, query
from planegrid.sources.tables import block_pairs, blocks


RANGE = 2


@query(
    "motion_search",
    f"""WITH {PAIRS}, o AS (SELECT dx, dy, (dy + {RANGE}) * {2 * RANGE + 1} + dx + {RANGE} AS seq, 2 * (CASE WHEN dx = 0 THEN 0 ELSE length(bin(abs(dx))) END + CASE WHEN dy = 0 THEN 0 ELSE length(bin(abs(dy))) END + 1) AS bits FROM range(-{RANGE}, {RANGE + 1}) a(dx), range(-{RANGE}, {RANGE + 1}) b(dy)),
c AS (SELECT p.block, o.dx, o.dy, o.seq, sum(abs(p.src - r.ref))::BIGINT + 4 * o.bits AS cost FROM pairs p, o JOIN pairs r ON r.block = p.block AND r.x = greatest(0, least(7, p.x + o.dx)) AND r.y = greatest(0, least(7, p.y + o.dy)) GROUP BY p.block, o.dx, o.dy, o.seq, o.bits)
SELECT block, arg_min(dx, cost * 100 + seq)::INT AS dx, arg_min(dy, cost * 100 + seq)::INT AS dy, min(cost)::BIGINT AS cost FROM c GROUP BY block""",
)
def motion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every displacement in reach by SAD and the vector's bits at lambda 4; the first of equals."""
    return searched(block_pairs(spark, sf_dir))


def searched(pairs: DataFrame, size: int = 8, reach: int = RANGE, lagrangian: int = 4) -> DataFrame:
    """(block, src, ref), square blocks of ``size`` in raster order, to (block, dx, dy, cost) of the best displacement.

    All blocks of a batch are tried together, a displacement at a time. Borders are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, ref = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, size, size) for i in (1, 2))
            wide = np.pad(ref, ((0, 0), (reach, reach), (reach, reach)), mode="edge")
            least, best = np.full(len(src), np.iinfo(np.int64).max), np.zeros((2, len(src)), np.int32)
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    seen = wide[:, reach + dy : reach + dy + size, reach + dx : reach + dx + size]
                    bits = 2 * (abs(dx).bit_length() + abs(dy).bit_length() + 1)
                    cost = np.abs(src - seen).sum((1, 2), dtype=np.int64) + lagrangian * bits
                    less = cost < least
                    least[less] = cost[less]
                    best[:, less] = [[dx], [dy]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best[0]), pa.array(best[1]), pa.array(least)], ["block", "dx", "dy", "cost"])

    return pairs.select(F.col("block").cast("long"), F.col("src").cast("array<int>"), F.col("ref").cast("array<int>")).mapInArrow(run, "block long, dx int, dy int, cost long")


@query(
    "bi_search",
    f"""WITH {PAIRS}, c AS (SELECT p.block, k, sum(abs(greatest(0, least(255, 2 * p.src - p.ref)) - b.v))::BIGINT AS cost FROM pairs p, range(1, 5) r(k) JOIN samples b ON b.block = p.block + 1 + k AND b.x = p.x AND b.y = p.y GROUP BY ALL)
SELECT block, arg_min(k, cost * 10 + k)::INT AS second, min(cost)::BIGINT AS cost FROM c GROUP BY block""",
)
def bi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the next block as first reference, the best second one among the four behind it, for the target 2 src - ref."""
    target = block_pairs(spark, sf_dir).select("block", F.zip_with("src", "ref", lambda s, p: F.greatest(F.lit(0), F.least(F.lit(255), 2 * s - p))).alias("t"))
    tried = target.select("block", "t", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).withColumn("at", F.col("block") + 1 + F.col("k"))
    cost = tried.join(blocks(spark, sf_dir).select(F.col("block").alias("at"), "px"), "at").select("block", "k", sad(F.col("t"), F.col("px")).alias("cost"))
    return cost.groupBy("block").agg(F.min_by("k", F.struct("cost", "k")).alias("second"), F.min("cost").alias("cost"))


@query(
    "intra_modes",
    f"""WITH {SAMPLES}, e AS (SELECT a.block, a.x, a.y, a.v, l.v AS l, t.v AS t FROM samples a JOIN samples l ON l.block = a.block AND l.y = a.y AND l.x = 0 JOIN samples t ON t.block = a.block AND t.x = a.x AND t.y = 0),
d AS (SELECT *, (sum(CASE WHEN x = 0 THEN v ELSE 0 END) OVER w + sum(CASE WHEN y = 0 THEN v ELSE 0 END) OVER w + 8)::BIGINT >> 4 AS dc FROM e WINDOW w AS (PARTITION BY block)),
c AS (SELECT block, unnest([{{'m': 0, 'c': sum(abs(v - ((l + t + 1) >> 1)))}}, {{'m': 1, 'c': sum(abs(v - dc))}}, {{'m': 10, 'c': sum(abs(v - l))}}, {{'m': 26, 'c': sum(abs(v - t))}}]) AS u FROM d GROUP BY block),
r AS (SELECT block, u.m AS mode, u.c::BIGINT + CASE WHEN u.m < 2 THEN 8 ELSE 20 END AS cost, row_number() OVER (PARTITION BY block ORDER BY u.c + CASE WHEN u.m < 2 THEN 8 ELSE 20 END, u.m) AS rank FROM c) SELECT block, rank, mode::INT AS mode, cost FROM r WHERE rank <= 3""",
)
def intra_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of planar (here the mean of left and top), DC, horizontal and vertical by SAD and the mode's bits."""
    px = F.col("px")
    row, column = lambda i: F.get(px, F.floor(i / 8).cast("int") * 8), lambda i: F.get(px, i % 8)
    edge = F.aggregate(F.concat(F.slice(px, 1, 8), F.array(*[F.get(px, F.lit(8 * y)) for y in range(8)])), F.lit(0), lambda s, v: s + v)
    own = blocks(spark, sf_dir).withColumn("dc", F.shiftright(edge + 8, 4))
    predictions = {
        0: F.transform(px, lambda _, i: F.shiftright(row(i) + column(i) + 1, 1)),
        1: F.array_repeat(F.col("dc"), 64),
        10: F.transform(px, lambda _, i: row(i)),
        26: F.transform(px, lambda _, i: column(i)),
    }
    tried = F.array(*[F.struct((sad(px, p) + (8 if m < 2 else 20)).alias("cost"), F.lit(m).alias("mode")) for m, p in predictions.items()])
    best = own.select("block", F.posexplode(F.slice(F.array_sort(tried), 1, 3)).alias("rank", "b"))
    return best.select("block", (F.col("rank") + 1).cast("long").alias("rank"), "b.mode", "b.cost")


_COST = "sum(v * v)::BIGINT - (sum(v)::BIGINT * sum(v)::BIGINT) // count(*)"


@query(
    "split_decision",
    f"""WITH {SAMPLES}, c0 AS (SELECT block, {_COST} + 600 AS c FROM samples GROUP BY block), c2 AS (SELECT block, x // 2 AS x, y // 2 AS y, {_COST} + 600 AS c FROM samples GROUP BY ALL),
c1 AS (SELECT block, x // 4 AS x, y // 4 AS y, {_COST} + 600 AS c FROM samples GROUP BY ALL), s2 AS (SELECT block, x // 2 AS x, y // 2 AS y, sum(c) AS c FROM c2 GROUP BY ALL),
b1 AS (SELECT block, sum(least(c1.c, s2.c))::BIGINT AS c, count(*) FILTER (s2.c < c1.c) AS n FROM c1 JOIN s2 USING (block, x, y) GROUP BY block)
SELECT block, c0.c AS whole, b1.c AS split, CASE WHEN b1.c < c0.c THEN 1 + n ELSE 0 END::BIGINT AS splits FROM c0 JOIN b1 USING (block)""",
)
def split_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadtree of three levels from the leaves up: a node splits if its children cost less; a node costs its scatter and 600."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8).astype(np.int64)

            def cost(size: int) -> np.ndarray:
                parts = px.reshape(len(px), 8 // size, size, 8 // size, size)
                total = parts.sum((2, 4))
                return (parts * parts).sum((2, 4)) - total * total // (size * size) + 600

            whole, four, leaves = cost(8)[:, 0, 0], cost(4), cost(2).reshape(-1, 2, 2, 2, 2).sum((2, 4))
            split = np.minimum(four, leaves).sum((1, 2))
            splits = np.where(split < whole, 1 + (leaves < four).sum((1, 2)), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole), pa.array(split), pa.array(splits)], ["block", "whole", "split", "splits"])

    own = blocks(spark, sf_dir).select(F.col("block").cast("long"), F.col("px").cast("array<int>"))
    return own.mapInArrow(run, "block long, whole long, split long, splits long")


@query(
    "mpm_list",
    f"""WITH {BLOCKS}, m AS (SELECT a.block, a.px[1] % 35 AS l, b.px[1] % 35 AS u FROM blocks a JOIN blocks b ON b.block = a.block + 1)
SELECT block, CASE WHEN l = u AND l < 2 THEN '0,1,26' WHEN l = u THEN l || ',' || (2 + (l + 29) % 32) || ',' || (2 + (l - 2 + 1) % 32) ELSE l || ',' || u || ',' || CASE WHEN l <> 0 AND u <> 0 THEN 0 WHEN l <> 1 AND u <> 1 THEN 1 ELSE 26 END END AS modes FROM m""",
)
def mpm_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most probable modes from those to the left and above."""
    mode = lambda c: F.get(c, F.lit(0)) % 35
    own = block_pairs(spark, sf_dir).select("block", mode("src").alias("l"), mode("ref").alias("u"))
    lit, col = F.lit, F.col
    third = F.when((col("l") != 0) & (col("u") != 0), 0).when((col("l") != 1) & (col("u") != 1), 1).otherwise(26)
    modes = F.when((col("l") == col("u")) & (col("l") < 2), F.array(lit(0), lit(1), lit(26)))
    modes = modes.when(col("l") == col("u"), F.array(col("l"), 2 + (col("l") + 29) % 32, 2 + (col("l") - 1) % 32)).otherwise(F.array(col("l"), col("u"), third))
    return own.select("block", F.array_join(modes, ",").alias("modes"))


@query(
    "merge_candidates",
    f"""WITH {BLOCKS}, m AS (SELECT block, list_transform([1, 2, 3, 4, 5], lambda i: px[i] // 64) AS c FROM blocks), k AS (SELECT block, c[1] AS a1, c[2] AS b1, c[3] AS b0, c[4] AS a0, c[5] AS b2 FROM m)
SELECT block, array_to_string(list_concat(list_filter([a1, CASE WHEN b1 <> a1 THEN b1 END, CASE WHEN b0 <> b1 THEN b0 END, CASE WHEN a0 <> a1 THEN a0 END, CASE WHEN b2 <> a1 AND b2 <> b1 THEN b2 END], lambda v: v IS NOT NULL)[1:4], [9, 9, 9, 9, 9])[1:5], ',') AS candidates FROM k""",
)
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four spatial candidates, pruned against the pairs that are compared, filled to five."""
    own = blocks(spark, sf_dir).select("block", *[F.floor(F.get("px", F.lit(i)) / 64).cast("int").alias(n) for i, n in enumerate(("a1", "b1", "b0", "a0", "b2"))])
    c = F.col
    kept = F.array_compact(F.array(c("a1"), F.when(c("b1") != c("a1"), c("b1")), F.when(c("b0") != c("b1"), c("b0")), F.when(c("a0") != c("a1"), c("a0")), F.when((c("b2") != c("a1")) & (c("b2") != c("b1")), c("b2"))))
    filled = F.slice(F.concat(F.slice(kept, 1, 4), F.array_repeat(F.lit(9), 5)), 1, 5)
    return own.select("block", F.array_join(filled, ",").alias("candidates"))


@query(
    "colocated",
    "SELECT a.l_orderkey, a.l_linenumber, (a.l_partkey // 16 * 16)::BIGINT AS place, b.l_quantity AS mv FROM lineitem a LEFT JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1",
)
def colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the picture before holds at the same place, and the place on the 16-sample grid that it is kept for."""
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    before = own.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_quantity").alias("mv"))
    return own.join(before, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.expr("l_partkey div 16 * 16").alias("place"), "mv")


@query("best_predictor", f"WITH {BLOCKS}, v AS (SELECT block, px[1] AS mv, px[2] AS p0, px[3] AS p1 FROM blocks), c AS (SELECT block, 2 * CASE WHEN mv = p0 THEN 0 ELSE length(bin(abs(mv - p0))) END AS c0, 2 * CASE WHEN mv = p1 THEN 0 ELSE length(bin(abs(mv - p1))) END AS c1 FROM v) SELECT block, CASE WHEN c1 < c0 THEN 1 ELSE 0 END::INT AS predictor, least(c0, c1)::INT AS bits FROM c")
def best_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheaper of two vector predictors, the first of equals."""
    v = lambda i: F.get("px", F.lit(i))
    cost = lambda p: (2 * bit_length(F.abs(v(0) - v(p)))).cast("int")
    own = blocks(spark, sf_dir).select("block", cost(1).alias("c0"), cost(2).alias("c1"))
    return own.select("block", F.when(F.col("c1") < F.col("c0"), 1).otherwise(0).alias("predictor"), F.least("c0", "c1").alias("bits"))
