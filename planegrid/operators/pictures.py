"""Planes and pictures: fields, crops, frame ranges, neighbours, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.operators.filters import joined
from planegrid.plans.registry import BLOCKS, PAIRS, SAMPLES, query
from planegrid.sources.tables import block_pairs, blocks, samples, table


def field(px: Column, parity: int, height: int = 8, padded: int = 8, width: int = 8) -> Column:
    """Every second line from ``parity`` on, rows beyond the field filled with 0 up to the padded height."""
    rows = [F.slice(px, 1 + width * (2 * y + parity), width) for y in range(height // 2)]
    return F.flatten(F.array(*rows, F.array_repeat(F.lit(0), width * (padded - height // 2))))


@query("field_split", f"WITH {SAMPLES} SELECT block, (y % 2)::INT AS parity, string_agg(v::INT, ',' ORDER BY y, x) || repeat(',0', 32) AS field FROM samples GROUP BY block, y % 2")
def field_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(p).alias("parity"), joined(field(F.col("px"), p)).alias("field")) for p in (0, 1)])
    return blocks(spark, sf_dir).select("block", F.explode(fields).alias("f")).select("block", "f.parity", "f.field")


@query("field_interleave", f"WITH {BLOCKS} SELECT block, array_to_string(px, ',') AS frame FROM blocks")
def field_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields put back: line y of parity p is line 2 y + p."""
    fields = blocks(spark, sf_dir).select("block", F.posexplode(F.array(field(F.col("px"), 0), field(F.col("px"), 1))).alias("parity", "f"))
    lines = fields.select("block", "parity", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("y"), "f").select("block", (F.col("y") * 2 + F.col("parity")).alias("y"), F.slice("f", F.col("y") * 8 + 1, 8).alias("line"))
    whole = lines.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"))
    return whole.select("block", joined(F.flatten(F.col("lines.line"))).alias("frame"))


@query("conformance_crop", f"WITH {SAMPLES} SELECT block, (x - 2)::INT AS x, (y - 1)::INT AS y, v FROM samples WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
def conformance_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window two samples in from left and right, one from top and bottom, counted from its own corner."""
    own = samples(blocks(spark, sf_dir)).where("x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
    return own.select("block", (F.col("x") - 2).alias("x"), (F.col("y") - 1).alias("y"), "v")


@query("frame_range", "WITH f AS (SELECT o_custkey AS stream, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame FROM orders) SELECT stream, frame - 2 AS frame, o_orderkey FROM f WHERE frame >= 2 AND frame < 7")
def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each stream the five frames after the first two, as seek 2 and frames 5 give them."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream"), "o_orderkey", (F.row_number().over(order) - 1).cast("long").alias("frame"))
    return own.where("frame >= 2 AND frame < 7").select("stream", (F.col("frame") - 2).alias("frame"), "o_orderkey")


@query(
    "neighbour_qp",
    f"""WITH {BLOCKS}, q AS (SELECT block, i, list_transform(px, lambda v: v % 52) AS qp FROM blocks, range(0, 64) r(i)), n AS (SELECT block, i, qp, CASE WHEN i = 0 THEN 26 ELSE qp[i] END AS p FROM q)
SELECT block, (i % 8)::INT AS x, (i // 8)::INT AS y, ((CASE WHEN i % 8 = 0 THEN p ELSE qp[i] END + CASE WHEN i < 8 THEN p ELSE qp[i - 7] END + 1) >> 1)::INT AS predicted FROM n""",
)
def neighbour_qp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounded mean of the QP to the left and above; where there is none, the QP coded before (26 at the start)."""
    qp, i = F.transform("px", lambda v: v % 52), F.col("i")
    own = blocks(spark, sf_dir).select("block", qp.alias("qp"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    before = F.coalesce(F.get("qp", i - 1), F.lit(26))
    left = F.when(i % 8 == 0, before).otherwise(F.get("qp", i - 1))
    above = F.when(i < 8, before).otherwise(F.get("qp", i - 8))
    return own.select("block", (i % 8).alias("x"), F.floor(i / 8).cast("int").alias("y"), F.shiftright(left + above + 1, 1).alias("predicted"))


def diagonal_scan(n: int) -> list[tuple[int, int]]:
    """(x, y) along up-right diagonals."""
    return sorted(((x, y) for x in range(n) for y in range(n)), key=lambda p: (p[0] + p[1], p[0]))


@query("scan_order", f"WITH {SAMPLES} SELECT block, string_agg(v::INT, ',' ORDER BY x + y, x) AS diagonal, string_agg(v::INT, ',' ORDER BY x, y) AS vertical FROM samples GROUP BY block")
def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda order: joined(F.transform(F.array(*[F.lit(8 * y + x) for x, y in order]), lambda i: F.get("px", i)))
    return blocks(spark, sf_dir).select("block", pick(diagonal_scan(8)).alias("diagonal"), pick([(x, y) for x in range(8) for y in range(8)]).alias("vertical"))


@query("tile_map", "WITH g AS (SELECT n, t, (t * n // 3)::BIGINT AS start, ((t + 1) * n // 3)::BIGINT AS stop FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part) p, range(0, 3) r(t)) SELECT n, t::INT AS tile, start, stop - start AS width FROM g")
def tile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform spacing: three tile columns of pictures of every width in use."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    own = sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tile")).withColumn("start", F.expr("tile * n div 3"))
    return own.select("n", "tile", "start", (F.expr("(tile + 1) * n div 3") - F.col("start")).alias("width"))


def filled(w: int, h: int, value: int) -> Column:
    """A rectangle of one value, in raster order."""
    return F.array_repeat(F.lit(value), w * h)


def copied(target: Column, source: Column, x0: int, y0: int, w: int, h: int, stride: int = 8) -> Column:
    """``target`` with the rectangle at (x0, y0) of ``source`` copied to the same place; both have ``stride`` samples a row."""
    inside = lambda i: (i % stride).between(x0, x0 + w - 1) & F.floor(i / stride).between(y0, y0 + h - 1)
    return F.transform(target, lambda v, i: F.when(inside(i), F.get(source, i)).otherwise(v))


@query(
    "block_ops",
    f"WITH {PAIRS}, c AS (SELECT block, x, y, src, ref, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3 THEN ref ELSE src END AS v FROM pairs) SELECT block, string_agg(v::INT, ',' ORDER BY y, x) AS copied, bool_and(v = src) AS same, bool_and(CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3 THEN v = ref ELSE TRUE END) AS part_same, sum(abs(v - 128))::BIGINT AS from_fill FROM c GROUP BY block",
)
def block_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle copied between blocks, blocks and rectangles compared, and the distance to a filled block."""
    own = block_pairs(spark, sf_dir).withColumn("v", copied(F.col("src"), F.col("ref"), 2, 1, 4, 3))
    rows = lambda c: F.concat(*[F.slice(c, 8 * y + 3, 4) for y in (1, 2, 3)])
    far = F.aggregate(F.zip_with("v", filled(8, 8, 128), lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    return own.select("block", joined(F.col("v")).alias("copied"), (F.col("v") == F.col("src")).alias("same"), (rows("v") == rows("ref")).alias("part_same"), far.alias("from_fill"))
