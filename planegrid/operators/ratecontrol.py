"""Rate control: bit weights of a structure, sliding rates, the leaky bucket and the adaptive rate model.

The feedback loops fold a segment's pictures in order; a segment is a user's day, so an array of
one stays small and segments run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.functions.scalar import clip3
from planegrid.plans.registry import SAMPLES, query
from planegrid.sources.tables import blocks, table

_CODED = "coded AS (SELECT user_id, date_trunc('day', ts) AS segment, ts, event_id, floor(value * 100)::BIGINT AS bits FROM events)"


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, segment, ts, event_id, bits): an event is a coded picture of a hundred bits a unit of value."""
    return table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("segment"), "ts", "event_id", F.floor(F.col("value") * 100).alias("bits"))


def _ordered(own: DataFrame) -> DataFrame:
    return own.groupBy("user_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "bits"))), lambda r: r["bits"]).alias("bits"))


@query(
    "sop_bit_weights",
    """WITH w(band, hi, w0, w1, w2, w3) AS (VALUES (0, 0.05, 30, 8, 4, 1), (1, 0.1, 25, 7, 4, 1), (2, 0.2, 20, 6, 4, 1), (3, 1e9, 15, 5, 4, 1)),
o AS (SELECT o_orderkey, o_totalprice / 1000000.0 AS bpp FROM orders), b AS (SELECT o_orderkey, bpp, min(band) AS band FROM o JOIN w ON bpp <= hi GROUP BY ALL)
SELECT o_orderkey, level::INT AS level, round(bpp * 8000 * CASE level WHEN 0 THEN w0 WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END / (w0 + w1 + 2 * w2 + 4 * w3), 6) AS target FROM b JOIN w USING (band), range(0, 4) r(level)""",
)
def sop_bit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each hierarchy level of a structure of eight, by weights that depend on the bits per pixel."""
    bpp = F.col("o_totalprice") / 1000000.0
    #: Weights of the four levels for up to 0.05, 0.1, 0.2 bits a pixel, and beyond.
    weights = lambda *w: F.array(*map(F.lit, w))
    w = F.when(bpp <= 0.05, weights(30, 8, 4, 1)).when(bpp <= 0.1, weights(25, 7, 4, 1)).when(bpp <= 0.2, weights(20, 6, 4, 1)).otherwise(weights(15, 5, 4, 1))
    own = table(spark, sf_dir, "orders").select("o_orderkey", bpp.alias("bpp"), w.alias("w"))
    whole = F.expr("w[0] + w[1] + 2 * w[2] + 4 * w[3]")
    own = own.select("o_orderkey", "bpp", whole.alias("whole"), F.posexplode("w").alias("level", "w"))
    return own.select("o_orderkey", "level", F.round(F.col("bpp") * 8000 * F.col("w") / F.col("whole"), 6).alias("target"))


@query("sliding_bpp", f"WITH {_CODED} SELECT user_id, event_id, " + ", ".join(f"round(avg(bits) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 4) AS mean_{k}" for k in (4, 8, 16)) + " FROM coded")
def sliding_bpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return coded(spark, sf_dir).select("user_id", "event_id", *[F.round(F.avg("bits").over(order.rowsBetween(1 - k, 0)), 4).alias(f"mean_{k}") for k in (4, 8, 16)])


def bucket(bits: Column, fill: int, size: int) -> Column:
    """Level, and pictures cut at either limit, of a bucket that ``fill`` bits enter before each picture leaves."""
    start = F.struct(F.lit(size // 2).cast("long").alias("level"), F.lit(0).alias("cut"))

    def step(s: Column, b: Column) -> Column:
        after = s["level"] + fill - b
        held = clip3(F.lit(size // 10).cast("long"), F.lit(size * 9 // 10).cast("long"), after)
        return F.struct(held.alias("level"), (s["cut"] + F.when(held == after, 0).otherwise(1)).alias("cut"))

    return F.aggregate(bits, start, step)


@query(
    "cpb_bucket",
    f"""WITH {_CODED}, s AS (SELECT user_id, segment, list(bits ORDER BY ts, event_id) AS bits FROM coded GROUP BY ALL)
SELECT user_id, segment, list_reduce(list_concat([50000::BIGINT], bits), lambda l, b: greatest(10000, least(90000, l + 6000 - b)))::BIGINT AS level FROM s""",
)
def cpb_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's last buffer level, kept between 10 and 90 per cent."""
    return _ordered(coded(spark, sf_dir)).select("user_id", "segment", bucket(F.col("bits"), 6000, 100000)["level"].alias("level"))


@query(
    "alpha_update",
    f"""WITH {_CODED}, s AS (SELECT user_id, segment, list(bits::DOUBLE ORDER BY ts, event_id) AS bits FROM coded GROUP BY ALL)
SELECT user_id, segment, round(list_reduce(list_concat([3.2003], bits), lambda a, b: greatest(0.05, least(20.0, a * (1 + 0.1 * greatest(-1.2, least(1.2, ln((b + 1) / 6000.0))))))), 6) AS alpha FROM s""",
)
def alpha_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate model's alpha after a segment: moved by a tenth of the log of spent over target bits, kept in 0.05 to 20."""

    def step(a: Column, b: Column) -> Column:
        error = clip3(F.lit(-1.2), F.lit(1.2), F.ln((b + 1) / 6000.0))
        return clip3(F.lit(0.05), F.lit(20.0), a * (1 + 0.1 * error))

    return _ordered(coded(spark, sf_dir)).select("user_id", "segment", F.round(F.aggregate("bits", F.lit(3.2003), step), 6).alias("alpha"))


@query(
    "finished_ctb_bits",
    f"""WITH {SAMPLES} SELECT a.block, a.x, a.y, coalesce(sum(b.v) FILTER (8 * b.y + b.x < 8 * a.y + a.x), 0)::BIGINT AS raster, (sum(b.v) FILTER (b.y <= a.y AND b.x <= least(7, a.x + a.y - b.y)) - a.v)::BIGINT AS wavefront FROM samples a JOIN samples b ON b.block = a.block GROUP BY a.block, a.x, a.y, a.v""",
)
def finished_ctb_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits spent before each unit: all earlier ones in raster order, or with a wavefront the triangle above it.

    The triangle is a sum of row prefixes, one for each row up to the unit's own.
    """
    i = F.col("i")
    own = blocks(spark, sf_dir).select("block", "px", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    x, y = (i % 8), F.floor(i / 8).cast("int")
    rows = F.transform(F.sequence(F.lit(0), y), lambda r: total(F.slice("px", 8 * r + 1, F.least(F.lit(8), x + y - r + 1))))
    return own.select("block", x.alias("x"), y.alias("y"), total(F.slice("px", 1, i)).alias("raster"), (total(rows) - F.get("px", i)).alias("wavefront"))


@query("intra_period", f"WITH {_CODED}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM coded) SELECT user_id, frame // 32 AS period, min(frame) AS first, count(*) AS frames, sum(bits)::BIGINT AS bits, (sum(bits)::BIGINT // count(*))::BIGINT AS per_frame FROM f GROUP BY ALL")
def intra_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by the intra period that holds them, as arithmetic in place of a range join."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = coded(spark, sf_dir).select("user_id", (F.row_number().over(order) - 1).cast("long").alias("frame"), "bits")
    found = own.groupBy("user_id", F.expr("frame div 32").alias("period")).agg(F.min("frame").alias("first"), F.count(F.lit(1)).alias("frames"), F.sum("bits").alias("bits"))
    return found.withColumn("per_frame", F.expr("bits div frames"))
