"""Block distortion: SAD, SSD, Hadamard sums, PSNR, and what is built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.plans.registry import PAIRS, SAMPLES, query
from planegrid.sources.tables import block_pairs, blocks, zip_with_sum


def sad(a: Column, b: Column) -> Column:
    return zip_with_sum(a, b, lambda x, y: F.abs(x - y))


def ssd(a: Column, b: Column) -> Column:
    return zip_with_sum(a, b, lambda x, y: (x - y) * (x - y))


def psnr(sse: Column, n: Column | int, peak: int = 255) -> Column:
    """10 log10(peak^2 / MSE); 999 where nothing differs."""
    return F.when(sse == 0, F.lit(999.0)).otherwise(10 * F.log10(F.lit(float(peak * peak)) * n / sse))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def hadamard(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """The n x n Hadamard transform of every tile of an 8x8 array in raster order.

    A butterfly per index bit: bits 0 to 2 run along x and 3 to 5 along y, so the bits below n on each
    axis transform all tiles in place.
    """
    step = F.col(column)
    for b in [1 << i for i in (0, 1, 2) if 1 << i < n] + [8 << i for i in (0, 1, 2) if 1 << i < n]:
        df = df.withColumn(out, step)
        own = F.col(out)
        step = F.transform(own, _butterfly(own, b))
    return df.withColumn(out, step)


def _butterfly(own: Column, b: int) -> Callable[[Column, Column], Column]:
    return lambda v, i: F.when(i.bitwiseAND(F.lit(b)) == 0, v + F.get(own, i + b)).otherwise(F.get(own, i - b) - v)


def tile_satd(coefficients: Column, n: int) -> Column:
    """The sum over tiles of (sum |t| + n / 4) / (n / 2), both divisions truncating."""
    total = F.lit(0).cast("long")
    for ty in range(0, 8, n):
        for tx in range(0, 8, n):
            inside = F.flatten(F.array(*[F.slice(coefficients, 1 + 8 * y + tx, n) for y in range(ty, ty + n)]))
            s = F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + F.abs(x))
            total = total + F.floor((s + n // 4) / (n // 2))
    return total


def satd(df: DataFrame, n: int) -> DataFrame:
    """(block, src, ref) to (block, satd)."""
    own = hadamard(df.withColumn("d", difference(F.col("src"), F.col("ref"))), "d", n, "t")
    return own.select("block", tile_satd(F.col("t"), n).cast("long").alias("satd"))


@query("psnr_pairs", f"WITH {PAIRS} SELECT block, sum((src - ref) * (src - ref))::BIGINT AS sse, round(CASE WHEN sum((src - ref) * (src - ref)) = 0 THEN 999.0 ELSE 10 * log10(65025.0 * 64 / sum((src - ref) * (src - ref))) END::DOUBLE, 6) AS psnr FROM pairs GROUP BY block")
def psnr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_pairs(spark, sf_dir).select("block", ssd(F.col("src"), F.col("ref")).alias("sse"))
    return found.withColumn("psnr", F.round(psnr(F.col("sse"), 64), 6))


@query("sad_pairs", f"WITH {PAIRS} SELECT block, sum(abs(src - ref))::BIGINT AS sad FROM pairs GROUP BY block")
def sad_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_pairs(spark, sf_dir).select("block", sad(F.col("src"), F.col("ref")).alias("sad"))


@query("ssd_pairs", f"WITH {PAIRS} SELECT block, sum((src - ref) * (src - ref))::BIGINT AS ssd, (sum((src * 4 - ref * 4) * (src * 4 - ref * 4))::BIGINT >> 4) AS ssd_16bit FROM pairs GROUP BY block")
def ssd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also for the samples at 10 bits, where the sum loses 4 bits."""
    wide = lambda c: F.transform(c, lambda v: v * 4)
    a, b = F.col("src"), F.col("ref")
    return block_pairs(spark, sf_dir).select("block", ssd(a, b).alias("ssd"), F.shiftright(ssd(wide(a), wide(b)), 4).alias("ssd_16bit"))


@query("sad_multiref4", f"WITH {SAMPLES} SELECT a.block, " + ", ".join(f"sum(abs(a.v - b.v)) FILTER (b.block = a.block + {k})::BIGINT AS sad_{k}" for k in range(1, 5)) + " FROM samples a JOIN samples b ON b.block BETWEEN a.block + 1 AND a.block + 4 AND a.x = b.x AND a.y = b.y GROUP BY a.block HAVING max(b.block) = a.block + 4")
def sad_multiref4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four references in one pass: each block goes to the four blocks before it."""
    own = blocks(spark, sf_dir)
    refs = own.select(F.explode(F.array(*[F.struct((F.col("block") - k).alias("block"), F.lit(k).alias("k")) for k in range(1, 5)])).alias("at"), F.col("px").alias("ref"))
    both = own.join(refs.select("at.*", "ref"), "block").select("block", "k", sad(F.col("px"), F.col("ref")).alias("sad"))
    found = both.groupBy("block").agg(*[F.sum(F.when(F.col("k") == k, F.col("sad"))).alias(f"sad_{k}") for k in range(1, 5)])
    return found.where("sad_4 IS NOT NULL")


def _satd_sql(n: int) -> str:
    mask = sum(b for b in [1 << i for i in (0, 1, 2) if 1 << i < n] + [8 << i for i in (0, 1, 2) if 1 << i < n])
    return f"""WITH {PAIRS}, d AS (SELECT block, 8 * y + x AS i, src - ref AS d FROM pairs),
t AS (SELECT block, i & {63 - mask} AS tile, u, sum(CASE WHEN bit_count((i & u)::INT) % 2 = 0 THEN d ELSE -d END) AS t FROM d, range(0, 64) r(u) WHERE (u & {63 - mask}) = 0 GROUP BY ALL),
s AS (SELECT block, tile, sum(abs(t)) AS s FROM t GROUP BY ALL) SELECT block, sum((s + {n // 4}) // {n // 2})::BIGINT AS satd FROM s GROUP BY block"""


for _n in (2, 4, 8):
    query(f"satd{_n}", _satd_sql(_n))(lambda spark, sf_dir, n=_n: satd(block_pairs(spark, sf_dir), n))


@query(
    "intra_complexity",
    f"""WITH {SAMPLES}, t AS (SELECT block, label, u, sum(CASE WHEN bit_count(((8 * y + x) & u)::INT) % 2 = 0 THEN v ELSE -v END) AS t FROM samples, range(0, 64) r(u) GROUP BY ALL),
s AS (SELECT block, label, (sum(abs(t)) FILTER (u > 0) + 2)::BIGINT >> 2 AS s FROM t GROUP BY ALL) SELECT label, sum(s)::BIGINT AS complexity FROM s GROUP BY label""",
)
def intra_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8x8 Hadamard sum of the samples themselves without the DC term, by group of blocks."""
    t = hadamard(blocks(spark, sf_dir), "px", 8, "t")
    s = F.aggregate(F.slice("t", 2, 63), F.lit(0).cast("long"), lambda a, x: a + F.abs(x))
    return t.select("label", F.shiftright(s + 2, 2).alias("s")).groupBy("label").agg(F.sum("s").alias("complexity"))


@query(
    "psnr_rollup",
    f"""WITH {PAIRS}, b AS (SELECT label, block, sum((src - ref) * (src - ref)) AS sse FROM pairs GROUP BY ALL),
p AS (SELECT label, sse, CASE WHEN sse = 0 THEN 999.0 ELSE 10 * log10(65025.0 * 64 / sse) END AS psnr FROM b)
SELECT label, count(*) AS blocks, round(CASE WHEN sum(sse) = 0 THEN 999.0 ELSE 10 * log10(65025.0 * 64 * count(*) / sum(sse)) END::DOUBLE, 6) AS pooled, round(avg(psnr)::DOUBLE, 6) AS mean FROM p GROUP BY ROLLUP (label)""",
)
def psnr_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both overall figures, from pooled errors and as the mean of the blocks', by label and for all."""
    own = blocks(spark, sf_dir).select("block", "label").join(block_pairs(spark, sf_dir), "block")
    sse = own.select("label", ssd(F.col("src"), F.col("ref")).alias("sse"))
    found = sse.withColumn("psnr", psnr(F.col("sse"), 64)).rollup("label")
    return found.agg(F.count(F.lit(1)).alias("blocks"), F.round(psnr(F.sum("sse"), 64 * F.count(F.lit(1))), 6).alias("pooled"), F.round(F.avg("psnr"), 6).alias("mean"))


@query("psnr_stream", f"WITH {PAIRS} SELECT count(*) AS samples, round(10 * log10(65025.0 * count(*) / sum((src - ref) * (src - ref)))::DOUBLE, 6) AS psnr FROM pairs")
def psnr_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One figure for two whole sample streams, cut to the shorter one by the join."""
    sse = block_pairs(spark, sf_dir).agg(F.sum(F.size("src")).alias("samples"), F.sum(ssd(F.col("src"), F.col("ref"))).alias("sse"))
    return sse.select("samples", F.round(psnr(F.col("sse"), F.col("samples")), 6).alias("psnr"))


@query(
    "residual_quadrants",
    f"""WITH {PAIRS}, q AS (SELECT block, """
    + ", ".join(f"sum(abs(src - ref)) FILTER (x // 4 = {i % 2} AND y // 4 = {i // 2})::BIGINT AS q{i}" for i in range(4))
    + """ FROM pairs GROUP BY block) SELECT *, (4 * abs((q0 + q1) - (q2 + q3)) <= q0 + q1 + q2 + q3) AS skip_rows, (4 * abs((q0 + q2) - (q1 + q3)) <= q0 + q1 + q2 + q3) AS skip_columns FROM q""",
)
def residual_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error by quadrant; halves within a quarter of the whole make that split not worth a try."""
    d = block_pairs(spark, sf_dir).withColumn("d", F.zip_with("src", "ref", lambda x, y: F.abs(x - y)))
    sums = {}
    for i in range(4):
        rows = [F.slice("d", 1 + 8 * y + 4 * (i % 2), 4) for y in range(4 * (i // 2), 4 * (i // 2) + 4)]
        sums[f"q{i}"] = F.aggregate(F.flatten(F.array(*rows)), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.select("block", *[c.alias(k) for k, c in sums.items()])
    whole = F.expr("q0 + q1 + q2 + q3")
    return d.withColumn("skip_rows", 4 * F.abs(F.expr("(q0 + q1) - (q2 + q3)")) <= whole).withColumn("skip_columns", 4 * F.abs(F.expr("(q0 + q2) - (q1 + q3)")) <= whole)
