"""Scalar maths of the codec domain as column expressions: integer semantics of truncating division and arithmetic shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.plans.registry import COEFFICIENTS, PAIRS, SAMPLES, query
from planegrid.sources.tables import block_pairs, blocks, coefficients, samples, table


def clip3(lo: Column | int, hi: Column | int, v: Column) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.greatest(as_column(lo), F.least(as_column(hi), v))


def clip16(v: Column) -> Column:
    return clip3(-32768, 32767, v)


def quantize(x: Column, scale: int, shift: int, offset: int) -> Column:
    """sign * ((|x| * scale + (offset << (shift - 16))) >> shift), saturated to 16 bits."""
    q = F.shiftright(F.abs(x) * scale + (offset << (shift - 16)), shift)
    return clip16(F.when(x < 0, -q).otherwise(q))


def dequantize(x: Column, scale: int, shift: int) -> Column:
    return clip16(F.shiftright(x * scale + (1 << (shift - 1)), shift))


@query(
    "quantize",
    f"""WITH {COEFFICIENTS}, q AS (SELECT l_orderkey, l_linenumber, x, greatest(-32768, least(32767, CASE WHEN x < 0 THEN -1 ELSE 1 END * ((abs(x) * 51 + (14 << 4)) >> 20))) AS q FROM coefs)
SELECT l_orderkey, bit_or(q)::BIGINT AS cbf, sum(q)::BIGINT AS total, count(*) AS n FROM (SELECT l_orderkey, q::BIGINT AS q FROM q) GROUP BY l_orderkey""",
)
def quantized_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantized coefficients of each unit; cbf is the OR of its levels, 0 where nothing is left."""
    q = coefficients(spark, sf_dir).select("l_orderkey", quantize(F.col("x"), 51, 20, 14).alias("q"))
    return q.groupBy("l_orderkey").agg(F.bit_or("q").alias("cbf"), F.sum("q").alias("total"), F.count(F.lit(1)).alias("n"))


@query("dequantize", f"WITH {COEFFICIENTS} SELECT l_orderkey, l_linenumber, x, greatest(-32768, least(32767, (x * 51 + 2) >> 2))::BIGINT AS flat, greatest(-32768, least(32767, (x * 52224 + 2) >> 2))::BIGINT AS steep FROM coefs")
def dequantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return coefficients(spark, sf_dir).select("l_orderkey", "l_linenumber", "x", dequantize(x, 51, 2).alias("flat"), dequantize(x, 52224, 2).alias("steep"))


#: Level scale by QP modulo 6, fixed values of the H.265 text (8.6.3), and the inverse factors.
LEVEL_SCALE = (40, 45, 51, 57, 64, 72)
QUANT_SCALE = (26214, 23302, 20560, 18396, 16384, 14564)


@query(
    "dequantize_matrix",
    f"""WITH {COEFFICIENTS}, m AS (SELECT *, 16 + (l_linenumber % 4) * 8 AS f, l_orderkey % 52 AS qp FROM coefs)
SELECT l_orderkey, l_linenumber, greatest(-32768, least(32767, (x * f * (list_extract([40, 45, 51, 57, 64, 72], (qp % 6 + 1)::INT)::BIGINT << (qp // 6)::INT) + 32) >> 6))::BIGINT AS d FROM m""",
)
def dequantize_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling by a matrix entry and the QP's level scale, in 64 bits."""
    own = coefficients(spark, sf_dir).withColumn("qp", (F.col("l_orderkey") % 52).cast("int"))
    factor = (16 + (F.col("l_linenumber") % 4) * 8).cast("long")
    scale = F.expr("shiftleft(element_at(array(40L, 45L, 51L, 57L, 64L, 72L), qp % 6 + 1), qp div 6)")
    return own.select("l_orderkey", "l_linenumber", clip16(F.shiftright(F.col("x") * factor * scale + 32, 6)).alias("d"))


@query(
    "qp_tables",
    """WITH r AS (SELECT DISTINCT l_orderkey % 52 AS qp FROM lineitem) SELECT qp::INT AS qp, list_extract([40, 45, 51, 57, 64, 72], (qp % 6 + 1)::INT) << (qp // 6)::INT AS level_scale, list_extract([26214, 23302, 20560, 18396, 16384, 14564], (qp % 6 + 1)::INT) AS quant_scale, (14 + qp // 6)::INT AS quant_shift,
CASE WHEN qp < 30 THEN qp WHEN qp >= 43 THEN qp - 6 ELSE list_extract([29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37], (qp - 29)::INT) END::INT AS chroma_qp FROM r""",
)
def qp_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scales, shift and chroma QP of every QP that line items have."""
    #: Chroma QP of luma QP 30 to 42, fixed values of the H.265 text (table 8-10).
    chroma = (29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37)
    own = coefficients(spark, sf_dir).select((F.col("l_orderkey") % 52).cast("int").alias("qp")).distinct()
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i)
    qp = F.col("qp")
    return own.select(
        "qp",
        F.expr("shiftleft(element_at(array(40, 45, 51, 57, 64, 72), qp % 6 + 1), qp div 6)").alias("level_scale"),
        pick(QUANT_SCALE, qp % 6 + 1).alias("quant_scale"),
        (14 + F.floor(qp / 6)).cast("int").alias("quant_shift"),
        F.when(qp < 30, qp).when(qp >= 43, qp - 6).otherwise(pick(chroma, F.greatest(F.lit(1), F.least(F.lit(13), qp - 29)))).alias("chroma_qp"),
    )


@query("reconstruct", f"WITH {PAIRS} SELECT block, string_agg(greatest(0, least(255, ref + (src - ref) * 2)), ',' ORDER BY y, x) AS rec FROM pairs GROUP BY block")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction plus a residual, here twice the difference to the source, clipped to 8 bits."""
    rec = F.zip_with("ref", F.zip_with("src", "ref", lambda s, r: (s - r) * 2), lambda p, d: clip3(0, 255, p + d))
    return block_pairs(spark, sf_dir).select("block", F.array_join(rec, ",").alias("rec"))


@query("subtract_bi", f"WITH {PAIRS} SELECT block, string_agg(greatest(0, least(255, 2 * src - ref)), ',' ORDER BY y, x) AS target FROM pairs GROUP BY block")
def subtract_bi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second reference must give when the first one is settled."""
    return block_pairs(spark, sf_dir).select("block", F.array_join(F.zip_with("src", "ref", lambda s, p: clip3(0, 255, 2 * s - p)), ",").alias("target"))


@query("bit_depth_convert", f"WITH {SAMPLES} SELECT block, label, x, y, v, v << 2 AS wide, least(255, ((v << 2) + 4) >> 2)::INT AS narrow FROM samples")
def bit_depth_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 bits to 10 and back; the way back adds a whole step of (1 << depth) >> 8 before it shifts."""
    wide = F.shiftleft("v", 2)
    return samples(blocks(spark, sf_dir)).select("block", "label", "x", "y", "v", wide.alias("wide"), F.least(F.lit(255), F.shiftright(wide + 4, 2)).alias("narrow"))


def lambda_of_qp(qp: Column, factor: Column) -> Column:
    return factor * F.pow(F.lit(2.0), (qp - 12) / 3.0)


@query(
    "lambda_qp",
    """WITH l AS (SELECT qp::INT AS qp, 0.57 * pow(2.0, (qp - 12) / 3.0) AS intra, 0.442 * pow(2.0, (qp - 12) / 3.0) * greatest(2.0, least(4.0, (qp - 12) / 6.0)) AS inter, l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 52 AS qp FROM lineitem))
SELECT l_orderkey, l_linenumber, qp, round(intra, 6) AS intra, round(inter, 6) AS inter, greatest(2, least(46, trunc(4.2005 * ln(intra) + 13.7122 + 0.5)::INT)) AS back FROM l""",
)
def lambda_qp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagrangians of each line item's QP, and the QP that the inverse model gives for the intra one."""
    own = coefficients(spark, sf_dir).select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") + F.col("l_linenumber")) % 52).cast("int").alias("qp"))
    intra = lambda_of_qp(F.col("qp"), F.lit(0.57))
    inter = lambda_of_qp(F.col("qp"), F.lit(0.442)) * clip3(F.lit(2.0), F.lit(4.0), (F.col("qp") - 12) / 6.0)
    back = clip3(2, 46, (4.2005 * F.ln(intra) + 13.7122 + 0.5).cast("int"))
    return own.select("l_orderkey", "l_linenumber", "qp", F.round(intra, 6).alias("intra"), F.round(inter, 6).alias("inter"), back.alias("back"))


@query(
    "rate_lambda",
    "SELECT o_orderkey AS picture, round(3.2003 * pow(o_totalprice / 1000000.0, -1.367), 6) AS lambda_inter, round(6.7542 / 256 * pow(pow(o_totalprice / 1000.0, 1.2517) / (o_totalprice / 1000000.0), 1.7860), 4) AS lambda_intra FROM orders",
)
def rate_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lambda by bits per pixel (inter), and by complexity to the power 1.2517 over it (intra)."""
    bpp = F.col("o_totalprice") / 1000000.0
    intra = F.lit(6.7542) / 256 * F.pow(F.pow(F.col("o_totalprice") / 1000.0, F.lit(1.2517)) / bpp, F.lit(1.7860))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("picture"), F.round(3.2003 * F.pow(bpp, F.lit(-1.367)), 6).alias("lambda_inter"), F.round(intra, 4).alias("lambda_intra"))


def bit_length(v: Column) -> Column:
    """Binary digits of a number of 0 or more; 0 has none."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


@query("mv_rate", f"WITH {COEFFICIENTS}, d AS (SELECT l_orderkey, l_linenumber, abs(x % 64)::BIGINT AS dx, abs(x // 64 % 32)::BIGINT AS dy FROM coefs) SELECT l_orderkey, l_linenumber, (2 * (CASE WHEN dx = 0 THEN 0 ELSE length(bin(dx)) END + CASE WHEN dy = 0 THEN 0 ELSE length(bin(dy)) END + 1))::INT AS bits FROM d")
def mv_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of a motion vector difference: twice the digits of both parts and one."""
    dx, dy = F.abs(F.col("x") % 64), F.abs(F.expr("x div 64") % 32)
    return coefficients(spark, sf_dir).select("l_orderkey", "l_linenumber", (2 * (bit_length(dx) + bit_length(dy) + 1)).cast("int").alias("bits"))


@query("exp_golomb", f"WITH {COEFFICIENTS}, c AS (SELECT l_orderkey, l_linenumber, x % 1000 AS se, CASE WHEN x % 1000 > 0 THEN 2 * (x % 1000) - 1 ELSE -2 * (x % 1000) END AS ue FROM coefs) SELECT l_orderkey, l_linenumber, se::BIGINT AS se, ue::BIGINT AS ue, repeat('0', length(bin(ue + 1)) - 1) || bin(ue + 1) AS code FROM c")
def exp_golomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed numbers, their place in the unsigned order, and the code: a prefix of zeros and the number plus one."""
    se = F.col("x") % 1000
    ue = F.when(se > 0, 2 * se - 1).otherwise(-2 * se)
    code = F.bin(ue + 1)
    return coefficients(spark, sf_dir).select("l_orderkey", "l_linenumber", se.alias("se"), ue.alias("ue"), F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code).alias("code"))


@query(
    "exp_golomb_read",
    f"WITH {COEFFICIENTS} SELECT l_orderkey, l_linenumber, (x % 1000)::BIGINT AS se FROM coefs",
)
def exp_golomb_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes read back."""
    zeros = F.length(F.regexp_extract("code", "^(0*)", 1))
    ue = F.conv(F.substr("code", zeros + 1, zeros + 1), 2, 10).cast("long") - 1
    se = F.when(ue % 2 == 1, (ue + 1) / 2).otherwise(-ue / 2).cast("long")
    return exp_golomb(spark, sf_dir).select("l_orderkey", "l_linenumber", se.alias("se"))


def distance_scale(tb: Column, td: Column) -> Column:
    """Factor in 1/256 by which a vector over td pictures becomes one over tb, with truncating division."""
    tx = F.expr("(16384 + abs(td) div 2) div td")
    return clip3(-4096, 4095, F.shiftright(tb * tx + 32, 6))


@query(
    "dist_scale",
    f"""WITH {COEFFICIENTS}, t AS (SELECT l_orderkey, l_linenumber, greatest(-128, least(127, x % 17)) AS tb, CASE WHEN x % 13 = 0 THEN 1 ELSE x % 13 END AS td, x % 512 AS mv FROM coefs),
s AS (SELECT *, greatest(-4096, least(4095, (tb * ((16384 + abs(td) // 2) // td) + 32)::BIGINT >> 6)) AS factor FROM t)
SELECT l_orderkey, l_linenumber, factor::BIGINT AS factor, greatest(-32768, least(32767, sign(factor * mv) * ((abs(factor * mv) + 127)::BIGINT >> 8)))::BIGINT AS scaled FROM s""",
)
def dist_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    own = coefficients(spark, sf_dir).select("l_orderkey", "l_linenumber", clip3(-128, 127, x % 17).alias("tb"), F.when(x % 13 == 0, F.lit(1).cast("long")).otherwise(x % 13).alias("td"), (x % 512).alias("mv"))
    own = own.withColumn("factor", distance_scale(F.col("tb"), F.col("td")))
    product = F.col("factor") * F.col("mv")
    return own.select("l_orderkey", "l_linenumber", "factor", clip16(F.signum(product.cast("double")).cast("long") * F.shiftright(F.abs(product) + 127, 8)).alias("scaled"))


@query("mv_clip", f"WITH {COEFFICIENTS} SELECT l_orderkey, l_linenumber, greatest(-8 * (x % 80 + 80) // 8 * 4 - 32, least(4 * (640 - abs(x % 640)), x))::BIGINT AS mv_x FROM coefs")
def mv_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector cut so that its block still touches the picture."""
    x = F.col("x")
    low = F.expr("(-8 * (x % 80 + 80)) div 8") * 4 - 32
    return coefficients(spark, sf_dir).select("l_orderkey", "l_linenumber", clip3(low, 4 * (640 - F.abs(x % 640)), x).alias("mv_x"))


def z_order(x: Column, y: Column, bits: int) -> Column:
    """The Morton index: bits of x and y in turn."""
    out = F.lit(0)
    for b in range(bits):
        out = out + F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)), 2 * b) + F.shiftleft(F.shiftright(y, b).bitwiseAND(F.lit(1)), 2 * b + 1)
    return out


@query("zorder", f"WITH {SAMPLES} SELECT block, (" + " + ".join(f"(((x >> {b}) & 1) << {2 * b}) + (((y >> {b}) & 1) << {2 * b + 1})" for b in range(3)) + ")::INT AS z, v FROM samples")
def zorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(blocks(spark, sf_dir)).select("block", z_order(F.col("x"), F.col("y"), 3).alias("z"), "v")


@query(
    "level_selection",
    """WITH levels(ord, level, max_ps, max_sr) AS (VALUES (1, 1.0, 36864, 552960), (2, 2.0, 122880, 3686400), (3, 2.1, 245760, 7372800), (4, 3.0, 552960, 16588800), (5, 3.1, 983040, 33177600), (6, 4.0, 2228224, 66846720), (7, 4.1, 2228224, 133693440), (8, 5.0, 8912896, 267386880), (9, 5.1, 8912896, 534773760), (10, 5.2, 8912896, 1069547520), (11, 6.0, 35651584, 1069547520), (12, 6.1, 35651584, 2139095040), (13, 6.2, 35651584, 4278190080)),
p AS (SELECT p_partkey, (p_size * p_size * 4096)::BIGINT AS ps, (p_size * p_size * 4096 * 30)::BIGINT AS sr FROM part) SELECT p_partkey, arg_min(level, ord)::DOUBLE AS level FROM p JOIN levels ON max_ps >= ps AND max_sr >= sr GROUP BY p_partkey""",
)
def level_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level whose limits hold a picture's samples and their rate."""
    #: Level, samples of a picture, samples a second: fixed values of the H.265 text (tables A.8 and A.9).
    levels = [
        (1.0, 36864, 552960),
        (2.0, 122880, 3686400),
        (2.1, 245760, 7372800),
        (3.0, 552960, 16588800),
        (3.1, 983040, 33177600),
        (4.0, 2228224, 66846720),
        (4.1, 2228224, 133693440),
        (5.0, 8912896, 267386880),
        (5.1, 8912896, 534773760),
        (5.2, 8912896, 1069547520),
        (6.0, 35651584, 1069547520),
        (6.1, 35651584, 2139095040),
        (6.2, 35651584, 4278190080),
    ]
    ps = (F.col("p_size") * F.col("p_size") * 4096).cast("long")
    first = F.lit(None).cast("double")
    for level, max_ps, max_sr in reversed(levels):
        first = F.when((ps <= max_ps) & (ps * 30 <= max_sr), F.lit(level)).otherwise(first)
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("level")).where("level IS NOT NULL")


@query("bitrate_scale", f"WITH {COEFFICIENTS}, r AS (SELECT l_orderkey, l_linenumber, abs(x) * 6400 + 64 AS rate FROM coefs), z AS (SELECT *, length(bin(rate)) - length(rtrim(bin(rate), '0')) AS zeros FROM r) SELECT l_orderkey, l_linenumber, greatest(0, least(15, zeros - 6))::INT AS scale, (rate >> (6 + greatest(0, least(15, zeros - 6)))::INT)::BIGINT AS value FROM z")
def bitrate_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate as value << (6 + scale), the scale being its trailing zeros beyond six, 15 at most."""
    rate = F.abs("x") * 6400 + 64
    own = coefficients(spark, sf_dir).select("l_orderkey", "l_linenumber", rate.alias("rate"))
    zeros = F.length(F.bin("rate")) - F.length(F.rtrim(F.bin("rate"), F.lit("0")))
    own = own.withColumn("scale", clip3(0, 15, zeros - 6).cast("int"))
    return own.select("l_orderkey", "l_linenumber", "scale", F.expr("shiftright(rate, 6 + scale)").alias("value"))


@query("option_strings", "SELECT part.p_partkey, regexp_extract(o, '(\\d+)x(\\d+)', 1)::INT AS w, regexp_extract(o, '(\\d+)x(\\d+)', 2)::INT AS h, len(string_split(p_type, ' ')) AS n_words FROM (SELECT p_partkey, p_type, (p_size * 16) || 'x' || (p_size * 9) AS o FROM part) part")
def option_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written WxH, and lists, taken apart."""
    own = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat((F.col("p_size") * 16).cast("string"), F.lit("x"), (F.col("p_size") * 9).cast("string")).alias("o"))
    part = lambda i: F.regexp_extract("o", r"(\d+)x(\d+)", i).cast("int")
    return own.select("p_partkey", part(1).alias("w"), part(2).alias("h"), F.size(F.split("p_type", " ")).cast("long").alias("n_words"))


@query("timecode", "SELECT event_id, (hour(ts))::INT AS hours, minute(ts)::INT AS minutes, second(ts)::INT AS seconds, (epoch_us(ts) % 1000000 * 25 // 1000000)::INT AS frames, epoch_us(ts) * 9 // 100 AS ticks FROM events")
def timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock fields, frames at 25 a second, and 90 kHz ticks."""
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.to_timestamp("ts"))).select(
        "event_id",
        F.hour("ts").alias("hours"),
        F.minute("ts").alias("minutes"),
        F.second("ts").alias("seconds"),
        F.expr("CAST(us % 1000000 * 25 DIV 1000000 AS INT)").alias("frames"),
        F.expr("us * 9 DIV 100").alias("ticks"),
    )


@query("range_check", "WITH rules(field, lo, hi) AS (VALUES ('quantity', 1, 45), ('discount', 0, 8), ('tax', 0, 7)), v AS (SELECT l_orderkey, l_linenumber, 'quantity' AS field, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'discount', round(l_discount * 100) FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', round(l_tax * 100) FROM lineitem) SELECT l_orderkey, l_linenumber, field, v::BIGINT AS v FROM v JOIN rules USING (field) WHERE v < lo OR v > hi")
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside their field's limits, one row each."""
    return violations(table(spark, sf_dir, "lineitem"))


def violations(items: DataFrame) -> DataFrame:
    rules = {"quantity": (F.round("l_quantity"), 1, 45), "discount": (F.round(F.col("l_discount") * 100), 0, 8), "tax": (F.round(F.col("l_tax") * 100), 0, 7)}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), v.cast("long").alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for f, (v, lo, hi) in rules.items()])
    bad = F.filter(fields, lambda r: (r["v"] < r["lo"]) | (r["v"] > r["hi"]))
    return items.select("l_orderkey", "l_linenumber", F.explode(bad).alias("r")).select("l_orderkey", "l_linenumber", "r.field", "r.v")
