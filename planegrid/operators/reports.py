"""Lookups, reports and rules around pictures: names, presets, pairings, refreshes, parameter sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.functions.scalar import exp_golomb
from planegrid.operators.digests import checksum
from planegrid.operators.distortion import hadamard, psnr, ssd, tile_satd
from planegrid.operators.filters import LUMA, along_x
from planegrid.operators.references import _DOCKETS, _EDGES, dockets, edges, stream
from planegrid.operators.statistics import hist_difference, segments, shot_changes
from planegrid.plans.registry import BLOCKS, COEFFICIENTS, ORACLES, PAIRS, SAMPLES, query
from planegrid.sources.tables import block_pairs, blocks, table

#: Packet types and their names in the H.265 text (table 7-1), fixed values; the numbers between have names by their ranges.
NAMES = {0: "TRAIL_N", 1: "TRAIL_R", 2: "TSA_N", 3: "TSA_R", 4: "STSA_N", 5: "STSA_R", 6: "RADL_N", 7: "RADL_R", 8: "RASL_N", 9: "RASL_R"}
NAMES |= {16: "BLA_W_LP", 17: "BLA_W_RADL", 18: "BLA_N_LP", 19: "IDR_W_RADL", 20: "IDR_N_LP", 21: "CRA_NUT"}
NAMES |= {32: "VPS_NUT", 33: "SPS_NUT", 34: "PPS_NUT", 35: "AUD_NUT", 36: "EOS_NUT", 37: "EOB_NUT", 38: "FD_NUT", 39: "PREFIX_SEI_NUT", 40: "SUFFIX_SEI_NUT"}
NAMES |= {k: f"RSV_VCL_{'R' if k % 2 else 'N'}{k}" for k in range(10, 16)} | {k: f"RSV_IRAP_VCL{k}" for k in (22, 23)} | {k: f"RSV_VCL{k}" for k in range(24, 32)}
NAMES |= {k: f"RSV_NVCL{k}" for k in range(41, 48)} | {k: f"UNSPEC{k}" for k in range(48, 64)}
#: Slice types (table 7-7).
SLICES = {0: "B", 1: "P", 2: "I"}


@query(
    "enum_names",
    "SELECT event_id, name, CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'P' ELSE 'I' END AS slice FROM events JOIN (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in sorted(NAMES.items())) + ") n(t, name) ON t = event_id % 64",
)
def enum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of every event's packet type and slice type."""
    table_of = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    kind = lambda n: (F.col("event_id") % n).cast("int")
    return table(spark, sf_dir, "events").select("event_id", table_of(NAMES)[kind(64)].alias("name"), table_of(SLICES)[kind(3)].alias("slice"))


#: Parts of a path that leave a stream out.
EXCLUDED = ("/1/", "page7", "x.")


@query("blacklist", "SELECT page_id, url FROM pages WHERE NOT (contains(url, '/1/') OR contains(url, 'page7') OR contains(url, 'x.'))")
def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages").select("page_id", "url")
    for part in EXCLUDED:
        own = own.where(~F.col("url").contains(part))
    return own


@query("stream_pairs", "WITH f AS (SELECT doc_id, 's' || doc_id // 3 AS stem, CASE doc_id % 3 WHEN 0 THEN '.bit' WHEN 1 THEN '_yuv.md5' ELSE '.txt' END AS ext FROM documents) SELECT b.stem, b.doc_id AS stream, m.doc_id AS digest FROM f b LEFT JOIN f m ON m.stem = b.stem AND m.ext = '_yuv.md5' WHERE b.ext = '.bit'")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a folder with the digest file of the same stem, null where there is none."""
    kind = F.element_at(F.array(F.lit(".bit"), F.lit("_yuv.md5"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("s"), F.expr("doc_id div 3").cast("string")).alias("stem"), kind.alias("ext"))
    digests = own.where("ext = '_yuv.md5'").select("stem", F.col("doc_id").alias("digest"))
    return own.where("ext = '.bit'").join(digests, "stem", "left").select("stem", F.col("doc_id").alias("stream"), "digest")


@query("poc_modulo_refs", f"WITH {_EDGES} SELECT e.user_id, e.poc, d.poc AS found FROM edges e JOIN dockets d ON d.user_id = e.user_id AND (d.poc & 15) = (e.ref & 15) AND d.poc BETWEEN e.ref - 7 AND e.ref + 8")
def poc_modulo_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References found by their four low bits; among 16 neighbours these name one picture."""
    own = dockets(stream(spark, sf_dir))
    low = lambda c: F.col(c).bitwiseAND(F.lit(15).cast("long"))
    asked = edges(own).withColumn("low", low("ref"))
    there = own.select("user_id", F.col("poc").alias("found"), low("poc").alias("low"))
    return asked.join(there, ["user_id", "low"]).where("found BETWEEN ref - 7 AND ref + 8").select("user_id", "poc", "found")


@query("usable_refs", f"WITH {_EDGES}, kept AS (SELECT * FROM dockets WHERE event_id % 10 <> 3) SELECT user_id, poc, ref FROM edges e SEMI JOIN kept k ON k.user_id = e.user_id AND k.poc = e.ref")
def usable_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = dockets(stream(spark, sf_dir))
    there = own.where("event_id % 10 <> 3").select("user_id", F.col("poc").alias("ref"))
    return edges(own).join(there, ["user_id", "ref"], "left_semi").select("user_id", "poc", "ref")


@query(
    "picture_report",
    f"""WITH {PAIRS}, p AS (SELECT block, sum((src - ref) * (src - ref)) AS sse FROM pairs GROUP BY block), c AS (SELECT block, (sum(xor(v & 255, xor(x, y))) % 4294967296)::BIGINT AS checksum FROM samples GROUP BY block)
SELECT block, label, round(CASE WHEN sse = 0 THEN 999.0 ELSE 10 * log10(65025.0 * 64 / sse) END::DOUBLE, 4) AS psnr, checksum FROM p JOIN c USING (block) JOIN blocks USING (block)""",
)
def picture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, digest and header of each picture side by side."""
    quality = block_pairs(spark, sf_dir).select("block", F.round(psnr(ssd(F.col("src"), F.col("ref")), 64), 4).alias("psnr"))
    return blocks(spark, sf_dir).select("block", "label", checksum(F.col("px"), 8).alias("checksum")).join(quality, "block")


@query("output_md5", "WITH c AS (SELECT conv_id, md5(string_agg(md5(text), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id) SELECT conv_id, digest FROM c")
def output_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over the digests of a stream's pictures in output order."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("d")))).alias("all"))
    return own.select("conv_id", F.md5(F.array_join(F.col("all.d"), "")).alias("digest"))


@query("satd_tiled", f"SELECT block, CASE block % 3 WHEN 0 THEN s8.satd WHEN 1 THEN s4.satd ELSE s2.satd END AS satd FROM ({ORACLES['satd8']}) s8 JOIN ({ORACLES['satd4']}) s4 USING (block) JOIN ({ORACLES['satd2']}) s2 USING (block)")
def satd_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform by the shape that is measured: 8, 4 or 2 samples wide."""
    own = block_pairs(spark, sf_dir).withColumn("d", F.zip_with("src", "ref", lambda a, b: a - b))
    for n in (2, 4, 8):
        own = hadamard(own, "d", n, f"t{n}")
    pick = F.when(F.col("block") % 3 == 0, tile_satd(F.col("t8"), 8)).when(F.col("block") % 3 == 1, tile_satd(F.col("t4"), 4)).otherwise(tile_satd(F.col("t2"), 2))
    return own.select("block", pick.cast("long").alias("satd"))


def spaced(frames: Column, gap: int) -> Column:
    """Of ordered frames those that come over ``gap`` after the last one taken."""
    return F.aggregate(frames, F.array().cast("array<bigint>"), lambda s, f: F.when((F.size(s) == 0) | (f - F.coalesce(F.element_at(s, -1), f) > gap), F.concat(s, F.array(f))).otherwise(s))


@query(
    "shot_changes",
    f"WITH RECURSIVE c AS (SELECT frame FROM ({ORACLES['shot_candidates']}) WHERE stands_out), taken(frame) AS (SELECT min(frame) FROM c UNION ALL SELECT (SELECT min(c.frame) FROM c WHERE c.frame - t.frame > 5) FROM taken t WHERE t.frame IS NOT NULL) SELECT frame FROM taken WHERE frame IS NOT NULL",
)
def final_shot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shot changes over five frames apart, of the frames that stand out."""
    return apart(shot_changes(hist_difference(spark, sf_dir)).where("stands_out").select("frame"), 5)


def apart(found: DataFrame, gap: int) -> DataFrame:
    """(frame) of a stream to those that come over ``gap`` after the last one taken.

    A frame with none in the ``gap`` before it is always taken, so each run of frames from one such to the next is
    folded by itself.
    """
    order = Window.partitionBy("segment").orderBy("frame")
    near = F.count(F.lit(1)).over(order.rangeBetween(-gap, -1))
    first = F.when(near == 0, F.col("frame"))
    own = segments(found, gap, gap).select("segment", "frame", "own", first.alias("first")).where("own")
    own = own.select("segment", "frame", "first", F.last("first", ignorenulls=True).over(order).alias("run"))
    # a run that begins in an earlier segment; a row per segment
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begun = own.groupBy("segment").agg(F.max("first").alias("last")).select("segment", F.last("last", ignorenulls=True).over(before).alias("begun"))
    runs = own.join(begun, "segment").groupBy(F.coalesce("run", "begun").alias("run")).agg(F.array_sort(F.collect_list("frame")).alias("f"))
    return runs.select(F.explode(spaced(F.col("f"), gap)).alias("frame"))


@query(
    "block_likelihood",
    f"""WITH {SAMPLES}, s AS (SELECT block, avg(v) AS m, var_pop(v) + 1 AS q FROM samples GROUP BY block) SELECT a.block, round((((a.m - b.m) / 2) ** 2 + (a.q + b.q) / 2) ** 2 / (a.q * b.q), 4) AS likelihood FROM s a JOIN s b ON b.block = a.block + 1""",
)
def block_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unlike a block and the next are in mean and variance; 1 for equal ones. A level of 1 keeps flat blocks apart from 0."""
    tall = blocks(spark, sf_dir).select("block", F.explode("px").alias("v")).groupBy("block").agg(F.avg("v").alias("m"), (F.var_pop("v") + 1).alias("q"))
    other = tall.select((F.col("block") - 1).alias("block"), F.col("m").alias("m2"), F.col("q").alias("q2"))
    top = F.pow(F.pow((F.col("m") - F.col("m2")) / 2, F.lit(2.0)) + (F.col("q") + F.col("q2")) / 2, F.lit(2.0))
    return tall.join(other, "block").select("block", F.round(top / (F.col("q") * F.col("q2")), 4).alias("likelihood"))


@query("buffering_windows", "WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, frame // 40 AS window_id, min(frame) AS first, count(*) AS frames, count(*) < 40 AS flushed FROM f GROUP BY ALL")
def buffering_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-analysis in windows of 40 pictures; the last one is flushed with what there is."""
    own = stream(spark, sf_dir)
    return own.groupBy("user_id", F.expr("poc div 40").alias("window_id")).agg(F.min("poc").alias("first"), F.count(F.lit(1)).alias("frames"), (F.count(F.lit(1)) < 40).alias("flushed"))


@query(
    "idr_placement",
    """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type = 'purchase' AS change FROM events)
SELECT user_id, frame // 32 AS period, coalesce(min(CASE WHEN change THEN frame END), min(frame)) AS idr FROM f GROUP BY ALL""",
)
def idr_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each period of 32 pictures the refresh: at its first shot change (a purchase), else at its start."""
    own = stream(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    change = F.min(F.when(F.col("event_type") == "purchase", F.col("poc")))
    return own.groupBy("user_id", F.expr("poc div 32").alias("period")).agg(F.coalesce(change, F.min("poc")).alias("idr"))


@query("dropped_leading", f"WITH {_DOCKETS} SELECT user_id, poc, coded FROM dockets WHERE NOT (whole AND sop = 2 AND step < 8)")
def dropped_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that are output after a start at the second structure's last picture: those that lead it are dropped."""
    return dockets(stream(spark, sf_dir)).where("NOT (whole AND sop = 2 AND step < 8)").select("user_id", "poc", "coded")


@query(
    "subpel_refine",
    f"""WITH {PAIRS}, taps(f, d, t) AS (VALUES {", ".join(f"({f}, {k - 3}, {t})" for f, row in enumerate(LUMA) for k, t in enumerate(row) if t)}),
i AS (SELECT a.block, a.x, a.y, a.src, f, sum(b.ref * t)::BIGINT AS s FROM pairs a CROSS JOIN taps JOIN pairs b ON b.block = a.block AND b.y = a.y AND b.x = greatest(0, least(7, a.x + d)) GROUP BY ALL),
c AS (SELECT block, f, sum(abs(src - greatest(0, least(255, (s + 32) >> 6))))::BIGINT + CASE f WHEN 0 THEN 0 WHEN 2 THEN 4 ELSE 8 END AS cost FROM i GROUP BY block, f) SELECT block, arg_min(f, cost * 10 + f)::INT AS fraction, min(cost)::BIGINT AS cost FROM c GROUP BY block""",
)
def subpel_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best quarter-sample fraction along x, by the interpolated block's SAD and the fraction's bits."""
    own = block_pairs(spark, sf_dir)
    tried = []
    for f, taps in enumerate(LUMA):
        p = F.transform(along_x(F.col("ref"), taps), lambda s: F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(s + 32, 6))))
        cost = F.aggregate(F.zip_with("src", p, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, d: s + d) + (0, 8, 4, 8)[f]
        tried.append(F.struct(cost.alias("cost"), F.lit(f).alias("fraction")))
    return own.select("block", F.array_min(F.array(*tried)).alias("b")).select("block", "b.fraction", "b.cost")


@query("derived_sizes", "SELECT p_partkey, (p_size * 16)::BIGINT AS w, (p_size * 9)::BIGINT AS h, ((p_size * 16 + 63) // 64)::BIGINT AS ctus_x, ((p_size * 9 + 63) // 64)::BIGINT AS ctus_y, ((p_size * 16 + 63) // 64 * ((p_size * 9 + 63) // 64))::BIGINT AS ctus, (1 << (4 + p_size % 13))::BIGINT AS max_lsb FROM part")
def derived_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in coding units and the order count's range, derived from what a parameter set states."""
    up = lambda k: F.expr(f"(p_size * {k} + 63) div 64")
    s = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", (s * 16).alias("w"), (s * 9).alias("h"), up(16).alias("ctus_x"), up(9).alias("ctus_y"), (up(16) * up(9)).alias("ctus"), F.expr("shiftleft(1L, 4 + p_size % 13)").alias("max_lsb"))


@query(
    "motion_equality",
    f"WITH {BLOCKS} SELECT block, y::INT AS y, px[8 * y + 4] // 86 = px[8 * y + 5] // 86 AND abs(px[8 * y + 4] - px[8 * y + 5]) < 4 AS same FROM blocks, range(0, 8) r(y)",
)
def motion_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two neighbours move alike: the same reference and vectors less than a sample apart."""
    own = blocks(spark, sf_dir).select("block", "px", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
    p, q = F.get("px", F.col("y") * 8 + 3), F.get("px", F.col("y") * 8 + 4)
    return own.select("block", "y", ((F.floor(p / 86) == F.floor(q / 86)) & (F.abs(p - q) < 4)).alias("same"))


@query("preset_lookup", "WITH presets(preset, n8, n4, met, rdoq, cfm) AS (VALUES ('slow', 8, 8, FALSE, TRUE, FALSE), ('medium', 3, 8, TRUE, TRUE, TRUE), ('fast', 3, 4, TRUE, FALSE, TRUE)) SELECT c_custkey, preset, n8, n4, met, rdoq, cfm FROM customer JOIN presets ON preset = CASE c_custkey % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'medium' ELSE 'fast' END")
def preset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preset's knobs for each session, from a table of three rows."""
    knobs = spark.createDataFrame([("slow", 8, 8, False, True, False), ("medium", 3, 8, True, True, True), ("fast", 3, 4, True, False, True)], "preset string, n8 int, n4 int, met boolean, rdoq boolean, cfm boolean")
    name = F.element_at(F.array(F.lit("slow"), F.lit("medium"), F.lit("fast")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("preset")).join(F.broadcast(knobs), "preset")  # three rows


def read_ue(bits: Column, n: int) -> Column:
    """The first n unsigned codes of a string of bits."""
    start = F.struct(bits.alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        zeros = F.length(F.regexp_extract(s["rest"], "^(0*)", 1))
        value = F.conv(F.substr(s["rest"], zeros + 1, zeros + 1), 2, 10).cast("long") - 1
        return F.struct(F.substr(s["rest"], 2 * zeros + 2, F.length(s["rest"])).alias("rest"), F.concat(s["out"], F.array(value)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step)["out"]


@query("parameter_sets", "SELECT p_partkey, 1::BIGINT AS chroma_format, (p_size * 16)::BIGINT AS width, (p_size * 9)::BIGINT AS height, (p_partkey % 3)::BIGINT AS depth_minus8 FROM part")
def parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four codes, written bit by bit and parsed back into a struct."""
    code = lambda v: F.concat(F.repeat(F.lit("0"), F.length(F.bin(v + 1)) - 1), F.bin(v + 1))
    s = F.col("p_size").cast("long")
    bits = F.concat(code(F.lit(1).cast("long")), code(s * 16), code(s * 9), code(F.col("p_partkey") % 3), F.lit("1000"))
    own = table(spark, sf_dir, "part").select("p_partkey", read_ue(bits, 4).alias("v"))
    return own.select("p_partkey", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("chroma_format", "width", "height", "depth_minus8"))])


@query("code_bits", f"WITH {COEFFICIENTS} SELECT l_orderkey, sum(2 * length(bin(CASE WHEN x % 1000 > 0 THEN 2 * (x % 1000) ELSE -2 * (x % 1000) + 1 END)) - 1)::BIGINT AS bits FROM coefs GROUP BY l_orderkey")
def code_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that a unit's levels take when each is written by itself."""
    return exp_golomb(spark, sf_dir).groupBy("l_orderkey").agg(F.sum(F.length("code")).cast("long").alias("bits"))
