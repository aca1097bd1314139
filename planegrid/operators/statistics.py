"""Histograms, block activity, and the offset filter's statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.plans.registry import PAIRS, SAMPLES, query
from planegrid.sources.tables import block_pairs, blocks, pictures, samples

PICTURES = "pictures AS (SELECT date_trunc('hour', ts) AS hour, least(255, floor(value / 2)::INT) AS v FROM events)"
HISTOGRAM = PICTURES + ", histogram AS (SELECT hour, v >> 2 AS bin, count(*) AS n FROM pictures GROUP BY ALL)"


def histogram(df: DataFrame, picture: str = "hour") -> DataFrame:
    """(picture, v) to (picture, bin, n): 64 bins of four levels each."""
    return df.groupBy(picture, F.shiftright("v", 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("luma_histogram", f"WITH {HISTOGRAM} SELECT hour, bin, n FROM histogram")
def luma_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(pictures(spark, sf_dir))


#: Pictures whose neighbours are looked at in one task.
SEGMENT = 4096


def numbered(hours: DataFrame) -> DataFrame:
    """(hour) to (hour, frame), from 1 in order: inside each month, behind the months before it, of which there are few."""
    months = hours.withColumn("month", F.trunc("hour", "month"))
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    starts = months.groupBy("month").agg(F.count(F.lit(1)).alias("n")).select("month", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("month").orderBy("hour"))
    return months.join(starts, "month").select("hour", (F.col("start") + inside).alias("frame"))


def segments(rows: DataFrame, before: int, after: int, length: int = SEGMENT) -> DataFrame:
    """Rows of a stream's ``frame`` with segment and own: each also comes, not own, to a segment that looks ``before`` or ``after`` over its border."""
    at = lambda d: F.floor((F.col("frame") + d) / length).cast("long")
    near = F.array_distinct(F.array(at(0), at(after), at(-before)))
    return rows.withColumn("segment", F.explode(near)).withColumn("own", F.col("segment") == at(0))


def histogram_difference(own: DataFrame) -> DataFrame:
    """(hour, bin, n) to (hour, difference): what the bins differ from the picture before, summed.

    Each bin goes to its picture and, negated, to the next, so one aggregation replaces a full outer self-join.
    """
    number = numbered(own.select("hour").distinct())
    bins = own.join(number, "hour")
    shifted = bins.select("frame", "bin", "n").union(bins.select(F.col("frame") + 1, "bin", -F.col("n")))
    total = shifted.groupBy("frame", "bin").agg(F.sum("n").alias("d")).groupBy("frame").agg(F.sum(F.abs("d")).alias("difference"))
    return total.join(number, "frame").where("frame > 1").select("hour", F.col("frame").cast("long").alias("frame"), "difference")


_DIFFERENCE = HISTOGRAM + """, numbered AS (SELECT hour, row_number() OVER (ORDER BY hour) AS frame FROM (SELECT DISTINCT hour FROM histogram)),
bins AS (SELECT frame, bin, n FROM histogram JOIN numbered USING (hour)),
differences AS (SELECT coalesce(a.frame, b.frame + 1) AS frame, sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0)))::BIGINT AS difference FROM bins a FULL JOIN bins b ON b.frame + 1 = a.frame AND a.bin = b.bin GROUP BY 1)"""


@query("hist_difference", f"WITH {_DIFFERENCE} SELECT hour, frame, difference FROM differences JOIN numbered USING (frame) WHERE frame > 1")
def hist_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_difference(histogram(pictures(spark, sf_dir)))


@query("fade_test", f"WITH {HISTOGRAM} SELECT hour, sum(n)::BIGINT AS samples, sum(CASE WHEN bin < 9 THEN n ELSE 0 END) = sum(n) AS black, sum(CASE WHEN bin >= 55 THEN n ELSE 0 END) = sum(n) AS white FROM histogram GROUP BY hour")
def fade_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures wholly in the first or in the last nine bins."""
    part = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) == F.sum("n")
    return histogram(pictures(spark, sf_dir)).groupBy("hour").agg(F.sum("n").alias("samples"), part(F.col("bin") < 9).alias("black"), part(F.col("bin") >= 55).alias("white"))


def shot_changes(differences: DataFrame) -> DataFrame:
    """(frame, difference, hour) to the frames that stand out among five before and four after.

    The right side's mean and deviation divide by five although it has four frames. Frames are numbered
    without gaps, so a segment needs five frames before it and four after.
    """
    order = Window.partitionBy("segment").orderBy("frame")
    left, right, around = order.rowsBetween(-5, -1), order.rowsBetween(1, 4), order.rowsBetween(-5, 4)
    differences = segments(differences, 5, 5)  # a frame goes where it is one of five before, or of four after
    d = F.col("difference").cast("double")
    own = differences.select(
        "own",
        "frame",
        "difference",
        F.avg("difference").over(left).alias("mean_l"),
        F.stddev_pop("difference").over(left).alias("dev_l"),
        (F.sum("difference").over(right) / 5.0).alias("mean_r"),
        F.collect_list(d).over(right).alias("rights"),
        F.max("difference").over(around).alias("most"),
        F.count(F.lit(1)).over(around).alias("n"),
    ).where("own AND n = 10")
    squares = F.aggregate("rights", F.lit(0.0), lambda a, x: a + (x - F.col("mean_r")) * (x - F.col("mean_r")))
    own = own.withColumn("dev_r", F.sqrt(squares / 5.0))
    level = F.greatest(F.col("mean_l") + 7 * F.col("dev_l"), F.col("mean_r") + 7 * F.col("dev_r"))
    return own.where("difference = most").withColumn("stands_out", F.col("difference") > level).select("frame", "difference", F.round(level, 6).alias("level"), "stands_out")


@query(
    "shot_candidates",
    f"""WITH {_DIFFERENCE}, own AS (SELECT frame, difference, avg(difference) OVER l AS mean_l, stddev_pop(difference) OVER l AS dev_l, sum(difference) OVER r / 5.0 AS mean_r,
list(difference) OVER r AS rights, max(difference) OVER a AS most, count(*) OVER a AS n FROM differences WHERE frame > 1 AND frame <= (SELECT max(frame) FROM numbered)
WINDOW l AS (ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r AS (ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), a AS (ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
devs AS (SELECT *, sqrt(list_sum(list_transform(rights, lambda x: (x - mean_r) * (x - mean_r))) / 5.0) AS dev_r FROM own WHERE n = 10 AND difference = most)
SELECT frame, difference, round(greatest(mean_l + 7 * dev_l, mean_r + 7 * dev_r)::DOUBLE, 6) AS level, difference > greatest(mean_l + 7 * dev_l, mean_r + 7 * dev_r) AS stands_out FROM devs""",
)
def shot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shot_changes(hist_difference(spark, sf_dir))


@query(
    "block_grid",
    f"WITH {SAMPLES} SELECT block, x // 2 AS cx, y // 2 AS cy, avg(v)::DOUBLE AS mean, round(var_pop(v)::DOUBLE, 6) AS variance FROM samples GROUP BY ALL",
)
def block_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of each 2x2 cell of a block."""
    tall = samples(blocks(spark, sf_dir))
    cell = lambda c: F.floor(F.col(c) / 2).cast("int")
    return tall.groupBy("block", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.avg("v").alias("mean"), F.round(F.var_pop("v"), 6).alias("variance"))


_ACTIVITY = SAMPLES + """, quadrants AS (SELECT block, label, x // 4 + 2 * (y // 4) AS q, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS ss FROM samples GROUP BY ALL),
activity AS (SELECT block, label, 1 + min(ss // 16 - (s // 16) * (s // 16)) AS activity FROM quadrants GROUP BY ALL)"""


def block_activity(own: DataFrame) -> DataFrame:
    """(block, label, px) to (block, label, activity): 1 + the least variance of the quadrants, with truncating divisions."""
    found = own
    variances = []
    for i in range(4):
        quad = F.flatten(F.array(*[F.slice("px", 1 + 8 * y + 4 * (i % 2), 4) for y in range(4 * (i // 2), 4 * (i // 2) + 4)]))
        s = F.aggregate(quad, F.lit(0).cast("long"), lambda a, x: a + x)
        ss = F.aggregate(quad, F.lit(0).cast("long"), lambda a, x: a + x * x)
        found = found.withColumn(f"m{i}", F.floor(s / 16)).withColumn(f"s{i}", F.floor(ss / 16))
        variances.append(F.col(f"s{i}") - F.col(f"m{i}") * F.col(f"m{i}"))
    return found.select("block", "label", (1 + F.least(*variances)).alias("activity"))


@query("activity_layers", f"WITH {_ACTIVITY} SELECT label, count(*) AS blocks, floor(avg(activity))::BIGINT AS mean_activity FROM activity GROUP BY ROLLUP (label)")
def activity_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_activity(blocks(spark, sf_dir)).rollup("label").agg(F.count(F.lit(1)).alias("blocks"), F.floor(F.avg("activity")).alias("mean_activity"))


@query(
    "activity_qp_offset",
    f"""WITH {_ACTIVITY}, m AS (SELECT label, floor(avg(activity))::DOUBLE AS a FROM activity GROUP BY label)
SELECT block, activity, floor(log2((2.0 * activity + a) / (activity + 2.0 * a)) * 6 + 0.49999)::BIGINT AS qp_offset FROM activity JOIN m USING (label)""",
)
def activity_qp_offset(spark: SparkSession, sf_dir: str, strength: float = 2.0) -> DataFrame:
    """The offset by a block's activity against its layer's mean; strength is 2 to the range over 6."""
    own = block_activity(blocks(spark, sf_dir))
    mean = own.groupBy("label").agg(F.floor(F.avg("activity")).cast("double").alias("a"))
    norm = (strength * F.col("activity") + F.col("a")) / (F.col("activity") + strength * F.col("a"))
    return own.join(mean, "label").select("block", "activity", F.floor(F.log2(norm) * 6 + 0.49999).alias("qp_offset"))


def band_statistics(pairs: DataFrame) -> DataFrame:
    """(block, src, ref) to (block, band, n, e): 32 bands of the reconstruction, with the summed error to the source."""
    tall = pairs.select("block", F.explode(F.arrays_zip("src", "ref")).alias("s")).select("block", "s.src", "s.ref")
    return tall.groupBy("block", F.shiftright("ref", 3).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") - F.col("ref")).alias("e"))


_BANDS = PAIRS + ", bands AS (SELECT block, ref >> 3 AS band, count(*) AS n, sum(src - ref)::BIGINT AS e FROM pairs GROUP BY ALL)"


@query("sao_band_stats", f"WITH {_BANDS} SELECT * FROM bands")
def sao_band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_statistics(block_pairs(spark, sf_dir))


@query(
    "sao_best_band",
    f"""WITH {_BANDS}, w AS (SELECT block, k, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT block FROM bands) b CROSS JOIN range(0, 29) r(k) LEFT JOIN bands USING (block) WHERE band BETWEEN k AND k + 3 OR band IS NULL GROUP BY ALL)
SELECT block, greatest(2, arg_max(k, n * 100 - k) + 1)::INT AS band_position, max(n) AS covered FROM w GROUP BY block""",
)
def sao_best_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four neighbouring bands with the most samples, the first of equals; the position is one more, and 2 at least."""
    spread = band_statistics(block_pairs(spark, sf_dir)).select("block", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("band") - 3), F.least(F.lit(28), F.col("band")))).alias("k"))
    sums = spread.groupBy("block", "k").agg(F.sum("n").alias("n"))
    best = sums.groupBy("block").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"), F.max("n").alias("covered"))
    return best.select("block", F.greatest(F.lit(2), F.col("k") + 1).cast("int").alias("band_position"), "covered")


#: The neighbours of each edge class: along x, along y, and the two diagonals.
EDGES = ((1, 0), (0, 1), (1, 1), (-1, 1))


def _edge_sql() -> str:
    parts = []
    for c, (dx, dy) in enumerate(EDGES):
        parts.append(f"SELECT a.block, {c} AS class, 2 + sign(a.ref - l.ref) + sign(a.ref - r.ref) AS category, a.src - a.ref AS e FROM pairs a JOIN pairs l ON l.block = a.block AND l.x = a.x - {dx} AND l.y = a.y - {dy} JOIN pairs r ON r.block = a.block AND r.x = a.x + {dx} AND r.y = a.y + {dy} WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6")
    return f"WITH {PAIRS}, edges AS ({' UNION ALL '.join(parts)}) SELECT block, class, category::INT AS category, count(*) AS n, sum(e)::BIGINT AS e FROM edges GROUP BY ALL"


@query("sao_edge_stats", _edge_sql())
def sao_edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and summed error of the five edge categories in each of four directions, for samples inside the block."""
    own = block_pairs(spark, sf_dir)
    inner = F.array(*[F.lit(8 * y + x) for y in range(1, 7) for x in range(1, 7)])
    tall = own.select("block", "src", "ref", F.explode(inner).alias("i"))
    sign = lambda d: F.signum((F.get("ref", F.col("i")) - F.get("ref", F.col("i") + d)).cast("double")).cast("int")
    categories = [F.struct(F.lit(c).alias("class"), (2 + sign(-(8 * dy + dx)) + sign(8 * dy + dx)).alias("category")) for c, (dx, dy) in enumerate(EDGES)]
    found = tall.select("block", (F.get("src", F.col("i")) - F.get("ref", F.col("i"))).alias("e"), F.explode(F.array(*categories)).alias("c"))
    return found.groupBy("block", "c.class", "c.category").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"))


@query(
    "sao_band_offsets",
    f"""WITH {_BANDS}, o AS (SELECT block, band, n, e, least(7, greatest(-7, sign(e) * (abs(e) // n))) AS q FROM bands), t AS (SELECT block, band, off, n * off * off - 2 * off * e AS delta FROM o, range(-7, 8) r(off) WHERE (off BETWEEN least(q, 0) AND greatest(q, 0)))
SELECT block, band, arg_min(off, delta * 100 + abs(off))::INT AS best, min(delta)::BIGINT AS delta FROM t GROUP BY ALL""",
)
def sao_band_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset between 0 and the mean error that lowers a band's squared error most: n o^2 - 2 o e."""
    own = band_statistics(block_pairs(spark, sf_dir))
    mean = (F.signum(F.col("e").cast("double")) * F.floor(F.abs("e") / F.col("n"))).cast("int")
    q = F.least(F.lit(7), F.greatest(F.lit(-7), mean))
    tried = own.select("block", "band", "n", "e", F.explode(F.sequence(F.least(q, F.lit(0)), F.greatest(q, F.lit(0)))).alias("o"))
    delta = F.col("n") * F.col("o") * F.col("o") - 2 * F.col("o") * F.col("e")
    return tried.groupBy("block", "band").agg(F.min_by("o", F.struct(delta, F.abs("o"))).alias("best"), F.min(delta).alias("delta"))


def offset_costs(stats: DataFrame, lagrangian: int, *keys: str) -> DataFrame:
    """(keys, n, e, least, most, sign_bits) to (keys, offset, cost) of the offset between 0 and the mean error that costs least.

    An offset o changes the squared error by n o^2 - 2 o e and takes |o| + 1 bits (7 at 7), and its sign where one is coded.
    """
    mean = (F.signum(F.col("e").cast("double")) * F.floor(F.abs("e") / F.col("n"))).cast("int")
    q = F.least(F.col("most"), F.greatest(F.col("least"), mean))
    tried = stats.withColumn("o", F.explode(F.sequence(F.least(q, F.lit(0)), F.greatest(q, F.lit(0)))))
    bits = F.least(F.abs("o") + 1, F.lit(7)) + F.when(F.col("o") != 0, F.col("sign_bits")).otherwise(0)
    tried = tried.withColumn("cost", F.col("n") * F.col("o") * F.col("o") - 2 * F.col("o") * F.col("e") + lagrangian * bits)
    return tried.groupBy(*keys).agg(F.min_by("o", F.struct("cost", F.abs("o"))).alias("offset"), F.min("cost").alias("cost"))


_LAGRANGIAN = 40
_OFFSETS = f"""t AS (SELECT s.*, o, n * o * o - 2 * o * e + {_LAGRANGIAN} * (least(abs(o) + 1, 7) + CASE WHEN o <> 0 THEN sign_bits ELSE 0 END) AS cost FROM (SELECT *, least(most, greatest(low, sign(e) * (abs(e) // n))) AS q FROM s) s, range(-7, 8) r(o) WHERE o BETWEEN least(q, 0) AND greatest(q, 0)),
b AS (SELECT block, kind, class, item, min(cost)::BIGINT AS cost FROM t GROUP BY ALL)"""


@query(
    "sao_search",
    f"""WITH {_BANDS}, es AS ({_edge_sql()}), s AS (SELECT block, 'edge' AS kind, class, category AS item, n, e, CASE WHEN category < 2 THEN 0 ELSE -7 END AS low, CASE WHEN category < 2 THEN 7 ELSE 0 END AS most, 0 AS sign_bits FROM es WHERE category <> 2
UNION ALL SELECT block, 'band', 0, band, n, e, -7, 7, 1 FROM bands), {_OFFSETS},
all_ AS (SELECT block, 'edge' AS kind, class, sum(cost)::BIGINT + {_LAGRANGIAN} * (4 - count(*) + 4) AS cost FROM b WHERE kind = 'edge' GROUP BY block, class
UNION ALL SELECT block, 'band', k, sum(cost)::BIGINT + {_LAGRANGIAN} * (4 - count(*) + 7) FROM b JOIN range(0, 29) r(k) ON item BETWEEN k AND k + 3 WHERE kind = 'band' GROUP BY block, k
UNION ALL SELECT DISTINCT block, 'none', 0, {_LAGRANGIAN} FROM bands)
SELECT block, arg_min(kind, (cost, kind, class)) AS kind, arg_min(class, (cost, kind, class))::INT AS class, min(cost)::BIGINT AS cost FROM all_ GROUP BY block""",
)
def sao_search(spark: SparkSession, sf_dir: str, lagrangian: int = _LAGRANGIAN) -> DataFrame:
    """Per block the cheapest of no offset, four edge classes and 29 places of four bands, by squared error and bits.

    Valleys (categories 0 and 1) are lifted, peaks (3 and 4) lowered. Where nothing stands an offset of 0 takes a bit.
    """
    own = block_pairs(spark, sf_dir).where("src IS NOT NULL AND ref IS NOT NULL").select(F.col("block").cast("long").alias("block"), "src", "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_sao_best(b, lagrangian) for b in whole_blocks(batches))

    return own.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, kind string, class int, cost long")


def whole_blocks(batches: Iterator[pa.RecordBatch], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, ``most`` rows or more, cut so that a block's rows stand in one."""
    held = None
    for b in (b.slice(i, most) for b in batches for i in range(0, len(b), most)):
        held = b if held is None else pa.concat_batches([held, b])
        first = int(np.searchsorted(np.array(held.column(0)), held.column(0)[-1].as_py()))
        if first:
            yield held.slice(0, first)
            held = held.slice(first)
    if held is not None and len(held):
        yield held


def _least_costs(n: np.ndarray, e: np.ndarray, least: int, most: int, sign_bits: int, lagrangian: int) -> np.ndarray:
    """The least cost of an offset between 0 and the mean error, as offset_costs has it; 0 where nothing stands."""
    mean = np.sign(e) * (np.abs(e) // np.maximum(n, 1))
    q = np.clip(mean, least, most)
    best = np.full(n.shape, np.iinfo(np.int64).max)
    for o in range(least, most + 1):
        cost = n * o * o - 2 * o * e + lagrangian * (min(abs(o) + 1, 7) + (sign_bits if o else 0))
        best = np.where((np.minimum(q, 0) <= o) & (o <= np.maximum(q, 0)), np.minimum(best, cost), best)
    return np.where(n > 0, best, 0)


def _sao_best(b: pa.RecordBatch, lagrangian: int) -> pa.RecordBatch:
    """(block, src, ref) of 8 x 8 samples to (block, kind, class, cost): all blocks' counts and errors at once, then the candidates in turn."""
    blocks_, of = np.unique(np.array(b.column(0)), return_inverse=True)
    src, ref = (b.column(i).flatten().to_numpy().astype(np.int64).reshape(-1, 8, 8) for i in (1, 2))
    size = len(blocks_)

    def counted(groups: np.ndarray, error: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
        at = (of[:, None] * items + groups.reshape(len(groups), -1)).ravel()
        n = np.bincount(at, minlength=size * items)
        return n.reshape(size, items), np.bincount(at, error.ravel(), size * items).astype(np.int64).reshape(size, items)

    # candidates in the order of kind and class, so the first of equal costs stands
    kinds, classes, costs = [], [], []

    def tried(kind: str, number: int, there: np.ndarray, cost: np.ndarray) -> None:
        kinds.append(kind)
        classes.append(number)
        costs.append(np.where(there, cost, np.iinfo(np.int64).max))

    n, e = counted(ref >> 3, src - ref, 32)
    least = _least_costs(n, e, -7, 7, 1, lagrangian)
    for k in range(29):
        some = (n[:, k : k + 4] > 0).sum(1)
        tried("band", k, some > 0, least[:, k : k + 4].sum(1) + lagrangian * (11 - some))
    inner = ref[:, 1:7, 1:7]
    for c, (dx, dy) in enumerate(EDGES):
        category = 2 + np.sign(inner - ref[:, 1 - dy : 7 - dy, 1 - dx : 7 - dx]) + np.sign(inner - ref[:, 1 + dy : 7 + dy, 1 + dx : 7 + dx])
        n, e = counted(category, (src - ref)[:, 1:7, 1:7], 5)
        some = (n[:, [0, 1, 3, 4]] > 0).sum(1)
        cost = _least_costs(n[:, :2], e[:, :2], 0, 7, 0, lagrangian).sum(1) + _least_costs(n[:, 3:], e[:, 3:], -7, 0, 0, lagrangian).sum(1)
        tried("edge", c, some > 0, cost + lagrangian * (8 - some))
    tried("none", 0, np.ones(size, bool), np.full(size, lagrangian))
    every = np.array(costs)
    best = every.argmin(0)
    columns = [pa.array(blocks_), pa.array(np.array(kinds)[best].tolist(), pa.string()), pa.array(np.array(classes, np.int32)[best]), pa.array(every[best, np.arange(size)])]
    return pa.RecordBatch.from_arrays(columns, ["block", "kind", "class", "cost"])


@query("bitrate_summary", "SELECT l_returnflag AS stream, count(*) AS frames, sum(floor(l_extendedprice))::BIGINT AS bytes, round(8 * sum(floor(l_extendedprice)) / count(*) * 24 / 1000, 6) AS kbps FROM lineitem GROUP BY 1")
def bitrate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = F.sum(F.floor("l_extendedprice"))
    return own.groupBy(F.col("l_returnflag").alias("stream")).agg(F.count(F.lit(1)).alias("frames"), size.alias("bytes"), F.round(8 * size / F.count(F.lit(1)) * 24 / 1000, 6).alias("kbps"))


@query("rd_merge", "SELECT l_orderkey AS unit, sum(l_quantity)::BIGINT AS bits, sum(floor(l_extendedprice))::BIGINT AS distortion, round(sum(l_quantity) + sum(floor(l_extendedprice)) / 64.0, 6) AS cost FROM lineitem GROUP BY 1")
def rd_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and distortion of a unit's parts added up, and bits + D / lambda."""
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("unit"))
    found = own.agg(F.sum("l_quantity").cast("long").alias("bits"), F.sum(F.floor("l_extendedprice")).alias("distortion"))
    return found.withColumn("cost", F.round(F.col("bits") + F.col("distortion") / 64.0, 6))


@query("stream_tally", "SELECT lang AS suite, count(*) AS total, count(*) FILTER (length(text) = n_chars)::BIGINT AS passed, count(*) FILTER (length(text) <> n_chars)::BIGINT AS failed FROM documents GROUP BY ROLLUP (lang)")
def stream_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose stated size holds, by suite and over all."""
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    holds = F.char_length("text") == F.col("n_chars")
    return own.rollup(F.col("lang").alias("suite")).agg(F.count(F.lit(1)).alias("total"), F.count_if(holds).alias("passed"), F.count_if(~holds).alias("failed"))


@query("stage_profile", "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 2) AS cycles, round(sum(value) / count(*), 6) AS cycles_per_call FROM events GROUP BY 1")
def stage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("stage"))
    return own.agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("cycles"), F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("cycles_per_call"))
