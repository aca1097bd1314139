"""Shot changes of pictures: histogram differences that stand out, likelihoods of cells, and fades from black or white.

A frame's difference stands out if none of five before and four after is larger and it lies 45 deviations above the mean of
either side, or seven, if the cells of both pictures are alike as well. A frame behind black or white ones is a change by
itself. Changes keep a distance, so those that could be are folded in order; only they are, in runs that are too far apart to
touch each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.plans.registry import BLOCKS, query
from planegrid.sources.tables import blocks

#: Deviations that are enough by themselves, and with a likelihood below LIKE.
STRONG, WEAK, LIKE = 45, 7, 1.7
#: Frames between two changes; the first frame of a stream counts as one.
GAP = 5
#: Bins of the histogram, and those at either end that make a frame black or white.
BINS, ENDS = 64, 9
#: What a cell is unlike that no cell beside it can be compared with.
UNLIKE = 10_000_000.0


def differences(frames: DataFrame) -> DataFrame:
    """Samples (stream, frame, px) of pictures, several rows a picture, to (stream, frame, difference, plain): the absolute differences of its
    histogram to the one before, null for a stream's first frame, and whether all samples lie in the first or the last bins."""
    tall = frames.select("stream", "frame", F.explode("px").alias("v")).groupBy("stream", "frame", F.shiftright("v", 2).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counted = tall.groupBy("stream", "frame").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"), (F.max("bin") < ENDS).alias("black"), (F.min("bin") >= BINS - ENDS).alias("white")
    )
    order = Window.partitionBy("stream").orderBy("frame")
    one = lambda h, k: F.coalesce(F.col(h)[k], F.lit(0))
    both = counted.withColumn("before", F.lag("h").over(order))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.abs(one("h", k) - one("before", k))), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("stream", "frame", F.when(F.col("before").isNotNull(), total).alias("difference"), (F.col("black") | F.col("white")).alias("plain"))


def candidates(found: DataFrame) -> DataFrame:
    """(stream, frame, difference, plain) with strong and weak: whether the difference stands out by 45 or by seven deviations.

    The four differences behind are summed over five. Frames need five differences before them, and five frames behind.
    """
    order = Window.partitionBy("stream").orderBy("frame")
    left, right, around = order.rowsBetween(-5, -1), order.rowsBetween(1, 4), order.rowsBetween(-5, 4)
    d = F.col("difference").cast("double")
    own = found.withColumns(
        {
            "ml": F.sum(d).over(left) / 5.0,
            "mr": F.sum(d).over(right) / 5.0,
            "l": F.collect_list(d).over(left),
            "r": F.collect_list(d).over(right),
            "most": F.max(d).over(around),
            "whole": F.count("difference").over(order.rowsBetween(-5, 5)) == 11,
        }
    )
    spread = lambda side, mean: F.sqrt(F.aggregate(side, F.lit(0.0), lambda s, x: s + (x - F.col(mean)) * (x - F.col(mean))) / 5.0)
    own = own.withColumns({"dl": spread("l", "ml"), "dr": spread("r", "mr")})
    over = lambda k: F.coalesce(F.col("whole") & (d >= F.col("most")) & (d > F.greatest(F.col("ml") + k * F.col("dl"), F.col("mr") + k * F.col("dr"))), F.lit(False))
    return own.select("stream", "frame", "difference", "plain", over(STRONG).alias("strong"), over(WEAK).alias("weak"))


def cells(frames: DataFrame) -> DataFrame:
    """Blocks (stream, frame, tx, ty, px) of pictures of 4 x 4 blocks to 8 x 8 cells: (stream, frame, cx, cy, mean, variance)."""
    quarter = lambda x, y: F.flatten(F.array(*[F.slice("px", 8 * (4 * y + k) + 4 * x + 1, 4) for k in range(4)]))
    parts = F.array(*[F.struct((2 * F.col("tx") + x).alias("cx"), (2 * F.col("ty") + y).alias("cy"), quarter(x, y).alias("v")) for y in (0, 1) for x in (0, 1)])
    own = frames.select("stream", "frame", F.explode(parts).alias("c")).select("stream", "frame", "c.*")
    mean = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x) / 16.0
    own = own.withColumn("mean", mean)
    variance = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / 16.0
    return own.select("stream", "frame", "cx", "cy", "mean", variance.alias("variance"))


def likelihoods(grid: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cells, and frames (stream, frame), to (stream, frame, likelihood): the mean over the 16 middle cells of how unlike each is to the likest of the nine
    cells around its place in the picture before; 1 for equal ones. A cell without variance compares with none."""
    mine = grid.join(wanted.select("stream", "frame"), ["stream", "frame"], "left_semi").where("cx BETWEEN 2 AND 5 AND cy BETWEEN 2 AND 5")
    before = wanted.select("stream", (F.col("frame") - 1).alias("frame"))
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    others = grid.join(before, ["stream", "frame"], "left_semi").select("stream", (F.col("frame") + 1).alias("frame"), F.explode(near).alias("d"), "cx", "cy", "mean", "variance")
    others = others.select("stream", "frame", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"), F.col("mean").alias("m0"), F.col("variance").alias("v0"))
    top = F.pow(F.pow((F.col("mean") - F.col("m0")) / 2, F.lit(2.0)) + (F.col("variance") + F.col("v0")) / 2, F.lit(2.0))
    one = F.when(F.col("variance") * F.col("v0") > 0, F.least(F.lit(UNLIKE), top / (F.col("variance") * F.col("v0"))))
    least = mine.join(others, ["stream", "frame", "cx", "cy"]).groupBy("stream", "frame", "cx", "cy").agg(F.coalesce(F.min(one), F.lit(UNLIKE)).alias("l"))
    return least.groupBy("stream", "frame").agg(F.avg("l").alias("likelihood"))


def _fold(events: Column) -> Column:
    """Events (step, kind, frame, since, what) in order to the changes (frame, what) among them.

    kind 0 is a difference that stands out, kind 1 a frame behind plain ones, the last of them ``since``.
    """
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(-1).cast("long").alias("faded"), F.array().cast("array<struct<frame:bigint,what:string>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        hit = F.when(e["kind"] == 0, e["frame"] - 1 - s["last"] > GAP).otherwise((e["since"] > s["faded"]) & (e["frame"] + 1 - s["last"] > GAP))
        return F.struct(
            F.when(hit, e["frame"]).otherwise(s["last"]).alias("last"),
            F.when(hit & (e["kind"] == 1), e["frame"]).otherwise(s["faded"]).alias("faded"),
            F.when(hit, F.array_append(s["out"], F.struct(e["frame"].alias("frame"), e["what"].alias("what")))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(events, start, step, lambda s: s["out"])


def changes(found: DataFrame, like: DataFrame) -> DataFrame:
    """candidates() and likelihoods of its weak ones to the changes: (stream, frame, what), what being strong, weak or fade."""
    order = Window.partitionBy("stream").orderBy("frame")
    since = F.last(F.when(F.col("plain"), F.col("frame")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = found.withColumn("since", since).join(like, ["stream", "frame"], "left")
    frame = F.col("frame").cast("long")
    what = F.when(F.col("strong"), "strong").when(F.col("weak") & (F.col("likelihood") < LIKE), "weak")
    # a picture is judged when five more are there; a fade is seen at once, behind what that step judges
    shot = F.when(what.isNotNull(), F.struct((frame + 5).alias("step"), F.lit(0).alias("kind"), frame.alias("frame"), F.lit(None).cast("long").alias("since"), what.alias("what")))
    fade = F.when(
        ~F.col("plain") & (F.col("since") >= frame - GAP - 2) & (frame > 0), F.struct(frame.alias("step"), F.lit(1).alias("kind"), frame.alias("frame"), F.col("since").cast("long").alias("since"), F.lit("fade").alias("what"))
    )
    events = own.select("stream", F.explode(F.array_compact(F.array(shot, fade))).alias("e"))
    # events so far apart do not touch; the stream's start counts as a change
    by_step = Window.partitionBy("stream").orderBy("e.step", "e.kind")
    new = F.when(F.col("e.step") - F.coalesce(F.lag("e.step").over(by_step), F.lit(0)) > 4 * GAP, 1).otherwise(0)
    runs = events.withColumn("new", new).withColumn("run", F.sum("new").over(by_step))
    folded = runs.groupBy("stream", "run").agg(F.array_sort(F.collect_list("e")).alias("events"))
    return folded.select("stream", F.explode(_fold(F.col("events"))).alias("x")).select("stream", "x.frame", "x.what")


#: Frames of the query's streams.
LENGTH = 1000


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen blocks are a picture; contrast and brightness change every nine pictures, and two of each 25 are black."""
    own = blocks(spark, sf_dir).withColumn("n", F.expr("block div 16"))
    level = F.when(F.col("n") % 25 < 2, F.lit(0)).otherwise(1)
    px = F.transform("px", lambda v: level * F.least(F.lit(255), F.floor(v / 4).cast("int") + (70 * (F.expr("n div 9") % 3)).cast("int")))
    return own.select(F.expr(f"n div {LENGTH}").alias("stream"), (F.col("n") % LENGTH).alias("frame"), (F.col("block") % 4).alias("tx"), F.expr("block % 16 div 4").alias("ty"), px.alias("px"))


_NEAR = "abs(o.cx - c.cx) <= 1 AND abs(o.cy - c.cy) <= 1"


@query(
    "shot_rule",
    f"""WITH RECURSIVE {BLOCKS}, f AS MATERIALIZED (SELECT block // 16 // {LENGTH} AS stream, block // 16 % {LENGTH} AS frame, block % 4 AS tx, block % 16 // 4 AS ty, list_transform(px, lambda v: CASE WHEN block // 16 % 25 < 2 THEN 0 ELSE least(255, v // 4 + 70 * (block // 16 // 9 % 3)) END) AS px FROM blocks),
tall AS MATERIALIZED (SELECT stream, frame, 2 * tx + i % 8 // 4 AS cx, 2 * ty + i // 8 // 4 AS cy, px[i + 1] AS v FROM f, range(0, 64) r(i)),
h AS MATERIALIZED (SELECT stream, frame, v >> 2 AS bin, count(*) AS n FROM tall GROUP BY ALL), plain AS (SELECT stream, frame, max(bin) < {ENDS} OR min(bin) >= {BINS - ENDS} AS plain FROM h GROUP BY ALL),
d AS MATERIALIZED (SELECT p.stream, p.frame, p.plain, CASE WHEN p.frame > 0 THEN (SELECT sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) FROM (SELECT bin, n FROM h WHERE h.stream = p.stream AND h.frame = p.frame) a FULL JOIN (SELECT bin, n FROM h WHERE h.stream = p.stream AND h.frame = p.frame - 1) b USING (bin)) END::DOUBLE AS x FROM plain p),
w AS (SELECT *, list(x) OVER l AS ls, list(x) OVER r AS rs, max(x) OVER a AS most, count(x) OVER k AS n FROM d WINDOW l AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING),
  a AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), k AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
m AS (SELECT *, list_sum(ls) / 5 AS ml, list_sum(rs) / 5 AS mr FROM w), s AS (SELECT *, sqrt(list_sum(list_transform(ls, lambda y: (y - ml) * (y - ml))) / 5) AS dl, sqrt(list_sum(list_transform(rs, lambda y: (y - mr) * (y - mr))) / 5) AS dr FROM m),
k AS MATERIALIZED (SELECT stream, frame, plain, coalesce(n = 11 AND x >= most AND x > greatest(ml + 45 * dl, mr + 45 * dr), FALSE) AS strong, coalesce(n = 11 AND x >= most AND x > greatest(ml + 7 * dl, mr + 7 * dr), FALSE) AS weak FROM s),
c AS MATERIALIZED (SELECT stream, frame, cx, cy, avg(v) AS m, var_pop(v) AS q FROM tall GROUP BY ALL),
o AS (SELECT c.stream, c.frame, c.cx, c.cy, coalesce(min(CASE WHEN c.q * o.q > 0 THEN least({UNLIKE}, pow(pow((c.m - o.m) / 2, 2) + (c.q + o.q) / 2, 2) / (c.q * o.q)) END), {UNLIKE}) AS l FROM c JOIN c o ON o.stream = c.stream AND o.frame = c.frame - 1 AND {_NEAR} WHERE c.cx BETWEEN 2 AND 5 AND c.cy BETWEEN 2 AND 5 GROUP BY ALL),
e0 AS (SELECT k.*, (SELECT max(b.frame) FROM k b WHERE b.stream = k.stream AND b.frame < k.frame AND b.plain) AS since, like_ FROM k LEFT JOIN (SELECT stream, frame, avg(l) AS like_ FROM o GROUP BY ALL) USING (stream, frame)),
e1 AS (SELECT stream, frame + 5 AS step, 0 AS kind, frame, NULL::BIGINT AS since, CASE WHEN strong THEN 'strong' ELSE 'weak' END AS what FROM e0 WHERE strong OR (weak AND like_ < {LIKE}) UNION ALL SELECT stream, frame, 1, frame, since, 'fade' FROM e0 WHERE NOT plain AND since >= frame - {GAP + 2} AND frame > 0),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY step, kind) AS i FROM e1),
t(stream, i, last, faded, hit, frame, what) AS (SELECT DISTINCT stream, 0::BIGINT, 0::BIGINT, -1::BIGINT, FALSE, 0::BIGINT, '' FROM e UNION ALL
  SELECT stream, i, CASE WHEN hit THEN frame ELSE last END, CASE WHEN hit AND kind = 1 THEN frame ELSE faded END, hit, frame, what FROM (SELECT t.stream, e.i, t.last, t.faded, e.frame, e.what, e.kind, CASE WHEN e.kind = 0 THEN e.frame - 1 - t.last > {GAP} ELSE e.since > t.faded AND e.frame + 1 - t.last > {GAP} END AS hit FROM t JOIN e ON e.stream = t.stream AND e.i = t.i + 1))
SELECT stream, frame, what FROM t WHERE hit""",
)
def shot_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shot changes of pictures made of blocks, by the whole rule."""
    own = films(spark, sf_dir)
    found = candidates(differences(own))
    return changes(found, likelihoods(cells(own), found.where("weak")))
