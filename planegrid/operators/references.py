"""Picture order, structures of pictures, reference sets and the decoded picture buffer.

A user's events are a stream: its n-th event is the picture of order count n. Structures of eight
pictures are coded by halves, so a picture's references lie its lowest set bit away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.plans.registry import query
from planegrid.sources.tables import table

SOP = 8
#: Places of a structure in coding order: the last, then middles.
CODING_ORDER = (8, 4, 2, 1, 3, 6, 5, 7)

_STREAM = "stream AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS poc, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_DOCKETS = _STREAM + """, places AS (SELECT *, CASE WHEN poc = 0 THEN 0 ELSE (poc - 1) // 8 + 1 END AS sop, CASE WHEN poc = 0 THEN 0 ELSE (poc - 1) % 8 + 1 END AS place FROM stream),
dockets AS (SELECT user_id, event_id, poc, sop, place, sop * 8 <= n - 1 AND poc > 0 AS whole, CASE WHEN sop * 8 <= n - 1 AND poc > 0 THEN place & -place ELSE 1 END AS step,
CASE WHEN poc > 0 AND sop * 8 <= n - 1 THEN (sop - 1) * 8 + list_position([8, 4, 2, 1, 3, 6, 5, 7], place) ELSE poc END AS coded FROM places)"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, poc, n): each event's place in its user's stream."""
    own = Window.partitionBy("user_id")
    order = own.orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.row_number().over(order) - 1).cast("long").alias("poc"), F.count(F.lit(1)).over(own).alias("n"))


def dockets(pictures: DataFrame) -> DataFrame:
    """Pictures with their structure (sop), place in it, distance to their references (step) and place in coding order.

    Picture 0 stands alone; a last structure of fewer than eight is coded one by one.
    """
    own = pictures.withColumn("sop", F.when(F.col("poc") == 0, F.lit(0).cast("long")).otherwise(F.expr("(poc - 1) div 8 + 1")))
    own = own.withColumn("place", F.when(F.col("poc") == 0, F.lit(0).cast("long")).otherwise(F.expr("(poc - 1) % 8 + 1")))
    own = own.withColumn("whole", (F.col("sop") * SOP <= F.col("n") - 1) & (F.col("poc") > 0))
    step = F.when(F.col("whole"), F.col("place").bitwiseAND(-F.col("place"))).otherwise(F.lit(1).cast("long"))
    coded = F.when(F.col("whole"), (F.col("sop") - 1) * SOP + F.array_position(F.array(*[F.lit(p).cast("long") for p in CODING_ORDER]), F.col("place"))).otherwise(F.col("poc"))
    return own.withColumn("step", step).withColumn("coded", coded)


@query("gop_dockets", f"WITH {_DOCKETS} SELECT user_id, event_id, poc, sop, place, step, coded, CASE WHEN poc = 0 THEN 'IDR' WHEN whole AND step < 8 THEN 'B' ELSE 'P' END AS slice, CASE WHEN poc = 0 THEN 0 WHEN NOT whole THEN 1 ELSE 4 - length(bin(step)) + 1 END::INT AS qp_offset FROM dockets")
def gop_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = dockets(stream(spark, sf_dir))
    kind = F.when(F.col("poc") == 0, "IDR").when(F.col("whole") & (F.col("step") < SOP), "B").otherwise("P")
    offset = F.when(F.col("poc") == 0, 0).when(~F.col("whole"), 1).otherwise(5 - F.length(F.bin("step")))
    return own.select("user_id", "event_id", "poc", "sop", "place", "step", "coded", kind.alias("slice"), offset.alias("qp_offset"))


def edges(own: DataFrame) -> DataFrame:
    """Each picture's references: one step back, and one ahead inside a structure of several."""
    refs = F.array(F.col("poc") - F.col("step"), F.when(F.col("whole") & (F.col("step") < SOP), F.col("poc") + F.col("step")))
    return own.where("poc > 0").select("user_id", "poc", "coded", F.explode(F.array_compact(refs)).alias("ref"))


_EDGES = _DOCKETS + ", edges AS (SELECT user_id, poc, coded, poc - step AS ref FROM dockets WHERE poc > 0 UNION ALL SELECT user_id, poc, coded, poc + step FROM dockets WHERE poc > 0 AND whole AND step < 8)"


@query("ref_edges", f"WITH {_EDGES} SELECT e.user_id, e.poc, e.ref, e.coded - d.coded AS distance FROM edges e JOIN dockets d ON d.user_id = e.user_id AND d.poc = e.ref")
def ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with how many pictures are coded from the one to the other."""
    own = dockets(stream(spark, sf_dir))
    target = own.select("user_id", F.col("poc").alias("ref"), F.col("coded").alias("ref_coded"))
    return edges(own).join(target, ["user_id", "ref"]).select("user_id", "poc", "ref", (F.col("coded") - F.col("ref_coded")).alias("distance"))


@query("missing_refs", f"WITH {_EDGES}, kept AS (SELECT * FROM dockets WHERE event_id % 10 <> 3) SELECT DISTINCT e.user_id, e.ref AS poc, TRUE AS generated FROM edges e JOIN kept k ON k.user_id = e.user_id AND k.poc = e.poc ANTI JOIN kept r ON r.user_id = e.user_id AND r.poc = e.ref")
def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures to be made up where a tenth of them is lost: referenced and not there."""
    kept = dockets(stream(spark, sf_dir)).where("event_id % 10 <> 3")
    there = kept.select("user_id", F.col("poc").alias("ref"))
    lost = edges(kept).join(there, ["user_id", "ref"], "left_anti")
    return lost.select("user_id", F.col("ref").alias("poc")).distinct().withColumn("generated", F.lit(True))


@query("rps_marking", f"WITH {_EDGES}, uses AS (SELECT user_id, ref AS poc, count(*) AS uses, max(coded) AS last_use FROM edges GROUP BY ALL) SELECT d.user_id, d.poc, coalesce(uses, 0) AS uses, last_use, CASE WHEN uses IS NULL THEN 'unused' WHEN last_use - d.coded > 8 THEN 'long' ELSE 'short' END AS marking FROM dockets d LEFT JOIN uses USING (user_id, poc)")
def rps_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each picture stays a reference."""
    own = dockets(stream(spark, sf_dir))
    uses = edges(own).groupBy("user_id", F.col("ref").alias("poc")).agg(F.count(F.lit(1)).alias("uses"), F.max("coded").alias("last_use"))
    marking = F.when(F.col("uses").isNull(), "unused").when(F.col("last_use") - F.col("coded") > 8, "long").otherwise("short")
    return own.join(uses, ["user_id", "poc"], "left").select("user_id", "poc", F.coalesce("uses", F.lit(0)).alias("uses"), "last_use", marking.alias("marking"))


@query("poc_decode", f"WITH {_STREAM} SELECT user_id, event_id, poc FROM stream")
def poc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts back from their four low bits: a fall by eight or more is a wrap, a rise by more than eight one back."""
    own = stream(spark, sf_dir).select("user_id", "event_id", "poc", F.col("poc").bitwiseAND(F.lit(15).cast("long")).alias("lsb"))
    order = Window.partitionBy("user_id").orderBy("poc")
    before = F.lag("lsb", 1, 0).over(order)
    wrap = F.when(before - F.col("lsb") >= 8, 1).when(F.col("lsb") - before > 8, -1).otherwise(0)
    own = own.withColumn("wrap", wrap)
    return own.select("user_id", "event_id", (F.sum("wrap").over(order) * 16 + F.col("lsb")).alias("poc"))


@query("dts", f"WITH {_STREAM}, t AS (SELECT s.user_id, s.event_id, poc, epoch_us(ts) * 9 // 100 AS pts FROM stream s JOIN events USING (event_id)), w AS (SELECT *, lag(pts, 3) OVER (PARTITION BY user_id ORDER BY poc) AS delayed, min(pts) OVER (PARTITION BY user_id) AS first_pts FROM t) SELECT user_id, event_id, pts, coalesce(delayed, first_pts - (3 - poc) * 3600) AS dts FROM w")
def dts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding times: the presentation time three pictures before, and before the first ones at the picture period."""
    own = stream(spark, sf_dir).select("user_id", "event_id", "poc", F.expr("unix_micros(cast(ts as timestamp)) * 9 div 100").alias("pts"))
    order = Window.partitionBy("user_id").orderBy("poc")
    early = F.min("pts").over(Window.partitionBy("user_id")) - (3 - F.col("poc")) * 3600
    return own.select("user_id", "event_id", "pts", F.coalesce(F.lag("pts", 3).over(order), early).alias("dts"))


def bump(coded: Column, reorder: int = 3) -> Column:
    """Pictures (arrays of structs that begin with the order count) in coding order to output order.

    The smallest order count goes out as soon as over ``reorder`` pictures wait; the rest goes out at the end.
    """

    def step(s: Column, picture: Column) -> Column:
        waiting = F.array_sort(F.array_append(s["waiting"], picture))
        full = F.size(waiting) > reorder
        return F.struct(
            F.when(full, F.slice(waiting, 2, reorder)).otherwise(waiting).alias("waiting"),
            F.when(full, F.array_append(s["out"], F.get(waiting, F.lit(0)))).otherwise(s["out"]).alias("out"),
        )

    none = F.slice(coded, 1, 0)
    return F.aggregate(coded, F.struct(none.alias("waiting"), none.alias("out")), step, lambda s: F.concat(s["out"], s["waiting"]))


@query("dpb_output", f"WITH {_DOCKETS} SELECT user_id, sop // 16 AS sop_run, row_number() OVER (PARTITION BY user_id, sop // 16 ORDER BY poc) - 1 AS output, poc, event_id FROM dockets")
def dpb_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output order by bumping, sequences of 16 structures each; three waiting pictures are enough for the structures of eight."""
    own = dockets(stream(spark, sf_dir)).select("user_id", F.expr("sop div 16").alias("sop_run"), F.struct("coded", F.struct("poc", "event_id").alias("picture")).alias("p"))
    # a sequence has 16 * SOP pictures at most
    runs = own.groupBy("user_id", "sop_run").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["picture"]).alias("coded"))
    out = runs.select("user_id", "sop_run", F.posexplode(bump(F.col("coded"))).alias("output", "picture"))
    return out.select("user_id", "sop_run", F.col("output").cast("long").alias("output"), "picture.poc", "picture.event_id")


@query("dpb_slots", f"WITH {_EDGES}, life AS (SELECT d.user_id, d.poc, d.coded AS born, coalesce(max(e.coded), d.coded) AS dies FROM dockets d LEFT JOIN edges e ON e.user_id = d.user_id AND e.ref = d.poc GROUP BY d.user_id, d.poc, d.coded), steps AS (SELECT user_id, born AS t, 1 AS d FROM life UNION ALL SELECT user_id, dies + 1, -1 FROM life), sums AS (SELECT user_id, t, sum(d) AS d FROM steps GROUP BY ALL), level AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS used FROM sums) SELECT user_id, max(used)::BIGINT AS slots FROM level GROUP BY user_id")
def dpb_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that a stream's buffer must hold at once: from their coding to their last use."""
    own = dockets(stream(spark, sf_dir))
    last = edges(own).groupBy("user_id", F.col("ref").alias("poc")).agg(F.max("coded").alias("last"))
    life = own.join(last, ["user_id", "poc"], "left").select("user_id", "coded", F.coalesce("last", "coded").alias("dies"))
    steps = life.select("user_id", F.explode(F.array(F.struct(F.col("coded").alias("t"), F.lit(1).alias("d")), F.struct((F.col("dies") + 1).alias("t"), F.lit(-1).alias("d")))).alias("s"))
    level = steps.groupBy("user_id", "s.t").agg(F.sum("s.d").alias("d"))
    used = F.sum("d").over(Window.partitionBy("user_id").orderBy("t"))
    return level.select("user_id", used.alias("used")).groupBy("user_id").agg(F.max("used").alias("slots"))


@query("reference_lists", f"WITH {_EDGES}, l AS (SELECT user_id, poc, list(ref ORDER BY abs(ref - poc), ref) FILTER (ref < poc) AS b, list(ref ORDER BY abs(ref - poc), ref) FILTER (ref > poc) AS a FROM edges GROUP BY ALL), c AS (SELECT user_id, poc, list_concat(coalesce(b, []), coalesce(a, [])) AS l0, list_concat(coalesce(a, []), coalesce(b, [])) AS l1 FROM l) SELECT user_id, poc, array_to_string(list_transform(range(0, 3), lambda i: l0[(i % len(l0) + 1)::INT]), ',') AS list0, array_to_string(list_transform(range(0, 3), lambda i: l1[(i % len(l1) + 1)::INT]), ',') AS list1 FROM c")
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists of three: before then after, and after then before, repeated in turn."""
    near = F.array_sort(F.collect_list(F.struct(F.abs(F.col("ref") - F.col("poc")).alias("d"), "ref")))
    own = edges(dockets(stream(spark, sf_dir))).groupBy("user_id", "poc").agg(near.alias("refs"))
    before, after = F.filter("refs", lambda r: r["ref"] < F.col("poc")), F.filter("refs", lambda r: r["ref"] > F.col("poc"))

    def three(own: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(own, i % F.size(own))["ref"]), ",")

    return own.select("user_id", "poc", three(F.concat(before, after)).alias("list0"), three(F.concat(after, before)).alias("list1"))


@query("delta_references", f"WITH {_EDGES} SELECT user_id, poc, array_to_string(list_transform(list(poc - ref ORDER BY poc - ref) FILTER (ref < poc), lambda x, i: x - 1), ',') AS coded_deltas FROM edges GROUP BY ALL")
def delta_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances back as they are coded, each less the one before and one."""
    own = edges(dockets(stream(spark, sf_dir))).where("ref < poc").groupBy("user_id", "poc").agg(F.array_sort(F.collect_list(F.col("poc") - F.col("ref"))).alias("d"))
    coded = F.transform("d", lambda v, i: v - F.coalesce(F.get("d", i - 1), F.lit(0)) - 1)
    return own.select("user_id", "poc", F.array_join(coded, ",").alias("coded_deltas"))
