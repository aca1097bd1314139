"""Points in intervals of unequal lengths, by joins on keys alone.

An interval is cut into aligned pieces whose lengths are powers of two, at most two of each, and a point lies in one aligned
piece of every length. So the join is on (key, length, piece), exact, with as many rows as there are results; an interval
costs the logarithm of its length, a point a row for each length that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.operators.references import _STREAM, stream
from planegrid.plans.registry import query
from planegrid.sources.scratch import written
from planegrid.sources.tables import table

#: Powers of two that positions may have.
LEVELS = 62


def _step(s: Column, level: Column) -> Column:
    """Takes the pieces of this length off both ends of [lo, hi), counted in it, and goes on in pairs."""
    odd_lo = (s["lo"] < s["hi"]) & (s["lo"] % 2 != 0)
    lo = F.when(odd_lo, s["lo"] + 1).otherwise(s["lo"])
    odd_hi = (lo < s["hi"]) & (s["hi"] % 2 != 0)
    hi = F.when(odd_hi, s["hi"] - 1).otherwise(s["hi"])
    piece = lambda at: F.struct(level.cast("int").alias("level"), at.alias("piece"))
    new = F.array_compact(F.array(F.when(odd_lo, piece(s["lo"])), F.when(odd_hi, piece(hi))))
    return F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi, 1).alias("hi"), F.concat(s["out"], new).alias("out"))


def pieces(start: Column, stop: Column, levels: int = LEVELS) -> Column:
    """The aligned pieces (level, piece) of [start, stop); none where stop is not above start."""
    begin = F.struct(start.cast("long").alias("lo"), F.greatest(start, stop).cast("long").alias("hi"), F.array().cast("array<struct<level:int,piece:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), begin, _step, lambda s: s["out"])


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at", start: str = "start", stop: str = "stop", how: str = "inner") -> DataFrame:
    """``points`` with each of the ``intervals`` of their keys that holds ``at``: start <= at < stop. ``how`` is inner or left.

    Positions are whole numbers from 0 on; intervals may overlap, nest and repeat. Points or intervals with a null key or
    place meet nothing (left: stand alone). The lengths that occur are looked up first; they are as many as a number has bits, and
    intervals, which are kept for that, are cut at no length above their last place.
    """
    known = written(intervals.where(F.col(start).isNotNull() & F.col(stop).isNotNull()), "intervals")
    levels = max(1, int(known.agg(F.max(stop)).first()[0] or 0).bit_length())
    cut_up = known.withColumn("__p", F.explode(pieces(F.col(start), F.col(stop), min(levels, LEVELS))))
    cut_up = written(cut_up.withColumns({"__level": F.col("__p.level"), "__piece": F.col("__p.piece")}).drop("__p"), "pieces")
    used = [r[0] for r in cut_up.select("__level").distinct().collect()]
    lengths = F.array(*[F.lit(x) for x in sorted(used)]) if used else F.array().cast("array<int>")
    tall = points.withColumn("__level", F.explode(lengths)).withColumn("__piece", F.call_function("shiftright", F.col(at).cast("long"), F.col("__level")))
    met = tall.join(cut_up, [*keys, "__level", "__piece"]).drop("__level", "__piece")
    if how == "inner":
        return met
    alone = points.join(met.select(*points.columns), [F.lit(True)] if not points.columns else [points[c].eqNullSafe(met[c]) for c in points.columns], "left_anti")
    rest = [c for c in met.columns if c not in points.columns]
    return met.unionByName(alone.select(*points.columns, *[F.lit(None).cast(met.schema[c].dataType).alias(c) for c in rest]))


@query(
    "segment_intervals",
    f"""WITH {_STREAM}, b AS (SELECT s.user_id, poc, n, e.event_type FROM stream s JOIN events e USING (event_id)),
shots AS (SELECT user_id, poc AS start, coalesce(lead(poc) OVER (PARTITION BY user_id ORDER BY poc), n) AS stop, 'shot' AS kind FROM b WHERE poc = 0 OR event_type = 'purchase'),
waits AS (SELECT user_id, poc AS start, least(n, poc + 3 + poc % 40) AS stop, 'wait' AS kind FROM b WHERE event_type = 'view' AND poc % 5 = 0),
i AS (SELECT * FROM shots UNION ALL SELECT * FROM waits)
SELECT b.user_id, b.poc, kind, start, stop FROM b JOIN i ON i.user_id = b.user_id AND b.poc >= start AND b.poc < stop""",
)
def segment_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture with the shots and waits that hold it: shots from one purchase to the next, waits of 3 to 42 pictures that overlap."""
    own = written(stream(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id"), "pictures")
    order = Window.partitionBy("user_id").orderBy("poc")
    shots = own.where("poc = 0 OR event_type = 'purchase'").select("user_id", F.col("poc").alias("start"), F.coalesce(F.lead("poc").over(order), "n").alias("stop"), F.lit("shot").alias("kind"))
    waits = own.where("event_type = 'view' AND poc % 5 = 0").select("user_id", F.col("poc").alias("start"), F.least("n", F.col("poc") + 3 + F.col("poc") % 40).alias("stop"), F.lit("wait").alias("kind"))
    return interval_join(own.select("user_id", "poc"), shots.unionByName(waits), ["user_id"], at="poc").select("user_id", "poc", "kind", "start", "stop")
