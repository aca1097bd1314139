"""Release of pictures in the order of their dependencies, for any graph of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.operators.references import _EDGES, dockets, edges, stream
from planegrid.plans.registry import query
from planegrid.sources.scratch import written


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "release")


def released(nodes: DataFrame, needs: DataFrame, keys: list[str], node: str = "node", need: str = "need") -> DataFrame:
    """(keys, node) and (keys, node, need) to (keys, node, level, state).

    A node without needs has level 0, another one a level above the highest that it needs: all of a level can go at once.
    state is "released"; "missing" where something that it needs, itself or through others, is not there; "cycle" where it
    needs itself through others, or stands between two such cycles; "behind" where it needs a cycle and none needs it. Levels of the latter three are null.

    Each round releases the nodes that wait for nothing more and strikes their edges off, so edges are joined once a round
    while they are left, and rounds are as many as levels. Cycles are what is left when nodes that nothing left needs are struck off.
    """
    there = nodes.select(*keys, F.col(node).alias("node")).distinct()
    own = needs.select(*keys, F.col(node).alias("node"), F.col(need).alias("need")).distinct().join(there, [*keys, "node"], "left_semi")
    wanted = there.withColumnRenamed("node", "need")
    left = _kept(own)
    lost = left.join(wanted, [*keys, "need"], "left_anti").select(*keys, "node").distinct()
    now, done, level = there.join(left.select(*keys, "node"), [*keys, "node"], "left_anti"), None, 0
    while True:
        now = _kept(now.withColumn("level", F.lit(level)))
        if now.isEmpty():
            break
        done = now if done is None else done.unionByName(now)
        gone = now.select(*keys, F.col("node").alias("need"))
        struck = left.join(gone, [*keys, "need"], "left_semi").select(*keys, "node").distinct()
        left = _kept(left.join(gone, [*keys, "need"], "left_anti"))
        now, level = struck.join(left.select(*keys, "node"), [*keys, "node"], "left_anti"), level + 1
    waiting = there if done is None else _kept(there.join(done, [*keys, "node"], "left_anti"))
    state = lambda df, name: df.select(*keys, "node", F.lit(None).cast("int").alias("level"), F.lit(name).alias("state"))
    found = state(waiting.limit(0), "") if done is None else done.select(*keys, "node", "level", F.lit("released").alias("state"))
    if waiting.isEmpty():
        return found
    # what is missing spreads along the edges that are left
    bad = _kept(lost)
    edge = bad
    while not edge.isEmpty():
        further = left.join(edge.select(*keys, F.col("node").alias("need")), [*keys, "need"], "left_semi").select(*keys, "node").distinct()
        edge = _kept(further.join(bad, [*keys, "node"], "left_anti"))
        bad = _kept(bad.unionByName(edge))
    rest = _kept(waiting.join(bad, [*keys, "node"], "left_anti"))
    ring = _kept(left.join(rest, [*keys, "node"], "left_semi").join(rest.withColumnRenamed("node", "need"), [*keys, "need"], "left_semi"))
    # a node that no node of the ring needs is only behind it
    while True:
        needed = ring.select(*keys, F.col("need").alias("node")).distinct()
        inner = _kept(ring.join(needed, [*keys, "node"], "left_semi"))
        if inner.count() == ring.count():
            break
        ring = inner
    rings = ring.select(*keys, "node").distinct()
    behind = rest.join(rings, [*keys, "node"], "left_anti")
    return found.unionByName(state(bad, "missing")).unionByName(state(rings, "cycle")).unionByName(state(behind, "behind"))


#: Coded pictures between two refreshes of the query.
PERIOD = 32


@query(
    "release_order",
    f"""WITH RECURSIVE {_EDGES}, k AS MATERIALIZED (SELECT user_id, coded // {PERIOD} AS period, poc, event_id FROM dockets WHERE event_id % 97 <> 5),
raw AS (SELECT d.user_id, d.coded // {PERIOD} AS period, e.poc AS node, e.ref AS need, r.coded // {PERIOD} AS other FROM edges e JOIN dockets d ON d.user_id = e.user_id AND d.poc = e.poc LEFT JOIN dockets r ON r.user_id = e.user_id AND r.poc = e.ref),
n AS MATERIALIZED (SELECT DISTINCT user_id, period, node, need FROM raw SEMI JOIN k ON k.user_id = raw.user_id AND k.poc = raw.node WHERE period = other UNION SELECT user_id, period, min(poc), max(poc) FROM k WHERE user_id % 10 = 3 GROUP BY ALL HAVING min(poc) < max(poc)),
reach(user_id, period, node, need, hops) AS (SELECT user_id, period, node, need, 1 FROM n UNION SELECT r.user_id, r.period, r.node, n.need, least(r.hops + 1, {PERIOD + 1}) FROM reach r JOIN n ON n.user_id = r.user_id AND n.period = r.period AND n.node = r.need),
s AS (SELECT k.user_id, k.period, k.poc, max(r.hops) AS hops, coalesce(bool_or(r.node = r.need), FALSE) AS own_cycle, coalesce(bool_or(r.need IS NOT NULL AND t.poc IS NULL), FALSE) AS lost FROM k LEFT JOIN reach r ON r.user_id = k.user_id AND r.period = k.period AND r.node = k.poc LEFT JOIN k t ON t.user_id = r.user_id AND t.period = r.period AND t.poc = r.need GROUP BY ALL),
c AS (SELECT r.user_id, r.period, r.node, bool_or(s.own_cycle) AS behind FROM reach r JOIN s ON s.user_id = r.user_id AND s.period = r.period AND s.poc = r.need GROUP BY ALL)
SELECT s.user_id, s.period, s.poc, CASE WHEN NOT lost AND NOT own_cycle AND NOT coalesce(behind, FALSE) THEN coalesce(hops, 0) END::INT AS level, CASE WHEN lost THEN 'missing' WHEN own_cycle THEN 'cycle' WHEN behind THEN 'behind' ELSE 'released' END AS state FROM s LEFT JOIN c ON c.user_id = s.user_id AND c.period = s.period AND c.node = s.poc""",
)
def release_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels at which pictures can be coded, inside periods of 32: a few pictures are lost, and for some users a period's first picture needs its last."""
    own = dockets(stream(spark, sf_dir))
    period = F.expr(f"coded div {PERIOD}")
    place = own.select("user_id", "poc", period.alias("period"))
    kept = own.where("event_id % 97 <> 5").select("user_id", period.alias("period"), "poc")
    refs = edges(own).select("user_id", F.col("poc").alias("node"), F.col("ref").alias("need"), period.alias("period"))
    inside = refs.join(place.select("user_id", F.col("poc").alias("need"), F.col("period").alias("other")), ["user_id", "need"]).where("period = other").drop("other")
    ring = kept.where("user_id % 10 = 3").groupBy("user_id", "period").agg(F.min("poc").alias("node"), F.max("poc").alias("need")).where("node < need")
    needs = inside.select("user_id", "period", "node", "need").unionByName(ring)
    found = released(kept.withColumnRenamed("poc", "node"), needs, ["user_id", "period"])
    return found.withColumnRenamed("node", "poc")
