"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a share of the whole mix, so each of its documents is wanted ``target /
source_size`` times, a whole number of copies plus one fraction. Fractions become whole by
pivotal rounding in blocks of about ``BLOCK`` documents: the largest document meets the pool of the
smaller ones, and words move from one to the other, in either direction by chance, until
the document's fraction is 0 or 1 (or the pool's are). The words of the block stay the same, and so do
the expected copies of each document. A block leaves one fractional document at most; those form the next
level's blocks, until one is left per source, which takes the nearer whole number. What a source then misses, half
of that document's words at most, the document whose size is nearest to it gives or takes back, up to ``AMENDS``
times; the state nearest to the target stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, uniform

#: Fractional documents that a block holds on average; a reduction level shrinks by this factor.
BLOCK = 64

#: Sources whose rows are joined by broadcast at most.
FEW = 10_000

#: Documents of a source that are taken or given back after the reduction.
AMENDS = 2

_EPS = 1e-9

#: A unit's name: 128 bits, so that no two units share one.
UID = "struct<a:bigint,b:bigint>"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """(source, source_size) to the target of each source.

    Sources in code point order, null last, take ``weights`` in turn and share ``total_share`` of all
    sizes; a target stops at ``most`` times its source's size and the excess is shared again by weight.
    The level that this ends at is found in one pass: in the order of cap / weight the capped sources
    come first, and the level is what they leave over the weight that remains.
    One row per source is all that these windows see.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    own = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    own = own.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) * total_share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    own = own.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    own = own.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return own.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap"))).select("source", "source_size", "target")


def _meet(s: Column, unit: Column, level: int, seed: int) -> Column:
    """One pivotal step: the largest unit left meets the pool of the smaller ones in its block.

    The state holds the pool's wanted words (mass) and size, and the map p -> a p + b that the
    transfers so far put on every fraction in the pool. A unit that stays fractional (open) has left
    the pool with fractions 0 or 1 alone.
    """
    size = unit["size"]
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["a"] * unit["p"] + s["b"]))
    mass = F.greatest(F.lit(0.0), s["mass"] - p * size)
    room = F.greatest(F.lit(0.0), s["size"] - size - mass)
    up, down = F.least((1 - p) * size, mass), F.least(p * size, room)
    gain = uniform(unit["uid"], F.lit(level), F.lit(seed)) * (up + down) < down
    kept = F.when(gain, F.when(mass > 0, 1 - up / mass).otherwise(1.0)).otherwise(F.when(room > 0, 1 - down / room).otherwise(1.0))
    after = F.when(gain, p + up / size).otherwise(p - down / size)
    whole = F.least(F.abs(after), F.abs(1 - after)) < _EPS
    stays = s["open"].isNull() & ~whole
    done = F.array(F.struct(unit["uid"].alias("uid"), F.round(after).cast("int").alias("extra")))
    left = F.struct(unit["uid"].alias("uid"), size.alias("size"), after.alias("p"))
    return F.struct(
        F.when(gain, mass - up).otherwise(mass + down).alias("mass"),
        (s["size"] - size).alias("size"),
        (kept * s["a"]).alias("a"),
        (kept * s["b"] + F.when(gain, 0.0).otherwise(1 - kept)).alias("b"),
        F.when(stays, left).otherwise(s["open"]).alias("open"),
        F.when(stays, s["done"]).otherwise(F.concat(s["done"], done)).alias("done"),
    )


def _fold(units: DataFrame, level: int, seed: int) -> DataFrame:
    """Blocks of (source, block, uid, size, p) to (source, open, done)."""
    unit = F.struct("size", "uid", "p")
    blocks = units.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(unit), asc=False).alias("units"),
        F.sum(F.col("size") * F.col("p")).alias("mass"),
        F.sum("size").alias("total"),
    )
    start = F.struct(
        F.col("mass"),
        F.col("total").alias("size"),
        F.lit(1.0).alias("a"),
        F.lit(0.0).alias("b"),
        F.lit(None).cast(f"struct<uid:{UID},size:double,p:double>").alias("open"),
        F.array().cast(f"array<struct<uid:{UID},extra:int>>").alias("done"),
    )
    return blocks.select("source", F.aggregate("units", start, lambda s, x: _meet(s, x, level, seed)).alias("r")).select("source", "r.open", "r.done")


def _join(rows: DataFrame, table: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with a row per source; by broadcast if the sources are few."""
    return rows.join(F.broadcast(table) if few else table, "__s", how)


def pivotal_extras(units: DataFrame, few: bool, seed: int = 0, block: int = BLOCK, amends: int = AMENDS) -> DataFrame:
    """(source, uid, size > 0, p in (0, 1)) to (uid, extra 0 or 1), words of a source kept.

    ``uid`` tells units apart. Blocks are dealt by its hash, so their sizes keep near ``block``.
    """
    done, level, all_ = None, 0, units
    while True:
        per_source = units.groupBy(_named("source").alias("__s")).agg(F.count(F.lit(1)).alias("n"))
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
        dealt = _join(units.withColumn("__s", _named("source")), per_source, few).drop("__s")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level), F.lit(seed)), blocks))
        folded = cut(_fold(dealt, level, seed))
        new = folded.select(F.explode("done").alias("d")).select("d.*")
        done = new if done is None else done.unionByName(new)
        units, level = folded.where("open IS NOT NULL").select("source", "open.*"), level + 1
        left = units.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if not left or left == 1:
            done = done.unionByName(units.select("uid", F.round("p").cast("int").alias("extra")))
            return _amended(all_, done, few, amends) if amends else done


def _named(c: str) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def _amended(units: DataFrame, extras: DataFrame, few: bool, amends: int) -> DataFrame:
    """(uid, extra) with up to ``amends`` units of each source turned, one after the other that whose size is nearest to what the source misses then.

    The first one leads beyond the target, from where those of the other direction come nearer than it was; of all
    states that a source goes through the nearest one stays.
    """
    own = cut(units.select(_named("source").alias("__s"), "uid", "size", "p").join(extras, "uid").withColumn("turn", F.lit(None).cast("int")))
    now = F.when(F.col("turn").isNull(), F.col("extra")).otherwise(1 - F.col("extra"))
    step = F.when(F.col("extra") == 0, F.col("size")).otherwise(-F.col("size"))
    states = None
    for i in range(amends + 1):
        missed = cut(own.groupBy("__s").agg(F.sum((F.col("p") - now) * F.col("size")).alias("missed")))
        state = missed.select("__s", F.struct(F.round(F.abs("missed"), 6).alias("off"), F.lit(i).alias("turns")).alias("b"))
        states = state if states is None else states.unionByName(state)
        if i == amends:
            break
        # the first turn leads beyond the target if one can: on that side all others may follow
        short = (F.col("missed") * step > 0) & (F.abs(step) >= F.abs("missed")) if i == 0 else F.lit(True)
        near = F.min(F.struct((~short).alias("short"), F.abs(F.col("missed") - step).alias("off"), F.col("uid").alias("uid")))
        turned = _join(own.where("turn IS NULL"), missed.where("abs(missed) >= 0.5"), few).groupBy("__s").agg(near.getField("uid").alias("turned"))
        own = cut(_join(own, turned, few, "left").withColumn("turn", F.when(F.col("uid") == F.col("turned"), i).otherwise(F.col("turn"))).drop("turned"))
    best = states.groupBy("__s").agg(F.min("b").getField("turns").alias("turns"))
    return _join(own, best, few).select("uid", F.when(F.col("turn") < F.col("turns"), 1 - F.col("extra")).otherwise(F.col("extra")).alias("extra"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    total_share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    amends: int = AMENDS,
) -> DataFrame:
    """Copies of each row of (doc_id, source, size, h) so that sources meet their targets.

    Returns those columns with source_size, target and copies. ``h``, of any type, tells texts apart. Rows alike in
    all four are one unit with a count, so no group of repeats is gathered: of m such rows each takes
    the whole copies, floor(m x fraction) of them one more, and one of them meets the others for the
    rest. A null source is a source; a document of size 0 takes the whole copies only. An empty
    table gives an empty result, and reruns give the same one.
    """
    units = docs.select("doc_id", "source", "size", "h").groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("m"))
    own = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.col("size"), F.col("h")]
    units = cut(units.withColumn("uid", F.struct(F.xxhash64(*own, F.lit(seed)).alias("a"), F.xxhash64(F.lit("b"), *own).alias("b"))))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = cut(source_targets(sizes, weights, total_share, most).withColumn("__s", _named("source")).drop("source"))
    few = targets.limit(FEW + 1).count() <= FEW
    units = _join(units.withColumn("__s", _named("source")), targets, few).drop("__s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("base", F.floor(wanted + _EPS).cast("int")).withColumn("more", F.greatest(F.lit(0.0), wanted - F.col("base")) * F.col("m"))
    units = units.withColumn("sure", F.floor(F.col("more") + _EPS).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("more") - F.col("sure")))
    open_units = units.where((F.col("size") > 0) & (F.col("p") > _EPS)).select("source", "uid", F.col("size").cast("double").alias("size"), "p")
    extras = pivotal_extras(open_units, few, seed, amends=amends)
    units = units.join(extras, "uid", "left").withColumn("sure", F.when(F.col("size") > 0, F.col("sure") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)))
    rows = units.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.least(F.col("base") + F.when(F.col("i") <= F.col("sure"), 1).otherwise(0), F.lit(int(most)))
    return rows.select("doc_id", "source", "size", "h", "source_size", "target", copies.cast("int").alias("copies"))


def sized(docs: DataFrame, name: str | None = None) -> DataFrame:
    """doc_id, source, words of the text (null: 0) and h, what tells rows apart: the column ``name``, or the text's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (F.col(name) if name else F.xxhash64("text")).alias("h"))


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; taken is size times copies."""
    mixed = mix(sized(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
