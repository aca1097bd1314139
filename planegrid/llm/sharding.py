"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws one exponential number per child, scaled by the child's weight, and
descends into the smallest (weighted rendezvous). A child's draw depends on the key and the child
only, so a changed weight moves rows only into or out of that child's subtree; rows whose region
and rack keep their weights keep their shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, number_within, uniform


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def base_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards filled into racks of ``per_rack``, racks into regions of ``racks``."""
    return [Leaf(i // (per_rack * racks), i // per_rack, i) for i in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard in a region of its own, so that rows move only into that shard."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, max(x.shard for x in tree) + 1, weight)]


def _children(tree: list[Leaf]) -> list[dict[int, dict[int, float]]]:
    """For each level: parent to {child: weight}; children of no weight take no rows and are left out."""
    levels: list[dict[int, dict[int, float]]] = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for x in tree:
        if x.weight > 0:
            for level, (parent, child) in zip(levels, ((0, x.region), (x.region, x.rack), (x.rack, x.shard))):
                level[parent][child] += x.weight
    return levels


def _draw(key: list[Column], salt: str, depth: int) -> Callable[[Column], Column]:
    """A child's exponential draw over its weight; the smallest one wins."""
    return lambda c: F.struct((-F.log(uniform(*key, F.lit(salt), F.lit(depth), c["id"])) / c["w"]).alias("s"), c["id"].alias("id"))


def shard_of(key: list[Column], tree: list[Leaf], salt: str = "planegrid") -> Column:
    """The shard of a key under ``tree``. Null keys are a key like any other."""
    at = F.lit(0)
    for depth, level in enumerate(_children(tree)):
        table = F.create_map(
            *[
                x
                for parent, kids in sorted(level.items())
                for x in (F.lit(parent), F.array(*[F.struct(F.lit(k).alias("id"), F.lit(w).alias("w")) for k, w in sorted(kids.items())]))
            ]
        )

        at = F.array_min(F.transform(F.element_at(table, at), _draw(key, salt, depth)))["id"]
    return at


def shard(df: DataFrame, key: list[str], tree: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with the column ``out``; a column of that name is replaced, others stay.

    Null keys and repeated rows go where their key goes; an empty table stays empty.
    """
    return df.withColumn(out, shard_of([F.col(k) for k in key], tree).cast("int"))


def op7_hash_tree(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``key``; grown_shard is the shard with one more."""
    tree = base_tree(shards)
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shard(shard(rows, ["doc_id"], tree), ["doc_id"], grown(tree), "grown_shard")
    numbered = number_within(placed, ["shard"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
