"""Bindings of the driver's tables to frames, planes, blocks and byte streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 luma block per embedding: (block, label, px), px being 64 samples of 0 to 255 in raster order."""
    sample = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 256 + 128).cast("int")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block"), "label", F.transform(F.slice("embedding", 1, 64), sample).alias("px"))


def samples(blocks: DataFrame) -> DataFrame:
    """Blocks to tall samples (block, label, x, y, v)."""
    tall = blocks.select("block", "label", F.posexplode("px").alias("i", "v"))
    return tall.select("block", "label", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "v")


def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block beside the next one: (block, src, ref)."""
    own = blocks(spark, sf_dir)
    nxt = own.select((F.col("block") - 1).alias("block"), F.col("px").alias("ref"))
    return own.select("block", F.col("px").alias("src")).join(nxt, "block")


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16-bit coefficient per line item: (l_orderkey, l_linenumber, x)."""
    x = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")) % 65536 - 32768
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.cast("long").alias("x"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture per hour of events: (frame, n, luma samples 0 to 255 in event order)."""
    own = table(spark, sf_dir, "events")
    return own.select(
        "event_id",
        "user_id",
        F.date_trunc("hour", "ts").alias("hour"),
        "ts",
        F.least(F.lit(255), F.floor(F.col("value") / 2).cast("int")).alias("v"),
        "value",
    )


def zip_with_sum(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    """The sum of f over two arrays' elements in step."""
    return F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda s, x: s + x)
