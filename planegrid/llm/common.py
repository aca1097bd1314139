"""Helpers the training-data operators share: inputs, lineage cuts, gapless numbering, hash draws."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The word of the corpus contracts, as a Java and DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _ready(spark: SparkSession) -> None:
    """Name the checkpoint folder, and let Spark's cleaner drop the shuffle files of earlier cuts.

    The cleaner works when the driver's garbage is collected, by default every half hour; what a
    cut has written needs no shuffle files, so they are released before the next one adds its own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/planegrid")
    gc.collect()
    sc._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that spark.checkpoint.dir names.

    Only a session without that setting (a test) gets a folder of its own.
    """
    _ready(df.sparkSession)
    return df.checkpoint()


def uniform(*key: Column) -> Column:
    """A draw in (0, 1) that depends on the key alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def row_name(*columns: str) -> Column:
    """A 128-bit name of a row's values in these columns; nulls and lengths are part of it."""
    parts = [x for c in columns for x in (F.coalesce(F.char_length(F.col(c).cast("string")), F.lit(-1)).cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return F.md5(F.concat_ws("\u0001", *parts))


#: Rows of a few numbers that a partition of a small table holds.
ROWS = 50_000


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about so many rows, in no more partitions than they need.

    A table that is cut keeps its partitions, and each is a task of every step that reads it, which the driver
    starts and remembers. A partition still has ``ROWS`` rows at most, so no task gets a large table.
    """
    return df.coalesce(max(1, -(-rows // ROWS)))


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", most: int = 1000, small: bool = False) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row per ``key`` and in n how many of ``rows`` hold it.

    A key of over one in ``most`` of these rows is joined by broadcast, the others by Spark's choice, so no
    task gets all rows of a frequent key; at most ``most`` keys are broadcast. Where all keys are frequent, or none
    is, there is one join only, and no look at the table where it is known to be ``small``. ``how`` is inner or left.
    Both are evaluated twice, so they must be cut.
    """
    if small:
        return rows.join(F.broadcast(table.drop("n")), key, how)
    total, high, low = table.agg(F.sum("n"), F.max("n"), F.min("n")).first()
    if not total or high * most <= total:
        return rows.join(table.drop("n"), key, how)
    if low * most > total:
        return rows.join(F.broadcast(table.drop("n")), key, how)
    often, rare = (table.where(c).drop("n") for c in (F.col("n") * most > total, F.col("n") * most <= total))
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rare, key, how)
    return rows.join(F.broadcast(often), key).unionByName(rest)


#: Rows of a small table.
FEW = 10_000


def few(table: DataFrame, most: int = FEW) -> int | None:
    """How many rows a table has, which is cut, or None if they are more than ``most``."""
    n = table.limit(most + 1).count()
    return n if n <= most else None


def is_small(table: DataFrame, most: int = FEW) -> bool:
    """Whether a table, which is cut, has at most ``most`` rows."""
    return few(table, most) is not None


def checked_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", small: bool | None = None) -> DataFrame:
    """``rows`` joined with a table that is cut: by broadcast if it is small, which is found out if not told, else by Spark's choice."""
    if small is None:
        small = is_small(table)
    return rows.join(F.broadcast(table) if small else table, key, how)


def ranges(spark: SparkSession) -> int:
    """Hash ranges that packed hashes are dealt into: a few per shuffle partition, however large the input."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows alike that are numbered together before they are dealt out one by one.
ALIKE = 1 << 16


def number_within(df: DataFrame, groups: list[str], name: str) -> DataFrame:
    """Add ``name``: a number from 0 without gaps inside each group, in no task a whole group.

    Rows alike in all columns are one with a count until they have numbers. The rows of a group are
    dealt into buckets by their hash, some per shuffle partition; each bucket numbers its own rows and starts
    where the buckets before it end. The table of starts has at most groups x buckets rows.
    """
    buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = cut(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__m")))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*[x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(dealt.groupBy(*groups, "__bucket").agg(F.sum("__m").alias("__n")))
    starts = sums.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*groups, "__bucket").orderBy(*df.columns).rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.join(starts, [*groups, "__bucket"]).withColumn("__first", F.col("__start") + F.coalesce(F.sum("__m").over(inside), F.lit(0)))
    some = first.withColumn("__from", F.explode(F.sequence(F.lit(0), F.col("__m") - 1, F.lit(ALIKE))))
    each = some.withColumn("__i", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + ALIKE, F.col("__m")) - 1)))
    return each.withColumn(name, F.col("__first") + F.col("__i")).select(*df.columns, name)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the checkpoint folder, until discard()."""
    spark = df.sparkSession
    _ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove saved() tables; all that is made of them must be cut or saved by now."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
