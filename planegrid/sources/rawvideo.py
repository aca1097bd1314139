"""Raw 4:2:0 video files: frames of a fixed size, luma then the two chroma planes, scanned and written as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.plans.registry import query
from planegrid.sources.tables import table


def frame_bytes(width: int, height: int, sample_bytes: int = 1) -> int:
    return sample_bytes * width * height * 3 // 2


def planes(files: DataFrame, width: int, height: int, seek: int = 0, frames: int | None = None) -> DataFrame:
    """(path, content) to (path, frame, plane, data) of 8-bit frames; a rest of less than a frame is left out (files.read_frames, which reads files, raises).

    The planes start at 0, 4/6 and 5/6 of a frame. ``seek`` and ``frames`` give a range, whose first frame is 0.
    """
    size, luma = frame_bytes(width, height), width * height
    n = F.floor(F.octet_length("content") / size).cast("int")
    last = n - 1 if frames is None else F.least(n - 1, F.lit(seek + frames - 1))
    own = files.where(n > seek).select("path", "content", F.explode(F.sequence(F.lit(seek), last)).alias("f"))
    parts = [(0, 0, luma), (1, luma, luma // 4), (2, luma + luma // 4, luma // 4)]
    plane = F.explode(F.array(*[F.struct(F.lit(p).alias("plane"), F.substr("content", F.col("f") * size + offset + 1, F.lit(length)).alias("data")) for p, offset, length in parts]))
    return own.select("path", (F.col("f") - seek).alias("frame"), plane.alias("p")).select("path", "frame", "p.plane", "p.data")


def written(own: DataFrame) -> DataFrame:
    """(path, frame, plane, data) back to (path, content)."""
    ordered = F.array_sort(F.collect_list(F.struct("frame", "plane", F.hex("data").alias("data"))))
    return own.groupBy("path").agg(F.unhex(F.array_join(F.transform(ordered, lambda r: r["data"]), "")).alias("content"))


def bytes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))


@query(
    "raw_planes",
    """WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), f AS (SELECT doc_id, h, unnest(range(0, length(h) // 192)) AS f FROM d), p(plane, o, n) AS (VALUES (0, 0, 64), (1, 64, 16), (2, 80, 16))
SELECT doc_id AS path, f::INT AS frame, plane, lower(substr(h, (f * 192 + 2 * o + 1)::BIGINT, 2 * n)) AS data FROM f, p""",
)
def raw_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as 8x8 4:2:0 frames of 96 bytes."""
    return planes(bytes_of(spark, sf_dir), 8, 8).select("path", "frame", "plane", F.lower(F.hex("data")).alias("data"))


@query("raw_write", "SELECT doc_id AS path, md5(unhex(substr(hex(encode(text)), 1, strlen(text) // 96 * 192))) AS digest FROM documents WHERE strlen(text) >= 96")
def raw_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames written back as one file each."""
    return written(planes(bytes_of(spark, sf_dir), 8, 8)).select("path", F.md5("content").alias("digest"))


@query("raw_seek", "WITH d AS (SELECT doc_id, strlen(text) // 96 AS n FROM documents) SELECT doc_id AS path, least(5, n - 2)::BIGINT AS frames FROM d WHERE n > 2")
def raw_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five frames from the third on, or what there is."""
    own = planes(bytes_of(spark, sf_dir), 8, 8, seek=2, frames=5).where("plane = 0")
    return own.groupBy("path").agg(F.count(F.lit(1)).alias("frames"))


def split_blocks(data: Column) -> Column:
    """The samples of a plane."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("int"))


@query(
    "chroma_means",
    """WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), f AS (SELECT doc_id, h, unnest(range(0, length(h) // 192)) AS f FROM d), s AS (SELECT doc_id, f, ('0x' || substr(h, (f * 192 + 2 * i + 1)::BIGINT, 2))::INT AS v FROM f, range(64, 80) r(i)) SELECT doc_id AS path, f::INT AS frame, avg(v)::DOUBLE AS mean FROM s GROUP BY ALL""",
)
def chroma_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = planes(bytes_of(spark, sf_dir), 8, 8).where("plane = 1")
    total = F.aggregate(split_blocks(F.col("data")), F.lit(0), lambda s, v: s + v)
    return own.select("path", "frame", (total / 16.0).alias("mean"))
