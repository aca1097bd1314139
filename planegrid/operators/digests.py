"""Picture digests: MD5, CRC-16 and the position-masked checksum."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planegrid.plans.registry import BLOCKS, SAMPLES, query
from planegrid.sources.tables import blocks


def checksum(px: Column, width: int) -> Column:
    """The sum of samples XOR a mask of their place, modulo 2^32; samples of 8 bits in raster order."""

    def masked(v: Column, i: Column) -> Column:
        x, y = i % width, F.floor(i / width).cast("int")
        mask = x.bitwiseXOR(y).bitwiseXOR(F.shiftright(x, 8)).bitwiseXOR(F.shiftright(y, 8)).bitwiseAND(F.lit(255))
        return v.bitwiseAND(F.lit(255)).bitwiseXOR(mask).cast("long")

    return F.pmod(F.aggregate(F.transform(px, masked), F.lit(0).cast("long"), lambda a, v: a + v), F.lit(1 << 32))


def sample_bytes(px: Column) -> Column:
    """8-bit samples as a binary."""
    return F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


@query("plane_checksum", f"WITH {SAMPLES} SELECT block, (sum(xor(v & 255, xor(x, y))) % 4294967296)::BIGINT AS checksum FROM samples GROUP BY block")
def plane_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("block", checksum(F.col("px"), 8).alias("checksum"))


@query("plane_md5", f"WITH {BLOCKS} SELECT block, md5(unhex(list_aggregate(list_transform(px, lambda v: printf('%02X', v)), 'string_agg', ''))) AS digest FROM blocks")
def plane_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("block", F.md5(sample_bytes(F.col("px"))).alias("digest"))


@F.pandas_udf(T.LongType())
def crc16(data: pd.Series) -> pd.Series:
    """CRC-16 of polynomial 0x1021 from 0xFFFF, with 16 zero bits behind the data."""
    import binascii

    # crc_hqx shifts the data in from the top, which is what the flush bits do for a register that shifts them in below
    return data.map(lambda b: None if b is None else binascii.crc_hqx(bytes(b), _CRC_START))


#: The register after its 16 ones have moved out at the top.
_CRC_START = 0x1D0F


@query(
    "plane_crc",
    f"""WITH {BLOCKS}, bits AS (SELECT block, list_concat(flatten(list_transform(px, lambda v: list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda s: (v >> s) & 1))), list_transform(range(0, 16), lambda z: 0)) AS bits FROM blocks)
SELECT block, list_reduce(list_concat([65535], bits), lambda c, b: xor(((c << 1) & 65535) | b, CASE WHEN (c & 32768) > 0 THEN 4129 ELSE 0 END))::BIGINT AS crc FROM bits""",
)
def plane_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("block", crc16(sample_bytes(F.col("px"))).alias("crc"))


@query("file_digests", "SELECT doc_id, substr(md5(text), 1, 8) AS prefix, md5(text) AS digest FROM documents")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's digest and its first four bytes."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring(F.md5("text"), 1, 8).alias("prefix"), F.md5("text").alias("digest"))


@query("grouped_hex", "SELECT doc_id, regexp_replace(upper(md5(text)), '(.{8})(.{8})(.{8})(.{8})', '\\1-\\2-\\3-\\4') AS grouped FROM documents")
def grouped_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.upper(F.md5("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws("-", *[F.substring(digest, 1 + 8 * i, 8) for i in range(4)]).alias("grouped"))


@query(
    "expected_digests",
    """WITH lines AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# ' || md5(text) WHEN doc_id % 3 = 1 THEN 'MD5 (stream.yuv) = ' || upper(md5(text)) ELSE md5(text) || '  stream.yuv' END AS line FROM documents)
SELECT doc_id, lower(regexp_extract(line, '([0-9a-fA-F]{32})', 1)) AS expected FROM lines WHERE NOT starts_with(line, '#')""",
)
def expected_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest files in either notation, comments skipped, case folded."""
    k, d = F.col("doc_id") % 3, F.md5("text")
    line = F.when(k == 0, F.concat(F.lit("# "), d)).when(k == 1, F.concat(F.lit("MD5 (stream.yuv) = "), F.upper(d))).otherwise(F.concat(d, F.lit("  stream.yuv")))
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", line.alias("line"))
    return parse_digests(lines)


def parse_digests(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("line").startswith("#")).select("doc_id", F.lower(F.regexp_extract("line", "([0-9a-fA-F]{32})", 1)).alias("expected"))


def ordered_md5(parts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, content and the columns of ``order``) to (key, digest, size): the MD5 of each key's contents, one behind the other.

    Parts are dealt by key and sorted in their partition; a task folds them as they come, so a key's bytes are in no row
    or group. Null contents are no bytes; keys without rows have no digest.
    """
    own = parts.select(F.col(key).alias(key), F.col("content").cast("binary").alias("content"), *[c for c in order if c != key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        at, fold, size = None, None, 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([at, pa.array([fold.hexdigest()]), pa.array([size], pa.int64())], [key, "digest", "size"])

        for b in batches:
            for i in range(len(b)):
                if at is None or b.column(0)[i] != at[0]:
                    if at is not None:
                        yield told()
                    at, fold, size = b.column(0).slice(i, 1), hashlib.md5(usedforsecurity=False), 0
                data = b.column(1)[i].as_py() or b""
                fold.update(data)
                size += len(data)
        if at is not None:
            yield told()

    dealt = own.repartition(key).sortWithinPartitions(key, *order).select(key, "content")
    return dealt.mapInArrow(run, f"{key} {dealt.schema[key].dataType.simpleString()}, digest string, size bigint")


_WIDE = f"""WITH {BLOCKS}, wide AS (SELECT block, label, list_transform(px, lambda v: (v << 2) | (v & 3)) AS v FROM blocks),
narrow AS (SELECT block, label, list_transform(v || v[1:16] || v[49:64], lambda x: least(255, (x + 4) >> 2)) AS n FROM wide),
hexed AS (SELECT block, label, list_reduce(list_transform(n, lambda x: lpad(lower(to_hex(x)), 2, '0')), lambda a, b: a || b) AS h FROM narrow)"""


@query("output_bytes_md5", _WIDE + " SELECT label, md5(unhex(string_agg(h, '' ORDER BY block DESC))) AS digest, (96 * count(*))::BIGINT AS size FROM hexed GROUP BY label")
def output_bytes_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MD5 over the bytes of all that a stream (a label) puts out: 10-bit pictures of 8 x 8 in output order, the last block first, as 8-bit samples."""
    from planegrid.sources.files import shaped

    wide = F.transform("px", lambda v: F.shiftleft(v, 2).bitwiseOR(v.bitwiseAND(F.lit(3))))
    pair = lambda v: F.concat(F.lpad(F.hex(v.bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(F.shiftright(v, 8)), 2, "0"))
    coded = lambda c: F.unhex(F.array_join(F.transform(c, pair), ""))
    own = blocks(spark, sf_dir).select("block", "label", wide.alias("v"))
    planes = F.array(F.col("v"), F.slice("v", 1, 16), F.slice("v", 49, 16))
    rows = own.select("block", "label", F.posexplode(planes).alias("plane", "v")).select("label", (-F.col("block")).alias("picture"), "plane", coded(F.col("v")).alias("data"))
    narrow = shaped(rows, 8, 8, bit_depth=10)
    return ordered_md5(narrow.withColumnRenamed("data", "content"), "label", ["picture", "plane"])
