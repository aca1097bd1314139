"""Queries over files: tables are written as byte streams and raw video, and read again by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.plans.registry import query
from planegrid.sources.annexb import HEXED, packet_bytes, packets, to_binary
from planegrid.sources.files import dumped, files_under, read_frames, read_packets, shaped, write_frames, write_parts, write_streams
from planegrid.sources.rawvideo import bytes_of, planes
from planegrid.sources.scratch import shared_folder, written

#: Byte streams that the documents' packets are dealt to.
STREAMS = 16
#: Folders that files, one or more for each document, are dealt to.
FOLDERS = 256


def stem(path: str) -> Column:
    """A file's name without folders and ending, as a number."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1).cast("long")


@query(
    "stream_ranges",
    f"""WITH {HEXED}, sized AS (SELECT stream_id, seq, h, 3 + length(h) // 2 + (len(string_split(line, ' ')) - 1) AS size FROM hexed JOIN lines USING (stream_id, seq))
SELECT (stream_id % {STREAMS})::BIGINT AS stream, (sum(size + 4) OVER (PARTITION BY stream_id % {STREAMS} ORDER BY stream_id, seq) - size)::BIGINT AS pos, size::INT AS size, (seq % 64)::INT AS nal_type, md5(unhex(h)) AS payload FROM sized""",
)
def stream_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of all documents in sixteen files, found again by ranges of bytes that fall anywhere."""
    folder = shared_folder(spark, "streams")
    part = to_binary(packet_bytes(F.col("nal_type"), F.col("payload")))
    own = packets(spark, sf_dir).select((F.col("stream_id") % STREAMS).alias("stream_id"), F.struct("stream_id", "seq").alias("seq"), part.alias("part"))
    write_streams(own, folder)
    found = read_packets(spark, folder, rangeBytes=100_003, pieceBytes=10_007)
    return found.select(stem("path").alias("stream"), "pos", "size", "nal_type", F.md5("rbsp").alias("payload"))


def _cropped(offset: int, width: int, height: int, crop: tuple[int, int, int, int]) -> str:
    """SQL for the hex digits of a cropped plane of frame f in the text h of frames of 192 bytes."""
    left, right, top, bottom = crop
    lines = [f"substr(h, (f * 384 + {2 * (offset + y * width + left) + 1})::BIGINT, {2 * (width - left - right)})" for y in range(top, height - bottom)]
    return " || ".join(lines)


@query(
    "cropped_video",
    f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= 192), f AS (SELECT doc_id, h, unnest(range(0, length(h) // 384)) AS f FROM d),
p AS (SELECT doc_id, f, 0 AS plane, {_cropped(0, 16, 8, (2, 4, 2, 0))} AS x FROM f UNION ALL SELECT doc_id, f, 1, {_cropped(128, 8, 4, (1, 2, 1, 0))} FROM f UNION ALL SELECT doc_id, f, 2, {_cropped(160, 8, 4, (1, 2, 1, 0))} FROM f)
SELECT doc_id AS video, f::INT AS frame, plane, md5(unhex(x)) AS digest FROM p""",
)
def cropped_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as 16 x 8 frames, cropped to 10 x 6, written as a raw video file each and read by ranges of frames."""
    folder = shared_folder(spark, "video")
    write_frames(shaped(planes(bytes_of(spark, sf_dir), 16, 8), 16, 8, (2, 4, 2, 0)), folder, folders=FOLDERS)
    found = read_frames(spark, folder, 10, 6, framesPerPartition=700)
    return found.select(stem("path").alias("video"), "frame", "plane", F.md5("data").alias("digest"))


#: Where the digest of a stream is looked for, first to last. {0} is its path without the ending, {1} the whole path, {2} the
#: path without the ending and its last two characters, {3} its folder, {4} that folder's own name.
DIGEST_NAMES = ("{0}.yuv.md5", "{0}_yuv.md5", "{0}_3.yuv.md5", "{1}.yuv.md5", "{0}.md5", "{0}_md5.txt", "{0}_md5sum.txt", "{2}_yuv.md5", "{3}/{4}_yuv.md5", "{3}/md5sum.txt")


def listed_streams(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Streams (.bit, .bin) anywhere under a folder: path, digest (the first of DIGEST_NAMES that is there, or null), pattern (its place among them) and excluded.

    Files are listed by tasks, not read. Each stream asks for its names, and names meet the listing by an equi-join; a stream whose path
    holds one of the strings ``excluded`` is told.
    """
    files = files_under(spark, folder).select("path")
    own = files.where(F.col("path").rlike(r"\.(bit|bin)$"))
    base, parent = F.regexp_extract("path", r"^(.*)\.\w+$", 1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    given = (base, F.col("path"), F.left(base, F.length(base) - 2), parent, F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))

    def name(pattern: str) -> Column:
        parts = []
        for piece in pattern.replace("{", "|{").replace("}", "|").split("|"):
            parts.append(given[int(piece[1:])] if piece.startswith("{") else F.lit(piece))
        return F.concat(*parts)

    asked = own.select("path", F.posexplode(F.array(*map(name, DIGEST_NAMES))).alias("pattern", "digest"))
    found = asked.join(files.withColumnRenamed("path", "digest"), "digest").groupBy("path").agg(F.min(F.struct("pattern", "digest")).alias("d"))
    out = F.lit(False)
    for part in excluded:
        out = out | F.col("path").contains(part)
    return own.join(found, "path", "left").select("path", "d.digest", "d.pattern", out.alias("excluded"))


#: Digest names of the query's streams f<n>/str<n>.bit, by pattern.
_FILES = ("'str' || {0} || '.yuv.md5'", "'str' || {0} || '_yuv.md5'", "'str' || {0} || '_3.yuv.md5'", "'str' || {0} || '.bit.yuv.md5'", "'str' || {0} || '.md5'", "'str' || {0} || '_md5.txt'", "'str' || {0} || '_md5sum.txt'")
_FILES += ("left('str' || {0}, length('str' || {0}) - 2) || '_yuv.md5'", "'f' || {0} || '_yuv.md5'", "'md5sum.txt'")
_FILE = "CASE pattern " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FILES)) + " END"


@query(
    "conformance_listing",
    f"""WITH p AS (SELECT doc_id AS id, doc_id % 12 AS pattern FROM documents WHERE doc_id % 12 < 10 UNION SELECT doc_id, 9 FROM documents WHERE doc_id % 24 IN (2, 11)),
b AS (SELECT id, min(pattern) AS pattern FROM p GROUP BY id)
SELECT 'f' || doc_id || '/str' || doc_id || '.bit' AS stream, 'f' || id || '/' || {_FILE.format('id')} AS digest, b.pattern::INT AS pattern, contains('f' || doc_id || '/str' || doc_id || '.bit', '7/s') AS excluded FROM documents LEFT JOIN b ON id = doc_id""",
)
def conformance_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a stream per document and its digest under one of ten names, under two, or none, listed and paired; a few streams are excluded."""
    folder = shared_folder(spark, "conformance")
    own = bytes_of(spark, sf_dir).select(F.col("path").cast("string").alias("id"), F.col("path").alias("n"))
    patterns = F.array_distinct(F.array_compact(F.array(F.when(F.col("n") % 12 < 10, F.col("n") % 12), F.when((F.col("n") % 24).isin(2, 11), 9))))
    digests = own.select("id", "n", F.explode(patterns).alias("pattern")).select("id", "n", F.expr(_FILE.format("id")).alias("file"))
    streams = own.select("id", "n", F.expr("'str' || id || '.bit'").alias("file"))
    place = F.concat((F.col("n") % FOLDERS).cast("string"), F.lit("/f"), "id", F.lit("/"), "file")
    rows = streams.unionByName(digests).select(place.alias("name"), F.encode("id", "UTF-8").alias("content"))
    write_parts(rows, folder, [])
    found = listed_streams(spark, folder, ("7/s",))
    short = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+)$", 1)
    return found.select(short("path").alias("stream"), F.when(F.col("digest").isNotNull(), short("digest")).alias("digest"), F.col("pattern").cast("int").alias("pattern"), "excluded")


def _line(stride: int, i: int) -> str:
    """SQL for the hex digits of line i of a field's plane d."""
    return f"substr(d, {2 * stride * i + 1}, {2 * stride})"


def _woven(plane: int, stride: int, lines: int) -> str:
    """SQL for a frame's plane made of two fields' t and b, either of which may be missing."""
    blank = "'" + "00" * stride + "'"
    parts = [f"coalesce({_line(stride, i).replace('d,', side + ',', 1)}, {blank})" for i in range(lines) for side in ("t", "b")]
    return f"SELECT id, frame, {plane} AS plane, {' || '.join(parts)} AS x FROM w WHERE plane = {plane}"


@query(
    "dumped_frames",
    f"""WITH h AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= 48), p AS (SELECT id, f AS picture, plane, substr(h, (96 * f + o)::BIGINT, n) AS d FROM (SELECT id, h, unnest(range(0, length(h) // 96)) AS f FROM h), (VALUES (0, 1, 64), (1, 65, 16), (2, 81, 16)) k(plane, o, n) WHERE f % 5 <> 3),
w AS (SELECT id, picture // 2 AS frame, plane, max(CASE WHEN picture % 2 = 0 THEN d END) AS t, max(CASE WHEN picture % 2 = 1 THEN d END) AS b FROM p WHERE id % 2 = 0 GROUP BY ALL),
a AS ({_woven(0, 8, 4)} UNION ALL {_woven(1, 4, 2)} UNION ALL {_woven(2, 4, 2)} UNION ALL SELECT id, picture, plane, d FROM p WHERE id % 2 = 1)
SELECT id AS video, frame::INT AS frame, plane, md5(unhex(x)) AS digest FROM a""",
)
def dumped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pictures of 8 x 4, a fifth of them not reconstructed: those of even documents are fields in turn, put together line by line; all are dumped to files and read again."""
    own = planes(bytes_of(spark, sf_dir), 8, 4).withColumnRenamed("frame", "picture")
    fields = F.when(F.col("path") % 2 == 0, 1 + F.col("picture") % 2).otherwise(0)
    pictures = own.withColumns({"reconstructed": F.col("picture") % 5 != 3, "field": fields.cast("int"), "stride": F.when(F.col("plane") == 0, 8).otherwise(4)})
    folder = shared_folder(spark, "dump")
    found = written(dumped(pictures), "frames")
    for name, odd, height in (("fields", 0, 8), ("frames", 1, 4)):
        write_frames(found.where(F.col("path").cast("long") % 2 == odd), f"{folder}/{name}", folders=FOLDERS)
        back = read_frames(spark, f"{folder}/{name}", 8, height, framesPerPartition=500)
        # Spark takes the planes read for as small as the list of files and would broadcast them, so the join is by sorting
        # files number their frames from 0; those that nothing was reconstructed of are not in them
        names = found.where(F.col("path").cast("long") % 2 == odd).where("plane = 0").select(F.col("path").cast("long").alias("video"), "frame")
        places = names.withColumn("place", F.row_number().over(Window.partitionBy("video").orderBy("frame")) - 1)
        back = back.select(stem("path").alias("video"), F.col("frame").alias("place"), "plane", F.md5("data").alias("digest")).join(places.hint("merge"), ["video", "place"])
        told = back.select("video", "frame", "plane", "digest")
        out = told if odd == 0 else out.unionByName(told)
    return out
