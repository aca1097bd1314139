"""Annex-B byte streams: packets to streams and back, packet classes, access units, parameter sets.

Packets are written as expressions, a packet a row; for these bytes are read as Latin-1 text, a character a
byte. Streams are taken apart over their bytes, a batch of them at a time; files of any size are read by ranges
(files.read_packets).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.plans.registry import query
from planegrid.sources.tables import table

START = "\u0000\u0000\u0000\u0001"


def as_bytes_text(binary: Column) -> Column:
    return F.decode(binary, "ISO-8859-1")


def to_binary(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def protect(payload: Column) -> Column:
    """A byte 3 behind two zero bytes that a byte of 3 or less follows."""
    return F.regexp_replace(payload, "\\x00\\x00(?=[\\x00-\\x03])", "\u0000\u0000\u0003")


def unprotect(payload: Column) -> Column:
    return F.regexp_replace(payload, "\\x00\\x00\\x03", "\u0000\u0000")


def packet_bytes(nal_type: Column, payload: Column) -> Column:
    """A packet behind its start code: a header of two bytes, and the protected payload with the bit that ends it."""
    header = F.concat(F.char(F.shiftleft(nal_type, 1)), F.lit("\u0001"))
    return F.concat(F.lit(START), header, protect(F.concat(as_bytes_text(payload), F.lit("\u0080"))))


def write_stream(packets: DataFrame) -> DataFrame:
    """(stream_id, seq, nal_type, payload) to (stream_id, stream): packets in order behind start codes. A row holds a stream; files.write_streams gathers none."""
    own = packets.select("stream_id", F.struct("seq", packet_bytes(F.col("nal_type"), F.col("payload")).alias("p")).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), "")
    return own.groupBy("stream_id").agg(to_binary(whole).alias("stream"))


START_CODE = b"\0\0\1"
#: Packets of short streams that share a batch, and rows whose records are read together.
TOGETHER = 1000
#: Columns of a packet: where its header is in the stream, its bytes without zeros behind it, the header's fields, the payload.
PACKET = {"pos": "bigint", "size": "int", "nal_type": "int", "layer_id": "int", "tid": "int", "rbsp": "binary"}


def payload_of(packet: bytes) -> bytes:
    """A packet's payload without header, protection, zeros behind it and the byte 128 that ends it."""
    own = packet[2:].replace(b"\0\0\3", b"\0\0").rstrip(b"\0")
    return own[:-1] if own.endswith(b"\x80") else own


def packet_rows(found: list[tuple[int, bytes]]) -> list[pa.Array]:
    """(pos, bytes up to the next start code) of packets to the columns of PACKET."""
    own = [(pos, data.rstrip(b"\0")) for pos, data in found]
    first = [d[0] if d else 0 for _, d in own]
    second = [d[1] if len(d) > 1 else 0 for _, d in own]
    return [
        pa.array([pos for pos, _ in own], pa.int64()),
        pa.array([len(d) for _, d in own], pa.int32()),
        pa.array([a >> 1 & 63 for a in first], pa.int32()),
        pa.array([(a & 1) << 5 | b >> 3 for a, b in zip(first, second)], pa.int32()),
        pa.array([(b & 7) - 1 for b in second], pa.int32()),
        pa.array([payload_of(d) for _, d in own], pa.binary()),
    ]


def taken_apart(stream: bytes) -> list[tuple[int, bytes]]:
    """(pos, bytes up to the next start code) of a stream's packets; what stands before the first code belongs to none."""
    out, at = [], stream.find(START_CODE)
    while at >= 0:
        pos = at + len(START_CODE)
        at = stream.find(START_CODE, pos)
        out.append((pos, stream[pos : at if at >= 0 else len(stream)]))
    return out


def slices(batches: Iterator[pa.RecordBatch], n: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``n`` rows, so that what is made of one stays small however long Spark's are."""
    for b in batches:
        for i in range(0, len(b), n):
            yield b.slice(i, n)


def tokenize(streams: DataFrame) -> DataFrame:
    """(stream_id, stream) to a row per packet: stream_id, seq from 0, and PACKET.

    Start codes have two zero bytes or more before the byte 1; what stands before the first one belongs to no
    packet, nor do zero bytes before a start code or behind the last packet. A null or empty stream has no packets.
    """
    own = streams.select("stream_id", F.col("stream").cast("binary").alias("stream"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, seq, found = [], [], []
            for i in range(len(b)):
                own = taken_apart(b.column(1)[i].as_py() or b"")
                of += [i] * len(own)
                seq += range(len(own))
                found += own
                if len(found) >= TOGETHER or (found and i == len(b) - 1):
                    ids = b.column(0).take(pa.array(of, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(seq, pa.int32()), *packet_rows(found)], ["stream_id", "seq", *PACKET])
                    of, seq, found = [], [], []

    return own.mapInArrow(run, f"stream_id {own.schema['stream_id'].dataType.simpleString()}, seq int, " + ", ".join(f"{n} {t}" for n, t in PACKET.items()))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet per line of a document; blanks become bytes 0 0 2, which need protection."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    payload = F.replace(F.decode(F.encode("line", "UTF-8"), "ISO-8859-1"), F.lit(" "), F.lit("\u0000\u0000\u0002"))
    return lines.select("stream_id", "seq", (F.col("seq") % 64).alias("nal_type"), to_binary(payload).alias("payload"))


_LINES = """lines AS (SELECT doc_id AS stream_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)"""
HEXED = _LINES + """, hexed AS (SELECT stream_id, seq, array_to_string(list_transform(string_split(line, ' '), lambda w: hex(encode(w))), '000002') AS h FROM lines)"""


@query("nal_packets", f"WITH {HEXED} SELECT stream_id, seq::INT AS seq, (seq % 64)::INT AS nal_type, 0 AS layer_id, 0 AS tid, md5(unhex(h)) AS payload FROM hexed")
def nal_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams written and taken apart again."""
    found = tokenize(write_stream(packets(spark, sf_dir)))
    return found.select("stream_id", "seq", "nal_type", "layer_id", "tid", F.md5("rbsp").alias("payload"))


@query("nal_positions", f"WITH {HEXED}, sized AS (SELECT stream_id, seq, 3 + length(h) // 2 + (len(string_split(line, ' ')) - 1) AS size FROM hexed JOIN lines USING (stream_id, seq)) SELECT stream_id, seq::INT AS seq, size::INT AS size, (sum(size + 4) OVER (PARTITION BY stream_id ORDER BY seq) - size)::BIGINT AS pos FROM sized")
def nal_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where packets begin and how long they are with their protection."""
    return tokenize(write_stream(packets(spark, sf_dir))).select("stream_id", "seq", "size", "pos")


def classes(t: Column) -> dict[str, Column]:
    """Predicates on the packet type."""
    return {
        "is_vcl": t < 32,
        "is_slice": (t <= 9) | t.between(16, 21),
        "is_irap": t.between(16, 23),
        "is_idr": t.isin(19, 20),
        "is_bla": t.between(16, 18),
        "is_cra": t == 21,
        "is_leading": t.between(6, 9),
        "is_sub_layer_non_ref": t.isin(0, 2, 4, 6, 8, 10, 12, 14),
        "starts_au": t.between(32, 35) | (t == 39) | t.between(41, 44) | t.between(48, 55),
    }


@query(
    "nal_classes",
    """SELECT event_id, (event_id % 64)::INT AS t, t < 32 AS is_vcl, t <= 9 OR t BETWEEN 16 AND 21 AS is_slice, t BETWEEN 16 AND 23 AS is_irap, t IN (19, 20) AS is_idr, t BETWEEN 16 AND 18 AS is_bla, t = 21 AS is_cra, t BETWEEN 6 AND 9 AS is_leading, t IN (0, 2, 4, 6, 8, 10, 12, 14) AS is_sub_layer_non_ref,
t BETWEEN 32 AND 35 OR t = 39 OR t BETWEEN 41 AND 44 OR t BETWEEN 48 AND 55 AS starts_au FROM events""",
)
def nal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 64).cast("int").alias("t"))
    return own.select("event_id", "t", *[c.alias(n) for n, c in classes(F.col("t")).items()])


@query("au_segmentation", "WITH s AS (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS au FROM conversations) SELECT conv_id, au::BIGINT AS au, count(*) AS packets, sum(length(text))::BIGINT AS size, min(turn) AS first FROM s GROUP BY ALL")
def au_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access units of a conversation: one opens at every turn that is not an answer."""
    own = table(spark, sf_dir, "conversations")
    opens = F.when(F.col("role") != "assistant", 1).otherwise(0)
    au = F.sum(opens).over(Window.partitionBy("conv_id").orderBy("turn"))
    return own.withColumn("au", au).groupBy("conv_id", "au").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.char_length("text")).alias("size"), F.min("turn").alias("first"))


def access_units(own: DataFrame) -> DataFrame:
    """(stream_id, seq, nal_type, rbsp) with au, the access unit's number from 0 in its stream.

    A unit opens at the first slice of a picture (its first bit is set), or at the first packet that starts a unit behind
    the last slice of a picture: delimiters, parameter sets, prefix messages and the reserved types.
    """
    t = F.col("nal_type")
    first = classes(t)["is_slice"] & (F.ascii(F.substring(as_bytes_text(F.col("rbsp")), 1, 1)) >= 128)
    starts = classes(t)["starts_au"]
    order = Window.partitionBy("stream_id").orderBy("seq")
    # behind a slice, or before all, a unit may open; behind a packet that opened one, it may not
    last = F.last(F.when(classes(t)["is_vcl"], True).when(starts, False), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (starts | first) & F.coalesce(last, F.lit(True))
    own = own.withColumn("__opens", F.when(opens, 1).otherwise(0))
    return own.withColumn("au", F.greatest(F.lit(0), F.sum("__opens").over(order) - 1)).drop("__opens")


@query(
    "packet_access_units",
    f"""WITH {HEXED}, p AS (SELECT stream_id, seq, (seq % 64)::INT AS t, length(h) // 2 + 3 AS size, substr(h, 1, 2) >= '80' AS bit FROM hexed), c AS (SELECT *, t < 32 AS vcl, t BETWEEN 32 AND 35 OR t = 39 OR t BETWEEN 41 AND 44 OR t BETWEEN 48 AND 55 AS starts, (t <= 9 OR t BETWEEN 16 AND 21) AND bit AS first FROM p),
l AS (SELECT *, last_value(CASE WHEN vcl THEN TRUE WHEN starts THEN FALSE END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM c),
a AS (SELECT *, greatest(0, sum(CASE WHEN (starts OR first) AND coalesce(last, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) - 1) AS au FROM l)
SELECT stream_id, au::BIGINT AS au, count(*) AS packets, sum(CASE WHEN vcl THEN 1 ELSE 0 END)::BIGINT AS slices, min(seq)::INT AS first_seq FROM a GROUP BY ALL""",
)
def packet_access_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access units of written streams: their packets, slices and first packet."""
    own = access_units(tokenize(write_stream(packets(spark, sf_dir))))
    vcl = F.count_if(classes(F.col("nal_type"))["is_vcl"])
    return own.groupBy("stream_id", F.col("au").cast("long").alias("au")).agg(F.count(F.lit(1)).alias("packets"), vcl.alias("slices"), F.min("seq").alias("first_seq"))


@query("active_parameter_set", "SELECT conv_id, turn, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS active FROM conversations")
def active_parameter_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn the last system turn up to it: the as-of join as one window."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "system", F.col("turn")), ignorenulls=True).over(order).alias("active"))


@query("sei_messages", f"WITH {_LINES} SELECT stream_id, seq::INT AS seq, (seq * 7)::INT AS payload_type, strlen(line)::INT AS payload_size FROM lines")
def sei_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message headers written and read: type and size, each as bytes 255 and a rest."""
    ff = lambda v: F.concat(F.repeat(F.lit("FF"), F.floor(v / 255).cast("int")), F.lpad(F.hex(v % 255), 2, "0"))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    coded = lines.select("stream_id", "seq", F.concat(ff(F.col("seq") * 7), ff(F.octet_length("line"))).alias("h"))
    value = lambda part: (F.length(part) - 2) / 2 * 255 + F.conv(F.right(part, F.lit(2)), 16, 10).cast("int")
    first, second = F.regexp_extract("h", "^((?:FF)*..)((?:FF)*..)$", 1), F.regexp_extract("h", "^((?:FF)*..)((?:FF)*..)$", 2)
    return coded.select("stream_id", "seq", value(first).cast("int").alias("payload_type"), value(second).cast("int").alias("payload_size"))
