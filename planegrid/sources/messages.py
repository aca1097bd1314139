"""Insertion of parameter sets and messages into access units, by rules on each unit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.operators.references import _DOCKETS, dockets, stream
from planegrid.plans.registry import query

PREFIX, SUFFIX = 39, 40
#: Payload types of messages (annex D of the H.265 text), fixed values.
TIMING, USER_DATA, ACTIVE_SETS, PICTURE_HASH, MASTERING, TRANSFER = 1, 5, 129, 132, 137, 147


class Rules(NamedTuple):
    """What is inserted. Bytes are a packet's payload; None inserts nothing."""

    vps: bytes | None = None
    sps: bytes | None = None
    pps: bytes | None = None
    #: Sets before every key picture, not the stream's first unit alone.
    repeat_headers: bool = False
    #: transfer_characteristics preferred by the display.
    transfer: int | None = None
    #: 16 bytes that name the kind of user data, and the data, once in a stream.
    user_data: bytes | None = None
    #: Three primaries and the white point, x and y, then the largest and the least luminance.
    mastering: tuple[int, ...] | None = None
    #: Every unit tells its picture's structure: "fields" from its column ``field``, "doubled" 7.
    timing: str | None = None
    #: hash_type of the units' column ``digest``; None leaves hashes out.
    hash_type: int | None = None


def message(kind: int, data: Column) -> Column:
    """A message's payload of a packet: type and size as bytes 255 and a rest, then the data (hex digits)."""
    number = lambda n: F.concat(F.repeat(F.lit("FF"), F.floor(n / 255).cast("int")), F.lpad(F.hex(n % 255), 2, "0"))
    return F.unhex(F.concat(F.lit("FF" * (kind // 255) + f"{kind % 255:02X}"), number(F.length(data) / 2), data))


def _rows(rules: Rules) -> list[tuple[int, int, Column, Column]]:
    """(slot, nal_type, payload, when) of all that the rules may insert; slices stand in slot 100."""
    t = F.col("nal_type")
    key, irap = t.between(16, 21), t.between(16, 23)
    first = F.col("au") == 0
    shown = irap | (F.col("poc") == 0)
    digits = lambda b: F.lit(b.hex().upper())
    out = []
    for slot, (kind, data) in enumerate(((32, rules.vps), (33, rules.sps), (34, rules.pps))):
        if data is not None:
            out.append((slot, kind, F.lit(data), key if rules.repeat_headers else key & first))
    if rules.transfer is not None:
        out.append((10, PREFIX, message(TRANSFER, digits(bytes([rules.transfer]))), shown))
    if rules.user_data is not None:
        out.append((11, PREFIX, message(USER_DATA, digits(rules.user_data)), first))
    if rules.mastering is not None:
        data = b"".join(v.to_bytes(2 if i < 8 else 4, "big") for i, v in enumerate(rules.mastering))
        out.append((12, PREFIX, message(MASTERING, digits(data)), shown))
    if rules.timing is not None:
        # video set 0, self-contained, no update, one sequence set, number 0
        out.append((13, PREFIX, message(ACTIVE_SETS, F.lit("0B")), F.lit(True)))
        structure = F.col("field") if rules.timing == "fields" else F.lit(7)
        scan = 2 if rules.timing == "fields" else 0
        # four bits of structure, two of the scan, one of repetition, and the bit that fills the byte up
        out.append((14, PREFIX, message(TIMING, F.lpad(F.hex(structure * 16 + scan * 4 + 1), 2, "0")), F.lit(True)))
    if rules.hash_type is not None:
        out.append((200, SUFFIX, message(PICTURE_HASH, F.concat(F.lit(f"{rules.hash_type:02X}"), F.hex("digest"))), F.col("digest").isNotNull()))
    return out


def inserted(packets: DataFrame, units: DataFrame, rules: Rules) -> DataFrame:
    """Packets (stream_id, au, seq, nal_type, payload) with what ``rules`` add, numbered anew: (stream_id, seq, au, nal_type, payload).

    ``units`` has a row per access unit: stream_id, au (from 0), nal_type of its slices, poc, field and digest (hash or
    null). Sets, then messages stand before a unit's packets, its hash behind them. Packets are numbered inside their unit,
    and units by the sums of those before, so no window holds a stream's packets. Units without packets get none.
    """
    made = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("nal_type"), payload.cast("binary").alias("payload"))) for slot, kind, payload, when in _rows(rules)]))
    own = packets.select("stream_id", "au", F.lit(100).alias("slot"), F.col("seq").cast("long").alias("old"), F.col("nal_type").cast("int"), "payload")
    all_ = own
    if _rows(rules):
        with_packets = units.join(packets.select("stream_id", "au").distinct(), ["stream_id", "au"], "left_semi")
        new = with_packets.select("stream_id", "au", F.explode(made).alias("m")).select("stream_id", "au", "m.slot", F.lit(0).cast("long").alias("old"), F.col("m.nal_type").cast("int").alias("nal_type"), "m.payload")
        all_ = own.unionByName(new)
    counts = all_.groupBy("stream_id", "au").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("stream_id").orderBy("au").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("stream_id", "au", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("stream_id", "au").orderBy("slot", "old")
    placed = all_.withColumn("i", F.row_number().over(inside) - 1).join(starts, ["stream_id", "au"])
    return placed.select("stream_id", (F.col("start") + F.col("i")).cast("int").alias("seq"), "au", "nal_type", "payload")


def extracted(packets: DataFrame) -> DataFrame:
    """The inverse: packets (stream_id, seq, nal_type, ...) without parameter sets and messages, numbered anew."""
    kept = packets.where(~F.col("nal_type").between(32, 34) & ~F.col("nal_type").isin(PREFIX, SUFFIX))
    return kept.withColumn("seq", (F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) - 1).cast("int"))


#: The rules of the query: some user data, a display of wide colours, hashes.
RULES = Rules(b"\x0c\x01", b"\x01\x01", b"\xc1\x72", True, 18, bytes(range(16)) + b"planegrid", (13250, 34500, 7500, 3000, 34000, 16000, 15635, 16450, 10_000_000, 50), "fields", 0)


def _sql_message(kind: int, data: str) -> str:
    return f"unhex('{kind:02X}' || lpad(to_hex(length({data}) // 2), 2, '0') || {data})"


_MASTERING = "".join(f"{v:0{4 if i < 8 else 8}X}" for i, v in enumerate(RULES.mastering or ()))
_UNITS = _DOCKETS + ", u AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY coded) - 1 AS au, CASE WHEN poc = 0 THEN 19 WHEN poc % 32 = 0 THEN 21 ELSE 1 END AS t, poc, event_id % 2 + 1 AS field, CASE WHEN event_id % 5 > 0 THEN upper(md5(event_id::VARCHAR)) END AS digest FROM dockets)"


@query(
    "message_insertion",
    f"""WITH {_UNITS}, r AS (SELECT user_id, au, 100 AS slot, k AS old, t, encode(poc::VARCHAR || '/' || k) AS p FROM u, range(0, 2) s(k)
UNION ALL SELECT user_id, au, 0, 0, 32, unhex('0C01') FROM u WHERE t >= 16 UNION ALL SELECT user_id, au, 1, 0, 33, unhex('0101') FROM u WHERE t >= 16 UNION ALL SELECT user_id, au, 2, 0, 34, unhex('C172') FROM u WHERE t >= 16
UNION ALL SELECT user_id, au, 10, 0, 39, {_sql_message(TRANSFER, "'12'")} FROM u WHERE t >= 16 OR poc = 0 UNION ALL SELECT user_id, au, 11, 0, 39, {_sql_message(USER_DATA, "'" + (RULES.user_data or b"").hex().upper() + "'")} FROM u WHERE au = 0
UNION ALL SELECT user_id, au, 12, 0, 39, {_sql_message(MASTERING, f"'{_MASTERING}'")} FROM u WHERE t >= 16 OR poc = 0 UNION ALL SELECT user_id, au, 13, 0, 39, unhex('81010B') FROM u
UNION ALL SELECT user_id, au, 14, 0, 39, unhex('0101' || lpad(upper(to_hex(field * 16 + 9)), 2, '0')) FROM u UNION ALL SELECT user_id, au, 200, 0, 40, unhex('841100' || digest) FROM u WHERE digest IS NOT NULL)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY au, slot, old) - 1)::INT AS seq, au::BIGINT AS au, t::INT AS nal_type, md5(p) AS payload FROM r""",
)
def message_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of two slices a picture with sets, messages and hashes put in."""
    own = dockets(stream(spark, sf_dir))
    au = (F.row_number().over(Window.partitionBy("user_id").orderBy("coded")) - 1).cast("long")
    kind = F.when(F.col("poc") == 0, 19).when(F.col("poc") % 32 == 0, 21).otherwise(1)
    digest = F.when(F.col("event_id") % 5 > 0, F.unhex(F.md5(F.col("event_id").cast("string"))))
    units = own.select(F.col("user_id").alias("stream_id"), au.alias("au"), kind.alias("nal_type"), "poc", (F.col("event_id") % 2 + 1).cast("int").alias("field"), digest.alias("digest"))
    slices = units.select("stream_id", "au", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "nal_type", "poc")
    payload = F.encode(F.concat_ws("/", "poc", "k"), "UTF-8")
    packets = slices.select("stream_id", "au", (2 * F.col("au") + F.col("k")).alias("seq"), "nal_type", payload.alias("payload"))
    found = inserted(packets, units, RULES)
    return found.select(F.col("stream_id").alias("user_id"), "seq", "au", "nal_type", F.md5("payload").alias("payload"))
