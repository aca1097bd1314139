"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the plan is made on the histogram of lengths, which has at
most ``capacity`` rows at any corpus size. The reduction fixes a sequence as soon as one small set
is as good as every other set that its largest piece could join: the piece alone if nothing fits
beside it, with the piece that fills it exactly, or with the largest piece that fits if no two
pieces fit together. What remains is packed best-fit decreasing. The plan's slots, ranges of ranks
within a length, then join the pieces, numbered within their length.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, number_within

CAPACITY = 2048

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Counter[Pattern], dict[int, int]]:
    """Sequences that the reduction fixes, by pattern, and the pieces that are left."""
    left = {a: n for a, n in counts.items() if n}
    lengths = sorted(left)
    fixed: Counter[Pattern] = Counter()

    def take(pattern: Pattern, n: int) -> None:
        fixed[pattern] += n
        for a, k in pattern:
            left[a] -= n * k
            if not left[a]:
                del left[a]
                lengths.pop(bisect.bisect_left(lengths, a))

    changed = True
    while changed:
        changed = False
        for a in sorted(lengths, reverse=True):
            while a in left:
                room = capacity - a
                own = left[a]
                others = lengths if own > 1 else [x for x in (lengths[:3]) if x != a]
                if not others or others[0] > room:
                    take(((a, 1),), own)
                    changed = True
                    break
                i = bisect.bisect_right(lengths, room) - 1
                b = lengths[i]
                if b == a and own == 1:
                    i -= 1
                    b = lengths[i]
                smallest = others[0]
                second = smallest if left[smallest] - (smallest == a) > 1 else next((x for x in others[1:3] if x != smallest), capacity)
                if b == room or smallest + second > room:
                    take(((a, 2),), own // 2) if a == b else take(((max(a, b), 1), (min(a, b), 1)), min(own, left[b]))
                    changed = True
                else:
                    break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing, run on the histogram: sequences filled alike are handled together."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left: [pattern, sequences]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_ or not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append([pattern, n])

    for a in sorted(counts, reverse=True):
        n = counts[a]
        while n:
            i = bisect.bisect_left(rooms, a)
            if i == len(rooms):
                k = min(n, capacity // a)
                bins, rest = divmod(n, k)
                put(capacity - a * k, (a,) * k, bins)
                if rest:
                    put(capacity - a * rest, (a,) * rest, 1)
                break
            room = rooms[i]
            pattern, m = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            k = room // a
            bins, rest = divmod(n, k)
            if bins >= m:
                put(room - a * k, pattern + (a,) * k, m)
                n -= m * k
            else:
                if bins:
                    put(room - a * k, pattern + (a,) * k, bins)
                if rest:
                    put(room - a * rest, pattern + (a,) * rest, 1)
                if m - bins - bool(rest):
                    put(room, pattern, m - bins - bool(rest))
                n = 0
    packed: Counter[Pattern] = Counter()
    for groups in open_.values():
        for pattern, m in groups:
            packed[tuple(sorted(Counter(pattern).items(), reverse=True))] += m
    return packed


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces a sequence, first offset) of each slot."""
    fixed, left = reduce_by_dominance(counts, capacity)
    slots, used, sequence = [], Counter(), 0
    for pattern, m in [*sorted(fixed.items()), *sorted(best_fit(left, capacity).items())]:
        offset = 0
        for a, k in pattern:
            slots.append((a, used[a], m * k, sequence, k, offset))
            used[a] += m * k
            offset += a * k
        sequence += m
    return slots


class _Encoder:
    """A text's ids as little-endian 32-bit numbers, those of ``tokenizers`` with the vocabulary's JSON file.

    They are found with the rank file of the same vocabulary by tiktoken, at any length of a text, in under
    half the CPU time. The strings of the JSON file's added tokens become these tokens, as they do
    there. The tests hold both encoders' ids against each other for every code point, for special
    strings and for very long words.
    """

    def __init__(self, json: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        added = {t.content: i for i, t in Tokenizer.from_file(json).get_added_tokens_decoder().items()}
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = set(added)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=merges, special_tokens=added)

    def __call__(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special=self.added).astype("<u4", copy=False).tobytes()


def tokenized(docs: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) to the pieces of the documents' ids, each closed by id 0 (a null text is that id alone).

    ``vocabulary`` names a JSON file and a rank file in ``folder`` (None: those of public_tokenizers).
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        at = f"{folder}/{vocabulary}" if folder else public_tokenizers.path(vocabulary)
        encode = _Encoder(f"{at}.json", f"{at}.tiktoken", public_tokenizers.PATTERN)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(data) // 4
                end = n % capacity or min(n, capacity)
                begin = piece = 0
                while begin < n:
                    rows.append((doc_id, piece, begin, end - begin, zlib.crc32(data[4 * begin : 4 * end])))
                    begin, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut_up, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with a length to the same with sequence_id and offset, in as few sequences as the plan finds.

    Every row has a place of its own, repeated rows too. Lengths lie in 1 to ``capacity``. ``pieces``
    is evaluated more than once, so it must be cut. An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    slots = plan_slots(counts, capacity)  # some slots for each of at most capacity lengths
    schema = "length bigint, lo bigint, n bigint, seq bigint, each bigint, off bigint"
    table = spark.createDataFrame(slots, schema) if slots else spark.createDataFrame([], T._parse_datatype_string(schema))
    ranked = number_within(pieces, ["length"], "__rank")
    at = F.col("__rank") - F.col("lo")
    return (
        ranked.join(F.broadcast(table.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & F.expr("__rank >= lo AND __rank < lo + n"))
        .withColumn("sequence_id", F.col("seq") + F.floor(at / F.col("each")).cast("bigint"))
        .withColumn("offset", F.col("off") + at % F.col("each") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(cut(tokenized(docs)))


def op10_martello_toth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 2048 tokens."""
    return packed_documents(documents(spark, sf_dir))
