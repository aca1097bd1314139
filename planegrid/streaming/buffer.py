"""The decoded picture buffer with its rules for output and removal, as a fold over a stream's pictures and as streaming state with timers.

A picture that comes first removes those that neither output nor a later picture needs; then the smallest order count goes
out as long as too many wait, one has waited too long, or the buffer is full. A refresh empties the buffer, with or
without output. In the streaming form the buffer is a state list; an end mark empties it, and so does a timer where a
stream falls silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from planegrid.operators.references import _DOCKETS, dockets, edges, stream
from planegrid.plans.registry import query
from planegrid.sources.scratch import shared_folder
from planegrid.streaming.output import finished


class Limits(NamedTuple):
    """What a sequence's set states: pictures in the buffer less one, pictures that wait, and pictures that a waiting one may see pass (0: any) plus one."""

    buffering: int = 5
    reorder: int = 2
    latency: int = 0


class Held(NamedTuple):
    """A picture in the buffer: output tells whether it still has to go out, reference whether later ones may use it, passed how many came since."""

    poc: int
    output: bool = True
    reference: bool = True
    passed: int = 0


def _smallest(buffer: list[Held]) -> tuple[int, list[Held]]:
    """The picture of the smallest order count that waits goes out, and out of the buffer if nothing needs it."""
    at = min((h.poc, i) for i, h in enumerate(buffer) if h.output)[1]
    left = buffer[at]._replace(output=False)
    return left.poc, [*buffer[:at], *([left] if left.reference else []), *buffer[at + 1 :]]


def _waiting(buffer: list[Held], limits: Limits) -> bool:
    """Whether more wait than may, or one has waited too long."""
    return sum(h.output for h in buffer) > limits.reorder or bool(limits.latency and any(h.output and h.passed >= limits.latency + limits.reorder - 1 for h in buffer))


def step(buffer: list[Held], poc: int, kept: list[int], refresh: bool, drop: bool, shown: bool, limits: Limits) -> tuple[list[Held], list[int]]:
    """(buffer, order counts that go out) when a picture comes that keeps the pictures ``kept`` as references.

    ``refresh``: a picture that nothing before it is needed for; ``drop``: those before go without output. ``shown``: whether the
    picture itself is for output.
    """
    out: list[int] = []
    if refresh:
        while not drop and any(h.output for h in buffer):
            left, buffer = _smallest(buffer)
            out.append(left)
        buffer = []
    else:
        buffer = [h._replace(reference=h.poc in kept) for h in buffer]
        buffer = [h for h in buffer if h.output or h.reference]
        while any(h.output for h in buffer) and (_waiting(buffer, limits) or len(buffer) > limits.buffering):
            left, buffer = _smallest(buffer)
            out.append(left)
    if shown:
        buffer = [h._replace(passed=h.passed + 1) if h.output and h.poc > poc else h for h in buffer]
    buffer = [*buffer, Held(poc, shown)]
    while any(h.output for h in buffer) and _waiting(buffer, limits):
        left, buffer = _smallest(buffer)
        out.append(left)
    return buffer, out


def flushed(buffer: list[Held]) -> list[int]:
    return sorted(h.poc for h in buffer if h.output)


PICTURE = "seq long, poc long, kept array<long>, refresh boolean, drop boolean, shown boolean"


def _fold(rows: Iterator, buffer: list[Held], limits: Limits) -> tuple[list[Held], list[tuple[int, int]]]:
    """Rows of PICTURE in order to the buffer behind them and (seq at which it went out, poc); a null poc is the end mark."""
    told = []
    for r in rows:
        if pd.isna(r.poc):
            out, buffer = flushed(buffer), []
        else:
            buffer, out = step(buffer, int(r.poc), [int(x) for x in r.kept] if r.kept is not None else [], bool(r.refresh), bool(r.drop), bool(r.shown), limits)
        told += [(int(r.seq), p) for p in out]
    return buffer, told


def buffered(pictures: DataFrame, limits: Limits, key: str = "stream_id") -> DataFrame:
    """(key, seq, poc, kept, refresh, drop, shown) to (key, output, seq, poc): the order in which pictures go out, and with which picture.

    Streams are folded in the order of seq, each by itself; what waits at the end goes out with a null seq. Pictures are dealt by
    stream and sorted in their partition, and a task folds them as they come, so no stream is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, any_, buffer, n = None, False, [], 0
        for b in batches:
            told: list[tuple[int | None, int, int | None, int]] = []
            for stream_id, seq, poc, kept, refresh, drop, shown in zip(*(c.to_pylist() for c in b.columns)):
                if any_ and stream_id != at:
                    told += [(at, n + i, None, p) for i, p in enumerate(flushed(buffer))]
                    buffer, n = [], 0
                at, any_ = stream_id, True
                if poc is None:
                    out, buffer = flushed(buffer), []
                else:
                    buffer, out = step(buffer, poc, kept or [], bool(refresh), bool(drop), bool(shown), limits)
                told += [(stream_id, n + i, seq, p) for i, p in enumerate(out)]
                n += len(out)
            yield batch(told)
        yield batch([(at, n + i, None, p) for i, p in enumerate(flushed(buffer))])

    def batch(told: list[tuple[int | None, int, int | None, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in told], pa.int64()) for i in range(4)], [key, "output", "seq", "poc"])

    own = pictures.select(F.col(key).cast("long").alias(key), F.col("seq").cast("long"), F.col("poc").cast("long"), "kept", "refresh", "drop", "shown")
    dealt = own.repartition(key).sortWithinPartitions(key, "seq")
    return dealt.mapInArrow(run, f"{key} long, output long, seq long, poc long")


class BufferProcessor(StatefulProcessor):
    """The buffer of one stream as state: a list of pictures and the count of those out. Outputs are numbered across batches.

    An event-time timer, set anew by every batch ``silence`` milliseconds behind its last picture, empties the buffer.
    """

    def __init__(self, limits: Limits, silence: int):
        self.limits, self.silence = limits, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "poc long, output boolean, reference boolean, passed int")
        self.count = handle.getValueState("count", "n long")

    def _told(self, key: tuple, told: list[tuple[int | None, int]]) -> Iterator[pd.DataFrame]:
        if told:
            n = int(self.count.get()[0]) if self.count.exists() else 0
            self.count.update((n + len(told),))
            yield pd.DataFrame({"stream_id": [key[0]] * len(told), "output": range(n, n + len(told)), "seq": pd.array([s for s, _ in told], "Int64"), "poc": [p for _, p in told]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = pd.concat(list(rows)).sort_values("seq")
        buffer = [Held(int(h[0]), bool(h[1]), bool(h[2]), int(h[3])) for h in self.held.get()] if self.held.exists() else []
        buffer, told = _fold(batch.itertuples(index=False), buffer, self.limits)
        self.held.clear()
        if buffer:
            self.held.put([tuple(h) for h in buffer])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if buffer:
            self.handle.registerTimer(int(batch["ts"].max().timestamp() * 1000) + self.silence)
        yield from self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        buffer = [Held(int(h[0]), bool(h[1]), bool(h[2]), int(h[3])) for h in self.held.get()] if self.held.exists() else []
        self.held.clear()
        yield from self._told(key, [(None, p) for p in flushed(buffer)])

    def close(self) -> None:
        pass


def buffered_stream(pictures: DataFrame, limits: Limits, silence: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """The streaming form of ``buffered``: (stream_id, ts, PICTURE) as a stream. A row with a null poc is the end mark."""
    spark = pictures.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = pictures.withWatermark("ts", late).groupBy("stream_id")
    return own.transformWithStateInPandas(BufferProcessor(limits, silence), "stream_id long, output long, seq long, poc long", "Append", "EventTime")


def coded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pictures in coding order: (stream_id, ts, PICTURE). A picture keeps what it or a later one refers to; the first one refreshes."""
    own = dockets(stream(spark, sf_dir))
    last = edges(own).groupBy("user_id", F.col("ref").alias("poc")).agg(F.max("coded").alias("last"))
    lives = own.join(last, ["user_id", "poc"]).where("last > coded").select("user_id", F.col("poc").alias("kept"), F.explode(F.sequence(F.col("coded") + 1, F.col("last"))).alias("coded"))
    kept = lives.groupBy("user_id", "coded").agg(F.array_sort(F.collect_list("kept")).alias("kept"))
    return own.join(kept, ["user_id", "coded"], "left").select(
        F.col("user_id").alias("stream_id"),
        F.to_timestamp("ts").alias("ts"),
        F.col("coded").cast("long").alias("seq"),
        F.col("poc").cast("long").alias("poc"),
        F.coalesce("kept", F.array().cast("array<bigint>")).alias("kept"),
        (F.col("poc") == 0).alias("refresh"),
        F.lit(False).alias("drop"),
        (F.col("event_id") % 11 != 4).alias("shown"),
    )


_SHOWN = "shown AS (SELECT user_id, poc, coded, row_number() OVER (PARTITION BY user_id ORDER BY poc) - 1 AS output FROM dockets WHERE event_id % 11 <> 4)"


@query("buffer_rules", f"WITH {_DOCKETS}, {_SHOWN} SELECT user_id AS stream_id, output::BIGINT AS output, poc::BIGINT AS poc FROM shown")
def buffer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of coded pictures by all rules of the buffer, each stream folded by itself; some pictures are not for output."""
    return buffered(coded_stream(spark, sf_dir), Limits(6, 3, 0)).drop("seq")


@query("buffer_stream", f"WITH {_DOCKETS}, {_SHOWN} SELECT user_id AS stream_id, output::BIGINT AS output, poc::BIGINT AS poc FROM shown WHERE user_id % 4 = 1")
def buffer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with state; an end mark empties each buffer. A stream's pictures come in one file, so in order."""
    own = coded_stream(spark, sf_dir).where("stream_id % 4 = 1")
    ends = own.groupBy("stream_id").agg(F.max("ts").alias("ts"), (F.max("seq") + 1).alias("seq"))
    marks = ends.select("stream_id", "ts", "seq", F.lit(None).cast("long").alias("poc"), F.array().cast("array<bigint>").alias("kept"), F.lit(False).alias("refresh"), F.lit(False).alias("drop"), F.lit(False).alias("shown"))
    folder = shared_folder(spark, "pictures")
    own.unionByName(marks).repartition(3, "stream_id").write.parquet(folder)
    rows = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 8).parquet(folder)
    return finished(buffered_stream(rows, Limits(6, 3, 0)), "append").drop("seq")
