"""The picture buffer by its rules, as a fold and as a stream with state and timers."""

import datetime
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from planegrid.streaming.buffer import PICTURE, Held, Limits, buffered, buffered_stream, step
from planegrid.streaming.output import finished


def go(pictures, limits):
    """(order counts out, the coding place at which each goes out) of (poc, kept, refresh, drop, shown)."""
    buffer, told = [], []
    for i, (poc, kept, refresh, drop, shown) in enumerate(pictures):
        buffer, out = step(buffer, poc, kept, refresh, drop, shown, limits)
        told += [(p, i) for p in out]
        assert sum(h.output for h in buffer) <= max(limits.reorder, 0)
    return told, buffer


def test_reordering():
    own = [(0, [], True, False, True), (8, [0], False, False, True), (4, [0, 8], False, False, True), (2, [0, 4, 8], False, False, True), (1, [0, 2, 4, 8], False, False, True), (3, [2, 4, 8], False, False, True)]
    told, buffer = go(own, Limits(6, 3))
    assert told == [(0, 3), (1, 4), (2, 5)] and sorted(h.poc for h in buffer if h.output) == [3, 4, 8]


def test_a_picture_waits_no_longer_than_its_latency():
    own = [(9, [], True, False, True), *((10 + i, [9], False, False, True) for i in range(4))]
    # the counts above the picture are what passes; with a latency of one it sees one more than may wait
    told, _ = go(own, Limits(16, 8, 0))
    assert told == []
    late = [(20, [], True, False, True), (12, [20], False, False, True), (13, [20], False, False, True), (14, [20], False, False, True)]
    told, buffer = go(late, Limits(16, 2, 1))
    assert told[0][0] == 12 and all(h.passed <= 2 for h in buffer)


def test_a_full_buffer_and_pictures_that_nothing_needs():
    own = [(0, [], True, False, True), (1, [0], False, False, False), (2, [0, 1], False, False, True), (3, [2], False, False, True)]
    told, buffer = go(own, Limits(1, 5))
    assert told == [(0, 2)] and {h.poc for h in buffer} == {2, 3}


def test_refreshes_with_and_without_output():
    own = [(0, [], True, False, True), (2, [0], False, False, True), (1, [0, 2], False, False, True), (0, [], True, False, True), (5, [0], False, False, True), (0, [], True, True, True)]
    told, buffer = go(own, Limits(6, 3))
    assert told == [(0, 3), (1, 3), (2, 3)] and buffer == [Held(0)]


def sequence(rng, n):
    """Pictures of structures of four, some not for output, with refreshes."""
    out, base = [], 0
    while len(out) < n:
        if not out or rng.random() < 0.2:
            out.append((0, [], True, rng.random() < 0.3, True))
            base = 0
        for place in (4, 2, 1, 3):
            out.append((base + place, [p for p in (base, base + 2, base + 4) if p != base + place], False, False, rng.random() < 0.9))
        base += 4
    return out[:n]


def test_stream_as_fold(spark, tmp_path):
    """Batches give what one fold gives; an end mark or a stream's silence empties its buffer."""
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows, films = [], {}
    for s in range(4):
        films[s] = sequence(rng, 30)
        for i, p in enumerate(films[s]):
            # stream 3 falls silent after its tenth picture
            if s < 3 or i < 10:
                rows.append((s, start + datetime.timedelta(seconds=i), i, *p))
    for s in (0, 1):
        rows.append((s, start + datetime.timedelta(seconds=30), 30, None, None, False, False, False))
    limits = Limits(5, 2, 0)
    df = spark.createDataFrame(rows, f"stream_id long, ts timestamp, {PICTURE}")
    for k in range(4):  # files one after the other, so batches come in order
        df.where(F.expr(f"seq div 8 = {k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = finished(buffered_stream(source, limits, silence=5000), "append").toPandas()
    fold = buffered(df.where("poc IS NOT NULL"), limits).toPandas()
    for s in (0, 1, 3):
        a, b = (x[x.stream_id == s].sort_values("output").poc.tolist() for x in (got, fold))
        assert a == b, s
    # stream 2 has no end mark: what waited last is still in the state
    a, b = (x[x.stream_id == 2].sort_values("output").poc.tolist() for x in (got, fold))
    assert a == b[: len(a)] and len(b) - len(a) <= 3
    assert all(sorted(g.output) == list(range(len(g))) for _, g in got.groupby("stream_id"))
    assert pd.isna(got[got.stream_id == 3].sort_values("output").seq.iloc[-1])


def test_streams_are_folded_as_they_come(spark):
    """No stream is gathered: a partition's sorted pictures are folded in turn, one of no key and one of end marks alone among them."""
    rows = [(k, i, p, [], i == 0, False, True) for k in (1, None, 2) for i, p in enumerate([0, 4, 2, 1, 3])] + [(5, 0, None, None, False, False, False)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, poc long, kept array<long>, refresh boolean, drop boolean, shown boolean")
    out = buffered(df.repartition(3), Limits(5, 2, 0))
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.orderBy("stream_id", "output").collect()
    assert [(r["stream_id"], r["output"], r["poc"]) for r in got] == [(k, i, i) for k in (None, 1, 2) for i in range(5)]
