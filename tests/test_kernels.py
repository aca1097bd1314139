"""Kernels against NumPy on seeded blocks."""

import binascii

import numpy as np
import pytest
from pyspark.sql import functions as F

from planegrid.functions.scalar import dequantize, quantize
from planegrid.operators.digests import crc16
from planegrid.operators.distortion import sad, satd, ssd
from planegrid.operators.reports import read_ue, spaced
from planegrid.operators.statistics import shot_changes
from planegrid.sources.annexb import protect, tokenize, unprotect, write_stream
from planegrid.sources.rawvideo import planes, written
from planegrid.streaming.output import bumped, finished


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(0, 256, 64).tolist(), rng.integers(0, 256, 64).tolist()) for i in range(40)]
    return rows, spark.createDataFrame(rows, "block long, src array<int>, ref array<int>")


def test_sad_and_ssd(pairs):
    rows, df = pairs
    got = {r[0]: (r[1], r[2]) for r in df.select("block", sad(F.col("src"), F.col("ref")), ssd(F.col("src"), F.col("ref"))).collect()}
    for i, a, b in rows:
        d = np.array(a) - np.array(b)
        assert got[i] == (np.abs(d).sum(), (d * d).sum())


@pytest.mark.parametrize("n", [2, 4, 8])
def test_satd(pairs, n):
    rows, df = pairs
    h = np.array([[1]])
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    got = {r["block"]: r["satd"] for r in satd(df, n).collect()}
    for i, a, b in rows:
        d = (np.array(a) - np.array(b)).reshape(8, 8)
        want = sum((np.abs(h @ d[y : y + n, x : x + n] @ h).sum() + n // 4) // (n // 2) for y in range(0, 8, n) for x in range(0, 8, n))
        assert got[i] == want


def test_quantize_signs_and_limits(spark):
    x = spark.createDataFrame([(v,) for v in (-32768, -1, 0, 1, 5000, 32767)], "x long")
    for v, q, d in x.select("x", quantize(F.col("x"), 26214, 20, 14), dequantize(F.col("x"), 52224, 2)).collect():
        want = (abs(v) * 26214 + (14 << 4)) >> 20
        assert q == (-want if v < 0 else want)
        assert d == max(-32768, min(32767, (v * 52224 + 2) >> 2))


def test_crc_is_the_bitwise_one(spark):
    data = [b"", b"\x00", b"123456789", bytes(range(256))]
    got = [r[0] for r in spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary").orderBy("i").select(crc16("d")).collect()]
    for d, g in zip(data, got):
        c = 0xFFFF
        for bit in [(byte >> s) & 1 for byte in d for s in range(7, -1, -1)] + [0] * 16:
            top, c = c >> 15, ((c << 1) & 0xFFFF) | bit
            c ^= 0x1021 if top else 0
        assert g == c
    assert binascii.crc_hqx(b"", 0x1D0F) == got[0]


def test_emulation_prevention_round_trip(spark):
    rng = np.random.default_rng(3)
    payloads = [bytes(rng.choice([0, 1, 2, 3, 4, 255], 60).tolist()) for _ in range(200)] + [b"\0\0\0\0\0", b"", b"\0\0\3"]
    df = spark.createDataFrame([(i // 50, i % 50, i % 64, bytearray(p)) for i, p in enumerate(payloads)], "stream_id int, seq int, nal_type int, payload binary")
    streams = write_stream(df)
    for r in streams.collect():
        body = bytes(r["stream"]).split(b"\0\0\0\1")
        assert all(b"\0\0\1" not in p and b"\0\0\0" not in p for p in body)
    got = {(r["stream_id"], r["seq"]): (r["nal_type"], bytes(r["rbsp"])) for r in tokenize(streams).collect()}
    assert got == {(i // 50, i % 50): (i % 64, p) for i, p in enumerate(payloads)}


def test_protection_marks_every_run(spark):
    text = spark.createDataFrame([("\0\0\1\0\0\0\0\3",)], "t string")
    once = text.select(protect(F.col("t")).alias("p"))
    assert once.first()[0] == "\0\0\3\1\0\0\3\0\0\3\3"
    assert once.select(unprotect(F.col("p"))).first()[0] == "\0\0\1\0\0\0\0\3"


def test_raw_planes_round_trip(spark):
    content = bytes(range(256)) * 3
    df = spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"short"))], "path string, content binary")
    own = planes(df, 8, 8)
    assert own.count() == 3 * (len(content) // 96)
    assert {r["path"]: bytes(r["content"]) for r in written(own).collect()} == {"a": content[: len(content) // 96 * 96]}
    assert planes(df, 8, 8, seek=2, frames=3).select("frame").distinct().count() == 3


def test_bumping_as_a_stream(spark, tmp_path):
    """Coding order in, order counts out; the stream's end lets the rest go."""
    order = [0, 8, 4, 2, 1, 3, 6, 5, 7]
    rows = [(u, i, p) for u in (1, 2) for i, p in enumerate(order)] + [(u, 99, -1) for u in (1, 2)]
    spark.createDataFrame(rows, "user_id long, seq long, poc long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, seq long, poc long").parquet(str(tmp_path / "in"))
    got = finished(bumped(stream), "append").orderBy("user_id", "output").collect()
    assert [(r["user_id"], r["poc"]) for r in got] == [(u, p) for u in (1, 2) for p in range(9)]


def test_changes_keep_their_distance(spark):
    df = spark.createDataFrame([([3, 5, 8, 9, 15, 30, 36],), ([],)], "f array<bigint>")
    assert [r[0] for r in df.select(spaced(F.col("f"), 5)).collect()] == [[3, 9, 15, 30, 36], []]


def test_shot_change_stands_out(spark):
    d = [10, 12, 9, 11, 10, 12, 300, 11, 10, 9, 12, 10, 11, 10]
    df = spark.createDataFrame(list(enumerate(d, 2)), "frame long, difference long")
    got = [(r["frame"], r["stands_out"]) for r in shot_changes(df).collect()]
    assert (8, True) in got and sum(s for _, s in got) == 1


def test_codes_are_read_in_turn(spark):
    bits = spark.createDataFrame([("1" + "010" + "00111" + "0001000" + "1",)], "b string")
    assert bits.select(read_ue(F.col("b"), 4)).first()[0] == [0, 1, 6, 7]


def test_sao_search_in_one_pass(spark):
    """No candidate is a row: the search is one function over batches of whole blocks, wherever Spark cuts its batches."""
    import pyarrow as pa

    from planegrid.operators.statistics import _sao_best, sao_search, whole_blocks

    plan = sao_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    rng = np.random.default_rng(11)
    ids = np.sort(rng.integers(0, 40, 90))
    rows = pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(list(rng.integers(100, 130, (90, 64), dtype=np.int32))) for _ in range(2))], ["block", "src", "ref"])
    whole = _sao_best(rows, 40).to_pylist()
    for size, most in ((7, 1000), (1, 5), (90, 4)):
        parts = list(whole_blocks((rows.slice(i, size) for i in range(0, 90, size)), most))
        assert [r for p in parts for r in _sao_best(p, 40).to_pylist()] == whole and (size == 90 or len(parts) > 1)
    assert [r["block"] for r in whole] == sorted(set(ids.tolist()))
