"""Records of packets: streams of another writer, and round trips of every table."""

import random

import pytest
from pyspark.sql import functions as F

from planegrid.sources import syntax
from planegrid.sources.annexb import tokenize

#: Headers as widely used encoders write them: a 1280x720 sequence, Main profile, level 3.1.
SPS = "42010101600000030090000003000003005da00280802d165959a4932b804000000300400000 0782"


def test_a_foreign_sequence_set(spark):
    stream = bytes.fromhex("00000001" + SPS + "80")
    own = tokenize(spark.createDataFrame([(1, bytearray(stream))], "stream_id long, stream binary"))
    sps = syntax.as_struct(syntax.records(own), "sps", syntax.SPS).first()["sps"]
    assert (sps["pic_width_in_luma_samples"], sps["pic_height_in_luma_samples"]) == (1280, 720)
    assert (sps["general_profile_idc"], sps["general_level_idc"], sps["chroma_format_idc"]) == (1, 93, 1)
    assert sps["separate_colour_plane_flag"] is None and sps["bit_depth_luma_minus8"] == 0


@pytest.mark.parametrize("seed", range(8))
def test_round_trips(seed):
    rng = random.Random(seed)
    for table in (syntax.VPS, syntax.SPS, syntax.PPS, syntax.SLICE, *syntax.SEI.values()):
        v = {"nal_type": rng.choice([1, 19])}
        for f in table:
            if f.when is None or f.when(v):
                v[f.name] = rng.randrange(1 << int(f.code[1:])) if f.code[1:].isdigit() else rng.randrange(-300, 300) if f.code == "se" else rng.randrange(5000)
        data = syntax.write(v, table)
        assert syntax.read(data, table, {"nal_type": v["nal_type"]}) == v
        with pytest.raises(IndexError):
            syntax.read(data[: len(data) // 2], table, {"nal_type": v["nal_type"]})


def test_messages_of_packets(spark):
    hash_ = syntax.write({"hash_type": 0, "picture_md5_high": 2**64 - 3, "picture_md5_low": 5}, syntax.SEI[132])
    light = syntax.write({"max_content_light_level": 1000, "max_pic_average_light_level": 400}, syntax.SEI[144])
    coded = bytes([132, len(hash_)]) + hash_ + bytes([144, 4]) + light + bytes([255, 45, 255, 1]) + b"u" * 256
    rows = [(1, 0, 40, bytearray(coded)), (1, 1, 39, bytearray([144, 9, 1])), (1, 2, 39, bytearray([255])), (1, 3, 1, bytearray(b"\xe0")), (1, 4, 20, bytearray(b"\xb0")), (1, 5, 35, bytearray(b"\x50")), (1, 6, 33, bytearray(b""))]
    got = syntax.records(spark.createDataFrame(rows, "stream_id long, seq int, nal_type int, rbsp binary")).orderBy("seq", F.col("payload_type").asc_nulls_last()).collect()
    seen = [(r["seq"], r["kind"], r["payload_type"], r["fields"]) for r in got]
    assert seen[0][:3] == (0, "sei", 132) and seen[0][3]["picture_md5_high"] == str(2**64 - 3) and "picture_crc" not in seen[0][3]
    assert seen[1] == (0, "sei", 144, {"max_content_light_level": "1000", "max_pic_average_light_level": "400"})
    assert seen[2] == (0, "sei", 300, {}) and seen[3] == (1, "sei", 144, None) and seen[4] == (2, "sei", None, None)
    assert seen[5] == (3, "slice", None, {"first_slice_segment_in_pic_flag": "1", "slice_pic_parameter_set_id": "0"})
    assert seen[6] == (4, "slice", None, {"first_slice_segment_in_pic_flag": "1", "no_output_of_prior_pics_flag": "0", "slice_pic_parameter_set_id": "0"})
    assert seen[7] == (6, "sps", None, None) and len(seen) == 8


def test_records_are_read_in_slices(spark):
    """What is made of a batch is bounded however long it is, and short streams share one; of a set the wanted fields are told."""
    import pyarrow as pa

    from planegrid.sources.annexb import TOGETHER, slices

    long = pa.RecordBatch.from_arrays([pa.array(range(2 * TOGETHER + 5))], ["x"])
    assert [len(b) for b in slices(iter([long]))] == [TOGETHER, TOGETHER, 5]
    stream = bytearray(bytes.fromhex("00000001" + SPS + "80"))
    own = tokenize(spark.createDataFrame([(i, stream if i % 3 else bytearray()) for i in range(2500)], "stream_id long, stream binary").coalesce(1))
    found = syntax.records(own, ("pic_width_in_luma_samples",)).collect()
    assert sorted(r["stream_id"] for r in found) == [i for i in range(2500) if i % 3] and all(r["fields"] == {"pic_width_in_luma_samples": "1280"} for r in found)
