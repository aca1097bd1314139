"""Messages of every type: random values come back, cut ones are told, and timing is read with its sequence set."""

import random

import pytest
from test_headers import drive

from planegrid.sources import headers, messages, payloads


@pytest.mark.parametrize("kind", sorted(payloads.PAYLOADS))
def test_random_payloads_come_back(kind):
    rng = random.Random(kind)
    for k in range(30):
        sps = {n: rng.randrange(2) for n in ("nal_hrd_parameters_present_flag", "vcl_hrd_parameters_present_flag", "sub_pic_hrd_params_present_flag", "frame_field_info_present_flag", "sub_pic_cpb_params_in_pic_timing_sei_flag")}
        size = rng.choice([17, 20, 33]) if kind == 5 else rng.choice([2, 5, 13, 17, 49])
        make = lambda: payloads.PAYLOADS[kind](sps, size)  # noqa: E731, B023
        v, _ = drive(make(), rng)
        data = headers.write(v, make())
        assert headers.read(data, make())[0] == v, k
        if len(data) > 3:
            with pytest.raises(IndexError):
                headers.read(data[:-2], make())


def test_messages_of_packets(spark):
    sps = headers.write(headers._sequence_values(10) | {"frame_field_info_present_flag": 1, "au_cpb_removal_delay_length_minus1": 7, "dpb_output_delay_length_minus1": 7}, headers.sequence_set())
    timing = bytes([1, 3, 0x2B, 0x00, 0x80])  # structure 2, scan 2, repeated, then two delays of 8 bits: 128 and 64
    rows = [
        (0, 39, timing),  # no sequence set yet: nothing is known of its fields
        (1, 33, sps),
        (2, 39, timing + bytes([144, 4, 3, 232, 1, 144]) + bytes([255, 45, 1, 9])),
        (3, 40, bytes([132, 17, 0, *range(16)])),
        (4, 39, bytes([144, 9, 1])),
        (5, 39, bytes([255])),
        (6, 39, bytes([144, 2, 1, 1])),
        (7, 1, b"\x80"),
    ]
    df = spark.createDataFrame([(1, i, t, bytearray(d)) for i, t, d in rows], "stream_id long, seq int, nal_type int, rbsp binary").repartition(3)
    got = {(r["seq"], r["number"]): r for r in payloads.sei_payloads(df).collect()}
    assert set(got) == {(0, 0), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0), (5, 0), (6, 0)}
    assert got[0, 0]["fields"] == {}
    v = got[2, 0]["fields"]
    assert (v["pic_struct"], v["source_scan_type"], v["duplicate_flag"]) == (2, 2, 1)
    assert (v["au_cpb_removal_delay_minus1"], v["pic_dpb_output_delay"]) == (128, 64)
    assert got[2, 1]["fields"] == {"max_content_light_level": 1000, "max_pic_average_light_level": 400}
    assert (got[2, 2]["payload_type"], got[2, 2]["error"]) == (300, "unknown")
    assert [got[3, 0]["fields"][f"picture_hash[0][{i}]"] for i in range(16)] == list(range(16))
    assert [got[k, 0]["error"] for k in (4, 5, 6)] == ["cut short", "no message", "cut short"]


def test_what_insertion_writes_can_be_read(spark):
    """Inserted messages are read back with the values of their rules, sets stand first, and taking all out again restores the packets."""
    packets = [(1, au, 10 * au + k, 19 if au == 0 else 1, bytearray(f"{au}{k}".encode())) for au in range(4) for k in range(2)]
    units = [(1, au, 19 if au == 0 else 1, au, 1 + au % 2, bytearray(bytes([au] * 16)) if au != 2 else None) for au in range(5)]
    df = spark.createDataFrame(packets, "stream_id long, au long, seq int, nal_type int, payload binary")
    found = messages.inserted(df, spark.createDataFrame(units, "stream_id long, au long, nal_type int, poc int, field int, digest binary"), messages.RULES)
    rows = found.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    assert [r["nal_type"] for r in rows][:11] == [32, 33, 34, 39, 39, 39, 39, 39, 19, 19, 40]
    assert [r["nal_type"] for r in rows if r["au"] == 2] == [39, 39, 1, 1]
    field = spark.createDataFrame([(1, -1, 33, bytearray(headers.write({"vui_parameters_present_flag": 1, "frame_field_info_present_flag": 1}, headers.sequence_set())))], "stream_id long, seq int, nal_type int, rbsp binary")
    told = payloads.sei_payloads(found.where("nal_type <> 33").select("stream_id", "seq", "nal_type", found["payload"].alias("rbsp")).unionByName(field)).orderBy("seq").collect()
    assert [r["payload_type"] for r in told] == [147, 5, 137, 129, 1, 132, 129, 1, 132, 129, 1, 129, 1, 132]
    assert all(r["error"] is None for r in told)
    assert told[0]["fields"] == {"preferred_transfer_characteristics": 18} and told[2]["fields"]["max_display_mastering_luminance"] == 10_000_000
    assert [r["fields"]["pic_struct"] for r in told if r["payload_type"] == 1] == [1, 2, 1, 2]
    assert told[3]["fields"] == {"active_video_parameter_set_id": 0, "self_contained_cvs_flag": 1, "no_parameter_set_update_flag": 0, "num_sps_ids_minus1": 0, "active_seq_parameter_set_id[0]": 0}
    assert [(r["seq"], bytes(r["payload"])) for r in messages.extracted(found).orderBy("seq").collect()] == [(i, bytes(p[4])) for i, p in enumerate(packets)]
    assert messages.inserted(df, spark.createDataFrame(units, "stream_id long, au long, nal_type int, poc int, field int, digest binary"), messages.Rules()).count() == 8


def test_orders_of_one_file_are_coded_by_many_tasks(spark):
    """A file of few bytes and many rows comes in one partition; messages are written behind a shuffle."""
    plan = payloads.sei_fields(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("RepartitionByExpression") > plan.rindex("MapInArrow")
