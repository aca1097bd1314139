"""Whole parameter sets and slice headers: streams of other writers, random records, and which sets are active."""

import random

import pytest

from planegrid.sources import headers
from planegrid.sources.annexb import payload_of

#: Sets as a widely used encoder writes them: 1280x720 and a picture set that goes with many sequences.
SPS = "42010101600000030090000003000003005da00280802d165959a4932b80400000030040000007 82".replace(" ", "")
PPS = "4401c172b46240"


def test_foreign_sets_to_their_last_bit():
    for text, syntax, want in (
        (SPS, headers.sequence_set, {"pic_width_in_luma_samples": 1280, "pic_height_in_luma_samples": 720, "general_level_idc": 93, "amp_enabled_flag": 0, "sample_adaptive_offset_enabled_flag": 1, "vui_parameters_present_flag": 1, "vui_num_units_in_tick": 1, "vui_time_scale": 30}),
        (PPS, headers.picture_set, {"pps_pic_parameter_set_id": 0, "sign_data_hiding_enabled_flag": 1, "weighted_pred_flag": 1, "entropy_coding_sync_enabled_flag": 1, "pps_extension_present_flag": 0}),
    ):
        raw = bytes.fromhex(text)[2:].replace(b"\0\0\3", b"\0\0")
        got, _, bits = headers.read(raw, syntax())
        assert {k: got[k] for k in want} == want
        rest = format(int.from_bytes(raw, "big"), f"0{8 * len(raw)}b")[bits:]
        assert rest == "1" + "0" * (len(rest) - 1) and len(rest) <= 8  # the bit that ends a payload, and zeros


def drive(syntax, rng):
    """Random values for a syntax, small where they count something."""
    out = {}
    try:
        name, code = next(syntax)
        while True:
            if isinstance(code, int):
                x = rng.randrange(1 << code) if "present" in name or "flag" in name or "delta_poc" in name else rng.randrange(min(1 << code, 5))
                x = min(x, 1) if name == "sps_extension_7bits" or name == "pps_extension_7bits" else x
            else:
                x = rng.randrange(-4, 5) if code == headers.SE else rng.randrange(3)
            if name == "delta_idx_minus1":
                x = 0
            out[name] = x
            name, code = syntax.send(x)
    except StopIteration as end:
        return out, end.value


@pytest.mark.parametrize("seed", range(60))
def test_random_records_come_back(seed):
    rng = random.Random(seed)
    sps, sets = drive(headers.sequence_set(), rng)
    pps, _ = drive(headers.picture_set(), rng)
    data = headers.write(sps, headers.sequence_set())
    assert headers.read(data, headers.sequence_set())[:2] == (sps, sets)
    assert headers.read(headers.write(pps, headers.picture_set()), headers.picture_set())[0] == pps
    with pytest.raises(IndexError):
        headers.read(data[: len(data) // 2], headers.sequence_set())
    for nal_type in (1, 19, 21):
        for _ in range(10):
            try:
                v, found = drive(headers.slice_header(nal_type, sps, sets, pps), rng)
            except IndexError:  # a list entry or set beyond what there is
                continue
            assert headers.read(headers.write(v, headers.slice_header(nal_type, sps, sets, pps)), headers.slice_header(nal_type, sps, sets, pps))[:2] == (v, found)


def coded(values, index=0, sets=(), in_slice=False):
    data = headers.write(values, headers.reference_set(index, list(sets), in_slice))
    return headers.read(data + b"\0", headers.reference_set(index, list(sets), in_slice))[1]


def test_reference_sets_moved_from_earlier_ones():
    """The example of a set of -1, -3, +2 moved by -2, with one not used and one left out; and one coded by itself."""
    own = coded({"num_negative_pics": 2, "num_positive_pics": 1, "delta_poc_s0_minus1[1]": 1, "delta_poc_s1_minus1[0]": 1, "used_by_curr_pic_s0_flag[0]": 1, "used_by_curr_pic_s1_flag[0]": 1}, in_slice=True)
    assert own == ([(-1, True), (-3, False)], [(2, True)])
    moved = {"inter_ref_pic_set_prediction_flag": 1, "delta_rps_sign": 1, "abs_delta_rps_minus1": 1}
    moved |= {"used_by_curr_pic_flag[0]": 1, "use_delta_flag[1]": 1, "used_by_curr_pic_flag[2]": 1, "used_by_curr_pic_flag[3]": 1}
    # -1 - 2 = -3 used, -3 - 2 = -5 kept but not used, 2 - 2 = 0 is the picture itself, 0 - 2 = -2 used
    assert coded(moved, 1, [own], True) == ([(-2, True), (-3, True), (-5, False)], [])
    with pytest.raises(IndexError):
        coded(moved | {"delta_idx_minus1": 3}, 1, [own], True)


def test_lists_with_long_term_pictures_and_chosen_entries():
    sps = {"long_term_ref_pics_present_flag": 1, "num_long_term_ref_pics_sps": 2, "lt_ref_pic_poc_lsb_sps[1]": 9, "used_by_curr_pic_lt_sps_flag[1]": 1, "pic_width_in_luma_samples": 64, "pic_height_in_luma_samples": 64, "chroma_format_idc": 1}
    pps = {"lists_modification_present_flag": 1}
    sets = [([(-2, True), (-4, False)], [(3, True)])]
    v = {"first_slice_segment_in_pic_flag": 1, "short_term_ref_pic_set_sps_flag": 1, "num_long_term_sps": 1, "lt_idx_sps[0]": 1, "num_long_term_pics": 1, "poc_lsb_lt[1]": 5}
    v |= {"num_ref_idx_active_override_flag": 1, "num_ref_idx_l0_active_minus1": 4, "num_ref_idx_l1_active_minus1": 1, "ref_pic_list_modification_flag_l1": 1, "list_entry_l1[0]": 2, "list_entry_l1[1]": 0}
    make = lambda: headers.slice_header(1, sps, sets, pps)
    _, found, _ = headers.read(headers.write(v, make()) + b"\0", make())
    kind, before, behind, list0, list1 = found
    assert (kind, before, behind) == (0, [-2], [3])
    assert list0 == [(-2, False), (3, False), (9, True), (-2, False), (3, False)]
    assert list1 == [(9, True), (3, False)]


def test_sets_that_are_active(spark):
    """A set sent anew counts from there on; a slice without its sets, or cut short, is told."""
    sps = lambda number, width: headers.write({"sps_seq_parameter_set_id": number, "pic_width_in_luma_samples": width, "pic_height_in_luma_samples": 64}, headers.sequence_set())
    pps = lambda number, of, qp: headers.write({"pps_pic_parameter_set_id": number, "pps_seq_parameter_set_id": of, "init_qp_minus26": qp}, headers.picture_set())
    header = lambda number: headers.write({"first_slice_segment_in_pic_flag": 1, "slice_pic_parameter_set_id": number, "slice_type": 2}, headers.slice_header(19, {}, [], {}))
    rows = [
        (0, 33, sps(0, 100)),
        (1, 19, header(3)),  # no picture set yet
        (2, 34, pps(3, 0, 1)),
        (3, 19, header(3)),
        (4, 33, sps(0, 200)),
        (5, 33, sps(1, 300)),
        (6, 19, header(3)),
        (7, 34, pps(3, 1, 2)),
        (8, 34, pps(4, 7, 0)),
        (9, 34, b"\x01"),  # cannot be read
        (10, 19, header(3)),
        (11, 19, header(4)),  # its sequence set is not there
        (12, 19, header(3)[:1]),
        (13, 20, b""),
        (14, 39, b"\x01"),
    ]
    df = spark.createDataFrame([(1, i, t, bytearray(d)) for i, t, d in rows] + [(2, 0, 19, bytearray(header(3)))], "stream_id long, seq int, nal_type int, rbsp binary").repartition(3)
    got = {(r["stream_id"], r["seq"]): r for r in headers.slice_headers(df).collect()}
    assert set(got) == {(1, i) for i in (1, 3, 6, 10, 11, 12, 13)} | {(2, 0)}
    told = {k: (r["sps"]["pic_width_in_luma_samples"], r["pps"]["init_qp_minus26"]) for k, r in got.items() if r["error"] is None}
    assert told == {(1, 3): (100, 1), (1, 6): (200, 1), (1, 10): (300, 2)}
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {(1, 1): "no set", (1, 11): "no set", (1, 12): "cut short", (1, 13): "no set", (2, 0): "no set"}
    sets = {r["seq"]: (r["kind"], r["id"], r["uses"]) for r in headers.parameter_sets(df).collect()}
    assert sets[9] == ("pps", None, None) and sets[8] == ("pps", 4, 7) and sets[5] == ("sps", 1, None)


def test_payload_of_a_packet():
    assert payload_of(bytes.fromhex(SPS) + b"\0\0") == bytes.fromhex(SPS)[2:].replace(b"\0\0\3", b"\0\0")


def test_slices_tell_what_is_wanted(spark):
    """A sequence set's hundreds of values do not go out with every slice if a few are asked for."""
    sps = headers.write({"pic_width_in_luma_samples": 64, "pic_height_in_luma_samples": 64, "scaling_list_enabled_flag": 1, "sps_scaling_list_data_present_flag": 1}, headers.sequence_set())
    rows = [(1, 0, 33, sps), (1, 1, 34, headers.write({"init_qp_minus26": 3}, headers.picture_set())), (1, 2, 19, headers.write({"first_slice_segment_in_pic_flag": 1, "slice_type": 2, "slice_qp_delta": 4}, headers.slice_header(19, {}, [], {})))]
    df = spark.createDataFrame([(*r[:3], bytearray(r[3])) for r in rows], "stream_id long, seq int, nal_type int, rbsp binary")
    r = headers.slice_headers(df, ("pic_width_in_luma_samples", "init_qp_minus26", "slice_qp_delta")).first()
    assert (r["sps"], r["pps"], r["fields"], r["error"]) == ({"pic_width_in_luma_samples": 64}, {"init_qp_minus26": 3}, {"slice_qp_delta": 4}, None)
    assert len(headers.slice_headers(df).first()["sps"]) > 40
