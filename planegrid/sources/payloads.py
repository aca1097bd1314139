"""Messages of coded streams, each payload read whole by the syntax of its type (annex D of the H.265 text).

Syntaxes are generators, as in headers; those of timing and buffering depend on the sequence set that was sent last, which
comes to a message by a window over its stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.plans.registry import query
from planegrid.sources.annexb import slices
from planegrid.sources.headers import SE, UE, Syntax, _each, read, sequence_set, write
from planegrid.sources.tables import table

Values = dict[str, int]


def _plain(*fields: tuple[str, int | str]) -> Callable[..., Syntax]:
    """Fields one after the other, whatever their values."""

    def go(sps: Values, size: int) -> Syntax:
        for names, code in fields:
            yield from _each(names, code)

    return go


def _unless(cancel: str, number: str | None, rest: Callable[..., Syntax]) -> Callable[..., Syntax]:
    """A payload that may have a number, and that nothing follows if its cancel flag is set."""

    def go(sps: Values, size: int) -> Syntax:
        if number:
            yield number, UE
        if not (yield cancel, 1):
            yield from rest(sps, size)

    return go


def _delays(sps: Values) -> tuple[bool, bool, bool]:
    """Whether the sequence has buffer models for packets, for slices, and parts of pictures."""
    return bool(sps.get("nal_hrd_parameters_present_flag")), bool(sps.get("vcl_hrd_parameters_present_flag")), bool(sps.get("sub_pic_hrd_params_present_flag"))


def buffering_period(sps: Values, size: int) -> Syntax:
    nal, vcl, parts = _delays(sps)
    removal = sps.get("au_cpb_removal_delay_length_minus1", 23) + 1
    initial = sps.get("initial_cpb_removal_delay_length_minus1", 23) + 1
    yield "bp_seq_parameter_set_id", UE
    again = 0 if parts else (yield "irap_cpb_params_present_flag", 1)
    if again:
        yield "cpb_delay_offset", removal
        yield "dpb_delay_offset", sps.get("dpb_output_delay_length_minus1", 23) + 1
    yield "concatenation_flag", 1
    yield "au_cpb_removal_delay_delta_minus1", removal
    top = sps.get("sps_max_sub_layers_minus1", 0)
    for kind, there in (("nal", nal), ("vcl", vcl)):
        for i in range(sps.get(f"cpb_cnt_minus1[{top}]", 0) + 1 if there else 0):
            yield from _each(f"{kind}_initial_cpb_removal_delay {kind}_initial_cpb_removal_offset", initial, f"[{i}]")
            if parts or again:
                yield from _each(f"{kind}_initial_alt_cpb_removal_delay {kind}_initial_alt_cpb_removal_offset", initial, f"[{i}]")


def picture_timing(sps: Values, size: int) -> Syntax:
    nal, vcl, parts = _delays(sps)
    if sps.get("frame_field_info_present_flag"):
        yield "pic_struct", 4
        yield "source_scan_type", 2
        yield "duplicate_flag", 1
    if nal or vcl:
        yield "au_cpb_removal_delay_minus1", sps.get("au_cpb_removal_delay_length_minus1", 23) + 1
        yield "pic_dpb_output_delay", sps.get("dpb_output_delay_length_minus1", 23) + 1
        if parts:
            yield "pic_dpb_output_du_delay", sps.get("dpb_output_delay_du_length_minus1", 0) + 1
            if sps.get("sub_pic_cpb_params_in_pic_timing_sei_flag"):
                n = (yield "num_decoding_units_minus1", UE) + 1
                step = sps.get("du_cpb_removal_delay_increment_length_minus1", 0) + 1
                common = yield "du_common_cpb_removal_delay_flag", 1
                if common:
                    yield "du_common_cpb_removal_delay_increment_minus1", step
                for i in range(n):
                    yield f"num_nalus_in_du_minus1[{i}]", UE
                    if not common and i < n - 1:
                        yield f"du_cpb_removal_delay_increment_minus1[{i}]", step


def _pan_scan(sps: Values, size: int) -> Syntax:
    for i in range((yield "pan_scan_cnt_minus1", UE) + 1):
        yield from _each("pan_scan_rect_left_offset pan_scan_rect_right_offset pan_scan_rect_top_offset pan_scan_rect_bottom_offset", SE, f"[{i}]")
    yield "pan_scan_rect_persistence_flag", 1


def _bytes(name: str, skipped: int = 0) -> Callable[..., Syntax]:
    def go(sps: Values, size: int) -> Syntax:
        for i in range(size - skipped):
            yield f"{name}[{i}]", 8

    return go


def registered_data(sps: Values, size: int) -> Syntax:
    used = 1
    if (yield "itu_t_t35_country_code", 8) == 255:
        yield "itu_t_t35_country_code_extension_byte", 8
        used = 2
    yield from _bytes("itu_t_t35_payload_byte", used)(sps, size)


def unregistered_data(sps: Values, size: int) -> Syntax:
    for i in range(4):
        yield f"uuid_iso_iec_11578[{i}]", 32
    yield from _bytes("user_data_payload_byte", 16)(sps, size)


def scene_info(sps: Values, size: int) -> Syntax:
    if (yield "scene_info_present_flag", 1):
        yield "prev_scene_id_valid_flag", 1
        yield "scene_id", UE
        if (yield "scene_transition_type", UE) > 3:
            yield "second_scene_id", UE


def _film_grain(sps: Values, size: int) -> Syntax:
    yield "film_grain_model_id", 2
    if (yield "separate_colour_description_present_flag", 1):
        yield from _each("film_grain_bit_depth_luma_minus8 film_grain_bit_depth_chroma_minus8", 3)
        yield "film_grain_full_range_flag", 1
        yield from _each("film_grain_colour_primaries film_grain_transfer_characteristics film_grain_matrix_coeffs", 8)
    yield "blending_mode_id", 2
    yield "log2_scale_factor", 4
    present = []
    for c in range(3):
        present.append((yield f"comp_model_present_flag[{c}]", 1))
    for c in range(3):
        if present[c]:
            intervals = (yield f"num_intensity_intervals_minus1[{c}]", 8) + 1
            values = (yield f"num_model_values_minus1[{c}]", 3) + 1
            for i in range(intervals):
                yield from _each("intensity_interval_lower_bound intensity_interval_upper_bound", 8, f"[{c}][{i}]")
                for j in range(values):
                    yield f"comp_model_value[{c}][{i}][{j}]", SE
    yield "film_grain_characteristics_persistence_flag", 1


def post_filter_hint(sps: Values, size: int) -> Syntax:
    rows, columns = yield from _each("filter_hint_size_y filter_hint_size_x", UE)
    yield "filter_hint_type", 2
    for c in range(3):
        for y in range(rows):
            for x in range(columns):
                yield f"filter_hint_value[{c}][{y}][{x}]", SE


def _tone_mapping(sps: Values, size: int) -> Syntax:
    yield "tone_map_persistence_flag", 1
    coded, target = yield from _each("coded_data_bit_depth target_bit_depth", 8)
    wide = lambda n: (n + 7 >> 3) << 3
    kind = yield "tone_map_model_id", UE
    if kind == 0:
        yield from _each("min_value max_value", 32)
    elif kind == 1:
        yield from _each("sigmoid_midpoint sigmoid_width", 32)
    elif kind == 2:
        for i in range(1 << target):
            yield f"start_of_coded_interval[{i}]", wide(coded)
    elif kind == 3:
        for i in range((yield "num_pivots", 16)):
            yield f"coded_pivot_value[{i}]", wide(coded)
            yield f"target_pivot_value[{i}]", wide(target)
    elif kind == 4:
        for name in ("camera_iso_speed", "exposure_index"):
            if (yield f"{name}_idc", 8) == 255:
                yield f"{name}_value", 32
        yield "exposure_compensation_value_sign_flag", 1
        yield from _each("exposure_compensation_value_numerator exposure_compensation_value_denom_idc", 16)
        yield from _each("ref_screen_luminance_white extended_range_white_level", 32)
        yield from _each("nominal_black_level_code_value nominal_white_level_code_value extended_white_level_code_value", 16)


def _frame_packing(sps: Values, size: int) -> Syntax:
    kind = yield "frame_packing_arrangement_type", 7
    quincunx = yield "quincunx_sampling_flag", 1
    yield "content_interpretation_type", 6
    yield from _each("spatial_flipping_flag frame0_flipped_flag field_views_flag current_frame_is_frame0_flag frame0_self_contained_flag frame1_self_contained_flag", 1)
    if not quincunx and kind != 5:
        yield from _each("frame0_grid_position_x frame0_grid_position_y frame1_grid_position_x frame1_grid_position_y", 4)
    yield "frame_packing_arrangement_reserved_byte", 8
    yield "frame_packing_arrangement_persistence_flag", 1


def structure_of_pictures(sps: Values, size: int) -> Syntax:
    yield "sop_seq_parameter_set_id", UE
    for i in range((yield "num_entries_in_sop_minus1", UE) + 1):
        kind = yield f"sop_vcl_nut[{i}]", 6
        yield f"sop_temporal_id[{i}]", 3
        if kind not in (19, 20):
            yield f"sop_short_term_rps_idx[{i}]", UE
        if i:
            yield f"sop_poc_delta[{i}]", SE


def active_sets(sps: Values, size: int) -> Syntax:
    yield "active_video_parameter_set_id", 4
    yield from _each("self_contained_cvs_flag no_parameter_set_update_flag", 1)
    for i in range((yield "num_sps_ids_minus1", UE) + 1):
        yield f"active_seq_parameter_set_id[{i}]", UE


def picture_hash(sps: Values, size: int) -> Syntax:
    kind = yield "hash_type", 8
    width = {0: 16, 1: 2, 2: 4}.get(kind, 0)
    for c in range((size - 1) // width if width else 0):
        for i in range(width):
            yield f"picture_hash[{c}][{i}]", 8


def time_code(sps: Values, size: int) -> Syntax:
    for i in range((yield "num_clock_ts", 2)):
        at = f"[{i}]"
        if (yield f"clock_timestamp_flag{at}", 1):
            yield f"units_field_based_flag{at}", 1
            yield f"counting_type{at}", 5
            full = yield f"full_timestamp_flag{at}", 1
            yield from _each("discontinuity_flag cnt_dropped_flag", 1, at)
            yield f"n_frames{at}", 9
            for name, code in (("seconds", 6), ("minutes", 6), ("hours", 5)):
                if not full and not (yield f"{name}_flag{at}", 1):
                    break
                yield f"{name}_value{at}", code
            n = yield f"time_offset_length{at}", 5
            if n:
                yield f"time_offset_value{at}", n


def _knee(sps: Values, size: int) -> Syntax:
    yield "knee_function_persistence_flag", 1
    yield from _each("input_d_range input_disp_luminance output_d_range output_disp_luminance", 32)
    for i in range((yield "num_knee_points_minus1", UE) + 1):
        yield from _each("input_knee_point output_knee_point", 10, f"[{i}]")


def _colour_remapping(sps: Values, size: int) -> Syntax:
    yield "colour_remap_persistence_flag", 1
    if (yield "colour_remap_video_signal_info_present_flag", 1):
        yield "colour_remap_full_range_flag", 1
        yield from _each("colour_remap_primaries colour_remap_transfer_function colour_remap_matrix_coefficients", 8)
    depths = yield from _each("colour_remap_input_bit_depth colour_remap_output_bit_depth", 8)
    wide = [(n + 7 >> 3) << 3 for n in depths]

    def tables(name: str) -> Syntax:
        for c in range(3):
            n = yield f"{name}_lut_num_val_minus1[{c}]", 8
            for i in range(n + 1 if n else 0):
                yield f"{name}_lut_coded_value[{c}][{i}]", wide[0]
                yield f"{name}_lut_target_value[{c}][{i}]", wide[1]

    yield from tables("pre")
    if (yield "colour_remap_matrix_present_flag", 1):
        yield "log2_matrix_denom", 4
        for c in range(3):
            for i in range(3):
                yield f"colour_remap_coeffs[{c}][{i}]", SE
    yield from tables("post")


def _alpha(sps: Values, size: int) -> Syntax:
    yield "alpha_channel_use_idc", 3
    bits = (yield "alpha_channel_bit_depth_minus8", 3) + 9
    yield from _each("alpha_transparent_value alpha_opaque_value", bits)
    yield "alpha_channel_incr_flag", 1
    if (yield "alpha_channel_clip_flag", 1):
        yield "alpha_channel_clip_type_flag", 1


#: Syntaxes by payload type.
PAYLOADS: dict[int, Callable[..., Syntax]] = {
    0: buffering_period,
    1: picture_timing,
    2: _unless("pan_scan_rect_cancel_flag", "pan_scan_rect_id", _pan_scan),
    3: _bytes("ff_byte"),
    4: registered_data,
    5: unregistered_data,
    6: _plain(("recovery_poc_cnt", SE), ("exact_match_flag broken_link_flag", 1)),
    9: scene_info,
    15: _plain(("snapshot_id", UE)),
    16: _plain(("progressive_refinement_id pic_order_cnt_delta", UE)),
    17: _plain(("progressive_refinement_id", UE)),
    19: _unless("film_grain_characteristics_cancel_flag", None, _film_grain),
    22: post_filter_hint,
    23: _unless("tone_map_cancel_flag", "tone_map_id", _tone_mapping),
    45: _unless("frame_packing_arrangement_cancel_flag", "frame_packing_arrangement_id", _frame_packing),
    47: _unless("display_orientation_cancel_flag", None, _plain(("hor_flip ver_flip", 1), ("anticlockwise_rotation", 16), ("display_orientation_persistence_flag", 1))),
    128: structure_of_pictures,
    129: active_sets,
    131: _plain(("temporal_sub_layer_zero_idx irap_pic_id", 8)),
    132: picture_hash,
    134: _plain(("refreshed_region_flag", 1)),
    135: _plain(),
    136: time_code,
    137: _plain(("display_primaries_x0 display_primaries_y0 display_primaries_x1 display_primaries_y1 display_primaries_x2 display_primaries_y2 white_point_x white_point_y", 16), ("max_display_mastering_luminance min_display_mastering_luminance", 32)),
    138: _unless("segmented_rect_frame_packing_arrangement_cancel_flag", None, _plain(("segmented_rect_content_interpretation_type", 2), ("segmented_rect_frame_packing_arrangement_persistence_flag", 1))),
    141: _unless("knee_function_cancel_flag", "knee_function_id", _knee),
    142: _unless("colour_remap_cancel_flag", "colour_remap_id", _colour_remapping),
    143: _plain(("deinterlaced_picture_source_parity_flag", 1)),
    144: _plain(("max_content_light_level max_pic_average_light_level", 16)),
    147: _plain(("preferred_transfer_characteristics", 8)),
    165: _unless("alpha_channel_cancel_flag", None, _alpha),
}


def messages(data: bytes) -> list[tuple[int, bytes | None]]:
    """(type, payload) of a packet's messages; a payload that is longer than the packet is None and the last one."""
    out, at = [], 0

    def number(at: int) -> tuple[int, int]:
        n = 0
        while data[at] == 255:
            n, at = n + 255, at + 1
        return n + data[at], at + 1

    while at < len(data):
        kind, at = number(at)
        size, at = number(at)
        if at + size > len(data):
            return [*out, (kind, None)]
        out.append((kind, data[at : at + size]))
        at += size
    return out


def sei_payloads(packets: DataFrame) -> DataFrame:
    """(stream_id, seq, nal_type, rbsp) to a row per message: stream_id, seq, number, payload_type, size, fields and error.

    A message is read with the sequence set sent last before it in its stream. Fields are null for a type without a
    syntax here ("unknown"), where the payload ends early ("cut short"), and where the packet does ("no message" if not even a
    header stands).
    """
    own = packets.where("nal_type IN (33, 39, 40)").select(F.col("stream_id").cast("long"), F.col("seq").cast("int"), F.col("nal_type").cast("int"), "rbsp")
    order = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("sps", F.last(F.when(F.col("nal_type") == 33, F.col("rbsp")), ignorenulls=True).over(order)).where("nal_type <> 33")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Values] = {}
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.int64()), pa.string())
        for b in slices(batches):
            rows = []
            for stream_id, seq, data, sps in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if sps is not None and sps not in known:
                    try:
                        known[sps] = read(sps, sequence_set())[0]
                    except (IndexError, OverflowError):
                        known[sps] = {}
                try:
                    found = messages(data or b"")
                except IndexError:
                    rows.append((stream_id, seq, 0, None, None, None, "no message"))
                    continue
                for i, (kind, payload) in enumerate(found):
                    fields, error = None, None
                    if payload is None:
                        error = "cut short"
                    elif kind not in PAYLOADS:
                        error = "unknown"
                    else:
                        try:
                            fields = list(read(payload, PAYLOADS[kind](known.get(sps, {}), len(payload)))[0].items())
                        except (IndexError, OverflowError):
                            error = "cut short"
                    rows.append((stream_id, seq, i, kind, None if payload is None else len(payload), fields, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], ["stream_id", "seq", "number", "payload_type", "size", "fields", "error"])

    return own.mapInArrow(run, "stream_id long, seq int, number int, payload_type int, size int, fields map<string,bigint>, error string")


#: Types of the query's messages, with the names and ranges of their values: value k of an order is (key * (k + 3) + type) % range.
_MADE = (
    (6, (("recovery_poc_cnt", 900), ("exact_match_flag", 2), ("broken_link_flag", 2))),
    (16, (("progressive_refinement_id", 70000), ("pic_order_cnt_delta", 300))),
    (131, (("temporal_sub_layer_zero_idx", 256), ("irap_pic_id", 256))),
    (144, (("max_content_light_level", 65536), ("max_pic_average_light_level", 4000))),
    (147, (("preferred_transfer_characteristics", 256),)),
)


def _sql_value(k: int, kind: int, most: int) -> str:
    return f"((o_orderkey * {k + 3} + {kind}) % {most})"


@query(
    "sei_fields",
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT o_orderkey, {i} AS number, {kind} AS payload_type, unnest([{', '.join(repr(n) for n, _ in fields)}]) AS name, unnest([{', '.join(_sql_value(k, kind, m) for k, (_, m) in enumerate(fields))}])::BIGINT AS value FROM orders" for i, (kind, fields) in enumerate(_MADE))
    + ") SELECT o_orderkey, number::INT AS number, payload_type::INT AS payload_type, name, value FROM m",
)
def sei_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet of five messages per order, written and read field by field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = []
            for key in b.column(0).to_pylist():
                data = b""
                for kind, fields in _MADE:
                    payload = write({n: (key * (k + 3) + kind) % m for k, (n, m) in enumerate(fields)}, PAYLOADS[kind]({}, 0))
                    data += bytes([kind, len(payload)]) + payload
                made.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * len(b), pa.int32()), pa.array([39] * len(b), pa.int32()), pa.array(made, pa.binary())], ["stream_id", "seq", "nal_type", "rbsp"])

    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("stream_id")).repartition("stream_id")
    found = sei_payloads(keys.mapInArrow(run, "stream_id long, seq int, nal_type int, rbsp binary"))
    return found.select(F.col("stream_id").alias("o_orderkey"), "number", "payload_type", F.explode("fields").alias("name", "value"))
