"""Whole parameter sets and slice headers, each slice read with the sets that are active for it.

A syntax is a generator: it yields the name and code of the next field and is sent its value, so conditions, loops and
predicted parts are plain Python, and one text of a syntax serves reading and writing. Codes are the number of bits, or
UE and SE for Exp-Golomb codes. What a set is by itself is read first; the sets of a slice come to it by as-of joins over
packets, a window each over the picture set's and the sequence set's number; then the slice's header is read with both.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planegrid.operators.references import _EDGES, SOP, dockets, stream
from planegrid.plans.registry import query
from planegrid.sources.annexb import slices, tokenize, write_stream
from planegrid.sources.syntax import Bits

UE, SE = "ue", "se"
Syntax = Generator[tuple[str, int | str], int, Any]
#: A reference set: distances of pictures before, then behind, the nearest first, each with whether the picture itself uses it.
Distances = tuple[list[tuple[int, bool]], list[tuple[int, bool]]]


def read(data: bytes, syntax: Syntax) -> tuple[dict[str, int], Any, int]:
    """A record's fields, what its syntax returns, and the bits read. IndexError where the record ends early."""
    bits, out = Bits(data), {}
    try:
        name, code = next(syntax)
        while True:
            x = out[name] = bits.ue() if code == UE else bits.se() if code == SE else bits.u(code) if code else 0
            name, code = syntax.send(x)
    except StopIteration as end:
        return out, end.value, bits.at


def write(values: dict[str, int], syntax: Syntax) -> bytes:
    """A record's bits, filled with zeros to whole bytes; fields without a value are 0."""
    out = []
    try:
        name, code = next(syntax)
        while True:
            x = values.get(name, 0)
            if isinstance(code, int):
                out.append(format(x, f"0{code}b") if code else "")
            else:
                k = x if code == UE else 2 * x - 1 if x > 0 else -2 * x
                out.append("0" * ((k + 1).bit_length() - 1) + format(k + 1, "b"))
            name, code = syntax.send(x)
    except StopIteration:
        text = "".join(out)
        text += "0" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big")


def _each(names: str, code: int | str, at: str = "") -> Syntax:
    """Fields of one code; the list of their values."""
    out = []
    for n in names.split():
        out.append((yield n + at, code))
    return out


def _bits_for(n: int) -> int:
    """Bits of a number below n."""
    return max(0, n - 1).bit_length()


def _profile(kind: str, at: str = "") -> Syntax:
    for name, code in (("profile_space", 2), ("tier_flag", 1), ("profile_idc", 5), ("profile_compatibility_flags", 32), ("constraint_flags", 48)):
        yield f"{kind}_{name}{at}", code


def profile_tier_level(sub_layers: int) -> Syntax:
    yield from _profile("general")
    yield "general_level_idc", 8
    present = []
    for i in range(sub_layers):
        present.append((yield from _each("sub_layer_profile_present_flag sub_layer_level_present_flag", 1, f"[{i}]")))
    for i in range(sub_layers, 8 if sub_layers else 0):
        yield f"reserved_zero_2bits[{i}]", 2
    for i, (profile, level) in enumerate(present):
        if profile:
            yield from _profile("sub_layer", f"[{i}]")
        if level:
            yield f"sub_layer_level_idc[{i}]", 8


def scaling_lists() -> Syntax:
    for size in range(4):
        for matrix in range(6 if size < 3 else 2):
            at = f"[{size}][{matrix}]"
            if (yield f"scaling_list_pred_mode_flag{at}", 1):
                if size > 1:
                    yield f"scaling_list_dc_coef_minus8{at}", SE
                for i in range(16 if size == 0 else 64):
                    yield f"scaling_list_delta_coef{at}[{i}]", SE
            else:
                yield f"scaling_list_pred_matrix_id_delta{at}", UE


def reference_set(index: int, sets: list[Distances], in_slice: bool = False) -> Syntax:
    """A set of distances, coded by itself or moved by some distance from an earlier one."""
    at = "" if in_slice else f"[{index}]"
    if index and (yield f"inter_ref_pic_set_prediction_flag{at}", 1):
        back = (yield f"delta_idx_minus1{at}", UE) + 1 if in_slice else 1
        negative = yield f"delta_rps_sign{at}", 1
        move = ((yield f"abs_delta_rps_minus1{at}", UE) + 1) * (-1 if negative else 1)
        if back > index:
            raise IndexError("no set so far back")
        found = {}
        for j, (d, _) in enumerate([*sets[index - back][0], *sets[index - back][1], (0, True)]):
            used = yield f"used_by_curr_pic_flag{at}[{j}]", 1
            kept = used or (yield f"use_delta_flag{at}[{j}]", 1)
            if kept and d + move:
                found[d + move] = bool(used)
        return [(d, found[d]) for d in sorted(found, reverse=True) if d < 0], [(d, found[d]) for d in sorted(found) if d > 0]
    counts = yield from _each("num_negative_pics num_positive_pics", UE, at)
    out: Distances = ([], [])
    for side, (n, sign) in enumerate(zip(counts, (-1, 1))):
        d = 0
        for i in range(n):
            d += sign * ((yield f"delta_poc_s{side}_minus1{at}[{i}]", UE) + 1)
            out[side].append((d, bool((yield f"used_by_curr_pic_s{side}_flag{at}[{i}]", 1))))
    return out


def buffer_model(sub_layers: int) -> Syntax:
    """hrd_parameters with its common part."""
    kinds = yield from _each("nal_hrd_parameters_present_flag vcl_hrd_parameters_present_flag", 1)
    parts = 0
    if any(kinds):
        parts = yield "sub_pic_hrd_params_present_flag", 1
        if parts:
            yield "tick_divisor_minus2", 8
            yield "du_cpb_removal_delay_increment_length_minus1", 5
            yield "sub_pic_cpb_params_in_pic_timing_sei_flag", 1
            yield "dpb_output_delay_du_length_minus1", 5
        yield from _each("bit_rate_scale cpb_size_scale", 4)
        if parts:
            yield "cpb_size_du_scale", 4
        yield from _each("initial_cpb_removal_delay_length_minus1 au_cpb_removal_delay_length_minus1 dpb_output_delay_length_minus1", 5)
    for i in range(sub_layers + 1):
        fixed = yield f"fixed_pic_rate_general_flag[{i}]", 1
        fixed = fixed or (yield f"fixed_pic_rate_within_cvs_flag[{i}]", 1)
        low = 0
        if fixed:
            yield f"elemental_duration_in_tc_minus1[{i}]", UE
        else:
            low = yield f"low_delay_hrd_flag[{i}]", 1
        n = 1 if low else (yield f"cpb_cnt_minus1[{i}]", UE) + 1
        for kind, there in zip(("nal", "vcl"), kinds):
            for k in range(n if there else 0):
                at = f"_{kind}[{i}][{k}]"
                yield from _each("bit_rate_value_minus1 cpb_size_value_minus1", UE, at)
                if parts:
                    yield from _each("cpb_size_du_value_minus1 bit_rate_du_value_minus1", UE, at)
                yield f"cbr_flag{at}", 1


def usability(sub_layers: int) -> Syntax:
    """vui_parameters."""
    if (yield "aspect_ratio_info_present_flag", 1) and (yield "aspect_ratio_idc", 8) == 255:
        yield from _each("sar_width sar_height", 16)
    if (yield "overscan_info_present_flag", 1):
        yield "overscan_appropriate_flag", 1
    if (yield "video_signal_type_present_flag", 1):
        yield "video_format", 3
        yield "video_full_range_flag", 1
        if (yield "colour_description_present_flag", 1):
            yield from _each("colour_primaries transfer_characteristics matrix_coeffs", 8)
    if (yield "chroma_loc_info_present_flag", 1):
        yield from _each("chroma_sample_loc_type_top_field chroma_sample_loc_type_bottom_field", UE)
    yield from _each("neutral_chroma_indication_flag field_seq_flag frame_field_info_present_flag", 1)
    if (yield "default_display_window_flag", 1):
        yield from _each("def_disp_win_left_offset def_disp_win_right_offset def_disp_win_top_offset def_disp_win_bottom_offset", UE)
    if (yield "vui_timing_info_present_flag", 1):
        yield from _each("vui_num_units_in_tick vui_time_scale", 32)
        if (yield "vui_poc_proportional_to_timing_flag", 1):
            yield "vui_num_ticks_poc_diff_one_minus1", UE
        if (yield "vui_hrd_parameters_present_flag", 1):
            yield from buffer_model(sub_layers)
    if (yield "bitstream_restriction_flag", 1):
        yield from _each("tiles_fixed_structure_flag motion_vectors_over_pic_boundaries_flag restricted_ref_pic_lists_flag", 1)
        yield from _each("min_spatial_segmentation_idc max_bytes_per_pic_denom max_bits_per_min_cu_denom log2_max_mv_length_horizontal log2_max_mv_length_vertical", UE)


def sequence_set() -> Syntax:
    """seq_parameter_set_rbsp; returns its reference sets. Extensions but for the one of ranges are not read."""
    yield "sps_video_parameter_set_id", 4
    sub_layers = yield "sps_max_sub_layers_minus1", 3
    yield "sps_temporal_id_nesting_flag", 1
    yield from profile_tier_level(sub_layers)
    yield "sps_seq_parameter_set_id", UE
    if (yield "chroma_format_idc", UE) == 3:
        yield "separate_colour_plane_flag", 1
    yield from _each("pic_width_in_luma_samples pic_height_in_luma_samples", UE)
    if (yield "conformance_window_flag", 1):
        yield from _each("conf_win_left_offset conf_win_right_offset conf_win_top_offset conf_win_bottom_offset", UE)
    _, _, lsb = yield from _each("bit_depth_luma_minus8 bit_depth_chroma_minus8 log2_max_pic_order_cnt_lsb_minus4", UE)
    all_layers = yield "sps_sub_layer_ordering_info_present_flag", 1
    for i in range(0 if all_layers else sub_layers, sub_layers + 1):
        yield from _each("sps_max_dec_pic_buffering_minus1 sps_max_num_reorder_pics sps_max_latency_increase_plus1", UE, f"[{i}]")
    yield from _each("log2_min_luma_coding_block_size_minus3 log2_diff_max_min_luma_coding_block_size log2_min_luma_transform_block_size_minus2", UE)
    yield from _each("log2_diff_max_min_luma_transform_block_size max_transform_hierarchy_depth_inter max_transform_hierarchy_depth_intra", UE)
    if (yield "scaling_list_enabled_flag", 1) and (yield "sps_scaling_list_data_present_flag", 1):
        yield from scaling_lists()
    yield from _each("amp_enabled_flag sample_adaptive_offset_enabled_flag", 1)
    if (yield "pcm_enabled_flag", 1):
        yield from _each("pcm_sample_bit_depth_luma_minus1 pcm_sample_bit_depth_chroma_minus1", 4)
        yield from _each("log2_min_pcm_luma_coding_block_size_minus3 log2_diff_max_min_pcm_luma_coding_block_size", UE)
        yield "pcm_loop_filter_disabled_flag", 1
    sets: list[Distances] = []
    for i in range((yield "num_short_term_ref_pic_sets", UE)):
        sets.append((yield from reference_set(i, sets)))
    if (yield "long_term_ref_pics_present_flag", 1):
        for i in range((yield "num_long_term_ref_pics_sps", UE)):
            yield f"lt_ref_pic_poc_lsb_sps[{i}]", lsb + 4
            yield f"used_by_curr_pic_lt_sps_flag[{i}]", 1
    yield from _each("sps_temporal_mvp_enabled_flag strong_intra_smoothing_enabled_flag", 1)
    if (yield "vui_parameters_present_flag", 1):
        yield from usability(sub_layers)
    if (yield "sps_extension_present_flag", 1):
        more = yield "sps_range_extension_flag", 1
        yield "sps_extension_7bits", 7
        if more:
            yield from _each("transform_skip_rotation_enabled_flag transform_skip_context_enabled_flag implicit_rdpcm_enabled_flag explicit_rdpcm_enabled_flag extended_precision_processing_flag", 1)
            yield from _each("intra_smoothing_disabled_flag high_precision_offsets_enabled_flag persistent_rice_adaptation_enabled_flag cabac_bypass_alignment_enabled_flag", 1)
    return sets


def picture_set() -> Syntax:
    """pic_parameter_set_rbsp."""
    yield from _each("pps_pic_parameter_set_id pps_seq_parameter_set_id", UE)
    yield from _each("dependent_slice_segments_enabled_flag output_flag_present_flag", 1)
    yield "num_extra_slice_header_bits", 3
    yield from _each("sign_data_hiding_enabled_flag cabac_init_present_flag", 1)
    yield from _each("num_ref_idx_l0_default_active_minus1 num_ref_idx_l1_default_active_minus1", UE)
    yield "init_qp_minus26", SE
    _, skip, delta = yield from _each("constrained_intra_pred_flag transform_skip_enabled_flag cu_qp_delta_enabled_flag", 1)
    if delta:
        yield "diff_cu_qp_delta_depth", UE
    yield from _each("pps_cb_qp_offset pps_cr_qp_offset", SE)
    *_, tiles, _ = yield from _each("pps_slice_chroma_qp_offsets_present_flag weighted_pred_flag weighted_bipred_flag transquant_bypass_enabled_flag tiles_enabled_flag entropy_coding_sync_enabled_flag", 1)
    if tiles:
        columns, rows = yield from _each("num_tile_columns_minus1 num_tile_rows_minus1", UE)
        if not (yield "uniform_spacing_flag", 1):
            for i in range(columns):
                yield f"column_width_minus1[{i}]", UE
            for i in range(rows):
                yield f"row_height_minus1[{i}]", UE
        yield "loop_filter_across_tiles_enabled_flag", 1
    yield "pps_loop_filter_across_slices_enabled_flag", 1
    if (yield "deblocking_filter_control_present_flag", 1):
        _, off = yield from _each("deblocking_filter_override_enabled_flag pps_deblocking_filter_disabled_flag", 1)
        if not off:
            yield from _each("pps_beta_offset_div2 pps_tc_offset_div2", SE)
    if (yield "pps_scaling_list_data_present_flag", 1):
        yield from scaling_lists()
    yield "lists_modification_present_flag", 1
    yield "log2_parallel_merge_level_minus2", UE
    yield "slice_segment_header_extension_present_flag", 1
    if (yield "pps_extension_present_flag", 1):
        more = yield "pps_range_extension_flag", 1
        yield "pps_extension_7bits", 7
        if more:
            if skip:
                yield "log2_max_transform_skip_block_size_minus2", UE
            yield "cross_component_prediction_enabled_flag", 1
            if (yield "chroma_qp_offset_list_enabled_flag", 1):
                yield "diff_cu_chroma_qp_offset_depth", UE
                for i in range((yield "chroma_qp_offset_list_len_minus1", UE) + 1):
                    yield from _each("cb_qp_offset_list cr_qp_offset_list", SE, f"[{i}]")
            yield from _each("log2_sao_offset_scale_luma log2_sao_offset_scale_chroma", UE)


def _prediction_weights(colour: bool, active: list[int]) -> Syntax:
    yield "luma_log2_weight_denom", UE
    if colour:
        yield "delta_chroma_log2_weight_denom", SE
    for k, n in enumerate(active):
        flags = []
        for part in ("luma", "chroma")[: 1 + colour]:
            row = []
            for i in range(n):
                row.append((yield f"{part}_weight_l{k}_flag[{i}]", 1))
            flags.append(row)
        for i in range(n):
            if flags[0][i]:
                yield from _each(f"delta_luma_weight_l{k} luma_offset_l{k}", SE, f"[{i}]")
            if colour and flags[1][i]:
                for c in range(2):
                    yield from _each(f"delta_chroma_weight_l{k} delta_chroma_offset_l{k}", SE, f"[{i}][{c}]")


def slice_header(nal_type: int, sps: dict[str, int], sets: list[Distances], pps: dict[str, int]) -> Syntax:
    """slice_segment_header with its sets; returns (type, distances before, behind, lists 0 and 1 of (distance, long)).

    Types are 0 (B), 1 (P) and 2 (I). Long-term pictures stand in the lists by their order count's low bits. A dependent
    segment returns nothing: it has its slice's values.
    """
    s, p = (lambda n: sps.get(n, 0)), (lambda n: pps.get(n, 0))
    first = yield "first_slice_segment_in_pic_flag", 1
    if 16 <= nal_type <= 23:
        yield "no_output_of_prior_pics_flag", 1
    yield "slice_pic_parameter_set_id", UE
    dependent = 0
    if not first:
        if p("dependent_slice_segments_enabled_flag"):
            dependent = yield "dependent_slice_segment_flag", 1
        log = s("log2_min_luma_coding_block_size_minus3") + 3 + s("log2_diff_max_min_luma_coding_block_size")
        units = 1
        for side in ("width", "height"):
            units *= (s(f"pic_{side}_in_luma_samples") + (1 << log) - 1) >> log
        yield "slice_segment_address", _bits_for(units)
    found = None
    if not dependent:
        found = yield from _own_part(nal_type, s, sets, p)
    if p("tiles_enabled_flag") or p("entropy_coding_sync_enabled_flag"):
        n = yield "num_entry_point_offsets", UE
        if n:
            size = (yield "offset_len_minus1", UE) + 1
            for i in range(n):
                yield f"entry_point_offset_minus1[{i}]", size
    if p("slice_segment_header_extension_present_flag"):
        for i in range((yield "slice_segment_header_extension_length", UE)):
            yield f"slice_segment_header_extension_data_byte[{i}]", 8
    return found


def _own_part(nal_type: int, s, sets: list[Distances], p) -> Syntax:  # noqa: ANN001
    """What a slice's first segment has."""
    for i in range(p("num_extra_slice_header_bits")):
        yield f"slice_reserved_flag[{i}]", 1
    kind = yield "slice_type", UE
    if p("output_flag_present_flag"):
        yield "pic_output_flag", 1
    if s("separate_colour_plane_flag"):
        yield "colour_plane_id", 2
    near: Distances = ([], [])
    long: list[int] = []
    motion = 0
    if nal_type not in (19, 20):
        lsb = s("log2_max_pic_order_cnt_lsb_minus4") + 4
        yield "slice_pic_order_cnt_lsb", lsb
        if not (yield "short_term_ref_pic_set_sps_flag", 1):
            near = yield from reference_set(len(sets), sets, True)
        else:
            near = sets[(yield "short_term_ref_pic_set_idx", _bits_for(len(sets)))]
        if s("long_term_ref_pics_present_flag"):
            known = s("num_long_term_ref_pics_sps")
            from_set = (yield "num_long_term_sps", UE) if known else 0
            for i in range(from_set + (yield "num_long_term_pics", UE)):
                if i < from_set:
                    k = yield f"lt_idx_sps[{i}]", _bits_for(known)
                    low, used = s(f"lt_ref_pic_poc_lsb_sps[{k}]"), s(f"used_by_curr_pic_lt_sps_flag[{k}]")
                else:
                    low = yield f"poc_lsb_lt[{i}]", lsb
                    used = yield f"used_by_curr_pic_lt_flag[{i}]", 1
                if used:
                    long.append(low)
                if (yield f"delta_poc_msb_present_flag[{i}]", 1):
                    yield f"delta_poc_msb_cycle_lt[{i}]", UE
        if s("sps_temporal_mvp_enabled_flag"):
            motion = yield "slice_temporal_mvp_enabled_flag", 1
    offsets = [0]
    colour = s("chroma_format_idc") != 0 and not s("separate_colour_plane_flag")
    if s("sample_adaptive_offset_enabled_flag"):
        offsets = yield from _each("slice_sao_luma_flag slice_sao_chroma_flag" if colour else "slice_sao_luma_flag", 1)
    before, behind = ([d for d, used in side if used] for side in near)
    lists: list[list[tuple[int, bool]] | None] = [None, None]
    if kind < 2:
        active = [p(f"num_ref_idx_l{k}_default_active_minus1") + 1 for k in range(2 - kind)]
        if (yield "num_ref_idx_active_override_flag", 1):
            for k in range(len(active)):
                active[k] = (yield f"num_ref_idx_l{k}_active_minus1", UE) + 1
        total = len(before) + len(behind) + len(long)
        chosen: list[list[int] | None] = [None, None]
        if p("lists_modification_present_flag") and total > 1:
            for k, n in enumerate(active):
                if (yield f"ref_pic_list_modification_flag_l{k}", 1):
                    chosen[k] = []
                    for i in range(n):
                        chosen[k].append((yield f"list_entry_l{k}[{i}]", _bits_for(total)))
        for k, n in enumerate(active):
            one = [(d, False) for side in ((before, behind) if k == 0 else (behind, before)) for d in side] + [(d, True) for d in long]
            lists[k] = [one[j % total] for j in (range(n) if chosen[k] is None else chosen[k])] if total else []
        if kind == 0:
            yield "mvd_l1_zero_flag", 1
        if p("cabac_init_present_flag"):
            yield "cabac_init_flag", 1
        if motion:
            from_first = (yield "collocated_from_l0_flag", 1) if kind == 0 else 1
            if active[0 if from_first else 1] > 1:
                yield "collocated_ref_idx", UE
        if p("weighted_pred_flag" if kind == 1 else "weighted_bipred_flag"):
            yield from _prediction_weights(colour, active)
        yield "five_minus_max_num_merge_cand", UE
    yield "slice_qp_delta", SE
    if p("pps_slice_chroma_qp_offsets_present_flag"):
        yield from _each("slice_cb_qp_offset slice_cr_qp_offset", SE)
    if p("chroma_qp_offset_list_enabled_flag"):
        yield "cu_chroma_qp_offset_enabled_flag", 1
    off = p("pps_deblocking_filter_disabled_flag")
    if p("deblocking_filter_override_enabled_flag") and (yield "deblocking_filter_override_flag", 1):
        off = yield "slice_deblocking_filter_disabled_flag", 1
        if not off:
            yield from _each("slice_beta_offset_div2 slice_tc_offset_div2", SE)
    if p("pps_loop_filter_across_slices_enabled_flag") and (any(offsets) or not off):
        yield "slice_loop_filter_across_slices_enabled_flag", 1
    return kind, before, behind, *lists


def parameter_sets(packets: DataFrame) -> DataFrame:
    """(stream_id, seq, nal_type, rbsp) to (stream_id, seq, kind, id, uses, bits, fields): sequence and picture sets read whole.

    uses is the sequence set that a picture set names; bits are those that its syntax has. A set that ends early, or that
    breaks its syntax, has null id and fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for stream_id, seq, t, data in zip(*(c.to_pylist() for c in b.columns)):
                kind = {33: "sps", 34: "pps"}[t]
                try:
                    v, _, bits = read(data or b"", sequence_set() if t == 33 else picture_set())
                    rows.append((stream_id, seq, kind, v["sps_seq_parameter_set_id" if t == 33 else "pps_pic_parameter_set_id"], v.get("pps_seq_parameter_set_id"), bits, list(v.items())))
                except (IndexError, OverflowError):
                    rows.append((stream_id, seq, kind, None, None, None, None))
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], ["stream_id", "seq", "kind", "id", "uses", "bits", "fields"])

    own = packets.where("nal_type IN (33, 34)").select(F.col("stream_id").cast("long"), F.col("seq").cast("int"), F.col("nal_type").cast("int"), "rbsp")
    return own.mapInArrow(run, "stream_id long, seq int, kind string, id long, uses long, bits int, fields map<string,bigint>")


@lru_cache(maxsize=256)
def _number(data: bytes, sequence: bool) -> tuple[str | None, int | None, int | None]:
    """Kind, number and, of a picture set, the sequence set's number; streams often send sets alike."""
    try:
        v = read(data, sequence_set() if sequence else picture_set())[0]
    except (IndexError, OverflowError):
        return None, None, None
    return ("sps", v["sps_seq_parameter_set_id"], None) if sequence else ("pps", v["pps_pic_parameter_set_id"], v["pps_seq_parameter_set_id"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream_id, seq, nal_type, rbsp) with kind and the number of the set that a packet is or names first."""
    for b in slices(batches):
        rows = []
        for t, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            try:
                if t in (33, 34):
                    rows.append(_number(data or b"", t == 33))
                else:
                    bits = Bits(data or b"")
                    bits.u(2 if 16 <= t <= 23 else 1)
                    rows.append(("slice", bits.ue(), None))
            except (IndexError, OverflowError):
                rows.append(("slice", None, None))
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, types))], ["stream_id", "seq", "nal_type", "rbsp", "kind", "id", "uses"])


def active_sets(packets: DataFrame) -> DataFrame:
    """(stream_id, seq, nal_type, rbsp) to the slices with ``pps`` and ``sps``, the payloads of the sets that are active for each.

    The picture set is the last one of the number that the slice names, the sequence set the last one of the number that this one
    names, both before the slice; null where there is none. Sets that cannot be read are no sets.
    """
    own = packets.where("nal_type <= 9 OR nal_type BETWEEN 16 AND 21 OR nal_type IN (33, 34)").select(F.col("stream_id").cast("long"), F.col("seq").cast("int"), F.col("nal_type").cast("int"), "rbsp")
    own = own.mapInArrow(_named, "stream_id long, seq int, nal_type int, rbsp binary, kind string, id long, uses long")
    last = lambda kind, value, key: F.last(F.when(F.col("kind") == kind, value), ignorenulls=True).over(Window.partitionBy("stream_id", key).orderBy("seq"))
    first = own.where("kind IN ('pps', 'slice')").withColumn("set", last("pps", F.struct("rbsp", "uses"), "id")).where("kind = 'slice'")
    slices = first.select("stream_id", "seq", "nal_type", "rbsp", F.col("set.rbsp").alias("pps"), F.col("set.uses").alias("key"), F.lit("slice").alias("kind"))
    sets = own.where("kind = 'sps'").select("stream_id", "seq", "nal_type", "rbsp", F.lit(None).cast("binary").alias("pps"), F.col("id").alias("key"), "kind")
    both = slices.unionByName(sets).withColumn("sps", last("sps", F.col("rbsp"), "key")).where("kind = 'slice'")
    return both.select("stream_id", "seq", "nal_type", "rbsp", "pps", "sps")


ENTRY = "array<struct<distance:int,long:boolean>>"


def slice_headers(packets: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(stream_id, seq, nal_type, rbsp) to a row per slice segment: its header's fields, type and reference lists, read with its active sets.

    list0 and list1 have the distances of the order counts (or a long-term picture's low bits). ``error`` tells what is
    wrong: "no set" or "cut short"; fields are null then. Dependent segments have fields but no type and lists. ``wanted`` are the
    names that the maps tell, or all: a sequence set with scaling lists has hundreds, and goes out with every slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple] = {}
        some = lambda v: [(n, x) for n, x in v.items() if wanted is None or n in wanted]
        entries = pa.list_(pa.struct([("distance", pa.int32()), ("long", pa.bool_())]))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.int64()), pa.int32(), entries, entries, pa.map_(pa.string(), pa.int64()), pa.map_(pa.string(), pa.int64()), pa.string())
        for b in slices(batches):
            rows = []
            for stream_id, seq, t, data, pps, sps in zip(*(c.to_pylist() for c in b.columns)):
                row: list = [None] * 6 + ["no set" if pps is None or sps is None else None]
                if row[-1] is None:
                    if (sps, pps) not in known:
                        if len(known) > 256:
                            known.clear()
                        one, sets, _ = read(sps, sequence_set())
                        two = read(pps, picture_set())[0]
                        known[sps, pps] = (one, sets, two, some(one), some(two))
                    one, sets, two, told_one, told_two = known[sps, pps]
                    try:
                        v, found, _ = read(data or b"", slice_header(t, one, sets, two))
                        kind, _, _, list0, list1 = found or [None] * 5
                        told = [None if x is None else [{"distance": d, "long": far} for d, far in x] for x in (list0, list1)]
                        row = [some(v), kind, *told, told_one, told_two, None]
                    except (IndexError, OverflowError):
                        row[-1] = "cut short"
                rows.append((stream_id, seq, t, *row))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 10, types)], ["stream_id", "seq", "nal_type", "fields", "slice_type", "list0", "list1", "sps", "pps", "error"])

    values = "map<string,bigint>"
    return active_sets(packets).mapInArrow(run, f"stream_id long, seq int, nal_type int, fields {values}, slice_type int, list0 {ENTRY}, list1 {ENTRY}, sps {values}, pps {values}, error string")


#: Reference sets of the structures of eight: steps 8, 4, 2 and 1, each after the first moved from the one before or coded by itself.
_STEPS = (8, 4, 2, 1)


#: Users whose numbers are alike modulo this have sequence sets alike: the product of all that the values ask for.
_ALIKE = 2 * 3 * 5 * 7


@lru_cache(maxsize=_ALIKE)
def _written_sequence(user: int) -> bytes:
    return write(_sequence_values(user), sequence_set())


def _sequence_values(user: int) -> dict[str, int]:
    layers = user % 3
    v = {"sps_max_sub_layers_minus1": layers, "sub_layer_profile_present_flag[0]": 1, "sub_layer_level_present_flag[1]": 1, "general_level_idc": 93, "chroma_format_idc": 1}
    v |= {"pic_width_in_luma_samples": 64 * (user % 7 + 1), "pic_height_in_luma_samples": 64, "log2_max_pic_order_cnt_lsb_minus4": 4, "log2_diff_max_min_luma_coding_block_size": 1}
    v |= {"scaling_list_enabled_flag": user % 2, "sps_scaling_list_data_present_flag": 1, "scaling_list_pred_mode_flag[2][1]": 1, "scaling_list_dc_coef_minus8[2][1]": 5, "scaling_list_delta_coef[2][1][3]": -7}
    v |= {"num_short_term_ref_pic_sets": 4, "num_negative_pics[0]": 1, "delta_poc_s0_minus1[0][0]": 7, "used_by_curr_pic_s0_flag[0][0]": 1}
    # the second set from the first, moved by 4: -8 to -4, and the picture itself to 4
    v |= {"inter_ref_pic_set_prediction_flag[1]": 1, "abs_delta_rps_minus1[1]": 3, "used_by_curr_pic_flag[1][0]": 1, "used_by_curr_pic_flag[1][1]": 1}
    for i, step in enumerate(_STEPS[2:], 2):
        v |= {f"num_negative_pics[{i}]": 1, f"num_positive_pics[{i}]": 1}
        v |= {f"delta_poc_s{k}_minus1[{i}][0]": step - 1 for k in (0, 1)} | {f"used_by_curr_pic_s{k}_flag[{i}][0]": 1 for k in (0, 1)}
    v |= {"vui_parameters_present_flag": int(user % 5 == 0), "vui_timing_info_present_flag": 1, "vui_num_units_in_tick": 1001, "vui_time_scale": 60000, "vui_hrd_parameters_present_flag": 1, "nal_hrd_parameters_present_flag": 1}
    return v


def coded_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as coded packets (stream_id, seq, nal_type, payload): a sequence set, a picture set before every 32nd picture, and a slice per event."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, dict[str, int]] = {}
        for b in slices(batches):
            rows = []
            for user, poc, coded, step, whole, ahead in zip(*(c.to_pylist() for c in b.columns)):
                alike = user % _ALIKE
                if alike not in known:
                    known[alike] = _sequence_values(alike)
                values = known[alike]
                if coded == 0:
                    rows.append((user, 0, 33, _written_sequence(alike)))
                picture = {"init_qp_minus26": coded // 32 % 10 - 5, "num_ref_idx_l0_default_active_minus1": 1, "num_extra_slice_header_bits": user % 4}
                if coded % 32 == 0:
                    rows.append((user, 2 * coded + 1, 34, write(picture, picture_set())))
                sets = [([(-8, True)], []), *(([(-s, True)], [(s, True)]) for s in _STEPS[1:])]
                v = {"first_slice_segment_in_pic_flag": 1, "slice_type": 2 if poc == 0 else 0 if ahead else 1, "slice_pic_order_cnt_lsb": poc % 256, "short_term_ref_pic_set_sps_flag": int(whole)}
                v |= {"short_term_ref_pic_set_idx": _STEPS.index(step) if whole else 0, "num_negative_pics": 1, "used_by_curr_pic_s0_flag[0]": 1}
                v |= {"num_ref_idx_active_override_flag": 1, "num_ref_idx_l0_active_minus1": 2, "num_ref_idx_l1_active_minus1": 2, "slice_qp_delta": poc % 7 - 3}
                t = 19 if poc == 0 else 1
                rows.append((user, 2 * coded + 2, t, write(v, slice_header(t, values, sets, picture))))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)], ["stream_id", "seq", "nal_type", "payload"])

    own = dockets(stream(spark, sf_dir)).select("user_id", "poc", "coded", "step", "whole", (F.col("whole") & (F.col("step") < SOP)).alias("ahead"))
    return own.mapInArrow(run, "stream_id long, seq int, nal_type int, payload binary")


@query(
    "slice_lists",
    f"""WITH {_EDGES}, r AS (SELECT user_id, poc, list(ref - poc ORDER BY ref) FILTER (ref < poc) AS b, list(ref - poc ORDER BY ref) FILTER (ref > poc) AS a FROM edges GROUP BY ALL),
l AS (SELECT d.user_id, d.poc, d.coded, a IS NOT NULL AS two, list_concat(coalesce(b, []), coalesce(a, [])) AS f, list_concat(coalesce(a, []), coalesce(b, [])) AS g FROM dockets d LEFT JOIN r USING (user_id, poc))
SELECT user_id, (2 * coded + 2)::INT AS seq, CASE WHEN poc > 0 THEN poc % 256 END::BIGINT AS lsb, (CASE WHEN poc = 0 THEN 2 WHEN two THEN 0 ELSE 1 END)::INT AS slice_type, (64 * (user_id % 7 + 1))::BIGINT AS width, (21 + coded // 32 % 10 + poc % 7 - 3)::BIGINT AS qp,
CASE WHEN poc > 0 THEN array_to_string(list_transform([0, 1, 2], lambda i: f[(i % len(f) + 1)::INT]), ',') END AS list0, CASE WHEN two THEN array_to_string(list_transform([0, 1, 2], lambda i: g[(i % len(g) + 1)::INT]), ',') END AS list1 FROM l""",
)
def slice_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lists of all events' slices: coded into streams, taken apart, and read with the sets that were sent before each."""
    found = slice_headers(tokenize(write_stream(coded_pictures(spark, sf_dir))), ("slice_pic_order_cnt_lsb", "pic_width_in_luma_samples", "init_qp_minus26", "slice_qp_delta"))
    told = lambda c: F.array_join(F.transform(c, lambda x: x["distance"].cast("string")), ",")
    value = lambda m, n: F.col(m)[n]
    # a stream's packets are numbered anew; every 32nd picture has a set before it, and the first one two
    order = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq"))
    own = found.withColumn("n", order - 1)
    return own.select(
        F.col("stream_id").alias("user_id"),
        (2 * F.col("n") + 2).cast("int").alias("seq"),
        value("fields", "slice_pic_order_cnt_lsb").alias("lsb"),
        "slice_type",
        value("sps", "pic_width_in_luma_samples").alias("width"),
        (26 + value("pps", "init_qp_minus26") + value("fields", "slice_qp_delta")).alias("qp"),
        told("list0").alias("list0"),
        told("list1").alias("list1"),
    )
