"""Parameter sets, slice headers and messages of packets, read into structs by tables of their syntax.

A syntax is a tuple of fields (name, code, condition): u<n> has n bits, ue and se are Exp-Golomb codes, and a
condition is a function of the fields before it. One reader and one writer serve all tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.plans.registry import query
from planegrid.sources.annexb import slices, tokenize, write_stream
from planegrid.sources.tables import table

Values = dict[str, int]


class Field(NamedTuple):
    name: str
    code: str
    when: Callable[[Values], bool] | None = None


def fields(names: str, code: str, when: Callable[[Values], bool] | None = None) -> tuple[Field, ...]:
    return tuple(Field(n, code, when) for n in names.split())


def flag(name: str) -> Callable[[Values], bool]:
    return lambda v: v[name] == 1


_LEVEL = (
    *fields("general_profile_space", "u2"),
    *fields("general_tier_flag", "u1"),
    *fields("general_profile_idc", "u5"),
    *fields("general_profile_compatibility_flags", "u32"),
    *fields("general_constraint_flags", "u48"),
    *fields("general_level_idc", "u8"),
)

#: Syntax of the H.265 text (7.3.2 and 7.3.6.1), up to the first part whose length depends on other records. A sequence of several sub-layers is not read.
VPS = (
    *fields("vps_video_parameter_set_id", "u4"),
    *fields("vps_base_layer_internal_flag vps_base_layer_available_flag", "u1"),
    *fields("vps_max_layers_minus1", "u6"),
    *fields("vps_max_sub_layers_minus1", "u3"),
    *fields("vps_temporal_id_nesting_flag", "u1"),
    *fields("vps_reserved_0xffff_16bits", "u16"),
    *_LEVEL,
)
SPS = (
    *fields("sps_video_parameter_set_id", "u4"),
    *fields("sps_max_sub_layers_minus1", "u3"),
    *fields("sps_temporal_id_nesting_flag", "u1"),
    *_LEVEL,
    *fields("sps_seq_parameter_set_id chroma_format_idc", "ue"),
    *fields("separate_colour_plane_flag", "u1", lambda v: v["chroma_format_idc"] == 3),
    *fields("pic_width_in_luma_samples pic_height_in_luma_samples", "ue"),
    *fields("conformance_window_flag", "u1"),
    *fields("conf_win_left_offset conf_win_right_offset conf_win_top_offset conf_win_bottom_offset", "ue", flag("conformance_window_flag")),
    *fields("bit_depth_luma_minus8 bit_depth_chroma_minus8 log2_max_pic_order_cnt_lsb_minus4", "ue"),
    *fields("sps_sub_layer_ordering_info_present_flag", "u1"),
    *fields("sps_max_dec_pic_buffering_minus1 sps_max_num_reorder_pics sps_max_latency_increase_plus1", "ue"),
    *fields("log2_min_luma_coding_block_size_minus3 log2_diff_max_min_luma_coding_block_size log2_min_luma_transform_block_size_minus2", "ue"),
    *fields("log2_diff_max_min_luma_transform_block_size max_transform_hierarchy_depth_inter max_transform_hierarchy_depth_intra", "ue"),
    *fields("scaling_list_enabled_flag", "u1"),
)
PPS = (
    *fields("pps_pic_parameter_set_id pps_seq_parameter_set_id", "ue"),
    *fields("dependent_slice_segments_enabled_flag output_flag_present_flag", "u1"),
    *fields("num_extra_slice_header_bits", "u3"),
    *fields("sign_data_hiding_enabled_flag cabac_init_present_flag", "u1"),
    *fields("num_ref_idx_l0_default_active_minus1 num_ref_idx_l1_default_active_minus1", "ue"),
    *fields("init_qp_minus26", "se"),
    *fields("constrained_intra_pred_flag transform_skip_enabled_flag cu_qp_delta_enabled_flag", "u1"),
    *fields("diff_cu_qp_delta_depth", "ue", flag("cu_qp_delta_enabled_flag")),
    *fields("pps_cb_qp_offset pps_cr_qp_offset", "se"),
    *fields("pps_slice_chroma_qp_offsets_present_flag weighted_pred_flag weighted_bipred_flag transquant_bypass_enabled_flag tiles_enabled_flag entropy_coding_sync_enabled_flag", "u1"),
)
SLICE = (*fields("first_slice_segment_in_pic_flag", "u1"), *fields("no_output_of_prior_pics_flag", "u1", lambda v: 16 <= v["nal_type"] <= 23), *fields("slice_pic_parameter_set_id", "ue"))
#: Messages by payload type (annex D).
SEI = {
    1: fields("pic_struct", "u4") + fields("source_scan_type", "u2") + fields("duplicate_flag", "u1"),
    132: fields("hash_type", "u8") + fields("picture_md5_high picture_md5_low", "u64", lambda v: v["hash_type"] == 0) + fields("picture_crc", "u16", lambda v: v["hash_type"] == 1) + fields("picture_checksum", "u32", lambda v: v["hash_type"] == 2),
    137: fields("display_primaries_x0 display_primaries_y0 display_primaries_x1 display_primaries_y1 display_primaries_x2 display_primaries_y2 white_point_x white_point_y", "u16") + fields("max_display_mastering_luminance min_display_mastering_luminance", "u32"),
    144: fields("max_content_light_level max_pic_average_light_level", "u16"),
    147: fields("preferred_transfer_characteristics", "u8"),
}


class Bits:
    """A reader of bits; past the end it raises IndexError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u(self, n: int) -> int:
        first, last = self.at // 8, (self.at + n + 7) // 8
        if self.at + n > 8 * len(self.data):
            raise IndexError("the record is cut short")
        self.at += n
        return int.from_bytes(self.data[first:last], "big") >> (-self.at % 8) & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
        return (1 << zeros) - 1 + (self.u(zeros) if zeros else 0)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def read(data: bytes, syntax: tuple[Field, ...], known: Values | None = None) -> Values:
    """The fields of a record in order; ``known`` are values that conditions ask for. Fields whose condition fails are left out."""
    bits, v = Bits(data), dict(known or {})
    for f in syntax:
        if f.when is None or f.when(v):
            v[f.name] = bits.u(int(f.code[1:])) if f.code[1:].isdigit() else getattr(bits, f.code)()
    return v


def write(values: Values, syntax: tuple[Field, ...]) -> bytes:
    """The record's bits, filled up with zeros to whole bytes."""
    out = ""
    for f in syntax:
        if f.when is None or f.when(values):
            x = values[f.name]
            if f.code[1:].isdigit():
                out += format(x, f"0{f.code[1:]}b")
            else:
                k = x if f.code == "ue" else 2 * x - 1 if x > 0 else -2 * x
                out += "0" * ((k + 1).bit_length() - 1) + format(k + 1, "b")
    out += "0" * (-len(out) % 8)
    return int(out or "0", 2).to_bytes(len(out) // 8, "big")


def messages(data: bytes) -> list[tuple[int, bytes | None]]:
    """(payload type, payload) of a packet's messages; both lengths are bytes 255 and a rest. A payload that goes on behind the packet is None."""
    out, at = [], 0

    def number(at: int) -> tuple[int, int]:
        n = 0
        while data[at] == 255:
            n, at = n + 255, at + 1
        return n + data[at], at + 1

    while at < len(data):
        kind, at = number(at)
        size, at = number(at)
        out.append((kind, data[at : at + size] if at + size <= len(data) else None))
        at += size
    return out


KINDS = {32: ("vps", VPS), 33: ("sps", SPS), 34: ("pps", PPS)}


def records(packets: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """(stream_id, seq, nal_type, rbsp) to (stream_id, seq, kind, payload_type, fields): parameter sets, slice headers and known messages.

    fields maps names to values (as strings where over 63 bits). A packet has a row, a packet of messages one
    per message; other packets have none. Records that end early have null fields. ``wanted`` are the names told, or all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for stream, seq, t, data in zip(*(c.to_pylist() for c in b.columns)):
                found: list[tuple[str, int | None, bytes | None, tuple[Field, ...]]] = []
                if t in KINDS:
                    found = [(KINDS[t][0], None, data, KINDS[t][1])]
                elif t <= 9 or 16 <= t <= 21:
                    found = [("slice", None, data, SLICE)]
                elif t in (39, 40):
                    try:
                        found = [("sei", k, p, SEI.get(k, ())) for k, p in messages(data)]
                    except IndexError:
                        found = [("sei", None, b"", fields("cut_short", "u1"))]
                for kind, payload, own, syntax in found:
                    try:
                        v = None if own is None else read(own, syntax, {"nal_type": t})
                        if v:
                            v.pop("nal_type")
                    except IndexError:
                        v = None
                    rows.append((stream, seq, kind, payload, None if v is None else [(n, str(x)) for n, x in v.items() if wanted is None or n in wanted]))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["stream_id", "seq", "kind", "payload_type", "fields"])

    own = packets.select(F.col("stream_id").cast("long"), F.col("seq").cast("int"), F.col("nal_type").cast("int"), "rbsp")
    return own.mapInArrow(run, "stream_id long, seq int, kind string, payload_type int, fields map<string,string>")


def as_struct(found: DataFrame, kind: str, syntax: tuple[Field, ...]) -> DataFrame:
    """Records of one kind with their fields as a struct of numbers, null where a field is not coded."""
    wide = [F.col("fields")[f.name].cast("decimal(20,0)" if f.code == "u64" else "long").alias(f.name) for f in syntax]
    return found.where(F.col("kind") == kind).select("stream_id", "seq", "payload_type", F.struct(*wide).alias(kind))


def _coded(rows: DataFrame, syntax: tuple[Field, ...]) -> DataFrame:
    """(stream_id, seq, nal_type, v: map of values) to packets with the coded record as payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [write(dict.fromkeys((f.name for f in syntax), 0) | dict(v), syntax) for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], ["stream_id", "seq", "nal_type", "payload"])

    return rows.mapInArrow(run, "stream_id long, seq int, nal_type int, payload binary")


@query(
    "sequence_sets",
    "SELECT p_partkey AS stream_id, (p_size * 16)::BIGINT AS width, (p_size * 9)::BIGINT AS height, (p_partkey % 3)::BIGINT AS depth, CASE WHEN p_partkey % 2 = 1 THEN p_size % 8 END::BIGINT AS crop, (p_partkey % 13)::BIGINT AS lsb, CASE WHEN p_partkey % 4 = 3 THEN 1 END::BIGINT AS planes FROM part",
)
def sequence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence parameter set per part, coded into a stream and read back from its packet."""
    n = lambda c: F.expr(f"CAST({c} AS BIGINT)")
    values = {"pic_width_in_luma_samples": n("p_size * 16"), "pic_height_in_luma_samples": n("p_size * 9"), "bit_depth_luma_minus8": n("p_partkey % 3"), "general_profile_compatibility_flags": n("1610612736"), "general_constraint_flags": n("0")}
    values |= {"conformance_window_flag": n("p_partkey % 2"), "conf_win_right_offset": n("p_size % 8"), "log2_max_pic_order_cnt_lsb_minus4": n("p_partkey % 13"), "chroma_format_idc": n("p_partkey % 4"), "separate_colour_plane_flag": n("1")}
    v = F.create_map(*[x for k, c in values.items() for x in (F.lit(k), c)])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("stream_id"), F.lit(0).alias("seq"), F.lit(33).alias("nal_type"), v.alias("v"))
    names = {"pic_width_in_luma_samples": "width", "pic_height_in_luma_samples": "height", "bit_depth_luma_minus8": "depth", "conf_win_right_offset": "crop", "log2_max_pic_order_cnt_lsb_minus4": "lsb", "separate_colour_plane_flag": "planes"}
    own = as_struct(records(tokenize(write_stream(_coded(rows.repartition("stream_id"), SPS))), tuple(names)), "sps", tuple(f for f in SPS if f.name in names))
    return own.select("stream_id", *[F.col(f"sps.{k}").alias(a) for k, a in names.items()])
