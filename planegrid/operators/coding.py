"""Decisions and derived values of coding: mode numbers, marks of references, presets, sizes, vectors between samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.operators.filters import LUMA, taps
from planegrid.operators.planes import _PLACED, around, tiles
from planegrid.operators.references import _EDGES, dockets, edges, stream
from planegrid.plans.registry import PAIRS, query
from planegrid.sources.annexb import tokenize, write_stream
from planegrid.sources.headers import coded_pictures, parameter_sets
from planegrid.sources.tables import block_pairs, table


def likely_modes(left: Column, above: Column) -> Column:
    """The three likely modes of a block from those to its left and above it; where there is none, or no intra block, it counts as mode 1."""
    a, b = F.coalesce(left, F.lit(1)), F.coalesce(above, F.lit(1))
    third = F.when((a != 0) & (b != 0), 0).when((a != 1) & (b != 1), 1).otherwise(26)
    same = F.when(a < 2, F.array(F.lit(0), F.lit(1), F.lit(26))).otherwise(F.array(a, 2 + (a + 29) % 32, 2 + (a - 1) % 32))
    return F.when(a == b, same).otherwise(F.array(a, b, third))


def mode_code(mode: Column, likely: Column) -> Column:
    """How a mode is written: (index, rest). Its place among the likely ones, or, these sorted, its number without those below it."""
    rest = F.aggregate(F.reverse(F.array_sort(likely)), mode, lambda m, c: F.when(m > c, m - 1).otherwise(m))
    index = (F.array_position(likely, mode) - 1).cast("int")
    return F.struct(F.when(index >= 0, index).alias("index"), F.when(index < 0, rest).alias("rest"))


def coded_mode(code: Column, likely: Column) -> Column:
    """The mode that ``mode_code`` has written: the rest is raised by one for each likely mode, in rising order, that is not above it."""
    raised = F.aggregate(F.array_sort(likely), code["rest"], lambda m, c: F.when(m >= c, m + 1).otherwise(m))
    return F.coalesce(F.get(likely, code["index"]), raised)


@query(
    "mode_codes",
    f"""WITH {_PLACED}, m AS MATERIALIZED (SELECT plane, tx, ty, px[4] % 35 AS mode, label <> 0 AS intra FROM tiles),
n AS (SELECT m.plane, m.tx, m.ty, m.mode, coalesce(CASE WHEN l.intra THEN l.mode END, 1) AS a, coalesce(CASE WHEN u.intra THEN u.mode END, 1) AS b FROM m LEFT JOIN m l ON l.plane = m.plane AND l.tx = m.tx - 1 AND l.ty = m.ty LEFT JOIN m u ON u.plane = m.plane AND u.tx = m.tx AND u.ty = m.ty - 1),
c AS (SELECT *, CASE WHEN a = b AND a < 2 THEN [0, 1, 26] WHEN a = b THEN [a, 2 + (a + 29) % 32, 2 + (a - 1) % 32] ELSE [a, b, CASE WHEN a <> 0 AND b <> 0 THEN 0 WHEN a <> 1 AND b <> 1 THEN 1 ELSE 26 END] END AS k FROM n)
SELECT plane, tx, ty, mode::INT AS mode, CASE WHEN list_contains(k, mode) THEN list_position(k, mode) - 1 END::INT AS code, CASE WHEN NOT list_contains(k, mode) THEN mode - len(list_filter(k, lambda x: x < mode)) END::INT AS rest FROM c""",
)
def mode_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intra modes of planes' blocks as they are written, given the blocks at the left and above; the mode is read back from what is written."""
    mode = (F.get("px", F.lit(3)) % 35).cast("int")
    own = tiles(spark, sf_dir).select("plane", "tx", "ty", mode.alias("mode"), (F.col("label") != 0).alias("intra"))
    seen = around(own, {"left": (-1, 0), "above": (0, -1)}, F.when(F.col("intra"), F.col("mode")))
    seen = seen.withColumn("likely", likely_modes(F.col("left"), F.col("above"))).withColumn("c", mode_code(F.col("mode"), F.col("likely")))
    return seen.select("plane", "tx", "ty", coded_mode(F.col("c"), F.col("likely")).alias("mode"), F.col("c.index").alias("code"), F.col("c.rest").alias("rest"))


#: The five lists of a picture's reference set: near ones before and behind that it uses, near ones that later pictures use, far ones of both kinds.
LISTS = ("st_curr_before", "st_curr_after", "st_foll", "lt_curr", "lt_foll")


def marked(held: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Pictures in the buffer (keys, poc) against the set of the picture that comes (keys, LISTS): (keys, poc, mark, used).

    mark is "long" in a far list, else "short" in a near one, else "unused"; used, whether the coming picture itself refers
    to it. A picture without a set (a refresh) marks all unused.
    """
    own = held.join(sets, keys, "left")
    has = lambda n: F.coalesce(F.array_contains(n, F.col("poc")), F.lit(False))
    mark = F.when(has("lt_curr") | has("lt_foll"), "long").when(has("st_curr_before") | has("st_curr_after") | has("st_foll"), "short").otherwise("unused")
    return own.select(*keys, "poc", mark.alias("mark"), (has("st_curr_before") | has("st_curr_after") | has("lt_curr")).alias("used"))


_SETS = f"""WITH {_EDGES}, last AS (SELECT e.user_id, e.ref AS poc, max(e.coded) AS last, d.coded AS born FROM edges e JOIN dockets d ON d.user_id = e.user_id AND d.poc = e.ref GROUP BY e.user_id, e.ref, d.coded),
held AS (SELECT d.user_id, d.poc AS picture, l.poc, d.coded, l.last FROM dockets d JOIN last l ON l.user_id = d.user_id AND d.coded > l.born AND d.coded <= l.last + 3),
s AS (SELECT h.*, e.poc IS NOT NULL AS used FROM held h LEFT JOIN edges e ON e.user_id = h.user_id AND e.poc = h.picture AND e.ref = h.poc)"""


@query("reference_marks", _SETS + " SELECT user_id, picture, poc, CASE WHEN coded > last THEN 'unused' WHEN poc % 16 = 0 THEN 'long' ELSE 'short' END AS mark, used FROM s")
def reference_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the set of each picture makes of those in the buffer, three pictures beyond their last use; every sixteenth picture is a far one."""
    own = dockets(stream(spark, sf_dir))
    uses = edges(own)
    last = uses.groupBy("user_id", F.col("ref").alias("poc")).agg(F.max("coded").alias("last"))
    born = own.select("user_id", "poc", F.col("coded").alias("born")).join(last, ["user_id", "poc"])
    place = own.select("user_id", F.col("poc").alias("picture"), "coded")
    lives = born.select("user_id", "poc", "last", F.explode(F.sequence(F.col("born") + 1, F.greatest("born", "last") + 3)).alias("coded")).join(place, ["user_id", "coded"])
    refs = uses.select("user_id", F.col("poc").alias("picture"), F.col("ref").alias("poc"), F.lit(True).alias("used"))
    kept = lives.where("coded <= last").join(refs, ["user_id", "picture", "poc"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    far = F.col("poc") % 16 == 0
    kinds = (~far & F.col("used") & (F.col("poc") < F.col("picture")), ~far & F.col("used") & (F.col("poc") > F.col("picture")), ~far & ~F.col("used"), far & F.col("used"), far & ~F.col("used"))
    sets = kept.groupBy("user_id", "picture").agg(*[F.collect_list(F.when(c, F.col("poc"))).alias(n) for n, c in zip(LISTS, kinds)])
    return marked(lives.select("user_id", "picture", "poc"), sets, ["user_id", "picture"])


#: The switches of each preset (slow, medium, fast) and the numbers of candidates that they set.
PRESETS = (
    ("amp", False, False, False),
    ("smp_large", True, True, False),
    ("smp_small", True, True, True),
    ("small_search_window", False, False, True),
    ("bi_small_search_window", False, False, True),
    ("intra_in_inter", True, True, True),
    ("fdm", True, True, True),
    ("fdam", False, True, True),
    ("ecu", False, True, True),
    ("esd", False, True, True),
    ("cfm", False, True, True),
    ("met", False, True, True),
    ("rqt", True, False, False),
    ("rdoq", True, True, False),
    ("rcu_depth", False, True, True),
    ("sdh", True, True, False),
    ("tskip", False, False, False),
    ("aps", False, True, True),
    ("sao", True, True, False),
    ("sao_slow", True, False, False),
    ("merge_candidates", 5, 5, 2),
    ("refined_large", 8, 3, 3),
    ("refined_small", 8, 8, 4),
)


def preset_table(spark: SparkSession) -> DataFrame:
    """(preset, one column per knob), three rows."""
    rows = [(name, *[k[i + 1] for k in PRESETS]) for i, name in enumerate(("slow", "medium", "fast"))]
    return spark.createDataFrame(rows, "preset string, " + ", ".join(f"{k[0]} {'boolean' if isinstance(k[1], bool) else 'int'}" for k in PRESETS))


def intra_refinements(log2_size: Column) -> Column:
    """Intra modes that are refined for a block of this size under its preset's columns."""
    return F.when(log2_size > 3, F.col("refined_large")).otherwise(F.col("refined_small"))


_PRESET_ROWS = ", ".join("(" + ", ".join([f"'{name}'", *[str(k[i + 1]).upper() for k in PRESETS]]) + ")" for i, name in enumerate(("slow", "medium", "fast")))


@query(
    "preset_knobs",
    f"""WITH k(preset, {', '.join(k[0] for k in PRESETS)}) AS (VALUES {_PRESET_ROWS}), s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'medium' ELSE 'fast' END AS preset, (2 + c_custkey % 5)::INT AS log2_size FROM customer)
SELECT c_custkey, k.*, CASE WHEN log2_size > 3 THEN refined_large ELSE refined_small END AS refined, log2_size <= 3 AND smp_small OR smp_large AS smp FROM s JOIN k USING (preset)""",
)
def preset_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All knobs of each session's preset, with those that depend on a block's size worked out."""
    name = F.element_at(F.array(F.lit("slow"), F.lit("medium"), F.lit("fast")), (F.col("c_custkey") % 3 + 1).cast("int"))
    own = table(spark, sf_dir, "customer").select("c_custkey", name.alias("preset"), (2 + F.col("c_custkey") % 5).cast("int").alias("log2_size"))
    joined = own.join(F.broadcast(preset_table(spark)), "preset")  # three rows
    smp = F.when(F.col("log2_size") <= 3, F.col("smp_small")).otherwise(False) | F.col("smp_large")
    return joined.select("c_custkey", "preset", *[k[0] for k in PRESETS], intra_refinements(F.col("log2_size")).alias("refined"), smp.alias("smp"))


def derived(sets: DataFrame) -> DataFrame:
    """Sequence sets (..., fields) with the values that the H.265 text derives from them (7.4.3.2): sizes in samples, coding blocks and units, depths, ranges."""
    v = lambda n: F.coalesce(F.col("fields")[n], F.lit(0))
    own = sets.where("kind = 'sps' AND fields IS NOT NULL")
    own = own.withColumns({"chroma_array_type": F.when(v("separate_colour_plane_flag") == 1, 0).otherwise(v("chroma_format_idc")).cast("long"), "min_cb_log2_size": v("log2_min_luma_coding_block_size_minus3") + 3})
    own = own.withColumns(
        {
            "sub_width_c": F.when(v("chroma_format_idc").isin(1, 2), 2).otherwise(1).cast("long"),
            "sub_height_c": F.when(v("chroma_format_idc") == 1, 2).otherwise(1).cast("long"),
            "ctb_log2_size": F.col("min_cb_log2_size") + v("log2_diff_max_min_luma_coding_block_size"),
            "bit_depth_y": v("bit_depth_luma_minus8") + 8,
            "bit_depth_c": v("bit_depth_chroma_minus8") + 8,
        }
    )
    w, h = v("pic_width_in_luma_samples"), v("pic_height_in_luma_samples")
    up = lambda n, log: F.call_function("shiftright", n + F.call_function("shiftleft", F.lit(1).cast("long"), F.col(log).cast("int")) - 1, F.col(log).cast("int"))
    power = lambda log: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(log).cast("int"))
    own = own.withColumns(
        {
            "min_cb_size": power("min_cb_log2_size"),
            "ctb_size": power("ctb_log2_size"),
            "pic_width_in_min_cbs": F.call_function("shiftright", w, F.col("min_cb_log2_size").cast("int")),
            "pic_height_in_min_cbs": F.call_function("shiftright", h, F.col("min_cb_log2_size").cast("int")),
            "pic_width_in_ctbs": up(w, "ctb_log2_size"),
            "pic_height_in_ctbs": up(h, "ctb_log2_size"),
            "pic_size_in_samples": w * h,
            "pic_width_in_samples_c": F.floor(w / F.col("sub_width_c")),
            "pic_height_in_samples_c": F.floor(h / F.col("sub_height_c")),
            "qp_bd_offset_y": 6 * (F.col("bit_depth_y") - 8),
            "qp_bd_offset_c": 6 * (F.col("bit_depth_c") - 8),
            "max_pic_order_cnt_lsb": F.call_function("shiftleft", F.lit(16).cast("long"), v("log2_max_pic_order_cnt_lsb_minus4").cast("int")),
            "cropped_width": w - F.col("sub_width_c") * (v("conf_win_left_offset") + v("conf_win_right_offset")),
            "cropped_height": h - F.col("sub_height_c") * (v("conf_win_top_offset") + v("conf_win_bottom_offset")),
        }
    )
    return own.withColumns({"pic_size_in_min_cbs": F.col("pic_width_in_min_cbs") * F.col("pic_height_in_min_cbs"), "pic_size_in_ctbs": F.col("pic_width_in_ctbs") * F.col("pic_height_in_ctbs")})


@query(
    "sequence_sizes",
    "SELECT user_id AS stream_id, (64 * (user_id % 7 + 1))::BIGINT AS pic_width_in_luma, 16::BIGINT AS ctb_size, (4 * (user_id % 7 + 1))::BIGINT AS pic_width_in_ctbs, (16 * (user_id % 7 + 1))::BIGINT AS pic_size_in_ctbs, (64 * (user_id % 7 + 1))::BIGINT AS pic_size_in_min_cbs, (4096 * (user_id % 7 + 1))::BIGINT AS pic_size_in_samples, (32 * (user_id % 7 + 1))::BIGINT AS pic_width_in_samples_c, 256::BIGINT AS max_pic_order_cnt_lsb, 8::BIGINT AS bit_depth_y FROM (SELECT DISTINCT user_id FROM events)",
)
def sequence_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived values of the sequence sets in the events' coded streams."""
    coded = coded_pictures(spark, sf_dir).where("nal_type = 33")
    found = derived(parameter_sets(tokenize(write_stream(coded))))
    names = ("ctb_size", "pic_width_in_ctbs", "pic_size_in_ctbs", "pic_size_in_min_cbs", "pic_size_in_samples", "pic_width_in_samples_c", "max_pic_order_cnt_lsb", "bit_depth_y")
    return found.select("stream_id", F.col("fields")["pic_width_in_luma_samples"].alias("pic_width_in_luma"), *names)


def between(ref: np.ndarray, fx: int, fy: int) -> np.ndarray:
    """Blocks [block, y, x] moved by quarters of a sample along both axes: eight taps along x, then along y, borders repeated."""
    out = ref.astype(np.int64)
    shift = 0
    for f, axis in ((fx, 2), (fy, 1)):
        if f:
            out = taps(out, LUMA[f], axis)
            # the second pass takes six bits off what the first has added
            out, shift = (out >> 6, 6) if shift else (out, 6)
    return np.clip(out + 32 >> 6, 0, 255) if shift else out


def refined(pairs: DataFrame, lagrangian: int = 4) -> DataFrame:
    """(block, src, ref) to (block, fx, fy, cost): the quarter-sample move of ref along both axes that is nearest to src.

    All sixteen are tried; a move along an axis costs two bits at the half and four at a quarter, times ``lagrangian`` over two.
    The first of equals, in the order of fy, then fx.
    """
    bits = (0, 2, 1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, ref = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8).astype(np.int64) for i in (1, 2))
            cost = np.stack([np.abs(src - between(ref, fx, fy)).sum((1, 2)) + lagrangian * (bits[fx] + bits[fy]) for fy in range(4) for fx in range(4)]) if len(b) else np.zeros((16, 0), np.int64)
            k = cost.argmin(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((k % 4).astype(np.int32)), pa.array((k // 4).astype(np.int32)), pa.array(cost.min(0))], ["block", "fx", "fy", "cost"])

    own = pairs.select(F.col("block").cast("long"), F.col("src").cast("array<int>"), F.col("ref").cast("array<int>"))
    return own.mapInArrow(run, "block long, fx int, fy int, cost long")


_TAPS = ", ".join(f"({f}, {k - 3}, {t})" for f, row in enumerate(LUMA) for k, t in enumerate(row) if t and f)


@query(
    "subpel_both",
    f"""WITH {PAIRS}, taps(f, d, t) AS (VALUES {_TAPS}), f(f, bits) AS (VALUES (0, 0), (1, 2), (2, 1), (3, 2)),
x AS MATERIALIZED (SELECT a.block, a.x, a.y, k.f AS fx, CASE WHEN k.f = 0 THEN a.ref ELSE (SELECT sum(b.ref * t) FROM taps JOIN pairs b ON b.block = a.block AND b.y = a.y AND b.x = greatest(0, least(7, a.x + d)) WHERE taps.f = k.f) END::BIGINT AS s FROM pairs a, f k),
y AS (SELECT a.block, a.x, a.y, a.fx, k.f AS fy, CASE WHEN k.f = 0 THEN a.s ELSE (SELECT sum(b.s * t) FROM taps JOIN x b ON b.block = a.block AND b.fx = a.fx AND b.x = a.x AND b.y = greatest(0, least(7, a.y + d)) WHERE taps.f = k.f) END::BIGINT AS s FROM x a, f k),
p AS (SELECT block, x, y, fx, fy, CASE WHEN fx = 0 AND fy = 0 THEN s WHEN fx = 0 OR fy = 0 THEN greatest(0, least(255, (s + 32) >> 6)) ELSE greatest(0, least(255, ((s >> 6) + 32) >> 6)) END AS v FROM y),
c AS (SELECT p.block, fx, fy, sum(abs(src - v))::BIGINT + 4 * (any_value(g.bits) + any_value(h.bits)) AS cost FROM p JOIN pairs q ON q.block = p.block AND q.x = p.x AND q.y = p.y JOIN f g ON g.f = fx JOIN f h ON h.f = fy GROUP BY p.block, fx, fy)
SELECT block, arg_min(fx, cost * 16 + 4 * fy + fx)::INT AS fx, arg_min(fy, cost * 16 + 4 * fy + fx)::INT AS fy, min(cost)::BIGINT AS cost FROM c GROUP BY block""",
)
def subpel_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best quarter-sample move of each block's reference along both axes."""
    return refined(block_pairs(spark, sf_dir))
