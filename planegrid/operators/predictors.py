"""Motion vector predictors: ordered candidates from the blocks around and from the picture before, cut to two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planegrid.functions.scalar import clip3, clip16
from planegrid.operators.planes import _PLACED, around, tiles
from planegrid.plans.registry import query

#: Blocks that predict, by name: two at the left, three above.
SPATIAL = {"a0": (-1, 1), "a1": (-1, 0), "b0": (1, -1), "b1": (0, -1), "b2": (-1, -1)}


def scaled(mv: Column, tb: Column, td: Column) -> Column:
    """A part of a vector over the distance td, for the distance tb; both are kept in 8 bits."""
    wide = lambda d: clip3(F.lit(-128), F.lit(127), d).cast("long")
    size = F.nullif(F.abs(wide(td)), F.lit(0))
    whole = F.signum(wide(td).cast("double")).cast("long") * F.floor((16384 + F.shiftright(size, 1)) / size)
    product = clip3(-4096, 4095, F.shiftright(wide(tb) * whole + 32, 6)) * mv
    return clip16(F.signum(product.cast("double")).cast("long") * F.shiftright(F.abs(product) + 127, 8)).cast("int")


def vector(motion: Column, own: Column, to: Column) -> Column:
    """The vector of ``motion`` (struct of ref, mvx, mvy; ref is an order count) seen from the picture ``own`` for the reference ``to``.

    A vector to the same reference is taken as it is, another one is scaled by the distances.
    """
    part = lambda n: F.when(motion["ref"] == to, motion[n]).otherwise(scaled(motion[n], own - to, own - motion["ref"])).alias(n)
    return F.when(motion.isNotNull(), F.struct(part("mvx"), part("mvy")))


def first_of(names: list[str], ref: Column | None) -> Column:
    """The first block of these that has a vector, or, if ``ref`` is given, one to that reference."""
    return F.coalesce(*[F.when(F.col(n).isNotNull() if ref is None else F.col(n)["ref"] == ref, F.col(n)) for n in names])


def predictor_lists(motion: DataFrame, unit_rows: int = 8) -> DataFrame:
    """Blocks (plane, tx, ty, poc, ref, mvx, mvy, inter) to (plane, tx, ty, predictors): two vectors for each block's reference.

    ``inter`` tells whether a block has a vector at all; predictors are made for every block. From the left, then from above,
    the first vector to the same reference, else the first one, scaled; above scales only where nothing at the left has a
    vector, and then also stands in for the left. Equal ones count once. Where fewer than two are left, the block below right in the
    plane before (if it lies in the same ``unit_rows`` rows), else at the same place, gives one, scaled by its own distance;
    zeros fill up.
    """
    own = motion.select("plane", F.col("tx").cast("int"), F.col("ty").cast("int"), "poc", "ref", "mvx", "mvy", "inter")
    value = F.when(F.col("inter"), F.struct("ref", "mvx", "mvy"))
    seen = around(own, SPATIAL, value)
    before = own.select((F.col("plane") + 1).alias("plane"), "tx", "ty", F.when(F.col("inter"), F.struct("poc", "ref", "mvx", "mvy")).alias("m"))
    # one row per place, so each join finds one; the corner of the plane before may be a block that this one has not
    corner = before.select("plane", (F.col("tx") - 1).alias("tx"), (F.col("ty") - 1).alias("ty"), F.col("m").alias("c0")).where(f"(ty + 1) % {unit_rows} <> 0")
    seen = seen.join(corner, ["plane", "tx", "ty"], "left").join(before.withColumnRenamed("m", "c1"), ["plane", "tx", "ty"], "left")
    poc, ref = F.col("poc"), F.col("ref")
    left, above = ["a0", "a1"], ["b0", "b1", "b2"]
    some_left = F.coalesce(*[F.col(n)["ref"] for n in left]).isNotNull()
    same_above = vector(first_of(above, ref), poc, ref)
    a = F.coalesce(vector(first_of(left, ref), poc, ref), vector(first_of(left, None), poc, ref))
    seen = seen.withColumn("pa", F.when(some_left, a).otherwise(same_above))
    seen = seen.withColumn("pb", F.when(some_left, same_above).otherwise(vector(first_of(above, None), poc, ref)))
    spatial = F.array_distinct(F.array_compact(F.array("pa", "pb")))
    col = F.coalesce("c0", "c1")
    part = lambda n: scaled(col[n], poc - ref, col["poc"] - col["ref"]).alias(n)
    late = F.when(col.isNotNull(), F.when(col["poc"] - col["ref"] == poc - ref, F.struct(col["mvx"].alias("mvx"), col["mvy"].alias("mvy"))).otherwise(F.struct(part("mvx"), part("mvy"))))
    zero = F.struct(F.lit(0).alias("mvx"), F.lit(0).alias("mvy"))
    seen = seen.withColumn("spatial", spatial).withColumn("late", late)
    all_ = F.concat("spatial", F.when(F.size("spatial") < 2, F.array_compact(F.array("late"))).otherwise(F.slice("spatial", 1, 0)), F.array(zero, zero))
    return seen.select("plane", "tx", "ty", F.slice(all_, 1, 2).alias("predictors"))


def motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion made of tiles: a plane is a picture every second order count, references are one to four counts back; blocks of label 0 have no vector."""
    px = lambda i: F.get("px", F.lit(i))
    poc = (2 * F.col("plane")).cast("int")
    return tiles(spark, sf_dir).select("plane", "tx", "ty", poc.alias("poc"), (poc - 1 - px(3) % 4).alias("ref"), (px(9) - 128).alias("mvx"), (px(18) % 16 - 8).alias("mvy"), (F.col("label") != 0).alias("inter"))


def _sql_scaled(mv: str, tb: str, td: str) -> str:
    factor = f"greatest(-4096, least(4095, ({tb} * ((16384 + abs({td}) // 2) // {td}) + 32) >> 6))"
    return f"greatest(-32768, least(32767, sign({factor} * {mv}) * ((abs({factor} * {mv}) + 127)::BIGINT >> 8)))::INT"


_NEAR = ", ".join(f"{n}.ref AS {n}r, {n}.mvx AS {n}x, {n}.mvy AS {n}y" for n in SPATIAL)
_JOINS = " ".join(f"LEFT JOIN v {n} ON {n}.plane = m.plane AND {n}.tx = m.tx + {dx} AND {n}.ty = m.ty + {dy}" for n, (dx, dy) in SPATIAL.items())


def _sql_vector(names: list[str], same: bool) -> str:
    """[mvx, mvy] of the first block of these, to the same reference or scaled."""
    whens = []
    for n in names:
        if same:
            whens.append(f"WHEN {n}r = ref THEN [{n}x, {n}y]")
        else:
            own = f"CASE WHEN {n}r = ref THEN [{n}x, {n}y] ELSE [{_sql_scaled(n + 'x', '(poc - ref)', f'(poc - {n}r)')}, {_sql_scaled(n + 'y', '(poc - ref)', f'(poc - {n}r)')}] END"
            whens.append(f"WHEN {n}r IS NOT NULL THEN {own}")
    return f"CASE {' '.join(whens)} END"


@query(
    "amvp",
    f"""WITH {_PLACED}, m AS MATERIALIZED (SELECT plane, tx, ty, (2 * plane)::INT AS poc, (2 * plane - 1 - px[4] % 4)::INT AS ref, px[10] - 128 AS mvx, px[19] % 16 - 8 AS mvy, label <> 0 AS inter FROM tiles), v AS MATERIALIZED (SELECT * FROM m WHERE inter),
n AS (SELECT m.plane, m.tx, m.ty, m.poc, m.ref, {_NEAR}, coalesce(c0.poc - c0.ref, c1.poc - c1.ref) AS cd, coalesce(c0.mvx, c1.mvx) AS cx, coalesce(c0.mvy, c1.mvy) AS cy FROM m {_JOINS}
  LEFT JOIN v c0 ON c0.plane = m.plane - 1 AND c0.tx = m.tx + 1 AND c0.ty = m.ty + 1 AND (m.ty + 1) % 8 <> 0 LEFT JOIN v c1 ON c1.plane = m.plane - 1 AND c1.tx = m.tx AND c1.ty = m.ty),
p AS (SELECT *, a0r IS NOT NULL OR a1r IS NOT NULL AS has_left, {_sql_vector(['b0', 'b1', 'b2'], True)} AS above FROM n),
q AS (SELECT *, CASE WHEN has_left THEN coalesce({_sql_vector(['a0', 'a1'], True)}, {_sql_vector(['a0', 'a1'], False)}) ELSE above END AS pa, CASE WHEN has_left THEN above ELSE {_sql_vector(['b0', 'b1', 'b2'], False)} END AS pb,
  CASE WHEN cd = poc - ref THEN [cx, cy] WHEN cd IS NOT NULL THEN [{_sql_scaled('cx', '(poc - ref)', 'cd')}, {_sql_scaled('cy', '(poc - ref)', 'cd')}] END AS late FROM p),
l AS (SELECT *, CASE WHEN pa IS NULL AND pb IS NULL THEN [] WHEN pa IS NULL THEN [pb] WHEN pb IS NULL OR pa = pb THEN [pa] ELSE [pa, pb] END AS s FROM q),
f AS (SELECT plane, tx, ty, list_concat(CASE WHEN len(s) < 2 AND late IS NOT NULL THEN list_concat(s, [late]) ELSE s END, [[0, 0], [0, 0]]) AS f FROM l)
SELECT plane, tx, ty, f[1][1]::INT AS x0, f[1][2]::INT AS y0, f[2][1]::INT AS x1, f[2][2]::INT AS y1 FROM f""",
)
def amvp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vector predictors of every block of all planes."""
    p = lambda i, n: F.get("predictors", F.lit(i))[n]
    return predictor_lists(motions(spark, sf_dir)).select("plane", "tx", "ty", p(0, "mvx").alias("x0"), p(0, "mvy").alias("y0"), p(1, "mvx").alias("x1"), p(1, "mvy").alias("y1"))


#: Candidates of a merge list, and references that zero candidates go through.
MERGE, REFERENCES = 5, 4


def merge_lists(motion: DataFrame, unit_rows: int = 8, most: int = MERGE, references: int = REFERENCES) -> DataFrame:
    """Blocks as ``predictor_lists`` takes them to (plane, tx, ty, candidates): up to ``most`` motions (ref, mvx, mvy) that a block may take over whole.

    Left, above, above right, below left and, while there are fewer than four, above left; only the pairs that the
    H.265 text names (8.5.3.2.3) are compared. Then the place below right, or the same one, in the plane before, for the nearest reference.
    Zeros for the nearest references, one after the other, fill up, the last of them for the nearest one again.
    """
    own = motion.select("plane", F.col("tx").cast("int"), F.col("ty").cast("int"), "poc", "ref", "mvx", "mvy", "inter")
    seen = around(own, SPATIAL, F.when(F.col("inter"), F.struct("ref", "mvx", "mvy")))
    before = own.select((F.col("plane") + 1).alias("plane"), "tx", "ty", F.when(F.col("inter"), F.struct("poc", "ref", "mvx", "mvy")).alias("m"))
    corner = before.select("plane", (F.col("tx") - 1).alias("tx"), (F.col("ty") - 1).alias("ty"), F.col("m").alias("c0")).where(f"(ty + 1) % {unit_rows} <> 0")
    seen = seen.join(corner, ["plane", "tx", "ty"], "left").join(before.withColumnRenamed("m", "c1"), ["plane", "tx", "ty"], "left")
    new = lambda n, *others: F.when(~F.coalesce(*[F.when(F.col(n) == F.col(o), True) for o in others], F.lit(False)), F.col(n))
    four = F.array_compact(F.array(F.col("a1"), new("b1", "a1"), new("b0", "b1"), new("a0", "a1")))
    last = F.when(F.size(four) < 4, F.array_compact(F.array(new("b2", "a1", "b1")))).otherwise(F.slice(four, 1, 0))
    col, poc = F.coalesce("c0", "c1"), F.col("poc")
    part = lambda n: F.when(col["poc"] - col["ref"] == 1, col[n]).otherwise(scaled(col[n], F.lit(1), col["poc"] - col["ref"])).alias(n)
    late = F.when(col.isNotNull(), F.struct((poc - 1).alias("ref"), part("mvx"), part("mvy")))
    zero = lambda i: F.struct((poc - 1 - F.lit(i if i < references else 0)).alias("ref"), F.lit(0).alias("mvx"), F.lit(0).alias("mvy"))
    found = F.slice(F.concat(four, last, F.array_compact(F.array(late))), 1, most)
    return seen.select("plane", "tx", "ty", F.slice(F.concat(found, F.array(*[zero(i) for i in range(most)])), 1, most).alias("candidates"))


_SAME = "({0}r = {1}r AND {0}x = {1}x AND {0}y = {1}y)"


def _sql_new(n: str, *others: str) -> str:
    unlike = " AND ".join(f"NOT coalesce({_SAME.format(n, o)}, FALSE)" for o in others) or "TRUE"
    return f"CASE WHEN {n}r IS NOT NULL AND {unlike} THEN [{n}r, {n}x, {n}y] END"


@query(
    "merge_blocks",
    f"""WITH {_PLACED}, m AS MATERIALIZED (SELECT plane, tx, ty, (2 * plane)::INT AS poc, (2 * plane - 1 - px[4] % 4)::INT AS ref, px[10] // 64 * 16 AS mvx, px[19] % 4 AS mvy, label <> 0 AS inter FROM tiles), v AS MATERIALIZED (SELECT * FROM m WHERE inter),
n AS (SELECT m.plane, m.tx, m.ty, m.poc, {_NEAR}, coalesce(c0.poc - c0.ref, c1.poc - c1.ref) AS cd, coalesce(c0.mvx, c1.mvx) AS cx, coalesce(c0.mvy, c1.mvy) AS cy FROM m {_JOINS}
  LEFT JOIN v c0 ON c0.plane = m.plane - 1 AND c0.tx = m.tx + 1 AND c0.ty = m.ty + 1 AND (m.ty + 1) % 8 <> 0 LEFT JOIN v c1 ON c1.plane = m.plane - 1 AND c1.tx = m.tx AND c1.ty = m.ty),
f AS (SELECT *, list_filter([{_sql_new('a1')}, {_sql_new('b1', 'a1')}, {_sql_new('b0', 'b1')}, {_sql_new('a0', 'a1')}], lambda x: x IS NOT NULL) AS four FROM n),
g AS (SELECT plane, tx, ty, list_concat(list_concat(CASE WHEN len(four) < 4 THEN list_filter(list_concat(four, [{_sql_new('b2', 'a1', 'b1')}]), lambda x: x IS NOT NULL) ELSE four END,
  CASE WHEN cd IS NULL THEN [] WHEN cd = 1 THEN [[poc - 1, cx, cy]] ELSE [[poc - 1, {_sql_scaled('cx', '1', 'cd')}, {_sql_scaled('cy', '1', 'cd')}]] END)[1:5], [[poc - 1, 0, 0], [poc - 2, 0, 0], [poc - 3, 0, 0], [poc - 4, 0, 0], [poc - 1, 0, 0]])[1:5] AS c FROM f)
SELECT plane, tx, ty, array_to_string(list_transform(c, lambda x: x[1] || ' ' || x[2] || ' ' || x[3]), ',') AS candidates FROM g""",
)
def merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge lists of every block of all planes; vectors are coarse, so that neighbours agree."""
    px = lambda i: F.get("px", F.lit(i))
    poc = (2 * F.col("plane")).cast("int")
    own = tiles(spark, sf_dir).select("plane", "tx", "ty", poc.alias("poc"), (poc - 1 - px(3) % 4).alias("ref"), (F.floor(px(9) / 64) * 16).cast("int").alias("mvx"), (px(18) % 4).alias("mvy"), (F.col("label") != 0).alias("inter"))
    told = F.array_join(F.transform("candidates", lambda c: F.concat_ws(" ", c["ref"], c["mvx"], c["mvy"])), ",")
    return merge_lists(own).select("plane", "tx", "ty", told.alias("candidates"))
