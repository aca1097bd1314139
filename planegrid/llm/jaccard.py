"""N-gram Jaccard self-join with a token-group matrix.

Documents with equal shingle sets are one class. Three steps find what connects the classes:

1. A class of n shingles that links with another one lacks at most n // 4 of its own shingles there.
   So of its *half* (the shingles of even hash) all but n // 4 must occur in other classes. Shingles
   travel packed by hash range, a few ranges per shuffle partition, and are unpacked and counted there;
   what comes back is a count per document. Most documents end here.
2. The rest is partitioned into groups: classes that share the smallest of several permuted hashes. Inside
   blocks of a group, classes join the leaders that they link with, and the leaders of a group's blocks meet
   again in others. Classes joined are a unit: connected, whatever else links inside.
3. The token-group matrix holds the union of each unit's halves. The overlap of a class with what the
   other units hold bounds its overlap with any class there; only units with classes that reach the bound are
   opened, and of these those classes. Ordered from the rarest shingle on, two that link share one of their
   first shingles, whose places bound the overlap once more; what passes is compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked_join, cut, discard, documents, ranges, saved, spread_join
from .components import components
from .words import Texts, block_name, grouped, mixed, window_hashes

WIDTH = 5
#: Two sets link when PARTS * intersection >= SHARE * union.
SHARE, PARTS = 75, 100
#: Permuted hashes that vote for a class's group.
VOTES = 8
#: Classes, and bytes of text, of a block that meets in one task.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Times that leaders meet.
LEVELS = 3
BATCH = 6 << 20
_MANY = 0xFFFF


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; a text of fewer words has one of all its words."""
    t = Texts(column, lower=True)
    h = t.hashes()
    windows = window_hashes(h, width)
    out = []
    for i, j in zip(t.first[:-1].tolist(), t.first[1:].tolist()):
        if j - i >= width:
            out.append(np.unique(windows[i : j - width + 1]))
        elif j > i:
            out.append(mixed(window_hashes(h[i:j], j - i) ^ np.uint64(j - i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(s: np.ndarray) -> int:
    """A set's 64-bit name."""
    with np.errstate(over="ignore"):
        both = np.array([mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))])
        return int(mixed(both[:1] + mixed(both[1:]))[0].view(np.int64))


def lacking(n: int) -> int:
    """Shingles of a set of n that a set linked with it can lack."""
    return n - -(-SHARE * n // PARTS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = len(a), len(b)
    if not n or PARTS * min(n, m) < SHARE * max(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return PARTS * both >= SHARE * (n + m - both)


def half(s: np.ndarray) -> np.ndarray:
    return s[(s & np.uint64(1)) == 0]


#: Makes a table that is discarded with the others of a join.
Keep = Callable[[DataFrame], DataFrame]

_DOC = [("owner", pa.int32()), ("doc_id", pa.int64()), ("own", pa.string()), ("row", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("need", pa.int64())]
_PACKED = "part int, block bigint, codes array<bigint>, docs array<struct<owner:int,doc_id:bigint,own:string,row:bigint,cls:bigint,n:bigint,need:bigint>>"
_PACKED_NAMES = ["part", "block", "codes", "docs"]


def _scatter(parts: int):  # noqa: ANN202
    """(doc_id, text, own, row) to packed blocks: a row per hash range, and one row of the documents themselves.

    A code is 32 bits of a shingle's hash, which tell enough inside a range (a chance match only keeps a
    document), and 16 of the document's number in the block. A shingle that several documents of a block
    share is settled there: it counts for all of them and goes out once, as one that counts for none, so a
    frequent shingle costs a code per block only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_type = pa.list_(pa.struct(_DOC))
        for ordinal, b in enumerate(grouped(batches, size=BATCH)):
            sets = shingle_sets(b.column(1))
            keys = np.array([_key(s) if len(s) else 0 for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            _, lead = np.unique(keys, return_index=True)
            mine = np.zeros(len(sets), bool)
            mine[lead] = True  # equal sets of a block go out once
            halves = [half(s) if m else s[:0] for s, m in zip(sets, mine)]
            n_half = np.array([int(((s & np.uint64(1)) == 0).sum()) for s in sets], np.int64)
            h = np.concatenate(halves)
            of = np.repeat(np.arange(len(halves)), [len(x) for x in halves])
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.r_[new, len(h)])
            shared = np.bincount(of[np.repeat(times > 1, times)], minlength=len(sets))
            h, owner = h[new], np.where(times > 1, _MANY, of[new])
            block = block_name(keys.view(np.uint64), ordinal)
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            codes = (mixed(h) & np.uint64(0xFFFFFFFF)).astype(np.int64) << 16 | owner
            cuts = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts))
            packed = pa.ListArray.from_arrays(pa.array(np.r_[cuts[some], len(h)], pa.int32()), pa.array(codes))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), block)), packed, pa.nulls(len(some), docs_type)], _PACKED_NAMES)
            need = n_half - np.array([lacking(int(n)) for n in sizes]) - shared
            rows = [pa.array(range(len(sets)), pa.int32()), b.column(0), b.column(2), b.column(3), pa.array(keys), pa.array(sizes), pa.array(need)]
            docs = pa.ListArray.from_arrays(pa.array([0, len(sets)], pa.int32()), pa.StructArray.from_arrays(rows, [n for n, _ in _DOC]))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([block]), pa.nulls(1, pa.list_(pa.int64())), docs], _PACKED_NAMES)

    return run


def classed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own, row) to doc_id, own, row, cls, n (shingles) and stays: whether enough of the half occurs elsewhere."""
    packed = saved(docs.mapInArrow(_scatter(ranges(docs.sparkSession)), _PACKED))
    codes = packed.where("part >= 0").select("part", "block", "codes").repartition("part")
    each = codes.select("part", "block", F.explode("codes").alias("code"))
    each = each.select("part", "block", F.shiftright("code", 16).alias("h"), F.col("code").bitwiseAND(_MANY).cast("int").alias("owner"))
    # a hash has a row per block at most, and its range is in this task already
    again = each.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("part", "h"))).where((F.col("times") > 1) & (F.col("owner") != _MANY))
    found = again.groupBy("block", "owner").agg(F.count(F.lit(1)).alias("found"))
    rows = packed.where("part < 0").select("block", F.inline("docs"))
    stays = (F.col("n") > 0) & (F.col("need") <= F.coalesce("found", F.lit(0)))
    out = cut(rows.join(found, ["block", "owner"], "left").select("doc_id", "own", "row", "cls", "n", stays.alias("stays")))
    discard(packed)
    return out


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, text) to (cls, n, text, votes): the smallest hash under each permutation. A row goes whose cls is not its text's."""
    seeds = mixed(np.arange(1, VOTES + 1, dtype=np.uint64))
    for b in grouped(batches, "text"):
        sets = shingle_sets(b.column(1))
        keys = [_key(s) if len(s) else None for s in sets]
        kept = [i for i, (c, k) in enumerate(zip(b.column(0).to_pylist(), keys)) if k is not None and c == k]
        votes = [[int(mixed(sets[i] ^ s).min().view(np.int64)) for s in seeds] for i in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in kept], pa.int64()), pa.array([len(sets[i]) for i in kept], pa.int64()), b.column(1).take(pa.array(kept, pa.int64())), pa.array(votes, pa.list_(pa.int64()))],
            ["cls", "n", "text", "votes"],
        )


_UNIT = T.StructType(
    [
        T.StructField("cls", T.LongType()),
        T.StructField("lead", T.LongType()),
        T.StructField("leads", T.BooleanType()),
        T.StructField("n", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("need", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.LongType())),
    ]
)


def _attach(table: pa.Table) -> pa.Table:
    """One block of a group: each class joins the leaders that it links with, or is a leader itself.

    Classes joined are one unit, named by its first leader (lead), whose row holds the union of their halves.
    """
    table = table.combine_chunks()
    order = np.argsort(np.array(table.column("cls")), kind="stable")
    table = table.take(pa.array(order))
    sets = shingle_sets(table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text"))
    cls = table.column("cls").to_pylist()
    leaders: list[int] = []
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # ordered by hash, two sets that link share one of the first shingles that either can lack, and one more
    index: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        prefix = s[: lacking(len(s)) + 1].tolist()
        for j in sorted({j for x in prefix for j in index.get(x, ())}):
            if top(j) != top(i) and (cls[j] == cls[i] or linked(s, sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        if top(i) == i:
            leaders.append(i)
            for x in prefix:
                index.setdefault(x, []).append(i)
    of = [top(i) for i in range(len(sets))]
    members: dict[int, list[int]] = {}
    for i, j in enumerate(of):
        members.setdefault(j, []).append(i)
    tokens = [np.unique(np.concatenate([half(sets[k]) for k in members[i]])).view(np.int64) if i == j else None for i, j in enumerate(of)]
    leads = set(leaders)
    return pa.table(
        [
            pa.array(cls, pa.int64()),
            pa.array([cls[j] for j in of], pa.int64()),
            pa.array([i in leads for i in range(len(sets))], pa.bool_()),
            pa.array([len(s) for s in sets], pa.int64()),
            table.column("text"),
            pa.array([len(half(s)) - lacking(len(s)) for s in sets], pa.int64()),
            pa.array(tokens, pa.list_(pa.int64())),
        ],
        names=_UNIT.names,
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes with their texts to those that link."""
    for b in grouped(batches, "text_b"):
        left, right = shingle_sets(b.column(2)), shingle_sets(b.column(3))
        yield b.select(["a", "b"]).filter(pa.array([linked(x, y) for x, y in zip(left, right)], pa.bool_()))


def _units(classes: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Classes with texts and votes to their rows by leader, and the links between leaders."""
    vote = classes.select("cls", F.explode("votes").alias("v"))  # permuted hashes of several permutations do not meet
    best = cut(vote.groupBy("v").agg(F.min("cls").alias("g"), F.count(F.lit(1)).alias("n")))
    group = spread_join(vote, best, "v").groupBy("cls", "g").agg(F.count(F.lit(1)).alias("times"))
    group = cut(group.groupBy("cls").agg(F.max_by("g", F.struct("times", -F.col("g"))).alias("g")))  # read twice
    rows = classes.select("cls", "text", F.octet_length("text").alias("bytes")).join(group, "cls")
    found, links = None, None
    for level in range(LEVELS):
        size = rows.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
        # groups of several blocks are few, the others need no look-up
        dealt = checked_join(rows, cut(size.where("blocks > 1")), "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("cls", F.lit(level)), F.col("blocks")))
        own = keep(dealt.repartition("g", "sub").groupBy("g", "sub").applyInArrow(_with_group, T.StructType([*_UNIT, T.StructField("g", T.LongType()), T.StructField("again", T.BooleanType())])))
        if found is None:
            found = own.drop("g", "again")
        else:
            new = own.where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b"))
            links = new if links is None else links.unionByName(new)
        # the leaders of a group of several blocks meet in other blocks; what no level joins is left to the matrix
        rows = own.where("again AND leads").select("cls", "text", F.octet_length("text").alias("bytes"), "g")
        if rows.isEmpty():
            break
    if links is not None:
        lead = found.select("cls", "lead")
        links = links.join(lead.toDF("a", "la"), "a").join(lead.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return found, links


def _with_group(key: tuple, table: pa.Table) -> pa.Table:
    several = table.column("blocks")[0].as_py() > 1
    out = _attach(table.select(["cls", "text"]))
    return out.append_column("g", pa.array([key[0].as_py()] * len(out), pa.int64())).append_column("again", pa.array([several] * len(out), pa.bool_()))


def _crossing(rows: DataFrame, unit: DataFrame, keep: Keep) -> DataFrame:
    """Links between classes of different units, by the token-group matrix. rows: classes by leader, unit: lead to unit."""
    matrix = rows.where("tokens IS NOT NULL").select("lead", "tokens").join(unit, "lead").select("lead", "unit", F.explode("tokens").alias("token"))
    shared = matrix.groupBy("token").agg(F.min("unit").alias("u"), F.max("unit").alias("v")).where("u < v").select("token")
    flags = matrix.join(shared, "token").groupBy("lead").agg(F.collect_list("token").alias("flags"))  # at most a block's union
    least = rows.groupBy("lead").agg(F.min("need").alias("least"))
    # a leader without shared tokens has no flags; its classes that may lack all of their half are opened nonetheless
    flags = least.join(flags, "lead", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<bigint>")))
    flags = keep(flags.where(F.size("flags") >= F.col("least")).select(F.col("lead").alias("l"), "flags"))
    members = rows.select("cls", "lead", "n", "text").groupBy("lead")
    open_ = keep(members.cogroup(flags.groupBy("l")).applyInArrow(lambda x, y: _open(x, y), "cls bigint, lead bigint, n bigint, text string"))
    # A link joins two open classes, so these alone go on, with all their shingles.
    placed = open_.join(unit, "lead").select("cls", "unit", "n", "text")
    tokens = keep(placed.mapInArrow(_shingles, "cls bigint, unit bigint, n bigint, token bigint"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("unit").alias("u"), F.max("unit").alias("v")).where("u < v").select("token", "df")
    common = tokens.join(often, "token")
    # Rarest first, a class's own shingles stand before those; a pair that links shares one of the first n - ceil(3 n / 4) + 1.
    order = Window.partitionBy("cls").orderBy("df", "token")
    ranked = common.withColumn("at", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("cls")) + F.row_number().over(order) - 1)
    first = cut(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * SHARE / PARTS)).select("token", "cls", "unit", "n", "at"))
    other = first.toDF("token", "b", "unit_b", "n_b", "at_b")
    # of the first shared shingle, what is left on either side bounds the intersection
    fits = f"unit <> unit_b AND cls < b AND {PARTS + SHARE} * least(n - at, n_b - at_b) >= {SHARE} * (n + n_b)"
    pairs = first.join(other, (first["token"] == other["token"]) & F.expr(fits)).select(F.col("cls").alias("a"), "b").distinct()
    pairs = cut(pairs)
    texts = open_.select("cls", "text")
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_compared, "a bigint, b bigint")


def _open(rows: pa.Table, flags: pa.Table) -> pa.Table:
    """One leader's classes that have enough of their half in other units, or may lack all of it."""
    if not len(flags) or not len(rows):
        return rows.slice(0, 0)
    rows = rows.combine_chunks()
    token = np.sort(flags.column("flags").combine_chunks().values.to_numpy()).view(np.int64)
    kept = []
    for s in shingle_sets(rows.column("text").combine_chunks()):
        own = half(s)
        kept.append(int(np.isin(own.view(np.int64), token).sum()) >= len(own) - lacking(len(s)))
    return rows.filter(pa.array(kept, pa.bool_()))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with texts to a row per shingle."""
    for b in grouped(batches, "text", 1 << 20):
        sets = shingle_sets(b.column(3))
        times = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(np.array(b.column(i)), times), pa.int64()) for i in range(3)), pa.array(np.concatenate(sets).view(np.int64))], ["cls", "unit", "n", "token"])


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own) to doc_id, own, n_shingles, component_id and comp.

    comp names the component (null for a row without shingles), component_id is its smallest doc_id.
    Classes are named by 64 bits of their sets; ``own`` is carried along. A row without doc_id takes part
    like any other, but names no component; where none of a component has one, component_id is null.
    """
    tables: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        tables.append(saved(df))
        return tables[-1]

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("own").cast("string").alias("own"))
    docs = docs.withColumn("row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    sets = classed(docs)
    classes = cut(sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.max("stays").alias("stays"), F.min("row").alias("row")))
    # a class's text comes from the rows of one name: repeated ones, and one of another text once in a long while
    named = docs.join(classes.where("stays").select("row", "cls"), "row").select("cls", "text")
    voted = keep(named.mapInArrow(_votes, "cls bigint, n bigint, text string, votes array<bigint>").dropDuplicates(["cls"]))
    rows, links = _units(voted, keep)
    leads = rows.select("lead").distinct()
    if links is None:
        unit = cut(leads.withColumn("unit", F.col("lead")))
    else:
        joined = components(links)
        unit = cut(leads.join(joined, leads["lead"] == joined["node"], "left").select("lead", F.coalesce("component", "lead").alias("unit")))
    # what is read twice is cut, so that no plan holds it twice
    of = cut(rows.select("cls", "lead").join(unit, "lead").select("cls", "unit"))
    crossing = cut(_crossing(rows, unit, keep))
    if crossing.isEmpty():
        comp = of.withColumnRenamed("unit", "comp")
    else:
        ends = crossing.join(of.select(F.col("cls").alias("a"), F.col("unit").alias("ua")), "a").join(of.select(F.col("cls").alias("b"), F.col("unit").alias("ub")), "b")
        joined = components(ends.select(F.col("ua").alias("a"), F.col("ub").alias("b")))
        comp = of.join(joined, of["unit"] == joined["node"], "left").select("cls", F.coalesce("component", "unit").alias("comp"))
    named = cut(comp.join(classes.select("cls", "low"), "cls"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("lowest"))
    named = named.join(lowest, "comp").select("cls", "comp", "lowest")
    names = cut(classes.join(named, "cls", "left").select("cls", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("comp", "cls").alias("comp")))
    discard(*tables)
    found = sets.join(names, "cls", "left")
    return found.select("doc_id", "own", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("comp")).alias("comp"))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Texts without words, null ones among them, have no shingles and are their own component. Rows of
    equal texts are one class, repeated rows too. A row without doc_id links like others, but names no
    component; alone it has none. Texts are compared whole; other columns are left out; an empty table
    stays empty. A document below its half's bound by itself (a few shingles, none of even hash) is kept
    for the next step.
    """
    return near_rows(docs.select("doc_id", "text", F.lit(None).cast("string").alias("own"))).select("doc_id", "n_shingles", "component_id")


def op9_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' components under 5-word shingles and a Jaccard similarity of 0.75."""
    return near_components(documents(spark, sf_dir))
