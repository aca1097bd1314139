"""Substring dedup on a compacted de Bruijn graph of token k-mers.

A window of 35 words that occurs twice holds the same words of smallest hash in both places: its anchor, a run of
K words. Where a long passage repeats, both places have the same anchors in between, so the graph is made
of anchors alone, about one word in 13.

1. Anchors are the nodes. The k-mer from an anchor to the end of the next one in its text, a run of a few
   dozen words, is an edge between its two ends, labelled with all of its words.
2. Edges that repeat and do not branch at either end are compacted into paths, by pointer doubling over
   Spark joins. A run of a text's edges along a path has source coordinates: where it begins and ends in the
   text, and in the path. All runs that cover the same stretch of a path have the same words there, so a
   window inside two runs is a repeat; one sweep along each path finds these stretches.
3. Windows that reach over an end of a run (where texts part, or paths branch) are verified by their words: a
   hash of each meets those of the others, and of every stretch of a path once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, documents, saved, spread_join
from .words import Texts, grouped, mixed, window_hashes

WINDOW = 35
#: Words of an anchor; half a window's at most.
K = 10
BATCH = 6 << 20


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each run of ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def kmer_words(window: int) -> int:
    return min(K, max(1, window // 2))


def anchors(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the anchors: k-mers that are the smallest of a window inside one text."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = kmer_words(window)
    kmers = window_hashes(h, k)
    kmers |= np.uint64(1)  # 0 is below all
    width = window - k + 1
    least = _sliding(kmers, width, np.minimum)  # of the window that starts here
    ends = np.repeat(first[1:], np.diff(first))[: len(least)]
    least[np.arange(len(least)) + window > ends] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = _sliding(padded, width, np.maximum)[: len(kmers)]
    at = np.flatnonzero(kmers == most)
    return at, kmers[at]


def _scattered(h: np.ndarray, parts: int, block: int) -> tuple[list[tuple], np.ndarray]:
    """Rows by hash range of a block's distinct hashes, and which of its hashes are settled.

    What the block holds twice is settled; it goes out once, for other blocks to see, and so a frequent
    hash costs a row a block. Any other hash goes out with its place in the block.
    """
    order = np.argsort(h, kind="stable")
    own = h[order]
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    times = np.diff(np.r_[new, len(own)])
    settled = np.zeros(len(h), bool)
    settled[order] = np.repeat(times > 1, times)
    own, owner = own[new], np.where(times > 1, _MANY, order[new]).astype(np.uint32)
    part = ((own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    rows = [(p, block, own[i:j].tobytes(), owner[i:j].tobytes(), None, None, None) for p, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
    return rows, settled


def _meet(table: pa.Table) -> pa.Table:
    """One hash range: for each block, the places of its hashes that other blocks have too."""
    part = table.column("part")[0].as_py()
    if part < 0:
        return table
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("a")]
    h = np.concatenate(hashes)
    owner = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("b")])
    row = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    found = np.zeros(len(h), bool)
    found[order] = np.r_[False, same] | np.r_[same, False]
    found &= owner != _MANY
    row, owner = row[found], owner[found]
    cuts = np.searchsorted(row, np.arange(len(hashes) + 1))
    blocks = table.column("block").to_pylist()
    return pa.Table.from_batches([_rows([(part, blocks[r], owner[i:j].tobytes(), None, None, None, None) for r, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i])])


def _found(table: pa.Table, n: int, settled: bytes) -> np.ndarray:
    """Which of a block's n hashes occur more than once anywhere."""
    out = np.unpackbits(np.frombuffer(settled, np.uint8), count=n).astype(bool)
    for part, places in zip(table.column("part").to_pylist(), table.column("a")):
        if part >= 0:
            out[np.frombuffer(places.as_buffer(), np.uint32)] = True
    return out


def _own_rows(table: pa.Table) -> list[dict]:
    """The row of a block itself."""
    return table.filter(pa.compute.less(table.column("part"), 0)).to_pylist()


#: What a block of texts knows of a hash: it stands once in the block, more often (the row needs no other), or the row only says so to other blocks.
ONCE, OFTEN, SAYS = 0, 1, 2


def _told(h: np.ndarray, weight: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, salt) that a block sends out for its hashes, each counted ``weight`` times.

    Rows of a kind OFTEN are spread by ``name``, the others meet by their hash; for each hash that stands
    more often one row more says so, so a frequent hash costs a row per block where it meets others.
    """
    values, first, of = np.unique(h, return_index=True, return_inverse=True)
    often = np.bincount(of, weight, len(values)) > 1
    kind = np.where(often[of], OFTEN, ONCE).astype(np.int8)
    salt = np.where(kind == OFTEN, 1 + (name & np.int64(0x3FFFFFFF)), 0).astype(np.int32)
    says = first[often]
    return np.r_[np.arange(len(h)), says], np.r_[kind, np.full(len(says), SAYS, np.int8)], np.r_[salt, np.zeros(len(says), np.int32)]


def _repeated(rows: DataFrame, hash_: str) -> DataFrame:
    """Of rows that blocks have _told, those whose hash stands more than once; a block has two rows of a hash at most in one task."""
    met = rows.repartition(hash_, "salt").withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(hash_, "salt")))
    return met.where(f"kind = {OFTEN} OR (kind = {ONCE} AND times > 1)").drop("kind", "salt", "times")


def _once(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """A batch with each key once, and how often it had it."""
    _, first, copies = np.unique(np.array(b.column(0), np.int64), return_index=True, return_counts=True)
    order = np.argsort(first)
    return b.take(pa.array(first[order])), copies[order]


PLACES = "kind byte, salt int, node bigint, key bigint, at int, edge bigint, gap int, copies bigint"


def _anchor_rows(window: int):  # noqa: ANN202
    """(key, text) to a row per anchor: its word in the text, its hash, and the edge to the next anchor."""
    k = kmer_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, size=BATCH):
            b, copies = _once(b)
            keys = np.array(b.column(0), np.int64)
            t = Texts(b.column(1))
            h = t.hashes()
            at, node = anchors(h, t.first, window)
            if not len(at):
                continue
            doc = np.searchsorted(t.first, at, "right") - 1
            follows = np.r_[doc[1:] == doc[:-1], False]
            then = np.where(follows, np.r_[at[1:], 0], at)
            edge = np.zeros(len(at), np.uint64)
            kmers = window_hashes(h, k)
            for i in range(-(-(window - k + 1) // k) + 1):  # k-mers side by side, the last one at the end
                edge = mixed(edge * np.uint64(3) + kmers[np.minimum(at + i * k, then)])
            place = (at - t.first[doc]).astype(np.int32)
            row, kind, salt = _told(node, copies[doc], keys[doc] + place)
            columns = [kind, salt, node.view(np.int64)[row], keys[doc][row], place[row], edge.view(np.int64)[row], (then - at).astype(np.int32)[row], copies[doc][row]]
            masks = [None] * 5 + [~follows[row]] * 2 + [None]
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=m) for c, m in zip(columns, masks)], ["kind", "salt", "node", "key", "at", "edge", "gap", "copies"])

    return run


def places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, text) to (key, at, node, edge, gap, copies): places of anchors that stand more than once, once for all copies of a text."""
    found = _repeated(docs.mapInArrow(_anchor_rows(window), PLACES), "node")
    return found.groupBy("key", "at", "node", "edge", "gap").agg(F.sum("copies").alias("copies"))


def paths(nodes: DataFrame, often: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of repeated anchors, and (node, n) of these, to the places with goes, and (node, path, away).

    goes: whether the text follows an edge of a path here. An edge is used if it repeats, no other repeated
    edge leaves its first node, and none enters its second. A text that runs along such edges is a
    stretch of one path, so a node first takes the longest stretch that leads to it in any text;
    stretches that begin inside a path are joined to what leads there by pointer doubling. That ends when
    no further node arrives at a first node; first nodes, and those of a circle, which has none, have no row.
    """
    text = Window.partitionBy("key").orderBy("at")  # one text's anchors
    then = F.when(F.lead("at").over(text) == F.col("at") + F.col("gap"), F.lead("node").over(text))  # null if the next anchor does not repeat
    nodes = saved(nodes.select("*", then.alias("next")))
    edges = nodes.where("next IS NOT NULL AND node <> next").groupBy("node", "next", "edge", "gap").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    edges = cut(edges)
    out = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("next").alias("to"), F.first("edge").alias("by")).where("n = 1").drop("n")
    into = edges.groupBy("next").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("next").alias("to"))
    single = cut(out.join(into, "to").join(often, "node").select("node", "to", "by", "n"))
    goes = F.coalesce((F.col("next") == F.col("to")) & (F.col("edge") == F.col("by")), F.lit(False))
    placed = saved(spread_join(nodes, single, "node", "left").select("key", "at", "node", "gap", "copies", goes.alias("goes")))
    discard(nodes)
    begins = placed.select("key", "at", "node", F.when(F.coalesce(F.lag("goes").over(text), F.lit(False)), None).otherwise(F.struct("at", "node")).alias("b"))
    stretch = begins.select("node", "at", F.last("b", ignorenulls=True).over(text).alias("b"))
    behind = stretch.groupBy("node").agg(F.max(F.struct((F.col("at") - F.col("b.at")).cast("long").alias("away"), F.col("b.node").alias("path"))).alias("m"))
    behind = cut(behind.where("m.away > 0").select("node", "m.path", "m.away"))
    arrived = -1
    while True:
        ahead = behind.toDF("path", "path2", "away2")
        joined = behind.join(ahead, "path", "left")
        behind = cut(joined.select("node", F.coalesce("path2", "path").alias("path"), (F.col("away") + F.coalesce("away2", F.lit(0))).alias("away"), F.col("path2").isNull().alias("there")))
        n, now = behind.agg(F.count(F.lit(1)), F.count_if("there")).first()
        if now == n or now == arrived:
            return placed, behind.where("there").drop("there")
        behind, arrived = behind.drop("there"), now


def runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, text) to a saved table (key, path, lo, hi, at, copies): each run of a text along a path.

    lo and hi are words of the path, from the first anchor's first to behind the last anchor's last; at is
    the text's word at lo.
    """
    nodes = saved(places(docs, window))
    often = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    placed, on = paths(nodes, often)
    discard(nodes)
    located = spread_join(placed, cut(on.join(often, "node")), "node", "left")
    located = located.withColumns({"path": F.coalesce("path", "node"), "away": F.coalesce("away", F.lit(0)).cast("long")})
    text = Window.partitionBy("key").orderBy("at")
    back = lambda c: F.lag(c).over(text)
    on_path = back("goes") & (back("path") == F.col("path")) & (back("away") + back("gap") == F.col("away"))
    numbered = located.select("*", F.when(F.coalesce(on_path, F.lit(False)), 0).otherwise(1).alias("new"))
    numbered = numbered.withColumn("run", F.sum("new").over(text))
    found = numbered.groupBy("key", "run").agg(F.min("path").alias("path"), F.min("away").alias("lo"), (F.max("away") + kmer_words(window)).alias("hi"), F.min("at").alias("at"), F.max("copies").alias("copies"))
    found = saved(found.drop("run"))
    discard(placed)
    return found


def swept(own: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Runs to (path, stretches, n), and (path, lo, hi, key, begin).

    A stretch (begin, end) holds the first words of the windows that lie in two runs or more; n are the path's
    runs. The second table names, for every stretch of a path, one run that has it from ``begin`` on. A
    path's distinct runs are at most the square of its anchors.
    """
    # cut before the windows, which would have a path's rows meet unsummed
    spans = cut(own.groupBy("path", "lo", "hi").agg(F.sum("copies").alias("copies"), F.min("key").alias("key"), F.count(F.lit(1)).alias("n")))
    along = Window.partitionBy("path").orderBy("lo", "hi")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.max("hi").over(before))
    # the second furthest end so far: what the furthest so far has beaten, or a run with copies by itself
    second = F.greatest(F.least("hi", "reach"), F.when(F.col("copies") > 1, F.col("hi")))
    second = F.when(F.col("reach").isNull() & (F.col("copies") < 2), None).otherwise(second)
    spans = cut(spans.withColumn("second", second))
    swept_ = spans.withColumn("second", F.max("second").over(along)).withColumn("next", F.lead("lo").over(along))
    stretch = swept_.where("second IS NOT NULL").select("path", F.col("lo").alias("begin"), F.least("next", F.col("second") - window + 1).alias("end")).where("end > begin")
    by_begin = Window.partitionBy("path").orderBy("begin")
    isles = stretch.select("path", "begin", "end", F.when(F.lag("end").over(by_begin) == F.col("begin"), 0).otherwise(1).alias("new"))
    isles = isles.withColumn("isle", F.sum("new").over(by_begin)).groupBy("path", "isle").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    stretches = isles.groupBy("path").agg(F.collect_list(F.struct("begin", "end")).alias("stretches"))
    stretches = stretches.join(spans.groupBy("path").agg(F.sum("n").alias("n")), "path")
    first = spans.where("reach IS NULL OR hi > reach").select("path", "lo", "hi", "key", F.greatest("lo", F.col("reach") - window + 1).alias("begin"))
    return stretches, first


RANGES = "array<struct<from:int,to:int>>"


def graph_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, text) to a saved table, a row per text with repeated anchors: key, copies, spans and removed.

    removed: the words that the graph alone shows to repeat. spans: for each run its first and last word
    (from, to), and the windows that it shows to others (begin to end).
    """
    every = runs(docs, window)
    stretches, first = swept(every, window)
    own = spread_join(every, cut(stretches), "path", "left")
    own = own.join(first.hint("merge"), ["path", "lo", "hi", "key"], "left")
    shift = F.col("at") - F.col("lo")
    inside = F.filter(
        F.transform(F.coalesce("stretches", F.array().cast("array<struct<begin:bigint,end:bigint>>")), lambda r: F.struct(F.greatest(r["begin"], F.col("lo")).alias("a"), F.least(r["end"], F.col("hi") - window + 1).alias("z"))),
        lambda r: r["z"] > r["a"],
    )
    removed = F.transform(inside, lambda r: F.struct((r["a"] + shift).cast("int").alias("from"), (r["z"] - 1 + window + shift).cast("int").alias("to")))
    shown = F.when(F.col("begin").isNotNull() & (F.col("begin") <= F.col("hi") - window), F.col("begin") + shift)
    span = F.struct(F.col("at").cast("int").alias("from"), (F.col("hi") + shift).cast("int").alias("to"), shown.cast("int").alias("begin"), (F.col("hi") - window + 1 + shift).cast("int").alias("end"))
    # at most a text's anchors
    found = saved(own.groupBy("key").agg(F.max("copies").alias("copies"), F.collect_list(span).alias("spans"), F.flatten(F.collect_list(removed)).cast(RANGES).alias("removed")))
    discard(every)
    return found


WINDOWS = "kind byte, salt int, hash bigint, key bigint, at int, upto int"


def _windows(window: int):  # noqa: ANN202
    """(key, copies, spans, text) to a row per window that reaches over a run's end or that a run shows to others.

    Windows that the block itself shows to repeat come as runs, at to upto.
    """
    k = kmer_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, size=BATCH):
            b, _ = _once(b)
            keys, copies = np.array(b.column(0), np.int64), np.array(b.column(1), np.int64)
            t = Texts(b.column(3))
            h = t.hashes()
            lists = b.column(2)
            doc = np.repeat(np.arange(len(t)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            first, stop = t.first[doc], t.first[doc + 1] - window + 1  # where windows of the text begin, and end
            field = lambda name: np.array(flat.field(name).fill_null(0), np.int64) + first
            begin, end = field("from"), field("to")
            near = _marked(len(h), np.maximum(begin - (window - k), first), np.minimum(end - k + 1, stop))
            near &= ~_marked(len(h), begin, np.minimum(end - window + 1, stop))
            shows = flat.field("begin").is_valid().to_numpy(zero_copy_only=False)
            near |= _marked(len(h), field("begin")[shows], field("end")[shows])
            at = np.flatnonzero(near)
            if not len(at):
                continue
            hashes = window_hashes(h, window)[at]
            of = np.searchsorted(t.first, at, "right") - 1
            place = (at - t.first[of]).astype(np.int32)
            row, kind, salt = _told(hashes, copies[of], keys[of] + place)
            # rows that need no other: neighbours in one
            sure = kind == OFTEN
            alone = np.flatnonzero(sure)
            new = np.r_[True, (np.diff(at[row[alone]]) > 1) | (np.diff(of[row[alone]]) > 0)] if len(alone) else np.zeros(0, bool)
            upto = place[row].copy()
            if len(alone):
                heads = np.flatnonzero(new)
                upto[alone[heads]] = place[row[alone[np.r_[heads[1:], len(alone)] - 1]]]
                drop = np.zeros(len(row), bool)
                drop[alone[~new]] = True
                row, kind, salt, upto = row[~drop], kind[~drop], salt[~drop], upto[~drop]
            columns = [kind, salt, hashes.view(np.int64)[row], keys[of][row], place[row], upto]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "salt", "hash", "key", "at", "upto"])

    return run


def _marked(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of 0 to n - 1 lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    some = begin < end
    np.add.at(edge, begin[some], 1)
    np.add.at(edge, end[some], -1)
    return np.cumsum(edge[:-1]) > 0


def end_windows(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, text) and graph_spans to the windows that are verified by their words, as _windows gives them."""
    # both tables grow with the corpus, so neither is for a broadcast at any size
    placed = docs.join(spans.hint("merge"), "key").select("key", "copies", "spans", "text")
    return placed.mapInArrow(_windows(window), WINDOWS)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, text) to a saved table (key, removed), the ranges of words in windows that occur more than once, for texts that have any.

    ``key`` is the text's; rows of one key hold one text. Where a text's copies give its windows in several
    tasks they meet each other, and all windows of a text with copies repeat.
    """
    spans = graph_spans(docs, window)
    found = _repeated(end_windows(docs, spans.drop("removed"), window), "hash")
    found = found.groupBy("key").agg(F.collect_list(F.struct(F.col("at").alias("from"), (F.col("upto") + window).cast("int").alias("to"))).alias("removed"))  # at most a text's windows
    both = found.unionByName(spans.where(F.size("removed") > 0).select("key", "removed"))
    out = saved(both.groupBy("key").agg(F.flatten(F.collect_list("removed")).alias("removed")))  # two rows at most
    discard(spans)
    return out


def _cut_out(rest: list[str], joined: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches):
            t = Texts(b.column(b.schema.get_field_index("text")))
            texts, n_removed = [], []
            ranges = b.column(b.schema.get_field_index("removed")).to_pylist()
            for i, own in enumerate(ranges):
                a, z = int(t.first[i]), int(t.first[i + 1])
                keep = np.ones(z - a, bool)
                for r in own or ():
                    keep[r["from"] : r["to"]] = False
                n_removed.append(int(len(keep) - keep.sum()))
                data = t.data[t.bounds[i] : t.bounds[i + 1]].tobytes()
                if joined:
                    at = int(t.bounds[i])
                    words = [data[s - at : e - at] for s, e in zip(t.starts[a:z][keep].tolist(), t.ends[a:z][keep].tolist())]
                    data = b" ".join(words)
                elif n_removed[-1]:
                    # a word goes with the blanks behind it
                    stops = np.r_[t.starts[a + 1 : z], t.bounds[i + 1]]
                    gone = np.zeros(len(data) + 1, np.int32)
                    gone[t.starts[a:z][~keep] - t.bounds[i]] += 1
                    gone[stops[~keep] - t.bounds[i]] -= 1
                    data = np.frombuffer(data, np.uint8)[np.cumsum(gone)[:-1] == 0].tobytes()
                texts.append(data.decode("utf-8", "surrogatepass"))
            valid = b.column(b.schema.get_field_index("text")).is_valid()
            kept = pa.array(texts, pa.string()) if joined else pa.compute.if_else(valid, pa.array(texts, pa.string()), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), kept, pa.array(t.counts, pa.int64()), pa.array(n_removed, pa.int64())], [*rest, "text", "n_words", "n_removed"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, joined: bool = False) -> DataFrame:
    """``docs`` without the words that lie in a window of ``window`` words found anywhere else.

    Windows are judged on the input: every copy of a repeated passage goes. Adds n_words and n_removed;
    columns of these names, and of the name removed or key, are replaced, others stay. What is left of a
    text keeps its own blanks, or with ``joined`` is the kept words with one space between.
    Null texts have no words and stay null (joined: empty); texts of fewer words than a window stay as
    they are; of repeated rows nothing is left if they have a window. An empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "removed", "key")]
    keyed = docs.select(*rest, "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    found = repeated_spans(keyed.select("key", F.coalesce("text", F.lit("")).alias("text")), window)
    both = keyed.join(found.hint("merge"), "key", "left").select(*rest, "text", "removed")
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return both.mapInArrow(_cut_out(rest, joined), schema)


def op2_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word windows that occur twice."""
    kept = without_repeats(documents(spark, sf_dir).select("doc_id", "text"), joined=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
