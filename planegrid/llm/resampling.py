"""Importance resampling towards a target distribution of hashed n-grams.

Distinct words of the corpus and the target get ids in one dictionary: 63 bits of a hash, and numbers of their own for
words that share these. Texts travel as numbers of their block's words, a row a text; a block's n-grams are tuples of ids,
each once with its count, so a frequent n-gram is a row per block where counts meet. Each distinct tuple's bytes are
put together from the dictionary and hashed once, counts fall into the buckets, and each bucket's gain goes back by
tuple to the blocks, where a text's gains add up. A draw that depends on the doc_id turns the sums into a sample
without replacement (Gumbel top-k).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_join, cut, discard, documents, saved
from .licenses import BLANK
from .words import Texts, grouped

#: Buckets of the hashed n-grams, also the weight of the uniform part of both distributions.
BUCKETS = 10_000
#: Bytes of text of a block, whose distinct words and n-grams travel once.
BLOCK = 8 << 20
#: Words of a text that may be drawn.
LEAST = 20
#: Percent of these texts that are drawn.
SHARE = 10
SEED = 2024

#: Words that may share their id's bits with others and are told apart by numbers of their own.
CLASHES = 100_000

#: Rows of tuples, or words of texts, that a batch of a block's rows has, so that none is as large as the block.
SLICE = 1 << 15

#: What stands for a gain of 0 in 32 bits.
_ZERO = 1 << 31

def _words(b: pa.RecordBatch) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where the words of each text of a batch (side, doc_id, text) begin, and the words with the distinct ones as dictionary."""
    t = Texts(b.column(2), lower=True, blank=BLANK)
    inside = np.zeros(len(t.data) + 1, np.int8)
    inside[t.starts] = 1
    inside[t.ends] -= 1
    letters = t.data[np.cumsum(inside[:-1], dtype=np.int8, out=inside[:-1]).view(bool)]
    sizes = np.zeros(len(t.starts) + 1, np.int64)
    np.cumsum(t.ends - t.starts, out=sizes[1:])
    first = t.first
    del t, inside
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(letters)])
    return first, words.dictionary_encode()


def _ids(words: pa.Array, bits: int, own: dict[bytes, int]) -> np.ndarray:
    """Ids of distinct words: ``bits`` of a hash, or the number that a word has of its own."""
    said = words.to_pylist()
    ids = np.frombuffer(b"".join(blake2b(w, digest_size=8).digest() for w in said), np.uint64) >> np.uint64(64 - bits)
    ids = ids.astype(np.int64)
    if own:
        ids = np.array([own.get(w, i) for w, i in zip(said, ids.tolist())], np.int64)
    return ids


def _spelled(bits: int):  # noqa: ANN202
    """(side, doc_id, text) to (id, word), each word once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, size=BLOCK):
            words = _words(b)[1].dictionary
            yield pa.RecordBatch.from_arrays([pa.array(_ids(words, bits, {})), words.cast(pa.binary()).cast(pa.string())], ["id", "word"])

    return run


def _columns(most: int) -> str:
    """Of a block's rows: first its distinct tuples with their counts (one of one word stands as its id if ``most`` is 1), then its texts, of which codes is not null."""
    return f"side int, block bigint, ordinal int, gram {'array<bigint>' if most > 1 else 'bigint'}, times bigint, doc_id bigint, codes array<int>"


def _block(b: pa.RecordBatch, block: int, bits: int, own: dict[bytes, int], most: int) -> Iterator[pa.RecordBatch]:
    first, known = _words(b)
    codes = pa.ListArray.from_arrays(pa.array(first, pa.int32()), known.indices.cast(pa.int32()))
    ids = _ids(known.dictionary, bits, own)
    del known
    side = b.column(0)[0].as_py()
    gram = pa.list_(pa.int64()) if most > 1 else pa.int64()
    names = ["side", "block", "ordinal", "gram", "times", "doc_id", "codes"]
    named = lambda n: [pa.array(np.full(n, side, np.int32)), pa.array(np.full(n, block))]
    ordinal = 0
    for tuples, number, _ in _tuples(codes, most):
        times = np.bincount(number, minlength=len(tuples))
        for i in range(0, len(tuples), SLICE):
            k, n = (part := ids[tuples[i : i + SLICE]]).shape
            lists = pa.array(part.reshape(-1))
            if most > 1:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * n + 1, n), pa.int32()), lists)
            places = pa.array(np.arange(ordinal, ordinal + k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*named(k), places, lists, pa.array(times[i : i + k]), pa.nulls(k, pa.int64()), pa.nulls(k, codes.type)], names)
            ordinal += k
    i = 0
    while i < len(codes):
        j = max(i + 1, int(np.searchsorted(first, first[i] + SLICE, "right")) - 1)
        k = j - i
        yield pa.RecordBatch.from_arrays([*named(k), pa.nulls(k, pa.int32()), pa.nulls(k, gram), pa.nulls(k, pa.int64()), b.column(1).slice(i, k), codes.slice(i, k)], names)
        i = j


def _coded(bits: int, own: dict[bytes, int], most: int):  # noqa: ANN202
    """(side, doc_id, text) to the rows of blocks: a row for each of their distinct tuples, and a row for each text, as numbers of its block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for ordinal, b in enumerate(grouped(batches, size=BLOCK)):
            yield from _block(b, place + ordinal, bits, own, most)

    return run


def dictionary(rows: DataFrame, bits: int = 63) -> tuple[DataFrame, dict[bytes, int]]:
    """(side, doc_id, text) to a saved table (id, word), and the words that have an id of their own, as others share their bits.

    Of 10^10 words about five share 63 bits with another; more than ``CLASHES`` are an error.
    """
    words = saved(rows.mapInArrow(_spelled(bits), "id bigint, word string").distinct())
    shared = cut(words.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if shared.isEmpty():
        return words, {}
    apart = words.join(shared, "id", "left_semi").orderBy("word").select("word").limit(CLASHES + 1).collect()
    if len(apart) > CLASHES:
        raise ValueError(f"over {CLASHES} words share their {bits} bits")
    own = {r["word"]: -1 - i for i, r in enumerate(apart)}
    added = rows.sparkSession.createDataFrame([(i, w) for w, i in own.items()], "id bigint, word string")
    all_ = saved(words.join(shared, "id", "left_anti").unionByName(added))
    discard(words)
    return all_, {w.encode(): i for w, i in own.items()}


def _tuples(codes: pa.ListArray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to ``most``: a block's distinct tuples of n codes, the tuple of each n-gram, and its text. All codes of a block are in use, from 0 on."""
    ends = np.asarray(codes.offsets)
    flat = np.asarray(codes.values)[ends[0] : ends[-1]]
    of = np.repeat(np.arange(len(codes), dtype=np.int32), np.diff(ends))
    yield np.arange(flat.max() + 1 if len(flat) else 0).reshape(-1, 1), flat, of
    for n in range(2, most + 1):
        at = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.zeros(0, np.int64)
        grams = np.stack([flat[at + i] for i in range(n)], axis=1)
        distinct, number = np.unique(grams, axis=0, return_inverse=True)
        yield distinct, number.reshape(-1), of[at]


def _weights(most: int):  # noqa: ANN202
    """A block's row of gains, if it has words, and the rows of its texts (doc_id, codes) to a row per text: the number of its n-grams and the sum of their gains, which lie in the low halves of numbers that their order gives the high half."""

    def run(gains: pa.Table, texts: pa.Table) -> pa.Table:
        n = len(texts)
        gain = np.concatenate([np.asarray(x.values, np.int64) for x in gains.column("gains")] or [np.zeros(0, np.int64)])
        gain = ((np.sort(gain) & 0xFFFFFFFF) - _ZERO).astype(np.float64)
        codes = texts.column("codes").combine_chunks()
        words = np.diff(np.asarray(codes.offsets)).astype(np.int64)
        features, weight, ordinal = np.zeros(n, np.int64), np.zeros(n), 0
        for tuples, number, of in _tuples(codes, most):
            features += np.bincount(of, minlength=n)
            weight += np.bincount(of, gain[ordinal : ordinal + len(tuples)][number], n)
            ordinal += len(tuples)
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": words, "n_features": features, "weight": weight.astype(np.int64)})

    return run


def weights(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, bits: int = 63) -> DataFrame:
    """(doc_id, text) to doc_id, n_words, n_features and weight, the sum of the gains of a text's n-grams of 1 to ``most`` words.

    ``target`` has the column text. A bucket's gain is a thousand times the logarithm of its share among the target's
    n-grams over its share among those of ``docs``, both with one n-gram more in each bucket, rounded down. A text
    without words, a null one too, has no n-grams and the weight 0. Repeated rows count repeatedly; other columns are
    left out; an empty table stays empty, and an empty target has no n-grams. The result is not cut: it reads saved tables.
    """
    sides = docs.select(F.lit(0).alias("side"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    other = target.select(F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("doc_id"), "text")
    rows = sides.unionByName(other)
    words, own = dictionary(rows, bits)
    blocks = saved(rows.mapInArrow(_coded(bits, own, most), _columns(most)))
    grams = blocks.where("codes is null")
    part = lambda i: F.get("gram", F.lit(i)) if most > 1 else F.col("gram")
    on_side = lambda i: F.sum(F.when(F.col("side") == i, F.col("times")).otherwise(0))
    distinct = saved(grams.groupBy("gram").agg(on_side(0).alias("s"), on_side(1).alias("t")))
    # a word's bytes go to the place that it has in a tuple
    spelled = distinct.withColumn("id", part(0)).join(words.withColumnRenamed("word", "text"), "id").drop("id")
    for i in range(1, most):
        longer = spelled.withColumn("id", part(i)).join(words, "id", "left").drop("id")
        spelled = longer.withColumn("text", F.concat_ws(" ", "text", "word")).drop("word")
    hashed = saved(spelled.select("gram", "s", "t", F.pmod(F.crc32("text"), F.lit(buckets)).alias("bucket")))
    discard(distinct, words)
    # as many rows as buckets, whatever the corpus
    filled = hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    all_s, all_t = (sum(r[k] for r in filled) for k in ("s", "t"))
    counts = docs.sparkSession.createDataFrame([tuple(r) for r in filled], "bucket bigint, s bigint, t bigint")
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * F.lit(float(all_s + buckets)) / (d(F.col("s") + 1) * F.lit(float(all_t + buckets)))
    gains = counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    priced = hashed.join(F.broadcast(gains), "bucket").select("gram", "gain")
    # a block has one row of a tuple, so no tuple has more rows than there are blocks
    back = grams.where("side = 0").select("block", "ordinal", "gram").join(priced.hint("merge"), "gram")
    packed = F.shiftleft(F.col("ordinal").cast("bigint"), 32) + F.col("gain") + _ZERO
    back = back.groupBy("block").agg(F.collect_list(packed).alias("gains"))
    # a block meets its gains text by text: no row, and in a worker no batch, holds more than one block
    texts = blocks.where("side = 0 and codes is not null").select(F.col("block").alias("at"), "doc_id", "codes")
    both = back.groupBy("block").cogroup(texts.groupBy("at"))
    out = saved(both.applyInArrow(_weights(most), "doc_id bigint, n_words bigint, n_features bigint, weight bigint"))
    discard(blocks, hashed)
    return out


def numbered(rows: DataFrame, order: list) -> DataFrame:  # noqa: ANN001
    """Add ``place``, from 1 without gaps over all rows in this order: ranges are numbered by themselves, each from where those before it end."""
    dealt = saved(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    # a row per partition
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    inside = Window.partitionBy("__part").orderBy(*order)
    return checked_join(dealt.withColumn("__i", F.row_number().over(inside)), starts, "__part").withColumn("place", F.col("__start") + F.col("__i")).drop("__part", "__start", "__i")


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, least: int = LEAST, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, text) to doc_id, n_features, weight, score and rank (1, 2, 3... of the drawn texts, else null).

    Of the N texts of at least ``least`` words the floor(share * N / 100) of the highest scores are drawn, ties to the
    smaller doc_id. A score is the weight and a draw that depends on seed and doc_id. A row without doc_id draws as
    one of an empty doc_id and stands before others of its score; of rows that share score and doc_id any may come first.
    """
    weighed = weights(docs, target, most, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + draw).withColumn("may", F.col("n_words") >= least)
    drawn = share * weighed.where(F.col("n_words") >= least).count() // 100
    ranked = numbered(scored, [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()])
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


def op12_word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark's texts."""
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
