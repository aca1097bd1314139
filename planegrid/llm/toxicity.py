"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector for all thresholds. A feature is a word
or a word's beginning, its value 1 + log(times it stands in the text). An L1 penalty leaves weights to few words, and the
model keeps those alone, by their 64-bit hash, so words of no weight cannot collide with them.
The fit reads a bounded sample of labelled rows (``SAMPLE``); scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents
from .licenses import BLANK
from .words import Texts, grouped, mixed

#: Labelled rows that the fit reads at most: those of the smallest hash of doc_id.
SAMPLE = 6000
#: Sampled texts that must have a word for it to be a feature of the model.
LEAST = 5
#: Bytes of the beginnings of words that are features beside the whole words.
BEGINNINGS = (6, 8)
PENALTY = 3e-3
#: Steps at most; they end when no weight moves by more than TOLERANCE of the largest.
STEPS, TOLERANCE = 300, 1e-5


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # increasing; grades are 0 to len(thresholds)


def _hashed(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every place of a feature: words, and their beginnings of ``BEGINNINGS`` bytes."""
    doc = np.repeat(np.arange(len(t)), t.counts)
    kinds = [t.hashes()] + [mixed(t.hashes(n) ^ np.uint64(n)) for n in BEGINNINGS]
    return np.tile(doc, len(kinds)), np.concatenate(kinds)


def _features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of each distinct feature of each text."""
    doc, h = _hashed(t)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.r_[at, len(h)])


class Sample(NamedTuple):
    """Labelled texts: label of each, and (row, feature, times) of the features that enough of them have."""

    label: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    times: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, least: int = LEAST) -> Sample:
    """Up to ``rows`` labelled documents; labels or documents without an id, and null labels, are left out.

    Features are counted by Spark; those of fewer than ``least`` sampled texts are no features of the model and do not reach
    the driver. All others do: their number follows from the sampled texts alone.
    """
    drawn = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    drawn = drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches):
            doc, h, times = _features(Texts(b.column(1), lower=True, blank=BLANK))
            ids = np.array(b.column(0))[doc]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.view(np.int64)), pa.array(times, pa.int64())], ["doc_id", "feature", "times"])

    own = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id")  # at most SAMPLE rows
    found = cut(own.mapInArrow(run, "doc_id bigint, feature bigint, times bigint").groupBy("doc_id", "feature").agg(F.max("times").cast("int").alias("times")))
    common = found.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    common = common.select("feature")
    ids = drawn.toPandas()
    table = found.join(common, "feature").toArrow()
    order = np.argsort(ids["doc_id"].to_numpy())
    row = np.searchsorted(ids["doc_id"].to_numpy()[order], table.column("doc_id").to_numpy())
    return Sample(ids["toxic"].to_numpy()[order], row, table.column("feature").to_numpy().view(np.uint64), table.column("times").to_numpy())


def severity(s: Sample, grades: int = 3) -> np.ndarray:
    """Grades for rows that are only labelled toxic or not: 0 if not, else 1 to ``grades``.

    Toxic rows are ranked by the share of their features that the sample has mostly in toxic rows, and split
    into equal parts.
    """
    out = np.zeros(len(s.label), int)
    own = np.flatnonzero(s.label > 0)
    _, at = np.unique(s.feature, return_inverse=True)
    n, bad = np.bincount(at), np.bincount(at, s.label[s.row] > 0)
    telling = bad >= 0.9 * n
    share = np.bincount(s.row, telling[at] * s.times, len(out)) / np.maximum(1, np.bincount(s.row, s.times, len(out)))
    rank = np.argsort(np.argsort(share[own], kind="stable"), kind="stable")
    out[own] = 1 + rank * grades // max(1, len(own))
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(s: Sample, grade: np.ndarray, penalty: float = PENALTY) -> Model:
    """The cumulative-link model of the rows' grades.

    A first fit under the L1 penalty picks the features, a second one under a thirtieth of it weighs them.
    Grades that no row has are merged downwards; with fewer than two grades the model has no thresholds
    and every severity is 0.
    """
    levels = np.unique(grade)
    if len(levels) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    y = np.searchsorted(levels, grade)
    row, value = s.row, 1 + np.log(s.times)
    words, column = np.unique(s.feature, return_inverse=True)
    kept = np.ones(len(words), bool)
    for share in (1.0, 1 / 30):
        use = kept[column]
        words, column, row, value = words[kept], (np.cumsum(kept) - 1)[column[use]], row[use], value[use]
        w, theta = _solve(row, column, value, y, len(words), penalty * share)
        kept = w != 0
    return Model(words[kept], w[kept], theta)


def _solve(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient steps on the whole sample."""
    k = int(y.max())
    below = np.array([(y < j).mean() for j in range(1, k + 1)])
    theta = np.log(below / (1 - below))

    def slope(w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        eta = np.bincount(row, w[column] * value, len(y))
        edge = np.r_[-np.inf, theta, np.inf]
        hi, lo = np.where(y == k, 1.0, _logistic(edge[y + 1] - eta)), np.where(y == 0, 0.0, _logistic(edge[y] - eta))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_theta = np.array([-d_hi[y == j].sum() + d_lo[y == j + 1].sum() for j in range(k)])
        return np.bincount(column, (d_hi - d_lo)[row] * value, width) / len(y), g_theta / len(y)

    v = np.ones(width)  # the largest eigenvalue bounds the curvature
    for _ in range(20):
        v /= np.linalg.norm(v) + 1e-300
        v = np.bincount(column, np.bincount(row, v[column] * value, len(y))[row] * value, width) / len(y)
    step = 1 / (0.5 * (np.linalg.norm(v) + 1))
    w = ahead = np.zeros(width)
    ahead_theta, t = theta, 1.0
    for _ in range(STEPS):
        g, g_theta = slope(ahead, ahead_theta)
        new = ahead - step * g
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        new_theta = np.maximum.accumulate(ahead_theta - step * g_theta)
        # started afresh where it overshoots
        t, before = (1.0, 1.0) if (ahead - new) @ (new - w) > 0 else ((1 + (1 + 4 * t * t) ** 0.5) / 2, t)
        pull = (before - 1) / t
        if np.abs(new - w).max(initial=0) <= TOLERANCE * np.abs(new).max(initial=0) and np.abs(new_theta - theta).max() <= TOLERANCE:
            return new, new_theta
        ahead, ahead_theta = new + pull * (new - w), np.maximum.accumulate(new_theta + pull * (new_theta - theta))
        w, theta = new, new_theta
    return w, theta


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to doc_id, expected_severity, p_toxic (the chance of a grade over 0), grade (the likeliest) and toxic.

    Null texts and texts without words have severity 0; repeated rows give repeated rows; other columns
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches):
            t = Texts(b.column(1), lower=True, blank=BLANK)
            eta = np.zeros(len(t))
            if len(model.words):
                doc, h = _hashed(t)
                at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                found = np.flatnonzero(model.words[at] == h)
                pairs, times = np.unique(doc[found] * len(model.words) + at[found], return_counts=True)
                eta = np.bincount(pairs // len(model.words), model.weights[pairs % len(model.words)] * (1 + np.log(times)), len(t))
            over = np.stack([1 - _logistic(x - eta) for x in model.thresholds], 1) if len(model.thresholds) else np.zeros((len(t), 0))
            over[t.counts == 0] = 0
            share = np.diff(np.c_[np.zeros(len(t)), 1 - over, np.ones(len(t))], axis=1)
            p = over[:, 0] if over.shape[1] else np.zeros(len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(over.sum(1)), pa.array(p), pa.array(share.argmax(1), pa.int32()), pa.array(p >= 0.5)], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    schema = "doc_id bigint, expected_severity double, p_toxic double, grade int, toxic boolean"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def op5_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents by a model of their labels."""
    docs = documents(spark, sf_dir)
    rows = sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = predict(docs, fit(rows, severity(rows)))
    return found.withColumns({c: F.round(c, 6) for c in ("expected_severity", "p_toxic")})
