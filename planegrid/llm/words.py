"""Words of an Arrow text column as 64-bit hashes, computed over the column's bytes with NumPy.

A text's bytes are hashed where they lie, in pieces of about a megabyte, so a batch takes some ten bytes
of working memory per byte of a piece and 24 bytes per word, whatever the length of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

PIECE = 1 << 20
#: Texts of about so many bytes are handled together.
GROUP = 4 << 20

_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F | 1

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse; the tables grow with the longest word or block seen.

    They are made where they are first used, so that the driver, which hashes no text, has none.
    """

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def grow(self, n: int) -> None:
        if n > self.n:
            n = max(n, PIECE + 4096)
            inverse = pow(self.base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, self.base, np.uint64)])
                self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])
            self.n = n


_bytes, _words = _Powers(_BASE), _Powers(_WORD_BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Some texts and their words.

    data: the bytes; bounds: where texts begin and end in them; starts, ends: of the words;
    first: index of each text's first word, one more at the end; words of text i are first[i]:first[i + 1].
    """

    def __init__(self, column: pa.Array, lower: bool = False, blank: np.ndarray = BLANK):
        column = column.cast(pa.large_binary()).fill_null(b"")
        n = len(column)
        bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
        values = column.buffers()[2]
        data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if n and values is not None and values.size else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.bounds = bounds - bounds[0]
        off = blank[self.data]
        begins = np.empty(len(off) + 1, bool)
        begins[0] = True
        begins[1:-1] = off[:-1]
        begins[-1] = True
        begins[self.bounds] = True  # a word ends with its text
        self.starts = np.flatnonzero(begins[:-1] & ~off)
        stops = np.empty(len(off), bool)
        if len(off):
            stops[:-1] = off[1:]
            stops[-1] = True
            stops[self.bounds[1:][self.bounds[1:] > 0] - 1] = True
        self.ends = np.flatnonzero(stops & ~off) + 1
        self.first = np.searchsorted(self.starts, self.bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes."""
        stops = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + PIECE, "right")))
            s0 = self.starts[i]
            piece = self.data[s0 : self.ends[j - 1]].astype(np.uint64)
            _bytes.grow(len(piece) + 1)
            piece += np.uint64(1)
            piece *= _bytes.up[: len(piece)]
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(piece, out=sums[1:])
            a, b = self.starts[i:j] - s0, stops[i:j] - s0
            out[i:j] = mixed((sums[b] - sums[a]) * _bytes.down[a])
            i = j
        return out


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of h[i:i + width] for each i that has so many; texts are not told apart here."""
    n = len(h) - width + 1
    out = np.empty(max(0, n), np.uint64)
    step = 1 << 17
    _words.grow(step + width + 1)
    for i in range(0, n, step):
        part = h[i : i + step + width - 1] * _words.up[: len(h[i : i + step + width - 1])]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        m = len(part) - width + 1
        out[i : i + m] = mixed((sums[width : width + m] - sums[:m]) * _words.down[:m])
    return out


def word_hash(word: str) -> int:
    return int(Texts(pa.array([word])).hashes()[0])


def block_name(h: np.ndarray, ordinal: int) -> int:
    """A task's block of this ordinal, whose rows have these hashes.

    A block made again from the same rows has the same name; blocks of equal rows have different ones.
    """
    place = (TaskContext.get().partitionId() << 32) + ordinal
    with np.errstate(over="ignore"):
        rows = np.bitwise_xor.reduce(mixed(h ^ np.arange(len(h), dtype=np.uint64))) if len(h) else np.uint64(0)
        return int(mixed(mixed(np.array([place], np.uint64)) + rows)[0].view(np.int64))


#: Rows of a run at most: they are numbered in 15 bits.
ROWS = 1 << 15


def grouped(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of at most ``ROWS`` rows whose texts have about ``size`` bytes together."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
        i = 0
        while i < len(texts):
            j = min(i + ROWS, max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j
