"""Subword encoding that keeps offsets, and its inverse.

A text is normalised by the longest prefix that the model's compiled character map holds at each place; every
normalised character records the source byte that it comes from. Merges never cross a border that no piece of the
vocabulary holds, such as a blank's mark behind another character: what lies between two borders is merged once by
a worker and looked up from then on. The characters of the pieces, added up, point into the record of source bytes,
which gives each piece's span.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents
from .words import grouped

#: The mark that stands for a blank.
MARK = "▁"
#: Characters of the segments that a Python worker remembers, together.
REMEMBERED = 6_000_000
#: Characters of a segment whose pairs are looked through at each merge; longer ones are merged with a heap.
FEW = 40
#: Bytes of text handled together.
GROUP = 1 << 20

_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double array over UTF-8 keys, then the replacements, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    texts = blob[4 + size :]
    below = (units >> 10) << ((units & 512) >> 6)
    label = units & (1 << 31 | 255)
    letters = np.arange(1, 256)
    rules = {}
    todo = [(int(below[0]), b"")]
    while todo:
        base, key = todo.pop()
        at = base ^ letters
        inside = at < len(units)
        for c in letters[inside][label[at[inside]] == letters[inside]].tolist():
            node = base ^ c
            child = node ^ int(below[node])
            if units[node] >> 8 & 1:
                begin = int(units[child] & 0x7FFFFFFF)
                rules[(key + bytes([c])).decode()] = texts[begin : texts.index(b"\0", begin)].decode()
            todo.append((child, key + bytes([c])))
    return rules


def _widths(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


class Normalizer:
    """Longest-prefix normalisation with the source byte of every normalised character."""

    def __init__(self, rules: dict[str, str], prefix: bool, squeeze: bool):
        self.rules, self.prefix, self.squeeze = rules, prefix, squeeze
        self.lengths: dict[str, list[int]] = {}
        for key in rules:
            self.lengths.setdefault(key[0], []).append(len(key))
        self.lengths = {c: sorted(set(n), reverse=True) for c, n in self.lengths.items()}
        self.begins = re.compile("[ " + "".join(map(re.escape, self.lengths)) + "]")

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the source byte."""
        if not text:
            return "", np.zeros(1, np.int64)
        source = np.r_[0, np.cumsum(_widths(text))]
        if not self.rules and not self.squeeze:
            return MARK * self.prefix + text.replace(" ", MARK), source if not self.prefix else np.r_[0, source]
        return self._mapped(text, source)

    def _replaced(self, text: str, i: int) -> tuple[str, int]:
        """What the longest rule at this place makes, and how many characters it takes."""
        for n in self.lengths.get(text[i], ()):
            found = self.rules.get(text[i : i + n]) if i + n <= len(text) else None
            if found is not None:
                return found, n
        return text[i], 1

    def _mapped(self, text: str, source: np.ndarray) -> tuple[str, np.ndarray]:
        i = 0
        while self.squeeze and i < len(text):
            new, n = self._replaced(text, i)
            if new != " ":
                break
            i += n
        if i == len(text):
            return "", np.zeros(1, np.int64)
        parts, at = ([MARK], [source[i : i + 1]]) if self.prefix else ([], [])
        blank = self.squeeze
        while i < len(text):
            hit = self.begins.search(text, i)
            j = hit.start() if hit else len(text)
            if j > i:
                parts.append(text[i:j])
                at.append(source[i:j])
                i, blank = j, False
                continue
            new, n = self._replaced(text, i)
            if blank:
                new = new.lstrip(" ")
            if new:
                parts.append(new)
                at.append(np.full(len(new), source[i]))
                blank = self.squeeze and new.endswith(" ")
            i += n
        out = "".join(parts).replace(" ", MARK)
        kept = len(out.rstrip(MARK)) if self.squeeze else len(out)
        return out[:kept], np.concatenate([*at, source[-1:]])[: kept + 1]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + counts[i] - 1 one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Model:
    """A BPE vocabulary with byte fallback, read from a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("not a BPE vocabulary with byte fallback and without pieces of users")
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("blanks must be marked in front of words")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        self.byte = [0] * 256
        self.bytes: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
            text = {_UNKNOWN: proto.trainer_spec.unk_surface, _CONTROL: ""}.get(p.type, p.piece.replace(MARK, " "))
            self.bytes.append(bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else text.encode())
        self.kinds = np.array([p.type for p in proto.pieces], np.int8)
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        spec = proto.normalizer_spec
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.normalizer = Normalizer(character_map(spec.precompiled_charsmap), self.prefix, self.squeeze)
        #: What can be merged by itself.
        self.segment: Callable[[str], list[str]] = re.compile(self._borders(), re.DOTALL).findall
        self.sizes = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.strips = (self.prefix or self.squeeze) & (self.kinds == _NORMAL) & np.array([b.startswith(b" ") for b in self.bytes])

    def _borders(self) -> str:
        """A pattern of segments: between letters and others, and in front of marks, where no piece holds such a border."""
        letter, other = r"[^\W\d_]", rf"(?:[^\w{MARK}]|[\d_])"
        held = lambda border: any(re.search(border, p) for p in self.ids)
        if held(f"[^{MARK}]{MARK}"):
            return ".+"
        if held(f"{letter}{other}|{other}{letter}"):
            return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        return f"{MARK}*(?:{letter}+|{other}+)|{MARK}+"

    def merged(self, s: str) -> Iterator[tuple[int, int]]:
        """(id, characters) of the pieces of a segment. The characters of one written in bytes are its last byte's."""
        for p in self._few(s) if len(s) <= FEW else self._many(s):
            known = self.ids.get(p)
            if known is not None:
                yield known, len(p)
            else:
                spelled = p.encode("utf-8", "surrogatepass")
                for k, b in enumerate(spelled, 1):
                    yield self.byte[b], int(k == len(spelled))

    def _few(self, s: str) -> list[str]:
        """The pair of the best score is merged, the first one of equals, until no pair is a piece."""
        score, none = self.scores.get, -math.inf
        part = list(s)
        pairs = [score(a + b, none) for a, b in zip(s, s[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            part[i] += part.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = score(part[i - 1] + part[i], none)
            if i < len(pairs):
                pairs[i] = score(part[i] + part[i + 1], none)
        return part

    def _many(self, s: str) -> list[str]:
        """The same with a heap, so that time grows with n log n."""
        scores = self.scores
        part: list[str] = list(s)
        left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap = []
        for i in range(len(s) - 1):
            score = scores.get(s[i : i + 2])
            if score is not None:
                heap.append((-score, i, i + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not part[i] or not part[j] or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = ""
            after = right[i] = right[j]
            if after < len(s):
                left[after] = i
                score = scores.get(part[i] + part[after])
                if score is not None:
                    heapq.heappush(heap, (-score, i, after, size + len(part[after])))
            before = left[i]
            if before >= 0:
                score = scores.get(part[before] + part[i])
                if score is not None:
                    heapq.heappush(heap, (-score, before, i, size + len(part[before])))
        return [p for p in part if p]


class Segments(dict):
    """Segments by number, with their ids and characters end to end; a new one is merged when it is looked up."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.sizes, self.starts, self.held = array("i"), array("i"), array("q", [0]), 0

    def __missing__(self, s: str) -> int:
        for i, n in self.model.merged(s):
            self.ids.append(i)
            self.sizes.append(n)
        self.starts.append(len(self.ids))
        self.held += len(s) + 1
        self[s] = len(self.starts) - 2
        return len(self.starts) - 2


def _model_path(model: str) -> str:
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


@lru_cache(maxsize=1)
def _segments(path: str) -> Segments:
    """One table for all tasks of a Python worker, one after the other."""
    return Segments(Model(path))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", end: bool = True, decoded: bool = False) -> DataFrame:
    """(doc_id, text) to doc_id, ids, begin and ends: the pieces, and the source bytes that they cover.

    The first piece covers the bytes from ``begin`` on, each other one those from the end before; ends are exclusive.
    A character written in several byte pieces belongs to the last of them; a rule's replacement to the source of
    the whole rule. With ``end`` the end id follows, at the text's end; with ``decoded`` the text that the ids
    decode to. Null and empty texts have no other id; repeated rows give repeated rows; other columns are left out;
    an empty table stays empty. Texts are encoded whole. ``model`` is a file of public_tokenizers or a path that the
    executors can read.
    """
    names = ["doc_id", "ids", "begin", "ends", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _segments(_model_path(model))
        own = table.model
        for b in grouped(batches, size=GROUP):
            if table.held > REMEMBERED:
                table.forget()
            normal = [own.normalizer(t.as_py() or "") for t in b.column(1)]
            parts = [own.segment(s) for s, _ in normal]
            number = np.array(list(map(table.__getitem__, itertools.chain.from_iterable(parts))), np.int64)
            starts = np.array(table.starts)
            counts = starts[number + 1] - starts[number]
            at = _ragged(starts[number], counts)
            ids, sizes = np.array(table.ids, np.int32)[at], np.array(table.sizes, np.int64)[at]
            last = np.r_[0, np.cumsum(counts)][np.cumsum([len(p) for p in parts])]  # of each text
            # of a text of n normalised characters n + 1 places are known, its end too
            places = np.concatenate([p for _, p in normal])
            ends = places[np.cumsum(sizes) + np.repeat(np.arange(len(normal)), np.diff(np.r_[0, last]))]
            if end:
                ids, ends = np.insert(ids, last, own.end), np.insert(ends, last, [p[-1] for _, p in normal])
                last = last + np.arange(1, len(normal) + 1)
            columns = [b.column(0), _lists(ids, last), pa.array([int(p[0]) for _, p in normal], pa.int32()), _lists(ends, last)]
            if decoded:
                columns.append(_texts(own, ids, last))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>, begin int, ends array<int>" + ", decoded string" * decoded)


def _repaired(own: Model, ids: list[int]) -> bytes:
    """Text of ids whose byte pieces are no UTF-8: of a run of them each byte that begins no character is U+FFFD."""
    out, run = [], bytearray()

    def flush() -> None:
        i = 0
        while i < len(run):
            n = next((n for n in (1, 2, 3, 4) if _is_text(bytes(run[i : i + n]))), 0)
            out.append(bytes(run[i : i + n]) if n else "�".encode())
            i += n or 1
        run.clear()

    for i in ids:
        if own.kinds[i] == _BYTE:
            run.extend(own.bytes[i])
        else:
            flush()
            out.append(own.bytes[i])
    flush()
    return b"".join(out)


def _is_text(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


def _texts(own: Model, ids: np.ndarray, last: np.ndarray) -> pa.Array:
    """The texts that ids decode to; last: where those of each text end."""
    out = []
    for a, z in zip([0, *last.tolist()], last.tolist()):
        some = ids[a:z]
        text = own.letters[_ragged(own.starts[some], own.sizes[some])].tobytes()
        silent = own.kinds[some] == _CONTROL
        if silent[:-1].any() or not _is_text(text):  # a control id ends a character too
            text = _repaired(own, some.tolist())
        some = some[~silent]
        if len(some) and own.strips[some[0]]:
            text = text.lstrip(b" ") if own.squeeze else text[1:]
        out.append(text)
    return pa.array(out, pa.binary()).cast(pa.string())


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Add ``decoded``, the text of the column ``ids``; a column of that name is replaced.

    The blank that encoding puts before a text goes, control ids have no text, byte pieces are put together.
    Null and empty ids give an empty text.
    """
    kept = encoded.drop("decoded")
    names = [*kept.columns, "decoded"]
    place = kept.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(_model_path(model))
        for batch in batches:
            lists = batch.column(place)
            counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(own, np.asarray(lists.flatten(), np.int64), np.cumsum(counts))], names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def op11_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of the texts that they decode to; n_bytes is where the last piece ends."""
    both = encode(documents(spark, sf_dir), decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )
