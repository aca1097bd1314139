"""Data sources for files: raw video by ranges of frames, byte streams by ranges of bytes, and a sink of files in parts.

All are Spark data sources, so ranges are read and files written by tasks. Paths are what Arrow's file systems
open: local or shared folders, hdfs:// and object stores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from planegrid.sources.annexb import PACKET, START_CODE, packet_rows
from planegrid.sources.rawvideo import frame_bytes
from planegrid.sources.scratch import shared_folder, written


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[fs.FileInfo]:
    """The file, or the files of the folder, in order of their paths; hidden ones are left out."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted(files, key=lambda f: f.path)


def files_under(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the files anywhere under a folder, hidden ones left out; paths are those of the folder's file system.

    Tasks list the folders of a level, a round per level; a task holds the entries of one folder at a time, and the driver none.
    """
    _, root = opened(folder)
    names = ["path", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        for b in batches:
            for at in b.column(0).to_pylist():
                found = [f for f in system.get_file_info(fs.FileSelector(at)) if f.type != fs.FileType.NotFound and not f.base_name.startswith((".", "_"))]
                for i in range(0, len(found), ROWS):
                    part = found[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path for f in part], pa.string()), pa.array([f.size if f.type == fs.FileType.File else None for f in part], pa.int64())], names)

    level, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        found = written(level.mapInArrow(run, "path string, size bigint"), "listing")
        files = found if files is None else files.unionByName(found)
        level = found.where("size IS NULL").select("path")
        if level.isEmpty():
            return files.where("size IS NOT NULL")
        level = level.repartition(tasks(spark), "path")


def tasks(spark: SparkSession) -> int:
    """Tasks that files are dealt to: a number of its own, so that small rows are not put together into few tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Frames(NamedTuple):
    """A range of a file's frames; the first one counts as ``number``."""

    path: str
    begin: int
    n: int
    number: int


class Bytes(NamedTuple):
    """A range of a file's bytes."""

    path: str
    begin: int
    end: int


class Ranges(InputPartition):
    """Ranges of one or several files that a task reads one after the other."""

    def __init__(self, ranges: list):
        super().__init__(None)
        self.ranges = ranges


def together(ranges: list, sizes: list[int], most: int) -> list[Ranges]:
    """Ranges in order, as many to a partition as have ``most`` in all; one of more is a partition by itself."""
    out: list[list] = []
    held = 0
    for r, n in zip(ranges, sizes):
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += n
    return [Ranges(x) for x in out]


#: Bytes of frames that are read together; a larger frame is read by itself.
BATCH = 4 << 20
#: Rows of a batch.
ROWS = 10_000
#: Bytes of ranges that one task reads, and tasks that share less than that.
TASK_BYTES, TASKS = 16 << 20, 64


class Layout(NamedTuple):
    width: int
    height: int
    sample_bytes: int

    @property
    def frame(self) -> int:
        return frame_bytes(self.width, self.height, self.sample_bytes)

    @property
    def luma(self) -> int:
        return self.width * self.height * self.sample_bytes


class RawVideoReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.layout = Layout(int(options["width"]), int(options["height"]), 1 if int(options.get("bitdepth", 8)) == 8 else 2)
        self.seek, self.frames = int(options.get("seek", 0)), int(options["frames"]) if "frames" in options else None
        self.per = int(options.get("framesperpartition", max(1, (64 << 20) // self.layout.frame)))

    def ranges(self, path: str, size: int) -> list[Frames]:
        """Ranges of at most ``framesPerPartition`` frames; a file that ends inside a frame, or before the last one asked for, is an error."""
        n, rest = divmod(size, self.layout.frame)
        if rest:
            raise ValueError(f"{path}: {rest} bytes behind its last whole frame")
        wanted = n - self.seek if self.frames is None else self.frames
        if wanted < 0 or self.seek + wanted > n:
            raise ValueError(f"{path}: frames {self.seek} to {self.seek + max(0, wanted) - 1} asked for, it has {n}")
        return [Frames(path, self.seek + i, min(self.per, wanted - i), i) for i in range(0, wanted, self.per)]

    def partitions(self) -> list[Ranges]:
        out = [r for f in listed(self.path) for r in self.ranges(f.path, f.size)]
        return together(out, [r.n for r in out], self.per) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from self.planes(iter(partition.ranges))

    def planes(self, ranges: Iterator[Frames]) -> Iterator[pa.RecordBatch]:
        """The planes of ranges in turn; short ranges share a batch."""
        system, _ = opened(self.path)
        size, step = self.layout.frame, max(1, min(ROWS // 3, BATCH // self.layout.frame))
        held: list[tuple[str, int, int, bytes]] = []
        frames = 0
        for r in ranges:
            with system.open_input_file(r.path) as f:
                first = 0
                while first < r.n:
                    n = min(step - frames, r.n - first)
                    held.append((r.path, r.number + first, n, f.read_at(n * size, (r.begin + first) * size)))
                    first, frames = first + n, frames + n
                    if frames == step:
                        yield self._batch(held)
                        held, frames = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, held: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
        """(path, first number, frames, bytes) of ranges to a row per plane."""
        times = np.array([n for _, _, n, _ in held])
        luma, total = self.layout.luma, int(times.sum())
        ends = np.cumsum(np.tile([luma, luma // 4, luma // 4], total))
        data = pa.Array.from_buffers(pa.binary(), 3 * total, [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(b"".join(d for _, _, _, d in held))])
        frames = np.concatenate([np.arange(first, first + n, dtype=np.int32) for _, first, n, _ in held])
        paths = pa.array([p for p, _, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), 3 * times)))
        planes = np.tile(np.arange(3, dtype=np.int32), total)
        return pa.RecordBatch.from_arrays([paths, pa.array(np.repeat(frames, 3)), pa.array(planes), data], ["path", "frame", "plane", "data"])


class RawVideo(DataSource):
    """8 or 16 bit 4:2:0 frames of the file or folder ``path``: options width, height, bitDepth, seek, frames, framesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return "path string, frame int, plane int, data binary"

    def reader(self, schema) -> RawVideoReader:  # noqa: ANN001
        return RawVideoReader(self.options)


class ByteStreamReader(DataSourceReader):
    """Packets by ranges; a range has those whose start code ends in it, wherever the code began and the packet ends."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size, self.piece = int(options.get("rangebytes", 64 << 20)), int(options.get("piecebytes", 4 << 20))
        if self.size < 1 or self.piece < 1:
            raise ValueError("rangeBytes and pieceBytes are at least 1")

    def partitions(self) -> list[Ranges]:
        """Stretches of whole ranges. A task reads several: TASK_BYTES of them, or less where there are fewer than TASKS tasks."""
        files = listed(self.path)
        most = min(TASK_BYTES, -(-sum(f.size for f in files) // TASKS))
        step = max(1, most // self.size) * self.size
        stretches = [Bytes(f.path, i, min(f.size, i + step)) for f in files for i in range(0, f.size, step)]
        return together(stretches, [r.end - r.begin for r in stretches], step) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            for i in range(r.begin, r.end, self.size):
                yield from self._packets(Bytes(r.path, i, min(r.end, i + self.size)))

    def _packets(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        """Reads piece by piece; what is held is a piece and the packet that is not yet ended."""
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f:
            total = f.size()
            at = max(0, partition.begin - len(START_CODE) + 1)  # a code may begin in front of the range
            held, base = bytearray(), at  # bytes from base on
            start = None  # of the packet that is open
            while True:
                searched = max(0, len(held) - len(START_CODE) + 1)
                piece = f.read_at(min(self.piece, total - at), at) if at < total else b""
                held += piece
                at += len(piece)
                found, ended = [], False
                code = held.find(START_CODE, max(searched, 0 if start is None else start - base))
                while code >= 0:
                    first = base + code + len(START_CODE)
                    if start is not None:
                        found.append((start, bytes(held[start - base : code])))
                        start = None
                    if first > partition.end:  # the code's last byte lies behind the range
                        ended = True
                        break
                    start = first
                    code = held.find(START_CODE, first - base)
                if not piece and start is not None and not ended:
                    found.append((start, bytes(held[start - base :])))
                    start = None
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(found)), *packet_rows(found)], ["path", *PACKET])
                if ended or not piece or (start is None and at >= partition.end):
                    return
                keep = start if start is not None else base + len(held) - len(START_CODE) + 1
                if keep > base:
                    del held[: keep - base]
                    base = keep


class ByteStream(DataSource):
    """Packets of the Annex-B files at ``path``: options rangeBytes, the bytes of a range, and pieceBytes, those of a read."""

    @classmethod
    def name(cls) -> str:
        return "annexb"

    def schema(self) -> str:
        return "path string, " + ", ".join(f"{n} {t}" for n, t in PACKET.items())

    def reader(self, schema) -> ByteStreamReader:  # noqa: ANN001
        return ByteStreamReader(self.options)


def stored(folder: str, aside: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """(name, content) to files in the folder ``aside``: where each is, and where it goes under ``folder``. Rows of a name stand together; what a batch has of it is written at once."""
    system, root = opened(folder)
    seen: set[int] = set()  # hashes of names
    out, name, n = None, None, 0
    try:
        for b in batches:
            names, content = b.column(0), b.column(1).cast(pa.binary())
            if content.null_count:
                content = content.fill_null(b"")
            ends = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1] if len(content) else np.zeros(1, np.int32)
            new = [0, *(np.flatnonzero(pc.fill_null(pc.not_equal(names[1:], names[:-1]), True).to_numpy(zero_copy_only=False)) + 1).tolist()] if len(names) else []
            for i, j in zip(new, [*new[1:], len(names)]):
                own = names[i].as_py()
                if out is None or own != name:
                    if out:
                        out.close()
                        yield f"{aside}/{n - 1}", f"{root}/{name}"
                    out, name = None, own
                    parts = (name or "").split("/")
                    if not name or any(x in ("", ".", "..") for x in parts) or parts[0].startswith("_temporary-"):
                        raise ValueError(f"{name!r} is no name of a file in a folder")
                    if hash(name) in seen:
                        raise ValueError(f"the rows of {name} do not stand together")
                    seen.add(hash(name))
                    if not n:
                        system.create_dir(aside, recursive=True)
                    out, n = system.open_output_stream(f"{aside}/{n}"), n + 1
                if ends[j] > ends[i]:
                    out.write(content.buffers()[2].slice(int(ends[i]), int(ends[j] - ends[i])))
        if out:
            out.close()
            yield f"{aside}/{n - 1}", f"{root}/{name}"
    finally:
        if out and not out.closed:
            out.close()


class Written(WriterCommitMessage):
    """Files of a task: where they are, and where they go."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class FilesWriter(DataSourceArrowWriter):
    """Rows of one name, one behind the other, are the parts of one file.

    A task writes aside; files get their names when all tasks are done. A name that two tasks have, or that is
    there already unless it may be overwritten, fails the job before any file is in place.
    """

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        _, root = opened(self.folder)
        return Written(list(stored(self.folder, f"{root}/_temporary-{uuid.uuid4().hex}", batches)))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.folder)
        files = [x for m in messages if m for x in m.files]
        places = [to for _, to in files]
        there = [] if self.overwrite or not places else [i.path for i in system.get_file_info(places) if i.type != fs.FileType.NotFound]
        twice = sorted({p for p in places if places.count(p) > 1}) if len(set(places)) < len(places) else []
        if there or twice:
            self.abort(messages)
            raise ValueError(f"written twice: {twice[:3]}" if twice else f"there already: {there[:3]}")
        for path, to in files:
            system.create_dir(to.rsplit("/", 1)[0], recursive=True)
            system.move(path, to)
        self._clean(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(messages)

    def _clean(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.folder)
        for aside in {path.rsplit("/", 1)[0] for m in messages if m for path, _ in m.files}:
            if system.get_file_info(aside).type == fs.FileType.Directory:
                system.delete_dir(aside)


class Files(DataSource):
    """A sink of (name, content): the rows of a name, in their order, become the file ``path``/name; a null content is no bytes."""

    @classmethod
    def name(cls) -> str:
        return "fileparts"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:  # noqa: ANN001
        return FilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (RawVideo, ByteStream, Files):
        spark.dataSource.register(source)


def read_frames(spark: SparkSession, path: str, width: int, height: int, **options: int) -> DataFrame:
    """(path, frame, plane, data) of raw files, read by ranges of frames: no row holds more than a plane.

    The files anywhere under a folder are listed by tasks, and a task reads the ranges of many.
    """
    register(spark)
    system, root = opened(path)
    if system.get_file_info(root).type != fs.FileType.Directory:
        return spark.read.format("rawvideo").options(width=width, height=height, **options).load(path)
    reader = RawVideoReader({"path": path, "width": str(width), "height": str(height)} | {k.lower(): str(v) for k, v in options.items()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = reader.ranges(f, size)
                for i in range(0, len(found), ROWS):
                    yield pa.RecordBatch.from_pylist([r._asdict() for r in found[i : i + ROWS]], pa.schema([("path", pa.string()), ("begin", pa.int64()), ("n", pa.int64()), ("number", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reader.planes(Frames(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))

    ranges = files_under(spark, path).mapInArrow(cut, "path string, begin bigint, n bigint, number bigint")
    return ranges.repartition(tasks(spark), "path", "begin").mapInArrow(run, "path string, frame int, plane int, data binary")


def read_packets(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Packets of byte-stream files, read by ranges of bytes: path, pos (of the header in its file), size, nal_type, layer_id, tid and rbsp.

    A packet is found once whatever the ranges are, and no row holds more than a packet. ``pos`` orders a file's packets.
    """
    register(spark)
    return spark.read.format("annexb").options(**options).load(path)


def write_parts(parts: DataFrame, folder: str, order: list[str], overwrite: bool = False) -> None:
    """(name, content and the columns of ``order``) to a file per name, its rows' contents in order.

    A file is written by one task, row by row; nothing is gathered. Files are written aside, and tasks move them to their names when
    all are written and, unless they may be overwritten, none is there already; the driver knows the folders alone.
    """
    spark = parts.sparkSession
    register(spark)
    system, root = opened(folder)
    aside = f"{root}/_temporary-{uuid.uuid4().hex}"
    own = parts.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"), *order)
    dealt = own.repartition(tasks(spark), "name").sortWithinPartitions("name", *order).select("name", "content")
    pairs = ["path", "place"]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str | None, str]] = []
        try:
            for pair in stored(folder, f"{aside}/{uuid.uuid4().hex}", batches):
                found.append(pair)
                if len(found) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], pairs)
                    found = []
        except ValueError as wrong:  # told when no task writes any more
            found.append((None, str(wrong)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], pairs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_system, _ = opened(folder)
        for b in batches:
            if b.column(0).null_count:
                raise ValueError(b.filter(b.column(0).is_null()).column(1)[0].as_py())
            found = [] if overwrite else [i.path for i in own_system.get_file_info(b.column(1).to_pylist()) if i.type != fs.FileType.NotFound]
            if found:
                raise ValueError(f"there already: {found[:3]}")
            yield b.slice(0, 0)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_system, _ = opened(folder)
        made = None
        for b in batches:
            for path, place in zip(*(c.to_pylist() for c in b.columns)):
                # a task that runs again finds moved what it moved before
                if own_system.get_file_info(path).type == fs.FileType.NotFound and own_system.get_file_info(place).type == fs.FileType.File:
                    continue
                to = place.rsplit("/", 1)[0]
                if to != made:
                    own_system.create_dir(to, recursive=True)
                    made = to
                own_system.move(path, place)
            yield b.slice(0, 0)

    names = shared_folder(spark, "names")
    system.create_dir(root, recursive=True)  # of no rows there is a folder without files
    try:
        dealt.mapInArrow(store, "path string, place string").write.parquet(names)
        files = spark.read.schema("path string, place string").parquet(names).repartition(tasks(spark), "place")
        for step in (check, move):
            files.mapInArrow(step, "path string, place string").write.format("noop").mode("overwrite").save()
    finally:
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


def shaped(planes: DataFrame, width: int, height: int, crop: tuple[int, int, int, int] = (0, 0, 0, 0), bit_depth: int = 8) -> DataFrame:
    """(..., plane, data) of 4:2:0 frames without ``crop`` luma samples left, right, at the top and at the bottom, all even, as 8-bit samples.

    Samples of over 8 bits lie in two bytes, the low one first; they get a whole step of (1 << bit_depth) >> 8 more and
    are shifted to 8 bits, 255 at most. Of planes of another size than the frame's an error tells.
    """
    left, right, top, bottom = crop
    if any(c < 0 or c % 2 for c in crop) or left + right >= width or top + bottom >= height:
        raise ValueError(f"{crop} of {width} x {height} samples")
    names = planes.columns
    at, which = names.index("data"), names.index("plane")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, plane in zip(b.column(at), b.column(which).to_pylist()):
                half = 2 if plane else 1
                v = np.frombuffer(data.as_py(), np.uint8 if bit_depth == 8 else "<u2").reshape(height // half, width // half)
                v = v[top // half : (height - bottom) // half, left // half : (width - right) // half]
                if bit_depth > 8:
                    v = np.minimum(255, (v.astype(np.int64) + ((1 << bit_depth) >> 8)) >> (bit_depth - 8)).astype(np.uint8)
                out.append(v.tobytes())
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return planes.mapInArrow(run, planes.schema)


def in_folder(name: Column, folders: int) -> Column:
    """The name in one of so many folders, by its hash: a folder of a part of the files is listed by a task."""
    return F.concat(F.pmod(F.xxhash64(name), F.lit(folders)).cast("string"), F.lit("/"), name)


def write_frames(planes: DataFrame, folder: str, frames_per_file: int | None = None, overwrite: bool = False, folders: int | None = None) -> None:
    """(path, frame, plane, data) to raw files in the order of frames and planes: ``<path>.yuv``, or ``<path>/<first frame>.yuv`` of so many frames each.

    With ``folders`` the files are dealt to so many folders. Frames are what output order numbers them; a dump of decoded pictures is their planes with these numbers.
    """
    name = F.col("path").cast("string")
    if frames_per_file:
        name = F.concat(name, F.lit("/"), F.lpad((F.expr(f"frame div {frames_per_file}") * frames_per_file).cast("string"), 9, "0"))
    name = F.concat(name, F.lit(".yuv"))
    name = in_folder(name, folders) if folders else name
    write_parts(planes.select(name.alias("name"), F.col("data").alias("content"), "frame", "plane"), folder, ["frame", "plane"], overwrite)


def dumped(pictures: DataFrame) -> DataFrame:
    """Planes (path, picture, plane, data, reconstructed, field, stride) in the order of ``picture`` to frames: (path, frame, plane, data).

    Pictures that are not reconstructed are left out. A picture of ``field`` 1 is a frame's upper lines, one of 2 its
    lower ones, of ``stride`` bytes each; the two fields of a frame are pictures 2 k and 2 k + 1, and one without the other
    leaves lines of zeros.
    """
    own = pictures.where("reconstructed").select(F.col("path").cast("string"), F.when(F.col("field") > 0, F.expr("picture div 2")).otherwise(F.col("picture")).cast("int").alias("frame"), F.col("plane").cast("int"), "data", "field", F.col("stride").cast("int"))
    part = lambda k: F.first(F.when(F.col("field") == k, F.col("data")), ignorenulls=True)
    met = own.groupBy("path", "frame", "plane").agg(part(0).alias("whole"), part(1).alias("top"), part(2).alias("bottom"), F.max("stride").alias("stride"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for whole, top, bottom, stride in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6))):
                if whole is None:
                    lines = np.zeros((max(len(top or b""), len(bottom or b"")) // stride, 2, stride), np.uint8)
                    for k, data in enumerate((top, bottom)):
                        if data is not None:
                            lines[:, k] = np.frombuffer(data, np.uint8).reshape(-1, stride)
                    whole = lines.tobytes()
                out.append(whole)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["path", "frame", "plane", "data"])

    return met.mapInArrow(run, "path string, frame int, plane int, data binary")


def write_streams(streams: DataFrame, folder: str, overwrite: bool = False) -> None:
    """(stream_id, seq, part) to a byte-stream file each, ``<stream_id>.bit``, its parts in the order of seq."""
    write_parts(streams.select(F.concat(F.col("stream_id").cast("string"), F.lit(".bit")).alias("name"), F.col("part").alias("content"), "seq"), folder, ["seq"], overwrite)
