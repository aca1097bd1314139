"""Files in and out, foreign byte streams, and kernels of all sizes against plain versions."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from planegrid.operators import loopfilter, search, transforms
from planegrid.operators.references import bump
from planegrid.operators.digests import ordered_md5
from planegrid.sources.annexb import access_units, packet_bytes, to_binary, tokenize, write_stream
from planegrid.sources.files import dumped, read_frames, read_packets, shaped, write_frames, write_parts, write_streams


@pytest.mark.parametrize(("bits", "w", "h"), [(8, 16, 8), (16, 8, 8)])
def test_frame_ranges(spark, tmp_path, bits, w, h):
    size = w * h * 3 // 2 * bits // 8
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 23 * size, np.uint8).tobytes()
    (tmp_path / "in.yuv").write_bytes(data)
    own = read_frames(spark, str(tmp_path / "in.yuv"), w, h, bitDepth=bits, framesPerPartition=5)
    assert own.rdd.getNumPartitions() == 5
    got = own.orderBy("frame", "plane").collect()
    assert b"".join(bytes(r["data"]) for r in got) == data
    part = read_frames(spark, str(tmp_path / "in.yuv"), w, h, bitDepth=bits, framesPerPartition=2, seek=3, frames=5).orderBy("frame", "plane").collect()
    assert b"".join(bytes(r["data"]) for r in part) == data[3 * size : 8 * size] and part[0]["frame"] == 0
    for bad in ({"seek": 24}, {"seek": 20, "frames": 4}):
        with pytest.raises(PySparkException, match="asked for"):
            read_frames(spark, str(tmp_path / "in.yuv"), w, h, bitDepth=bits, **bad).count()
    (tmp_path / "cut.yuv").write_bytes(data[:-1])
    with pytest.raises(PySparkException, match="behind its last whole frame"):
        read_frames(spark, str(tmp_path / "cut.yuv"), w, h, bitDepth=bits).count()


def test_frames_written(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 7 * 96, np.uint8).tobytes()
    (tmp_path / "in.yuv").write_bytes(data)
    planes = read_frames(spark, str(tmp_path / "in.yuv"), 8, 8, framesPerPartition=2).withColumn("path", F.lit("s1")).repartition(4, "frame", "plane")
    write_frames(planes, str(tmp_path / "out"), frames_per_file=3)
    files = sorted((tmp_path / "out" / "s1").iterdir())
    assert [f.name for f in files] == ["000000000.yuv", "000000003.yuv", "000000006.yuv"]
    assert b"".join(f.read_bytes() for f in files) == data
    write_frames(planes, str(tmp_path / "whole"))
    assert (tmp_path / "whole" / "s1.yuv").read_bytes() == data and [f.name for f in (tmp_path / "whole").iterdir()] == ["s1.yuv"]


def test_a_sink_writes_all_or_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    rows = lambda *r: spark.createDataFrame([(n, bytearray(c) if c is not None else None, i) for i, (n, c) in enumerate(r)], "name string, content binary, i int")
    write_parts(rows(("a/x", b"1"), ("y", None), ("a/x", b"2"), ("a/x", None), ("a/x", b"3")), str(folder), ["i"])
    assert (folder / "a" / "x").read_bytes() == b"123" and (folder / "y").read_bytes() == b""
    with pytest.raises(PySparkException, match="there already"):
        write_parts(rows(("new", b"9"), ("y", b"9")), str(folder), ["i"])
    for bad in ("../up", "/top", "a//b", "", None, "_temporary-1/x"):
        with pytest.raises(PySparkException, match="no name of a file"):
            write_parts(rows(("new", b"9"), (bad, b"9")), str(folder), ["i"])
    twice = rows(("new", b"1")).unionByName(rows(("new", b"2"))).select("name", "content")
    with pytest.raises(PySparkException, match="written twice"):
        twice.write.format("fileparts").mode("append").save(str(folder))
    assert sorted(str(f.relative_to(folder)) for f in folder.rglob("*") if f.is_file()) == ["a/x", "y"]
    write_parts(rows(("y", b"9")), str(folder), ["i"], overwrite=True)
    assert (folder / "y").read_bytes() == b"9" and (folder / "a" / "x").exists()


def test_files_in_folders_are_listed_by_tasks(spark, tmp_path):
    """Names in folders of folders, moved by tasks and listed again; hidden ones are none, and nothing stays aside."""
    from planegrid.sources.files import files_under

    folder = tmp_path / "out"
    rows = [(f"{i % 3}/d{i}/x{i}.bin", bytearray(b"z" * i)) for i in range(40)] + [("top.bin", bytearray(b"1"))]
    write_parts(spark.createDataFrame(rows, "name string, content binary"), str(folder), [])
    (folder / "0" / "_hidden").mkdir()
    (folder / "0" / "_hidden" / "x").write_bytes(b"1")
    (folder / ".hidden").write_bytes(b"1")
    (folder / "empty").mkdir()
    got = {r["path"].removeprefix(f"{folder}/"): r["size"] for r in files_under(spark, str(folder)).collect()}
    assert got == {n: len(c) for n, c in rows} and not list(folder.glob("_temporary*"))


def test_frames_of_files_in_folders(spark, tmp_path):
    """Files dealt to folders are read as others are, many ranges by a task; a file that ends inside a frame raises."""
    rng = np.random.default_rng(7)
    rows = [(f"v{i}", f, p, bytearray(rng.integers(0, 256, n, np.uint8).tobytes())) for i in range(30) for f in range(i % 4 + 1) for p, n in enumerate((64, 16, 16))]
    write_frames(spark.createDataFrame(rows, "path string, frame int, plane int, data binary"), str(tmp_path / "out"), folders=4)
    assert {x.name for x in (tmp_path / "out").iterdir()} <= set("0123")
    own = read_frames(spark, str(tmp_path / "out"), 8, 8, framesPerPartition=1)
    assert own.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r["path"].rsplit("/", 1)[1], *r[1:3], bytes(r["data"])) for r in own.collect()) == sorted((f"{n}.yuv", f, p, bytes(d)) for n, f, p, d in rows)
    write_frames(own.limit(0), str(tmp_path / "none"), folders=4)
    assert read_frames(spark, str(tmp_path / "none"), 8, 8).count() == 0
    (tmp_path / "out" / "cut.yuv").write_bytes(b"1")
    with pytest.raises(PySparkException, match="behind its last whole frame"):
        read_frames(spark, str(tmp_path / "out"), 8, 8).count()


def test_a_task_reads_many_ranges(tmp_path):
    """Tasks are as many as the bytes ask for, not as there are ranges."""
    from planegrid.sources.files import TASKS, ByteStreamReader

    data = b"".join(b"\0\0\1" + bytes([2 * (i % 60), 1]) + b"\xff" * 95 for i in range(2000))
    (tmp_path / "a.bit").write_bytes(data)
    reader = ByteStreamReader({"path": str(tmp_path), "rangebytes": "100", "piecebytes": "64"})
    assert len(reader.partitions()) <= TASKS + 1
    assert sorted(pos for p in reader.partitions() for b in reader.read(p) for pos in b.column(1).to_pylist()) == [100 * i + 3 for i in range(2000)]


def test_planes_read_are_not_broadcast(spark):
    """The list of files is small, what is read of them is not."""
    from planegrid.sources.filed import dumped_frames

    plan = dumped_frames(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shapes_of_planes(spark):
    rng = np.random.default_rng(3)
    wide = [rng.integers(0, 1024, (8, 16)), rng.integers(0, 1024, (4, 8)), rng.integers(0, 1024, (4, 8))]
    rows = [("v", 0, p, bytearray(x.astype("<u2").tobytes())) for p, x in enumerate(wide)]
    got = shaped(spark.createDataFrame(rows, "path string, frame int, plane int, data binary"), 16, 8, (4, 2, 2, 2), 10).orderBy("plane").collect()
    for r, x in zip(got, wide):
        h = 1 if r["plane"] else 2
        own = x[h : x.shape[0] - h, 2 * h : x.shape[1] - h]
        assert bytes(r["data"]) == np.minimum(255, (own + 4) >> 2).astype(np.uint8).tobytes()
    for bad in ((1, 0, 0, 0), (8, 8, 0, 0)):
        with pytest.raises(ValueError, match="of 16 x 8"):
            shaped(spark.createDataFrame(rows, "path string, frame int, plane int, data binary"), 16, 8, bad)


def test_dumps_of_pictures_and_fields(spark):
    """Frames as they are, fields line by line, a field without its other one, and nothing that is not reconstructed."""
    rows = [("a", 0, 0, b"frame0", True, 0, 2), ("a", 1, 0, b"frame1", False, 0, 2)]
    rows += [("b", 4, 0, b"AABB", True, 1, 2), ("b", 5, 0, b"aabb", True, 2, 2), ("b", 7, 0, b"xxyy", True, 2, 2)]
    got = dumped(spark.createDataFrame([(*r[:3], bytearray(r[3]), *r[4:]) for r in rows], "path string, picture int, plane int, data binary, reconstructed boolean, field int, stride int"))
    assert sorted((r["path"], r["frame"], bytes(r["data"])) for r in got.collect()) == [("a", 0, b"frame0"), ("b", 2, b"AAaaBBbb"), ("b", 3, b"\0\0xx\0\0yy")]


def test_digest_over_ordered_bytes(spark):
    import hashlib

    rng = np.random.default_rng(4)
    rows = [(k, i, None if i == 3 else bytearray(rng.integers(0, 256, int(rng.integers(0, 300)), np.uint8).tobytes())) for k in (1, 2, None) for i in range(40)]
    got = {r["k"]: (r["digest"], r["size"]) for r in ordered_md5(spark.createDataFrame(rows, "k long, i int, content binary").repartition(7), "k", ["i"]).collect()}
    for k in (1, 2, None):
        data = b"".join(bytes(c or b"") for j, _, c in rows if j == k)
        assert got[k] == (hashlib.md5(data).hexdigest(), len(data))


def test_streams_written_and_foreign_start_codes(spark, tmp_path):
    packets = spark.createDataFrame([(1, i, 32 + i, bytearray(bytes([i, 0, 0, 1, 9]))) for i in range(3)] + [(2, 0, 1, bytearray(b"x"))], "stream_id int, seq int, nal_type int, payload binary")
    write_streams(packets.select("stream_id", "seq", to_binary(packet_bytes(F.col("nal_type"), F.col("payload"))).alias("part")), str(tmp_path / "bits"))
    read = spark.read.format("binaryFile").load(str(tmp_path / "bits")).select(F.regexp_extract("path", r"(\d+)\.bit$", 1).cast("int").alias("stream_id"), F.col("content").alias("stream"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, write_stream(packets).collect()))
    assert sorted((r["stream_id"], r["seq"], r["nal_type"], bytes(r["rbsp"])) for r in tokenize(read).collect()) == sorted((r["stream_id"], r["seq"], r["nal_type"], bytes(r["payload"])) for r in packets.collect())
    bodies = [b"\x40\x01\x0c\x80", b"\x42\x01\x01\x80", b"\x26\x01\xaf\x80", b"\x02\x01\xd0\x80"]
    codes = [b"\0\0\0\1", b"\0\0\1", b"\0\0\0\0\0\1", b"\0\0\1"]
    stream = b"junk" + b"".join(c + b for c, b in zip(codes, bodies))
    got = tokenize(spark.createDataFrame([(7, bytearray(stream))], "stream_id int, stream binary")).orderBy("seq").collect()
    assert [(r["pos"], r["size"], r["nal_type"]) for r in got] == [(stream.index(b), len(b), b[0] >> 1 & 63) for b in bodies]


@pytest.mark.parametrize(
    ("body", "size", "payload"),
    [("aa800a", 5, "aa800a"), ("aa8085", 5, "aa8085"), ("aa80000000", 4, "aa"), ("aa8000000300000300", 10, "aa"), ("aa0000030180", 8, "aa000001"), ("", 2, ""), ("80", 3, ""), ("aa0000800000", 6, "aa0000"), ("c0", 3, "c0")],
)
def test_foreign_ends(spark, body, size, payload):
    """Line ends, zeros and filling words behind a packet's last byte, within a stream and at its end."""
    head = bytes.fromhex("4001")
    stream = b"\0\0\1" + head + bytes.fromhex(body) + b"\0\0\1" + head + bytes.fromhex(body)
    got = tokenize(spark.createDataFrame([(1, bytearray(stream))], "stream_id int, stream binary")).orderBy("seq").collect()
    assert [(r["size"], bytes(r["rbsp"]).hex(), r["nal_type"]) for r in got] == [(size, payload, 32)] * 2


def random_stream(rng, n):
    """Packets behind codes of any length, with bytes in front of the first and zeros behind the last."""
    out = bytearray(b"\0\0\2")
    for _ in range(n):
        out += b"\0" * int(rng.choice([2, 2, 3, 6])) + b"\1"
        body = rng.choice(np.array([0, 0, 1, 2, 3, 0x80, 0xAA, 10, 13], np.uint8), int(rng.integers(0, 40))).tobytes()
        out += bytes([int(rng.integers(0, 128)), 1]) + body.replace(b"\0\0", b"\0\0\3")
    return bytes(out + b"\0" * int(rng.integers(0, 4)))


@pytest.mark.parametrize(("size", "piece"), [(1, 1), (2, 3), (3, 1000), (7, 2), (64, 5), (1000, 16), (10**6, 37), (10**6, 10**6)])
def test_packets_by_ranges_of_any_size(spark, tmp_path, size, piece):
    """Each packet once, whatever range it, its start code or its end falls in; whole streams taken apart say which."""
    from planegrid.sources.annexb import packet_rows, taken_apart
    from planegrid.sources.files import ByteStreamReader

    rng = np.random.default_rng(size)
    n = 3 if size < 8 else 40
    folder = tmp_path / "streams"
    folder.mkdir()
    want = []
    for i in range(4):
        data = [random_stream(rng, n), b"", b"no code at all\0\0", b"\0\0\1"][i]
        (folder / f"{i}.bit").write_bytes(data)
        want += [(f"{i}.bit", *r) for r in zip(*(c.to_pylist() for c in packet_rows(taken_apart(data))))]
    reader = ByteStreamReader({"path": str(folder), "rangebytes": str(size), "piecebytes": str(piece)})
    got = []
    for p in reader.partitions():
        for b in reader.read(p):
            got += [(r["path"].rsplit("/", 1)[1], *list(r.values())[1:]) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and len(got) >= n
    if size >= 64:
        rows = read_packets(spark, str(folder), rangeBytes=size, pieceBytes=piece).collect()
        assert sorted((r["path"].rsplit("/", 1)[1], *r[1:6], bytes(r["rbsp"])) for r in rows) == sorted(want)


def test_ranges_of_nothing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert read_packets(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(PySparkException, match="missing"):
        read_packets(spark, str(tmp_path / "missing")).count()


def test_access_units(spark):
    """AUD, VPS, SPS, PPS, slice, second slice of the picture, suffix message, next picture, prefix message and its picture."""
    kinds = [(35, 0), (32, 0), (33, 0), (34, 0), (19, 128), (19, 0), (40, 0), (1, 128), (39, 0), (1, 128), (1, 0)]
    df = spark.createDataFrame([(1, i, t, bytearray([b, 5])) for i, (t, b) in enumerate(kinds)], "stream_id int, seq int, nal_type int, rbsp binary")
    assert [r["au"] for r in access_units(df).orderBy("seq").collect()] == [0, 0, 0, 0, 0, 0, 0, 1, 2, 2, 2]


@pytest.mark.parametrize("n", [4, 8, 16, 32])
def test_transforms(n):
    """Nearly orthogonal, near the real cosine transform, and back to the residual."""
    m = transforms.cosine_matrix(n).astype(float)
    scale = 64 * np.sqrt(n)
    k, i = np.mgrid[:n, :n]
    real = np.cos((2 * i + 1) * k * np.pi / (2 * n)) * np.where(k == 0, 1, np.sqrt(2)) * 64
    assert np.abs(m - real).max() < 2 and np.abs(m @ m.T - np.eye(n) * scale**2).max() < 0.004 * scale**2
    rng = np.random.default_rng(n)
    x = rng.integers(-255, 256, (20, n, n))
    c = transforms.forward(x)
    log = int(np.log2(n))
    exact = (m @ x @ m.T) / 2.0 ** (log - 1 + log + 6)
    assert np.abs(c - exact).max() <= 1.5 + 0.51 * n * 90 / 2 ** (log + 6)
    assert np.abs(transforms.inverse(c) - x).max() <= 4
    if n == 4:
        assert np.abs(transforms.inverse(transforms.forward(x, sine=True), sine=True) - x).max() <= 4


def plain_edge(p, q, qp, bs):
    """One segment of four lines, [line][distance], as the text of the standard goes through it."""
    beta = loopfilter.BETA[min(51, qp)]
    tc = loopfilter.TC[max(0, min(53, qp + 2 * (bs - 1)))]
    clip = lambda lo, hi, v: max(lo, min(hi, v))
    bend = lambda v: abs(v[2] - 2 * v[1] + v[0])
    dp, dq = bend(p[0]) + bend(p[3]), bend(q[0]) + bend(q[3])
    if bs == 0 or dp + dq >= beta:
        return p, q, 0

    def sam(k):
        return 2 * (bend(p[k]) + bend(q[k])) < beta >> 2 and abs(p[k][3] - p[k][0]) + abs(q[k][0] - q[k][3]) < beta >> 3 and abs(p[k][0] - q[k][0]) < (5 * tc + 1) >> 1

    out_p, out_q = [list(v) for v in p], [list(v) for v in q]
    if sam(0) and sam(3):
        for k in range(4):
            for out, a, b in ((out_p[k], p[k], q[k]), (out_q[k], q[k], p[k])):
                out[0] = clip(a[0] - 2 * tc, a[0] + 2 * tc, (a[2] + 2 * a[1] + 2 * a[0] + 2 * b[0] + b[1] + 4) >> 3)
                out[1] = clip(a[1] - 2 * tc, a[1] + 2 * tc, (a[2] + a[1] + a[0] + b[0] + 2) >> 2)
                out[2] = clip(a[2] - 2 * tc, a[2] + 2 * tc, (2 * a[3] + 3 * a[2] + a[1] + a[0] + b[0] + 4) >> 3)
        return out_p, out_q, 2
    side = (beta + (beta >> 1)) >> 3
    for k in range(4):
        delta = (9 * (q[k][0] - p[k][0]) - 3 * (q[k][1] - p[k][1]) + 8) >> 4
        if abs(delta) >= 10 * tc:
            continue
        delta = clip(-tc, tc, delta)
        for out, a, sign, near in ((out_p[k], p[k], 1, dp < side), (out_q[k], q[k], -1, dq < side)):
            out[0] = clip(0, 255, a[0] + sign * delta)
            if near:
                out[1] = clip(0, 255, a[1] + clip(-(tc >> 1), tc >> 1, (((a[2] + a[0] + 1) >> 1) - a[1] + sign * delta) >> 1))
    return out_p, out_q, 1


@pytest.mark.parametrize("horizontal", [False, True])
def test_deblocking(spark, horizontal):
    rng = np.random.default_rng(5)
    rows, seen = [], set()
    for i in range(300):
        spread = int(rng.choice([1, 3, 8, 60]))
        base = int(rng.integers(20, 230))
        src, ref = (np.clip(base + step + rng.integers(-spread, spread + 1, (8, 8)), 0, 255) for step in (0, int(rng.integers(-9, 10))))
        rows.append((i, src.ravel().tolist(), ref.ravel().tolist(), int(rng.integers(10, 55)), int(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "block long, src array<int>, ref array<int>, qp int, strength int")
    for r in loopfilter.deblocked(df, horizontal).collect():
        _, src, ref, qp, bs = rows[r["block"]]
        src, ref = np.array(src).reshape(8, 8), np.array(ref).reshape(8, 8)
        got_s, got_r = np.array(r["src"]).reshape(8, 8), np.array(r["ref"]).reshape(8, 8)
        if horizontal:
            src, ref, got_s, got_r = src.T, ref.T, got_s.T, got_r.T
        for seg in range(2):
            lines = slice(4 * seg, 4 * seg + 4)
            p, q, de = plain_edge(src[lines, :3:-1].tolist(), ref[lines, :4].tolist(), qp, bs)
            assert r["decisions"][seg] == de
            assert got_s[lines, :3:-1].tolist() == p and got_r[lines, :4].tolist() == q
            seen.add(de)
        assert (got_s[:, :4] == src[:, :4]).all() and (got_r[:, 4:] == ref[:, 4:]).all()
    assert seen == {0, 1, 2}


@pytest.mark.parametrize(("n", "reach"), [(4, 1), (8, 3), (16, 4)])
def test_motion_of_any_size(spark, n, reach):
    rng = np.random.default_rng(n)
    rows = [(i, rng.integers(0, 256, n * n).tolist(), rng.integers(0, 256, n * n).tolist()) for i in range(12)]
    got = {r["block"]: (r["dx"], r["dy"], r["cost"]) for r in search.searched(spark.createDataFrame(rows, "block long, src array<int>, ref array<int>"), n, reach).collect()}
    for i, a, b in rows:
        a, b = np.array(a).reshape(n, n), np.pad(np.array(b).reshape(n, n), reach, mode="edge")
        tried = [(int(np.abs(a - b[reach + dy : reach + dy + n, reach + dx : reach + dx + n]).sum()) + 8 * (abs(dx).bit_length() + abs(dy).bit_length() + 1), k, dx, dy) for k, (dy, dx) in enumerate((y, x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1))]
        cost, _, dx, dy = min(tried)
        assert got[i] == (dx, dy, cost)


def test_bumping(spark):
    """Coding order to output order, also where pictures come too late to be sorted."""
    for reorder, coded in ((3, [0, 8, 4, 2, 1, 3, 6, 5, 7]), (1, [5, 4, 3, 2, 1]), (2, [])):
        df = spark.createDataFrame([([(p, 10 * p) for p in coded],)], "c array<struct<poc:long,id:long>>")
        waiting, out = [], []
        for p in coded:
            waiting = sorted([*waiting, p])
            if len(waiting) > reorder:
                out.append(waiting.pop(0))
        got = df.select(bump(F.col("c"), reorder)).first()[0]
        assert [r["poc"] for r in got] == out + waiting and all(r["id"] == 10 * r["poc"] for r in got)


def test_shots_over_segment_borders(spark, monkeypatch):
    """Segments of a few frames give what one segment gives, and runs of candidates fold as one list does."""
    from planegrid.operators import statistics
    from planegrid.operators.reports import apart

    rng = np.random.default_rng(9)
    d = rng.integers(5, 20, 120)
    d[[16, 30, 45, 63, 90]] += 400
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(d, 2)], "frame long, difference long")
    whole = sorted(map(tuple, statistics.shot_changes(df).collect()))
    frames = sorted(rng.choice(300, 90, replace=False).tolist())
    taken = []
    for f in frames:
        if not taken or f - taken[-1] > 5:
            taken.append(f)
    found = spark.createDataFrame([(f,) for f in frames], "frame long")
    for length in (4096, 16, 7):
        plain = statistics.segments
        monkeypatch.setattr(statistics.segments, "__defaults__", (length,))
        assert plain is statistics.segments
        assert sorted(map(tuple, statistics.shot_changes(df).collect())) == whole
        assert sorted(r["frame"] for r in apart(found, 5).collect()) == taken
    assert sum(r[3] for r in whole) >= 3
