"""File formats: round trips, headers, and a log built here."""

import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from pointloom.functions.geometry import doubles, xyz
from pointloom.sources import codecs, mcap
from pointloom.sources.points import export_map, export_mesh, export_points, find_files, load_clouds, read_frames, read_points, write_frames, write_mesh, write_points


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-50, 50, (2500, 3)).astype(np.float32))]
    return spark.createDataFrame(rows, "id long, x double, y double, z double").persist()


def _array(df, order):
    return np.array([tuple(r) for r in df.orderBy(order).select(*doubles(xyz())).collect()])


@pytest.mark.parametrize(("fmt", "tolerance"), [("pcd", 0), ("ply", 0), ("xyz", 6e-5), ("pts", 6e-5), ("las", 6e-4), ("e57", 0), ("npz", 0)])
def test_round_trip(spark, points, tmp_path, fmt, tolerance):
    path = write_points(points, str(tmp_path / "cloud"), fmt, order=["id"])
    back = read_points(spark, path)
    assert back.first().cloud == "cloud"
    assert np.abs(_array(back, "pt_idx") - _array(points, "id")).max() <= tolerance
    again = write_points(back, path, fmt, order=["pt_idx"])  # over the file that is being read
    assert np.abs(_array(read_points(spark, again), "pt_idx") - _array(points, "id")).max() <= 2 * tolerance


def test_headers(spark, points, tmp_path):
    pcd = open(write_points(points, str(tmp_path / "a.pcd"), order=["id"]), "rb").read()
    assert pcd.startswith(b"VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2500\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 2500\nDATA binary\n")
    assert len(pcd.split(b"DATA binary\n", 1)[1]) == 2500 * 12
    pts = open(write_points(points, str(tmp_path / "a.pts")), "rb").read().splitlines()
    assert pts[0] == b"2500" and len(pts) == 2501
    dxf = open(write_points(points.limit(2), str(tmp_path / "a.dxf")), "rb").read().decode()
    assert dxf.startswith("0\nSECTION\n2\nHEADER\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nPOINT\n8\nPointCloud\n10\n") and dxf.endswith("0\nENDSEC\n0\nEOF\n")
    las = open(write_points(points, str(tmp_path / "a.las")), "rb").read()
    assert las[:4] == b"LASF" and las[24:26] == bytes([1, 4]) and struct.unpack_from("<H", las, 94)[0] == 375 and len(las) == 375 + 20 * 2500
    e57 = open(write_points(points, str(tmp_path / "a.e57")), "rb").read()
    assert e57[:8] == b"ASTM-E57" and len(e57) % 1024 == 0
    with pytest.raises(ValueError, match="checksum"):
        codecs.decode_e57(e57[:2000] + bytes([e57[2000] ^ 1]) + e57[2001:])
    assert [p.rsplit(".", 1)[1] for p in export_points(points.limit(5), str(tmp_path / "b"))] == ["xyz", "pts", "e57", "las"]


def test_crc32c():
    assert codecs.crc32c_rows(np.frombuffer(b"123456789", np.uint8).reshape(1, -1))[0] == 0xE3069283


def test_other_pcd_kinds(spark, tmp_path):
    head = "VERSION 0.7\nFIELDS intensity x y z\nSIZE 2 4 8 4\nTYPE U F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA "
    rows = np.array([(7, 1, 2, 3), (8, 4, 5, 6)], np.dtype([("i", "<u2"), ("x", "<f4"), ("y", "<f8"), ("z", "<f4")]))
    want = [[1, 2, 3], [4, 5, 6]]
    assert codecs.decode_pcd((head + "binary\n").encode() + rows.tobytes()).tolist() == want
    assert codecs.decode_pcd((head + "ascii\n7 1 2 3\n8 4 5 6\n").encode()).tolist() == want
    flat = b"".join(rows[c].tobytes() for c in "ixyz")
    literal = b"".join(bytes([len(flat[a : a + 32]) - 1]) + flat[a : a + 32] for a in range(0, len(flat), 32))
    assert codecs.decode_pcd((head + "binary_compressed\n").encode() + struct.pack("<II", len(literal), len(flat)) + literal).tolist() == want
    with pytest.raises(ValueError):
        codecs.decode_pcd(b"VERSION 0.7\nFIELDS x y z\n")
    assert codecs.lzf_decompress(bytes([1, 65, 66, 0x40, 1]), 6) == b"ABABAB"


def test_unknown_suffix_and_compressed_las(spark):
    with pytest.raises(ValueError):
        read_points(spark, "a.laz")


def test_archives_of_frames(spark, tmp_path):
    frames = [np.array([[1, 0, 0], [0.1, 0, 0], [np.nan, 0, 0]], np.float32), np.array([[0, 100, 0], [0, 5, 0]], np.float32)]
    each = np.empty(2, object)
    each[:] = frames
    np.savez_compressed(tmp_path / "a.npz", points=each, timestamps=np.array([7, 9]), angle_times=np.array([1.0, 2.0]), angle_values=np.array([0.5, 0.6]))
    back = codecs.npz_frames((tmp_path / "a.npz").read_bytes())
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(back, frames, strict=True))
    assert codecs.decode_npz((tmp_path / "a.npz").read_bytes()).tolist() == [[1, 0, 0], [0, 5, 0]]
    np.savez(tmp_path / "same.npz", points=np.array([np.ones((2, 3)), np.ones((2, 3))], dtype=object))  # frames of one length make one array
    assert codecs.decode_npz((tmp_path / "same.npz").read_bytes()).shape == (4, 3)
    points, encoder = read_frames(spark, str(tmp_path / "a.npz"))
    assert [(r.frame_id, r.pt_idx, r.stamp_ns) for r in points.orderBy("frame_id", "pt_idx").collect()] == [(0, 0, 7), (0, 1, 7), (0, 2, 7), (1, 0, 9), (1, 1, 9)]
    assert [tuple(r)[1:] for r in encoder.orderBy("t_ns").collect()] == [(1, 0.5), (2, 0.6)]
    again = write_frames(points, encoder, str(tmp_path / "b"))
    with np.load(again, allow_pickle=True) as z:
        assert sorted(z.files) == ["angle_times", "angle_values", "points", "timestamps"] and z["timestamps"].tolist() == [7, 9]
        assert all(np.array_equal(a, b, equal_nan=True) and a.dtype == np.float32 for a, b in zip(z["points"], frames, strict=True))
    write_frames(points.limit(0), encoder.limit(0), str(tmp_path / "none.npz"))
    assert codecs.npz_frames((tmp_path / "none.npz").read_bytes()) == []


def test_archives_with_other_objects_are_refused(tmp_path):
    import os

    class Runs:
        def __reduce__(self):
            return os.getcwd, ()

    bad = np.empty(1, object)
    bad[0] = Runs()
    np.savez(tmp_path / "x.npz", points=bad)
    with pytest.raises(ValueError, match="more than arrays"):
        codecs.decode_npz((tmp_path / "x.npz").read_bytes())


def _scaled_e57(values, low, high, scale, offset):
    """A scan of scaled integers, packed bit by bit, in packets whose ends fall inside numbers."""
    bits = (high - low).bit_length()
    streams = []
    for c in range(3):
        number = sum(int(v - low) << (i * bits) for i, v in enumerate(values[:, c].tolist()))
        streams.append(number.to_bytes(-(-len(values) * bits // 8), "little"))
    packets = b""
    for a in range(0, max(map(len, streams)), 5):
        parts = [s[a : a + 5] for s in streams]
        body = struct.pack("<H3H", 3, *map(len, parts)) + b"".join(parts)
        body += bytes(-(len(body) + 4) % 4)
        packets += struct.pack("<BBH", 1, 0, len(body) + 3) + body
    section = struct.pack("<B7xQQQ", 1, 32 + len(packets), codecs._physical(80), 0) + packets
    field = lambda n: f'<{n} type="ScaledInteger" minimum="{low}" maximum="{high}" scale="{scale}" offset="{offset}"/>'
    xml = f'<?xml version="1.0"?><e57Root xmlns="{codecs._NS[1:-1]}"><data3D><vectorChild><points fileOffset="{codecs._physical(48)}" recordCount="{len(values)}"><prototype>{"".join(map(field, ("cartesianX", "cartesianY", "cartesianZ")))}</prototype></points></vectorChild></data3D></e57Root>'.encode()
    at = 48 + len(section)
    head = struct.pack("<8sIIQQQQ", b"ASTM-E57", 1, 0, 0, codecs._physical(at), len(xml), 1024)
    return codecs.to_pages(head + section + xml)


@pytest.mark.parametrize(("low", "high"), [(-1000, 1000), (-5, 2**40), (-(2**62), 2**62), (0, 1)])
def test_scaled_coordinates(low, high):
    values = np.random.default_rng(0).integers(low, high, (57, 3), endpoint=True)
    got = codecs.decode_e57(_scaled_e57(values, low, high, 0.001, 2.5))
    assert np.allclose(got, values.astype(float) * 0.001 + 2.5, rtol=1e-15)


@pytest.mark.parametrize("n", [0, 1, 1999, 2000, 2001, 4000, 9999])
def test_streamed_e57_is_the_same_in_any_pieces(n):
    p = np.random.default_rng(n).normal(size=(n, 3))
    whole = codecs.encode_e57(p)
    s = codecs.E57Stream(n)
    pieces = s.head() + b"".join(s.body(p[a : a + 333]) for a in range(0, n, 333)) + s.tail()
    assert pieces == whole and len(whole) % 1024 == 0 and np.array_equal(codecs.decode_e57(whole), p)
    assert struct.unpack_from("<Q", whole, 16)[0] == len(whole)


def test_files_are_found_in_order(spark, points, tmp_path):
    for name in ("b", "a"):
        write_points(points.limit(3), str(tmp_path / f"{name}.e57"))
    write_points(points.limit(0), str(tmp_path / "c.pcd"))
    names = lambda found: [f.rsplit("/", 1)[1] for f in found]
    assert names(find_files(spark, str(tmp_path))) == names(find_files(spark, default=str(tmp_path))) == ["a.e57", "b.e57"]
    assert names(find_files(spark, [f"{tmp_path}/b.e57", f"{tmp_path}/c.*"])) == ["b.e57", "c.pcd"]
    with pytest.raises(FileNotFoundError):
        find_files(spark, [str(tmp_path / "none.e57")])
    with pytest.warns(UserWarning, match="no points in .*c.pcd"):
        got = load_clouds(spark, [f"{tmp_path}/a.e57", f"{tmp_path}/c.pcd"])
    assert {r.cloud for r in got.collect()} == {"a"}
    with pytest.raises(ValueError, match="no points"), pytest.warns(UserWarning):
        load_clouds(spark, [f"{tmp_path}/c.pcd"])


def test_maps_are_in_order_of_their_cells_and_meshes_go_everywhere(spark, points, tmp_path):
    from pointloom.operators.voxel import voxel_first

    cells = voxel_first(points, 5.0, ["id"])
    back = read_points(spark, export_map(cells, str(tmp_path / "map.e57"))).orderBy("pt_idx").collect()
    want = sorted((r.kx, r.ky, r.kz, r.x, r.y, r.z) for r in cells.collect())
    assert [(r.x, r.y, r.z) for r in back] == [w[3:] for w in want]
    v = spark.createDataFrame([(i, float(i == 1), float(i == 2), 0.0, 0.0, 0.0, 1.0) for i in range(3)], "vid long, x double, y double, z double, nx double, ny double, nz double")
    t = spark.createDataFrame([(0, 1, 2)], "a long, b long, c long")
    assert [p.rsplit(".", 1)[1] for p in export_mesh(v, t, points.limit(4), str(tmp_path / "m"))] == ["obj", "stl", "dxf"]


def test_mesh_files(spark, tmp_path):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double, nx double, ny double, nz double")
    t = spark.createDataFrame([(0, 1, 2)], "a long, b long, c long")
    stl = open(write_mesh(v, t, str(tmp_path / "m.stl")), "rb").read()
    assert len(stl) == 84 + 50 and struct.unpack_from("<3f", stl, 84) == (0, 0, 1)
    assert "f 1//1 2//2 3//3" in open(write_mesh(v, t, str(tmp_path / "m.obj"))).read()


def _record(op, body):
    return struct.pack("<BQ", op, len(body)) + body


def _string(s):
    return struct.pack("<I", len(s)) + s.encode()


class _Out:
    """Writes CDR."""

    def __init__(self):
        self.b = bytearray(b"\0\1\0\0")

    def put(self, kind, *values):
        for v in values:
            self.b += bytes(-(len(self.b) - 4) % struct.calcsize(kind)) + struct.pack("<" + kind, v)
        return self

    def text(self, s):
        self.put("I", len(s) + 1)
        self.b += s.encode() + b"\0"
        return self


def _cloud(stamp, rows, pad=4):
    c = _Out().put("i", stamp // 10**9).put("I", stamp % 10**9).text("velodyne").put("I", 1, len(rows))
    c.put("I", 5)
    for name, offset, kind in (("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("ring", 12, 4), ("time", 16, 7)):
        c.text(name).put("I", offset).put("B", kind).put("I", 1)
    step = 20 + pad
    data = b"".join(struct.pack("<fffHxxf", *r) + bytes(pad) for r in rows)
    c.put("?", False).put("I", step, step * len(rows), len(data))
    c.b += data + b"\1"
    return bytes(c.b)


def _bag(compression):
    joint = lambda i: bytes(_Out().put("i", 1).put("I", i).text("").put("I", 1).text("joint").put("I", 1).put("d", 0.5 * i).put("I", 0, 0).b)
    imu = _Out().put("i", 1).put("I", 0).text("imu").put("d", *[0.0] * 25).put("d", 9.8, 0.1, 0.2).put("d", *[0.0] * 9)
    angle = bytes(_Out().put("d", 90.0).b)
    messages = [(1, 100, _cloud(1_000_000_005, [(1, 2, 3, 4, -0.05), (5, 6, 7, 8, 0.0)]))] + [(2, 200 + i, joint(i)) for i in range(3)] + [(3, 300, angle), (4, 400, bytes(imu.b)), (5, 500, b"other")]
    topics = {1: mcap.POINTS, 2: mcap.JOINT_STATE, 3: mcap.ANGLE, 4: mcap.IMU, 5: "/tf"}
    channels = b"".join(_record(4, struct.pack("<HH", k, 0) + _string(t) + _string("cdr") + struct.pack("<I", 0)) for k, t in topics.items())
    body = channels + b"".join(_record(5, struct.pack("<HIQQ", k, i, log, log) + data) for i, (k, log, data) in enumerate(messages))
    packed = zstandard.ZstdCompressor().compress(body) if compression == "zstd" else body
    chunk = struct.pack("<QQQI", 0, 1000, len(body), 0) + _string(compression) + struct.pack("<Q", len(packed)) + packed
    return mcap.MAGIC + _record(1, _string("ros2") + _string("")) + _record(6, chunk) + _record(0x0F, b"\0" * 4) + _record(2, b"\0" * 20) + mcap.MAGIC


@pytest.mark.parametrize("compression", ["", "zstd"])
def test_read_a_log(spark, tmp_path, compression):
    path = tmp_path / "log.mcap"
    path.write_bytes(_bag(compression))
    bag = mcap.read_bag(spark, str(path))
    rows = bag["points"].orderBy("pt_idx").collect()
    assert [(r.stamp_ns, r.x, r.y, r.z) for r in rows] == [(1_000_000_005, 1, 2, 3), (1_000_000_005, 5, 6, 7)]
    assert np.isclose(rows[0].time, -0.05)
    assert [(r.log_time_ns, r.stamp_ns, r.position) for r in bag["joint_state"].orderBy("log_time_ns").collect()] == [(200 + i, 10**9 + i, [0.5 * i]) for i in range(3)]
    assert bag["platform_angle"].first().deg == 90.0
    assert tuple(bag["imu"].select("ax", "ay", "az").first()) == (9.8, 0.1, 0.2)
    logs = spark.read.format("mcap").load(str(path))
    assert logs.select(F.countDistinct("topic")).first()[0] == 5
    assert logs.where(F.col("topic") == mcap.IMU).count() == 1 and logs.where(F.col("topic").isin(mcap.IMU, "/tf")).count() == 2
    assert logs.where((F.col("topic") == mcap.IMU) & (F.col("topic") == "/tf")).count() == 0


def test_find_logs(tmp_path):
    with pytest.raises(FileNotFoundError):
        mcap.resolve(str(tmp_path))
    packed = tmp_path / "b.mcap.zstd"
    packed.write_bytes(zstandard.ZstdCompressor().compress(_bag("")))
    assert mcap.resolve(str(tmp_path)) == [str(packed)]
    (tmp_path / "a.mcap").write_bytes(_bag(""))
    assert mcap.resolve(str(tmp_path)) == [str(tmp_path / "a.mcap")]


def test_compressed_log_in_a_folder(spark, tmp_path):
    (tmp_path / "b.mcap.zstd").write_bytes(zstandard.ZstdCompressor().compress(_bag("zstd")))
    assert mcap.read_bag(spark, str(tmp_path))["joint_state"].count() == 3
