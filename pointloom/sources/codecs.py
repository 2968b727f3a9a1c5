"""Point-cloud file formats: each decoded from and encoded to bytes with the standard library and numpy.

Decoders return an (n, 3) array in the file's precision. Encoders are split into a head (which needs the
number of points, and for LAS the offsets), bodies of any number of points, and a tail, so that a file can
be written in pieces.
"""

from __future__ import annotations

import io
import pickle
import struct
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass

import numpy as np

_PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8"}


def lzf_decompress(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        ctrl = data[i]
        i += 1
        if ctrl < 32:
            out += data[i : i + ctrl + 1]
            i += ctrl + 1
            continue
        length = ctrl >> 5
        if length == 7:
            length += data[i]
            i += 1
        at = len(out) - ((ctrl & 31) << 8) - data[i] - 1
        i += 1
        for _ in range(length + 2):
            out.append(out[at])
            at += 1
    if len(out) != size:
        raise ValueError("broken compressed data")
    return bytes(out)


def pcd_head(data: bytes) -> tuple[dict[str, list[str]], int]:
    """The header's lines by their first word, and where the points begin."""
    head, at = {}, 0
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("the PCD header has no DATA line")
        line = data[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if line and not line.startswith("#"):
            key, _, value = line.partition(" ")
            head[key.upper()] = value.split()
    return head, at


def decode_pcd(data: bytes) -> np.ndarray:
    """PCD 0.7: ascii, binary or binary_compressed, any fields of which x, y, z are taken."""
    head, at = pcd_head(data)
    names, n = head["FIELDS"], int(head["POINTS"][0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    kinds = [_PCD_TYPES[t, int(s)] for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    kind = head["DATA"][0].lower()
    if kind == "ascii":
        starts = dict(zip(names, np.cumsum([0, *counts[:-1]]).tolist(), strict=True))
        rows = np.loadtxt(io.BytesIO(data[at:]), ndmin=2, max_rows=n) if n else np.zeros((0, sum(counts)))
        return np.stack([rows[:, starts[c]] for c in "xyz"], 1).astype(np.float32)
    dtype = np.dtype([(f"{m}_{i}" if m not in "xyz" else m, k, (c,)) if c > 1 else (f"{m}_{i}" if m not in "xyz" else m, k) for i, (m, k, c) in enumerate(zip(names, kinds, counts, strict=True))])
    body = data[at:]
    if kind == "binary":
        rows = np.frombuffer(body, dtype, n)
        return np.stack([rows[c] for c in "xyz"], 1)
    if kind != "binary_compressed":
        raise ValueError(f"unknown PCD data kind {kind}")
    packed, size = struct.unpack_from("<II", body)
    flat, out, at = lzf_decompress(body[8 : 8 + packed], size), {}, 0
    for m, k, c in zip(names, kinds, counts, strict=True):  # one field after the other
        out[m] = np.frombuffer(flat, k, n * c, at)
        at += n * c * np.dtype(k).itemsize
    return np.stack([out[c] for c in "xyz"], 1)


def decode_rows(data: bytes) -> np.ndarray:
    """XYZ rows; a first line of one number, as PTS has, is a count."""
    first, _, rest = data.partition(b"\n")
    body = rest if len(first.split()) == 1 else data
    return np.loadtxt(io.BytesIO(body), ndmin=2, usecols=(0, 1, 2)) if body.strip() else np.zeros((0, 3))


#: What a pickle in an archive may name; anything else is refused before it is looked up.
_ARRAY_NAMES = {("numpy", "ndarray"), ("numpy", "dtype"), *((f"numpy.{c}.multiarray", f) for c in ("core", "_core") for f in ("_reconstruct", "scalar")), *((f"numpy.{c}.numeric", "_frombuffer") for c in ("core", "_core")), ("_codecs", "encode")}


class _ArrayUnpickler(pickle.Unpickler):
    """Reads arrays of arrays and nothing else."""

    def find_class(self, module: str, name: str):
        if (module, name) not in _ARRAY_NAMES:
            raise ValueError(f"the archive holds more than arrays: {module}.{name}")
        return super().find_class(module, name)


def _npy(data: bytes) -> np.ndarray:
    """One member of an archive; object arrays are unpickled by the restricted reader."""
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if not dtype.hasobject:
        return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)
    out = _ArrayUnpickler(f).load()
    if not isinstance(out, np.ndarray) or out.shape != shape:
        raise ValueError("the archive's header and array differ")
    return out


def read_npz(data: bytes) -> dict[str, np.ndarray]:
    """All members of an archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {m.removesuffix(".npy"): _npy(z.read(m)) for m in z.namelist()}


def npz_frames(data: bytes) -> list[np.ndarray]:
    """The frames of an archive: each array in ``points``, or each member whose name starts so, as (n, 3)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = [_npy(z.read(m)) for m in sorted(m for m in z.namelist() if m.startswith("points"))]
    flat = [f for p in parts for f in (p.reshape(-1) if p.dtype == object and p.ndim == 1 else [p])]
    return [np.asarray(f, np.float64 if np.asarray(f).dtype == object else None).reshape(-1, 3) for f in flat]


#: Ranges between which an archive's points lie, both ends excluded.
NPZ_RANGE = (0.3, 100.0)


def decode_npz(data: bytes) -> np.ndarray:
    """The points of all frames that are finite and between the ranges, one frame after the other."""
    parts = [np.zeros((0, 3), np.float32)]
    for p in npz_frames(data):
        r = np.linalg.norm(p, axis=1)
        parts.append(p[np.isfinite(p).all(1) & (r > NPZ_RANGE[0]) & (r < NPZ_RANGE[1])])
    return np.concatenate(parts)


_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def ply_head(data: bytes) -> tuple[str, int, list[str], list[str], int]:
    """Kind, number of vertices, names and types of their properties, and where they begin."""
    end = data.index(b"end_header")
    at = data.index(b"\n", end) + 1
    lines = [x.split() for x in data[:end].decode("ascii").splitlines()]
    kind = next(x[1] for x in lines if x[0] == "format")
    elements = [i for i, x in enumerate(lines) if x[0] == "element"]
    if not elements or lines[elements[0]][1] != "vertex":
        raise ValueError("the first element of the PLY file is not vertex")
    n = int(lines[elements[0]][2])
    props = [x for x in lines[elements[0] + 1 : elements[1] if len(elements) > 1 else None] if x[0] == "property"]
    if any(p[1] == "list" for p in props):
        raise ValueError("vertices with lists are not supported")
    return kind, n, [p[2] for p in props], [p[1] for p in props], at


def decode_ply(data: bytes) -> np.ndarray:
    """The vertices of a PLY file whose first element they are."""
    kind, n, names, types, at = ply_head(data)
    if kind == "ascii":
        rows = np.array([x.split() for x in data[at:].decode("ascii").splitlines()[:n]], float).reshape(n, len(names))
        return np.stack([rows[:, names.index(c)] for c in "xyz"], 1)
    order = "<" if "little" in kind else ">"
    rows = np.frombuffer(data, np.dtype([(m, order + _PLY_TYPES[t]) for m, t in zip(names, types, strict=True)]), n, at)
    return np.stack([rows[c] for c in "xyz"], 1)


def las_layout(data: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Where points begin, bytes of one, their number, scale and offset; LAS 1.0 to 1.4, uncompressed."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = data[25]
    offset = struct.unpack_from("<I", data, 96)[0]
    fmt, size, n = struct.unpack_from("<BHI", data, 104)
    if fmt & 0x80:
        raise ValueError("compressed LAS (LAZ) is not supported")
    if minor >= 4:
        n = struct.unpack_from("<Q", data, 247)[0] or n
    scale, shift = np.array(struct.unpack_from("<3d", data, 131)), np.array(struct.unpack_from("<3d", data, 155))
    return offset, size, n, scale, shift


def decode_las(data: bytes) -> np.ndarray:
    """LAS 1.0 to 1.4, uncompressed."""
    offset, size, n, scale, shift = las_layout(data)
    raw = np.frombuffer(data, np.dtype({"names": ["p"], "formats": ["(3,)<i4"], "offsets": [0], "itemsize": size}), n, offset)["p"]
    return raw * scale + shift


_PAGE, _DATA = 1024, 1020


def _crc32c_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    return t


_CRC = _crc32c_table()


def crc32c_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for j in range(rows.shape[1]):
        crc = _CRC[(crc ^ rows[:, j]) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def to_pages(logical: bytes) -> bytes:
    """Pages of 1020 bytes, each with its checksum."""
    logical += bytes(-len(logical) % _DATA)
    rows = np.frombuffer(logical, np.uint8).reshape(-1, _DATA)
    sums = crc32c_rows(rows).astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.hstack([rows, sums]).tobytes()


def from_pages(data: bytes, check: bool = True) -> bytes:
    rows = np.frombuffer(data[: len(data) // _PAGE * _PAGE], np.uint8).reshape(-1, _PAGE)
    if check and (crc32c_rows(rows[:, :_DATA]) != rows[:, _DATA:].copy().view(">u4").ravel()).any():
        raise ValueError("an E57 page has a wrong checksum")
    return rows[:, :_DATA].tobytes()


def _physical(logical: int) -> int:
    return logical // _DATA * _PAGE + logical % _DATA


def _logical(physical: int) -> int:
    return physical // _PAGE * _DATA + physical % _PAGE


_NS = "{http://www.astm.org/COMMIT/E57/2010-e57-v1.0}"


_PACKET = 2000  # points; a packet's length is a 16-bit number


class E57Stream:
    """One scan of double cartesian coordinates, written in pieces: its size follows from the number of points."""

    def __init__(self, count: int):
        full, rest = divmod(count, _PACKET)
        size = lambda n: 4 + 8 + 24 * n  # noqa: E731  a multiple of 4
        length = 32 + full * size(_PACKET) + (size(rest) if rest or not full else 0)
        self.count, self._left, self._rows = count, b"", np.zeros((0, 3))
        self._xml = f"""<?xml version="1.0" encoding="UTF-8"?>
<e57Root type="Structure" xmlns="{_NS[1:-1]}"><formatName type="String"><![CDATA[ASTM E57 3D Imaging Data File]]></formatName>
<guid type="String"><![CDATA[{{00000000-0000-4000-8000-000000000000}}]]></guid><versionMajor type="Integer">1</versionMajor><versionMinor type="Integer">0</versionMinor>
<data3D type="Vector" allowHeterogeneousChildren="1"><vectorChild type="Structure"><guid type="String"><![CDATA[{{00000000-0000-4000-8000-000000000001}}]]></guid>
<points type="CompressedVector" fileOffset="{_physical(48)}" recordCount="{count}"><prototype type="Structure"><cartesianX type="Float"/><cartesianY type="Float"/><cartesianZ type="Float"/></prototype>
<codecs type="Vector" allowHeterogeneousChildren="1"/></points></vectorChild></data3D></e57Root>""".encode()
        at = 48 + length
        total = -(-(at + len(self._xml)) // _DATA) * _PAGE
        self._start = struct.pack("<8sIIQQQQ", b"ASTM-E57", 1, 0, total, _physical(at), len(self._xml), _PAGE)
        self._start += struct.pack("<B7xQQQ", 1, length, _physical(48 + 32), 0)

    def _pages(self, logical: bytes, end: bool = False) -> bytes:
        data = self._left + logical
        cut = len(data) if end else len(data) // _DATA * _DATA
        self._left = data[cut:]
        return to_pages(data[:cut]) if cut else b""

    @staticmethod
    def _packet(block: np.ndarray) -> bytes:
        streams = [np.ascontiguousarray(block[:, i], "<f8").tobytes() for i in range(3)]
        body = struct.pack("<H3H", 3, *(len(s) for s in streams)) + b"".join(streams)
        return struct.pack("<BBH", 1, 0, len(body) + 3) + body

    #: Points of the next packet that a page may begin with, at most.
    AHEAD = _DATA // 8

    @property
    def size(self) -> int:
        """Bytes of the whole file."""
        return struct.unpack_from("<Q", self._start, 16)[0]

    def pages_of(self, first: int, points: np.ndarray, after: np.ndarray) -> tuple[int, bytes]:
        """Where the pages begin that ``points``, number ``first`` on and of whole packets, begin, and their bytes.

        ``after`` are the ``AHEAD`` points that follow, or as many as there are: the last page needs some.
        The first of all pages begin with the head, the last end with the description.
        """
        whole = 4 + 8 + 24 * _PACKET
        packets = b"".join(self._packet(points[a : a + _PACKET]) for a in range(0, max(1, len(points)), _PACKET))
        at = 0 if first == 0 else len(self._start) + first // _PACKET * whole
        data, end = (self._start if first == 0 else b"") + packets, first + len(points)
        if end >= self.count:
            data += self._xml
        else:
            rest = min(_PACKET, self.count - end)
            next_ = struct.pack("<BBH", 1, 0, 8 + 24 * rest + 3) + struct.pack("<H3H", 3, *[8 * rest] * 3)
            few = np.zeros((rest, 3))
            few[: len(after)] = after[:rest]
            next_ += b"".join(np.ascontiguousarray(few[:, i], "<f8").tobytes() for i in range(3))
            data += next_[: -(at + len(data)) % _DATA]
        skip = -at % _DATA
        return (at + skip) // _DATA * _PAGE, to_pages(data[skip:])

    def head(self) -> bytes:
        return self._pages(self._start)

    def body(self, points: np.ndarray) -> bytes:
        self._rows = np.concatenate([self._rows, points])
        cut = len(self._rows) // _PACKET * _PACKET
        whole, self._rows = self._rows[:cut], self._rows[cut:]
        return self._pages(b"".join(self._packet(whole[a : a + _PACKET]) for a in range(0, cut, _PACKET)))

    def tail(self) -> bytes:
        last = self._packet(self._rows) if len(self._rows) or not self.count else b""
        return self._pages(last + self._xml, end=True)


def encode_e57(points: np.ndarray) -> bytes:
    out = E57Stream(len(points))
    return out.head() + out.body(points) + out.tail()


def _packed_integers(data: bytes, bits: int, count: int) -> np.ndarray:
    """Unsigned integers of so many bits each, the lowest bit first, without gaps."""
    if not bits:
        return np.zeros(count, np.uint64)
    out, step = np.zeros(count, np.uint64), 8 * 4096
    for a in range(0, count, step):  # a multiple of 8 numbers begins at a whole byte
        n = min(step, count - a)
        part = np.frombuffer(data, np.uint8, -(-n * bits // 8), a * bits // 8)
        each = np.unpackbits(part, bitorder="little")[: n * bits].reshape(n, bits)
        out[a : a + n] = each.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    return out


def _e57_values(field: ET.Element, data: bytes, count: int) -> np.ndarray:
    """The values of one field of a scan: floats, integers or scaled integers."""
    kind = field.get("type")
    if kind == "Float":
        return np.frombuffer(data, "<f4" if field.get("precision") == "single" else "<f8")[:count].astype(float)
    if kind not in ("Integer", "ScaledInteger"):
        raise ValueError(f"E57 fields of type {kind} are not supported")
    low, high = int(field.get("minimum", -(2**63))), int(field.get("maximum", 2**63 - 1))
    raw = _packed_integers(data, (high - low).bit_length(), count)
    value = (raw + np.uint64(low % 2**64)).astype(np.int64).astype(float)  # modulo 2**64, as the sum fits again
    return value * float(field.get("scale", 1)) + float(field.get("offset", 0)) if kind == "ScaledInteger" else value


def decode_e57(data: bytes) -> np.ndarray:
    """All scans of cartesian coordinates, floats or scaled integers, one after the other, in double."""
    magic, _, _, _, xml_at, xml_size, _ = struct.unpack_from("<8sIIQQQQ", data)
    if magic != b"ASTM-E57":
        raise ValueError("not an E57 file")
    flat = from_pages(data)
    start = _logical(xml_at)
    root = ET.fromstring(flat[start : start + xml_size])
    out = [np.zeros((0, 3))]
    for scan in root.iter(f"{_NS}points"):
        fields = list(scan.find(f"{_NS}prototype"))
        names = [f.tag.removeprefix(_NS) for f in fields]
        need = [names.index(f"cartesian{c}") for c in "XYZ"]
        at = _logical(int(scan.get("fileOffset")))
        _, length, first, _ = struct.unpack_from("<B7xQQQ", flat, at)
        end, at = at + length, _logical(first)
        parts: list[list[bytes]] = [[] for _ in fields]
        while at < end:
            kind, _, size = struct.unpack_from("<BBH", flat, at)
            size += 1
            if kind == 1:
                n = struct.unpack_from("<H", flat, at + 4)[0]
                lengths = struct.unpack_from(f"<{n}H", flat, at + 6)
                p = at + 6 + 2 * n
                for i, k in enumerate(lengths):
                    parts[i].append(flat[p : p + k])
                    p += k
            at += size
        count = int(scan.get("recordCount"))
        out.append(np.stack([_e57_values(fields[i], b"".join(parts[i]), count) for i in need], 1))
    return np.concatenate(out)


DECODERS = {"pcd": decode_pcd, "xyz": decode_rows, "pts": decode_rows, "npz": decode_npz, "ply": decode_ply, "las": decode_las, "e57": decode_e57}


def _lines(p: np.ndarray) -> bytes:
    return "".join("%.4f %.4f %.4f\n" % tuple(r) for r in p.tolist()).encode()


def _dxf(p: np.ndarray) -> bytes:
    return "".join("0\nPOINT\n8\nPointCloud\n10\n%.4f\n20\n%.4f\n30\n%.4f\n" % tuple(r) for r in p.tolist()).encode()


LAS_SCALE = 0.001


def _las_head(n: int, s: dict) -> bytes:
    scaled = lambda v, c: round((v - s[f"mean_{c}"]) / LAS_SCALE) * LAS_SCALE + s[f"mean_{c}"]
    box = [scaled(s[f"{m}_{c}"], c) if n else 0.0 for c in "xyz" for m in ("max", "min")]
    out = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I3d3d6d", b"LASF", 0, 0, bytes(16), 1, 4, b"pointloom", b"pointloom", 1, 2024, 375, 375, 0, 0, 20, min(n, 2**32 - 1), *[min(n, 2**32 - 1), 0, 0, 0, 0], *[LAS_SCALE] * 3, *[s[f"mean_{c}"] or 0.0 for c in "xyz"], *box)
    return out + struct.pack("<QQIQ15Q", 0, 0, 0, n, n, *[0] * 14)


def _las_body(p: np.ndarray, s: dict) -> bytes:
    rows = np.zeros(len(p), np.dtype([("p", "<i4", (3,)), ("rest", "u1", (8,))]))
    rows["p"] = np.round((p - np.array([s[f"mean_{c}"] or 0.0 for c in "xyz"])) / LAS_SCALE).astype(np.int32)
    rows["rest"][:, 2] = 9  # first of one return
    return rows.tobytes()


@dataclass(frozen=True)
class Encoder:
    head: object = staticmethod(lambda n, s: b"")
    body: object = None
    tail: bytes = b""


ENCODERS = {
    "xyz": Encoder(body=lambda p, s: _lines(p)),
    "pts": Encoder(lambda n, s: f"{n}\n".encode(), lambda p, s: _lines(p)),
    "pcd": Encoder(
        lambda n, s: f"VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n".encode(),
        lambda p, s: np.ascontiguousarray(p, "<f4").tobytes(),
    ),
    "ply": Encoder(
        lambda n, s: f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty double x\nproperty double y\nproperty double z\nend_header\n".encode(),
        lambda p, s: np.ascontiguousarray(p, "<f8").tobytes(),
    ),
    "dxf": Encoder(lambda n, s: b"0\nSECTION\n2\nHEADER\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n", lambda p, s: _dxf(p), b"0\nENDSEC\n0\nEOF\n"),
    "las": Encoder(_las_head, _las_body),
}


def encode_npz(points: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, points=np.ascontiguousarray(points, np.float32))
    return out.getvalue()


def encode_frames(frames: list[np.ndarray], stamps: np.ndarray, angle_times: np.ndarray, angle_values: np.ndarray) -> bytes:
    """An archive of frames: ``points`` (an object per frame), ``timestamps``, ``angle_times``, ``angle_values``."""
    each = np.empty(len(frames), object)
    each[:] = [np.ascontiguousarray(f, np.float32) for f in frames]
    out = io.BytesIO()
    np.savez_compressed(out, points=each, timestamps=stamps, angle_times=angle_times, angle_values=angle_values)
    return out.getvalue()


def encode_obj(vertices: np.ndarray, normals: np.ndarray, triangles: np.ndarray) -> bytes:
    lines = ["v %.6f %.6f %.6f" % tuple(v) for v in vertices.tolist()] + ["vn %.6f %.6f %.6f" % tuple(v) for v in normals.tolist()]
    return "\n".join([*lines, *("f {0}//{0} {1}//{1} {2}//{2}".format(*t) for t in (triangles + 1).tolist()), ""]).encode()


def encode_stl(vertices: np.ndarray, triangles: np.ndarray) -> bytes:
    c = vertices[triangles]
    n = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
    n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-30)
    rows = np.zeros(len(triangles), np.dtype([("n", "<f4", (3,)), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    rows["n"], rows["v"] = n, c
    return bytes(80) + struct.pack("<I", len(triangles)) + rows.tobytes()
