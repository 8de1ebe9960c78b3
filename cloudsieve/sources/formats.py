"""Decoding of single cloud and image files (one file is one cloud, so it is bounded)."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

_PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8",
              ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8"}
_PLY_TYPES = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1",
              "char": "i1", "int8": "i1", "ushort": "u2", "uint16": "u2", "short": "i2", "int16": "i2",
              "uint": "u4", "uint32": "u4", "int": "i4", "int32": "i4"}


def unpack_lzf(data: bytes, size: int) -> bytes:
    """LZF block, as used by compressed PCD files."""
    out = bytearray()
    i = 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i:i + c + 1]
            i += c + 1
            continue
        length = c >> 5
        if length == 7:
            length += data[i]
            i += 1
        start = len(out) - ((c & 31) << 8) - data[i] - 1
        i += 1
        for j in range(start, start + length + 2):
            out.append(out[j])
    if len(out) != size:
        raise ValueError("damaged LZF block")
    return bytes(out)


@dataclass(frozen=True)
class PointLayout:
    """Where a file keeps its points: kind of data, first byte, number of points, type of a binary row (``row``) with the
    fields that hold x, y, z, and for ascii rows the numbers in a row and the places of x, y, z."""

    kind: str
    body: int
    n: int
    row: np.dtype
    fields: tuple[str, ...]
    width: int
    places: tuple[int, ...]

    def xyz(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates of binary rows."""
        return np.column_stack([rows[f].reshape(len(rows), -1)[:, 0] for f in self.fields]).astype(np.float32)

    def numbers(self, text: bytes, n: int) -> np.ndarray:
        """Coordinates of ``n`` ascii rows."""
        rows = np.array(text.split(), dtype=np.float64).reshape(n, self.width)
        return rows[:, list(self.places)].astype(np.float32)


def pcd_layout(data: bytes) -> PointLayout:
    """Layout from the head of a PCD file. A head that is not complete raises ValueError."""
    head, body = {}, 0
    while "DATA" not in head:
        end = data.index(b"\n", body)
        line = data[body:end].decode("ascii", "replace").split()
        body = end + 1
        if line and not line[0].startswith("#"):
            head[line[0].upper()] = line[1:]
    names = head["FIELDS"]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    types = [_PCD_TYPES[(t, int(s))] for t, s in zip(head["TYPE"], head["SIZE"])]
    at = np.cumsum([0, *counts])
    row = np.dtype([(f"f{i}", t, (c,)) for i, (t, c) in enumerate(zip(types, counts))])
    places = [names.index(c) for c in "xyz"]
    return PointLayout(head["DATA"][0].lower(), body, n, row, tuple(f"f{i}" for i in places), int(at[-1]),
                       tuple(int(at[i]) for i in places))


def parse_pcd(data: bytes) -> np.ndarray:
    """xyz of a PCD file (ascii, binary or binary_compressed)."""
    form = pcd_layout(data)
    if form.kind == "ascii":
        return form.numbers(data[form.body:], form.n)
    if form.kind == "binary":
        return form.xyz(np.frombuffer(data, dtype=form.row, count=form.n, offset=form.body))
    if form.kind == "binary_compressed":
        packed, full = struct.unpack_from("<II", data, form.body)
        raw = unpack_lzf(data[form.body + 8:form.body + 8 + packed], full)
        cols, at = {}, 0
        for name in form.row.names:
            kind, (count,) = form.row[name].subdtype
            cols[name] = np.frombuffer(raw, dtype=kind, count=form.n * count, offset=at)[::count]
            at += form.n * form.row[name].itemsize
        return np.column_stack([cols[f] for f in form.fields]).astype(np.float32)
    raise ValueError(f"unknown PCD data kind '{form.kind}'")


def ply_layout(data: bytes) -> PointLayout:
    """Layout from the head of a PLY file, whose vertices must be its first element. A head that is not complete raises ValueError."""
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    lines = [line.split() for line in data[:end].decode("ascii", "replace").splitlines()]
    kind = next(line[1] for line in lines if line[:1] == ["format"])
    first = next(i for i, line in enumerate(lines) if line[:1] == ["element"])
    if lines[first][1] != "vertex":
        raise ValueError("vertices are not the first element")
    props = []
    for line in lines[first + 1:]:
        if line[:1] != ["property"]:
            break
        props.append((line[2], line[1]))
    names = [p for p, _ in props]
    order = "<" if kind == "binary_little_endian" else ">"
    row = np.dtype([(p, order + _PLY_TYPES[t]) for p, t in props])
    return PointLayout("ascii" if kind == "ascii" else "binary", body, int(lines[first][2]), row, ("x", "y", "z"), len(props),
                       tuple(names.index(c) for c in "xyz"))


def parse_ply(data: bytes) -> np.ndarray:
    """xyz of the vertices of a PLY file (ascii or binary)."""
    form = ply_layout(data)
    if form.kind == "ascii":
        return form.numbers(b"\n".join(data[form.body:].split(b"\n")[:form.n]), form.n)
    return form.xyz(np.frombuffer(data, dtype=form.row, count=form.n, offset=form.body))


def unpack_lzw(data: bytes) -> bytes:
    """LZW strip or tile of a TIFF: codes of 9 to 12 bits, highest bit first, 256 clears the table, 257 ends."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, last, width, bits, held = [], b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            last = b""
        else:
            if code > len(table) - (not last):
                raise ValueError("damaged LZW block")
            entry = table[code] if code < len(table) else last + last[:1]
            if last:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


# Byte width of TIFF field types and the tags read here.
_TIFF_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR, _FORMAT = (
    256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 339)
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}


def _samples(raw: bytes, shape: tuple[int, int, int], kind: np.dtype, predictor: int) -> np.ndarray:
    """Samples of one strip or tile after undoing its predictor: none (1), differences along a row (2), of float bytes (3)."""
    rows, columns, depth = shape
    if predictor == 2:
        whole = np.dtype(f"{kind.str[0]}u{kind.itemsize}") if kind.itemsize > 1 else np.dtype("u1")
        steps = np.frombuffer(raw, whole, rows * columns * depth).reshape(shape)
        return np.cumsum(steps, axis=1, dtype=whole.newbyteorder("=")).astype(whole).view(kind)
    if predictor == 3:
        steps = np.frombuffer(raw, np.uint8, rows * columns * depth * kind.itemsize).reshape(rows, -1, depth)
        planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * depth)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{kind.itemsize}").reshape(shape)
    return np.frombuffer(raw, kind, rows * columns * depth).reshape(shape)


def parse_tiff(data: bytes) -> np.ndarray:
    """First image of a TIFF in strips or tiles (uncompressed, LZW or deflate) as (height, width, samples)."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        where = at + 2 + 12 * i + 8
        if count * _TIFF_SIZE.get(kind, 8) > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        if kind in (3, 4):
            tags[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", data, where)
    one = lambda tag, default=1: tags.get(tag, (default,))[0]
    width, height, samples, packed = tags[_WIDTH][0], tags[_HEIGHT][0], one(_SAMPLES), one(_COMPRESSION)
    if packed not in _UNPACK:
        raise ValueError(f"TIFF compression {packed} is not supported")
    letter = {1: "u", 2: "i", 3: "f"}[one(_FORMAT)]
    kind = np.dtype(f"{order}{letter}{tags[_BITS][0] // 8}")
    tiled = _TILE_OFFSETS in tags
    offsets, counts = (tags[_TILE_OFFSETS], tags[_TILE_COUNTS]) if tiled else (tags[_OFFSETS], tags[_COUNTS])
    high, wide = (one(_TILE_HEIGHT), one(_TILE_WIDTH)) if tiled else (min(one(_ROWS, height), height), width)
    down, across = -(-height // high), -(-width // wide)
    planes = samples if one(_PLANAR) == 2 else 1
    depth = samples // planes
    out = np.zeros((height, width, samples), kind)
    for i, (offset, count) in enumerate(zip(offsets, counts)):
        plane, place = divmod(i, down * across)
        top, left = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - top)
        part = _samples(_UNPACK[packed](data[offset:offset + count]), (rows, wide, depth), kind, one(_PREDICTOR))
        out[top:top + rows, left:left + wide, plane * depth:(plane + 1) * depth] = part[:height - top, :width - left]
    return out
