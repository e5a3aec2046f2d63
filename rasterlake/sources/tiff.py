"""TIFF and BigTIFF: headers, codecs and predictors, after the TIFF 6.0 specification and its technical notes."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from ..plans.header import Header

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
CODECS = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits", 50000: "zstd"}


@dataclass
class Layout:
    """Where a file's blocks lie and how they are packed."""

    header: Header
    order: str
    dtype: str
    codec: str
    predictor: int
    planar: bool
    block_width: int
    block_height: int
    across: int
    down: int
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def block(self, band: int, by: int, bx: int) -> int:
        return (band * self.down + by) * self.across + bx if self.planar else by * self.across + bx


def parse(read) -> Layout:
    """The layout of a file; ``read(offset, size)`` gives bytes. ``ValueError`` if it is no TIFF that can be read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    version = struct.unpack(order + "H", head[2:4])[0]
    if version == 42:
        at, big = struct.unpack(order + "I", head[4:8])[0], False
    elif version == 43:
        at, big = struct.unpack(order + "Q", head[8:16])[0], True
    else:
        raise ValueError("not a TIFF file")
    n_size, entry, word = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(order + ("Q" if big else "H"), read(at, n_size))[0]
    raw = read(at + n_size, n * entry)
    tags: dict[int, tuple] = {}
    inline = 8 if big else 4
    for k in range(n):
        e = raw[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(order + "HH", e[:4])
        count = struct.unpack(order + word, e[4 : 4 + inline])[0]
        size = _SIZES.get(kind, 1) * count
        body = e[4 + inline :][:size] if size <= inline else read(struct.unpack(order + word, e[4 + inline :])[0], size)
        if kind == 2:
            tags[tag] = (body.rstrip(b"\0").decode("latin-1"),)
        elif kind in _LETTERS:
            tags[tag] = struct.unpack(f"{order}{count}{_LETTERS[kind]}", body)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, bands = one(256), one(257), one(277, 1)
    if not width or not height:
        raise ValueError("the TIFF file has no size")
    kind = _KINDS.get((one(339, 1), one(258, 1)))
    if kind is None:
        raise ValueError(f"samples of format {one(339, 1)} and {one(258, 1)} bits are not supported")
    codec = CODECS.get(one(259, 1))
    if codec is None:
        raise ValueError(f"compression {one(259, 1)} is not supported")
    tiled = 322 in tags
    bw, bh = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    scale, tie, matrix = tags.get(33550), tags.get(33922), tags.get(34264)
    if matrix:
        transform = (matrix[3], matrix[0], matrix[1], matrix[7], matrix[4], matrix[5])
    elif scale and tie:
        transform = (tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1])
    else:
        transform = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    keys = tags.get(34735, ())
    crs = ""
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0 and keys[k + 3] != 32767:
            crs = f"EPSG:{keys[k + 3]}"
    nodata = one(42113)
    header = Header(width, height, transform, crs, bands, float(nodata) if nodata else None)
    return Layout(header, order, kind, codec, one(317, 1), one(284, 1) == 2 and bands > 1, bw, bh, -(-width // bw), -(-height // bh), list(tags.get(324 if tiled else 273, ())), list(tags.get(325 if tiled else 279, ())))


def unpack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        at += 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes from 9 to 12 bits, most significant bit first, widened one code early."""
    out = bytearray()
    table: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    bits = held = 0
    width, last = 9, None
    for byte in raw:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        while bits >= width:
            bits -= width
            code = held >> bits & ((1 << width) - 1)
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, last = 9, None
                continue
            if last is None:
                if code > 255:
                    raise ValueError("corrupt LZW data")
                piece = table[code]
            else:
                if code < len(table):
                    piece = table[code]
                elif code == len(table):
                    piece = last + last[:1]
                else:
                    raise ValueError("corrupt LZW data")
                table.append(last + piece[:1])
            out += piece
            last = piece
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def decompress(raw: bytes, codec: str) -> bytes:
    if codec == "none":
        return raw
    if codec == "deflate":
        return zlib.decompress(raw)
    if codec == "packbits":
        return unpack_bits(raw)
    if codec == "lzw":
        return unpack_lzw(raw)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def decode(raw: bytes, layout: Layout, rows: int) -> np.ndarray:
    """A block as float64 (rows, width, samples)."""
    samples = 1 if layout.planar else layout.header.bands
    width = layout.block_width
    kind = np.dtype(layout.order + layout.dtype)
    data = decompress(raw, layout.codec)
    need = rows * width * samples * kind.itemsize
    if len(data) < need:
        raise ValueError("a block is shorter than its size")
    if layout.predictor == 3:
        planes = np.frombuffer(data[:need], np.uint8).reshape(rows, width * samples * kind.itemsize)
        # differences go over the row's bytes, sample by sample; most significant bytes come first
        steps = np.cumsum(planes.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * samples)
        return np.ascontiguousarray(steps.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, samples).astype(float)
    cells = np.frombuffer(data[:need], kind).reshape(rows, width, samples)
    if layout.predictor == 2:
        cells = np.cumsum(cells.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    return cells.astype(float)


def encode_tile(cells: np.ndarray) -> bytes:
    """A float32 tile (rows, width) with predictor 3 and DEFLATE."""
    rows, width = cells.shape
    planes = cells.astype(">f4").reshape(rows, width, 1).view(np.uint8).reshape(rows, width, 4).transpose(0, 2, 1).reshape(rows, -1)
    steps = planes.copy()
    steps[:, 1:] -= planes[:, :-1]
    return zlib.compress(steps.tobytes(), 6)


def directory(header: Header, tile: int, offsets: list[int], sizes: list[int], at: int) -> bytes:
    """A BigTIFF directory at offset ``at`` for band-planar float32 tiles."""
    g = header.transform
    tags: list[tuple[int, int, list]] = [
        (256, 4, [header.width]), (257, 4, [header.height]), (258, 3, [32] * header.bands), (259, 3, [8]), (262, 3, [1]), (277, 3, [header.bands]), (284, 3, [2 if header.bands > 1 else 1]),
        (317, 3, [3]), (322, 3, [tile]), (323, 3, [tile]), (324, 16, offsets), (325, 16, sizes), (339, 3, [3] * header.bands),
    ]
    if g[2] == 0 and g[4] == 0:
        tags += [(33550, 12, [g[1], -g[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, g[0], g[3], 0.0])]
    else:
        tags.append((34264, 12, [g[1], g[2], 0.0, g[0], g[4], g[5], 0.0, g[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    if header.crs.upper().startswith("EPSG:"):
        n = int(header.crs[5:])
        tags.append((34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if n == 4326 else 1, 2048 if n == 4326 else 3072, 0, 1, n]))
    if header.nodata is not None:
        text = repr(header.nodata).encode() + b"\0"
        tags.append((42113, 2, list(text)))
    tags.sort()
    extra_at = at + 8 + 20 * len(tags) + 8
    head, extra = struct.pack("<Q", len(tags)), b""
    for tag, kind, values in tags:
        body = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{_LETTERS[kind]}", *values)
        head += struct.pack("<HHQ", tag, kind, len(values))
        if len(body) <= 8:
            head += body.ljust(8, b"\0")
        else:
            head += struct.pack("<Q", extra_at + len(extra))
            extra += body
    return head + struct.pack("<Q", 0) + extra
