"""GeoTIFF rasters: a reader of strips and tiles of one band and a writer, uncompressed or deflated.

Reads 8, 16, 32-bit integers and 32, 64-bit floats, horizontal prediction for integers, pixel scale with tie point, the
coordinate code and the no-data text.  Files come as rows (id, content); one file is decoded at a time."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values: sizes and letters of TIFF field types, linear unit codes
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
LINEAR_UNITS = {9001: "meter", 9002: "foot", 9003: "us_survey_foot"}


def fields(content: bytes) -> tuple[str, dict[int, list]]:
    """Byte order and the first directory's fields."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if not order or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", content, 4)[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        size, letter = _TYPES[kind]
        place = at + 10 + 12 * i
        if size * n > 4:
            place = struct.unpack_from(order + "I", content, place)[0]
        out[tag] = [content[place : place + n]] if letter == "s" else list(struct.unpack_from(f"{order}{n}{letter}", content, place))
    return order, out


def meta(content: bytes) -> dict:
    """width, height, west, north, dx, dy, epsg, unit, no_data."""
    _, f = fields(content)
    keys = f.get(34735, [0, 0, 0, 0])
    inline = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    codes = [inline[k] for k in (3072, 2048) if k in inline and inline[k] not in (0, 32767) and not 7000 <= inline[k] <= 7999]
    tie, scale = f.get(33922, [0.0] * 6), f.get(33550, [1.0, 1.0, 0.0])
    none = f.get(42113, [b""])[0].split(b"\0")[0].strip()
    return {"width": f[256][0], "height": f[257][0], "west": tie[3] - tie[0] * scale[0], "north": tie[4] + tie[1] * scale[1], "dx": scale[0], "dy": scale[1], "epsg": codes[0] if codes else None, "unit": LINEAR_UNITS.get(inline.get(4099) or inline.get(3076)), "no_data": float(none) if none else None}


def raster(content: bytes) -> np.ndarray:
    """The first band as float64 with NaN for no data."""
    order, f = fields(content)
    w, h, bits, form, bands = f[256][0], f[257][0], f.get(258, [8])[0], f.get(339, [1])[0], f.get(277, [1])[0]
    kind = np.dtype(f"{order}{'uif'[form - 1] if form in (1, 2, 3) else 'u'}{bits // 8}")
    tiled = 322 in f
    bw, bh = (f[322][0], f[323][0]) if tiled else (w, min(h, f.get(278, [h])[0]))
    offsets, counts = (f[324], f[325]) if tiled else (f[273], f[279])
    out, across = np.zeros((h, w)), -(-w // bw)
    for i, (o, n) in enumerate(zip(offsets, counts)):
        raw = content[o : o + n]
        if f.get(259, [1])[0] in (8, 32946):
            raw = zlib.decompress(raw)
        elif f.get(259, [1])[0] != 1:
            raise ValueError("compression is not supported")
        y, x = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, h - y)
        block = np.frombuffer(raw, kind, rows * bw * bands).reshape(rows, bw, bands)
        if f.get(317, [1])[0] == 2:
            block = np.cumsum(block, 1, dtype=kind)
        part = block[: h - y, : w - x, 0]
        out[y : y + part.shape[0], x : x + part.shape[1]] = part
    none = meta(content)["no_data"]
    return np.where(out == none, np.nan, out) if none is not None else out


def write(a: np.ndarray, west: float, north: float, dx: float, dy: float, epsg: int = 4326, no_data: float = -99999.0, deflate: bool = True) -> bytes:
    """A 32-bit float file of one strip."""
    raw = np.where(np.isnan(a), no_data, a).astype("<f4").tobytes()
    raw = zlib.compress(raw) if deflate else raw
    geo = [1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg]
    none = f"{no_data:g}\0".encode()
    entries = [
        (256, "I", [a.shape[1]]), (257, "I", [a.shape[0]]), (258, "H", [32]), (259, "H", [8 if deflate else 1]), (262, "H", [1]), (273, "I", [8]), (277, "H", [1]), (278, "I", [a.shape[0]]), (279, "I", [len(raw)]),
        (339, "H", [3]), (33550, "d", [dx, dy, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (34735, "H", geo), (42113, "s", none),
    ]
    start = 8 + len(raw) + len(raw) % 2
    extra, at, table = b"", start + 2 + 12 * len(entries) + 4, b""
    for tag, letter, values in entries:
        data = values if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        kind = next(k for k, (_, x) in _TYPES.items() if x == letter)
        if len(data) > 4:
            place = struct.pack("<I", at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, kind, len(values)) + place
    return b"II*\0" + struct.pack("<I", start) + raw + b"\0" * (len(raw) % 2) + struct.pack("<H", len(entries)) + table + b"\0" * 4 + extra


def read_tiff(files: DataFrame) -> DataFrame:
    """id, row, col, h of GeoTIFF files (id, content); no data is null."""
    kind = dict(files.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, content in zip(batch["id"], batch["content"]):
                a = raster(content)
                rows = max(1, 200_000 // max(1, a.shape[1]))
                for y in range(0, a.shape[0], rows):
                    part = a[y : y + rows]
                    yy, xx = np.indices(part.shape)
                    h = pd.Series(part.ravel())
                    yield pd.DataFrame({"id": i, "row": (yy.ravel() + y).astype(np.int32), "col": xx.ravel().astype(np.int32), "h": h.where(h.notna(), None)})

    return files.select("id", "content").mapInPandas(run, f"id {kind}, row int, col int, h double")


def tiff_files(cells: DataFrame, west: float, north: float, step: float) -> DataFrame:
    """id, content of GeoTIFF files, one a grid (id, row, col, h)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((pdf["row"].max() + 1, pdf["col"].max() + 1), np.nan)
        a[pdf["row"], pdf["col"]] = pdf["h"].astype(float)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "content": [write(a, west, north, step, step)]})

    return cells.groupBy("id").applyInPandas(run, f"id {dict(cells.dtypes)['id']}, content binary")


def png16(a: np.ndarray) -> bytes:
    """A 16-bit grey PNG of whole numbers from 0 to 65535."""
    rows = np.zeros((a.shape[0], 1 + 2 * a.shape[1]), np.uint8)
    rows[:, 1:] = a.astype(">u2").view(np.uint8).reshape(a.shape[0], -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_pixels(content: bytes) -> np.ndarray:
    """Samples (height, width, bands) of an 8 or 16-bit PNG without interlacing or palette."""
    at, data, head = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h, bits, colour, _, _, interlaced = head
    bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if bands is None or bits not in (8, 16) or interlaced:
        raise ValueError("kind of PNG is not supported")
    size, step = w * bands * bits // 8, bands * bits // 8
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, size + 1)
    out = np.zeros((h, size), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:], out[y - 1] if y else np.zeros(size, np.uint8)
        if raw[y, 0] == 0:
            out[y] = line
        elif raw[y, 0] == 2:
            out[y] = line + up
        elif raw[y, 0] == 1:
            out[y] = np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
        else:
            own = out[y]
            for x in range(size):
                a, b, c = int(own[x - step]) if x >= step else 0, int(up[x]), int(up[x - step]) if x >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[x] = (int(line[x]) + ((a + b) // 2 if raw[y, 0] == 3 else near)) & 255
    return out.reshape(h, w, bands) if bits == 8 else out.view(">u2").reshape(h, w, bands)


def elevation_pixels(content: bytes) -> np.ndarray:
    """Metres of an elevation tile in red, green and blue, NaN for no data."""
    p = png_pixels(content).astype(float)
    h = p[..., 0] * 256 + p[..., 1] + p[..., 2] / 256 - 32768
    return np.where(h <= -32760, np.nan, h)
