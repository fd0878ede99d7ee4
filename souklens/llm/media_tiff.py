"""TIFF media columns: payload bytes to TIFF files and back, one row (or array item) per page.

Reading walks the chain of image directories, undoes PackBits, LZW or deflate for each strip or tile, then the horizontal
predictor, and crops tiles to the page. Both byte orders are read; samples are 8 bits, chunky.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4}
PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("compression", T.IntegerType()), T.StructField("pixels", T.BinaryType())])


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    compression: int
    pixels: bytes


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 3 or more equal bytes as one pair, the rest as literals of at most 128."""
    out, i, n, lit = bytearray(), 0, len(data), 0

    def flush(a: int, b: int) -> None:
        while a < b:
            k = min(128, b - a)
            out.append(k - 1)
            out.extend(data[a : a + k])
            a += k

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            flush(lit, i)
            out += bytes((257 - (j - i), data[i]))
            lit = j
        i = j
    flush(lit, n)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, code width one code early, 256 clears, 257 ends."""
    out, acc, bits, width = bytearray(), 0, 0, 9
    table = {bytes((i,)): i for i in range(256)}
    size = 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits)
            acc &= (1 << bits) - 1

    put(256)
    w = b""
    for b in data:
        wb = w + bytes((b,))
        if wb in table:
            w = wb
            continue
        put(table[w])
        table[wb] = size
        size += 1
        if size == 4095:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif size >= 1 << width:
            width += 1
        w = bytes((b,))
    if w:
        put(table[w])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, last = list(base), b""
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("broken LZW data")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


_ENCODE = {NONE: bytes, LZW: lzw_encode, **dict.fromkeys((DEFLATE, OLD_DEFLATE), lambda d: zlib.compress(d, 1)), PACKBITS: pack_bits}
_DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def encode_tiff(payload: bytes, *, width: int = 192, samples: int = 1, compression: int = DEFLATE, predictor: int = 2, page_rows: int = 1024, strip_rows: int = 256, tile: int = 0, order: str = "<") -> bytes:
    """payload (a positive multiple of width x samples bytes) as pages of at most page_rows rows, in strips or square tiles."""
    line = width * samples
    if not payload or len(payload) % line:
        raise ValueError("the payload must be a positive multiple of a row")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width, samples)
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        height = len(page)
        if tile:
            down, across = -(-height // tile), -(-width // tile)
            full = np.pad(page, ((0, down * tile - height), (0, across * tile - width), (0, 0)), mode="edge")
            parts = [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        starts, counts = [], []
        for part in parts:
            if predictor == 2:
                diff = part.copy()
                diff[:, 1:] -= part[:, :-1]
                part = diff
            data = _ENCODE[compression](part.tobytes())
            starts.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [1 if samples < 3 else 2]), (277, 3, [samples]), (284, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, starts), (325, 4, counts)] if tile else [(273, 4, starts), (278, 4, [strip_rows]), (279, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                at = struct.pack(order + "I", len(out))
                out += data + b"\0" * (len(data) % 2)
                data = at
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def decode_tiff(data: bytes) -> list[Page]:
    """All pages of a file. Raises ValueError where it isn't a TIFF of the kinds read here."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages, seen = struct.unpack_from(order + "I", data, 4)[0], [], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("broken chain of directories")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            place = at + 10 + 12 * k
            if _SIZES.get(kind, 1) * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{order}{count}{'BHI'[kind // 2]}", data, place)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        pages.append(_page(data, tags))
    return pages


def _page(data: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    width, height = tags[256][0], tags[257][0]
    samples, compression, predictor = (tags.get(t, (1,))[0] for t in (277, 259, 317))
    if set(tags.get(258, (1,))) != {8} or tags.get(284, (1,))[0] != 1 or compression not in _DECODE or predictor not in (1, 2):
        raise ValueError("a kind of TIFF that isn't read here")
    tiled = 324 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, (height,))[0]))
    if min(width, height, samples, w, h) < 1:
        raise ValueError("a page without size")
    across = -(-width // w)
    starts, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if len(starts) != across * -(-height // h):
        raise ValueError("strips or tiles are missing")
    parts = []
    for k, (s, c) in enumerate(zip(starts, counts, strict=True)):  # all are there before the page takes memory
        rows = h if tiled else min(h, height - k * h)
        part = np.frombuffer(_DECODE[compression](data[s : s + c]), np.uint8)
        if len(part) < rows * w * samples:
            raise ValueError("a strip or tile is too short")
        part = part[: rows * w * samples].reshape(rows, w, samples)
        parts.append(np.cumsum(part, axis=1, dtype=np.uint8) if predictor == 2 else part)
    image = np.empty((height, width, samples), np.uint8)
    for k, part in enumerate(parts):
        y, x = k // across * h, k % across * w
        image[y : y + h, x : x + w] = part[: height - y, : width - x]
    return Page(width, height, samples, compression, image.tobytes())


def feature_of(pages: list[Page]) -> str:
    """Size, pages, mean and entropy of the samples of a file."""
    count = sum((np.bincount(np.frombuffer(p.pixels, np.uint8), minlength=256) for p in pages), np.zeros(256, np.int64))
    share = count[count > 0] / count.sum()
    return f"{pages[0].width}x{sum(p.height for p in pages)} p{len(pages)} mean {count @ np.arange(256) / count.sum():.4f} entropy {abs(-(share * np.log2(share)).sum()):.4f}"


def _bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about limit bytes of a column."""
    for batch in batches:
        if batch.num_rows:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
            i = 0
            while i < len(size):
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
                yield batch.slice(i, j - i)
                i = j


def _plus(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [c for c in batch.schema.names if c not in new]
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()), names=keep + list(new))


def _schema(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in new] + [T.StructField(k, v) for k, v in new.items()])


#: Ways to store a file, all of which a reader meets: codecs, strips and tiles, predictors, byte orders, several pages.
LAYOUTS = (
    {"compression": LZW}, {"compression": PACKBITS, "predictor": 1}, {"compression": DEFLATE, "tile": 64}, {"compression": NONE, "order": ">"},
    {"compression": DEFLATE}, {"compression": DEFLATE, "page_rows": 32, "strip_rows": 8}, {"compression": DEFLATE, "order": ">", "tile": 128, "predictor": 1}, {"compression": OLD_DEFLATE, "page_rows": 256},
)


def store_as_tiff(df: DataFrame, column: str = "text", unit: int = 192, layouts: tuple[dict, ...] = ({},)) -> DataFrame:
    """df with n_bytes and media: the column's UTF-8 bytes, filled up with blanks to a positive multiple of unit, as a TIFF file.

    The bytes' CRC-32 picks one of the layouts, so equal texts have equal files. A null is empty: one row of blanks. Columns of
    the added names are replaced; others pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, column):
            texts = [(x or "").encode() if isinstance(x, str | None) else bytes(x) for x in batch.column(column).to_pylist()]
            media = [encode_tiff(t.ljust(max(1, -(-len(t) // unit)) * unit), width=unit, **layouts[zlib.crc32(t) % len(layouts)]) for t in texts]
            yield _plus(batch, {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})

    return df.mapInArrow(run, _schema(df, {"n_bytes": T.LongType(), "media": T.BinaryType()}))


def read_tiff(df: DataFrame, column: str = "media") -> DataFrame:
    """df with pages (an array of page, width, height, samples, compression, pixels), feature and error.

    A null file has no pages; one that can't be read has none and says why in error; others have a null error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, column):
            pages, features, errors = [], [], []
            for data in batch.column(column).to_pylist():
                found, error = [], None
                try:
                    found = decode_tiff(data) if data is not None else []
                except (ValueError, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                pages.append([{"page": k, "width": p.width, "height": p.height, "samples": p.samples, "compression": p.compression, "pixels": p.pixels} for k, p in enumerate(found)])
                features.append(feature_of(found) if found else None)
                errors.append(error)
            kind = pa.list_(pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary())]))
            yield _plus(batch, {"pages": pa.array(pages, kind), "feature": pa.array(features, pa.string()), "error": pa.array(errors, pa.string())})

    return df.mapInArrow(run, _schema(df, {"pages": T.ArrayType(PAGE), "feature": T.StringType(), "error": T.StringType()}))


def tiff_pages(df: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each file: df's columns without the file, the page's, feature and error; a null file, or one that can't be
    read, has one row without a page."""
    return read_tiff(df, column).withColumn("_page", F.explode_outer("pages")).drop("pages", column).select("*", "_page.*").drop("_page")
