"""Image columns: Netpbm and BMP bytes as arrays, tiles as NPY, difference hashes.

An image is decoded to a ``(height, width, channels)`` array.  Resizing takes
the exact mean over each target cell, with fractions of border pixels, from an
integral image.  Tiles are written in the NPY format with a hash each.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, body, texts_of

#: Samples in a row of the image that stores a text.
ROW = 64


def _netpbm_header(data: bytes) -> tuple[bytes, list[int], int]:
    """Magic, the header's numbers and where the samples begin; '#' starts a comment."""
    magic, at, found = data[:2], 2, []
    need = 2 if magic in (b"P1", b"P4") else 3
    while len(found) < need:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        begin = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if begin == at:
            raise ValueError("bad Netpbm header")
        found.append(int(data[begin:at]))
    return magic, found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array; bitmaps give 0 for black and 255 for white."""
    magic, numbers, at = _netpbm_header(data)
    if magic not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    width, height = numbers[:2]
    channels = 3 if magic in (b"P3", b"P6") else 1
    most = numbers[2] if len(numbers) > 2 else 1
    if not 0 < most < 65536:
        raise ValueError("bad Netpbm maximum")
    n = width * height * channels
    if magic == b"P1":
        bits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8)[:n] - 48
        samples = (1 - bits) * 255
    elif magic == b"P4":
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        samples = (1 - np.unpackbits(rows, axis=1)[:, :width]) * 255
    elif magic in (b"P2", b"P3"):
        samples = np.array(data[at - 1 :].split()[:n], np.uint16 if most > 255 else np.uint8)
    else:
        kind = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
        samples = np.frombuffer(data, kind, n, at)
        samples = samples.astype(np.uint16) if most > 255 else samples
    if samples.size != n:
        raise ValueError("Netpbm samples are missing")
    return np.asarray(samples).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 24 and 32 bit BMP as RGB, top row first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("this kind of BMP isn't read")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits >= 24:
        n = bits // 8
        image = raw[:, : width * n].reshape(rows, width, n)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        colours = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        if bits == 8:
            index = raw[:, :width]
        else:
            per = 8 // bits
            index = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
            index = (index * (1 << np.arange(bits - 1, -1, -1))).sum(2)[:, :width]
            assert per
        image = colours[np.minimum(index, used - 1)]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: bytes, width: int = ROW) -> bytes:
    """8-bit samples as a binary grey map of whole rows."""
    if not samples or len(samples) % width:
        raise ValueError("whole rows only")
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def encode_bmp(image: np.ndarray) -> bytes:
    """An RGB array as a 24-bit BMP."""
    height, width = image.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    pixels = rows.tobytes()
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(pixels), 0, 0, 54, 40, width, height, 1, 24, 0, len(pixels), 2835, 2835, 0, 0) + pixels


def _edges(table: np.ndarray, n: int) -> np.ndarray:
    """The integral along axis 0 at n + 1 even places, between samples too."""
    at = np.arange(n + 1) * (len(table) - 1) / n
    low = np.minimum(at.astype(np.int64), len(table) - 2)
    part = (at - low).reshape(-1, *[1] * (table.ndim - 1))
    return table[low] * (1 - part) + table[low + 1] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell of a ``height`` x ``width`` grid laid over the image.

    The integral image is summed over rows in blocks, so that beside the image
    only one block is in memory: of each block, only the grid's lines stay.
    """
    rows, columns = image.shape[:2]
    step = max(1, (1 << 21) // max(1, columns))
    at = np.arange(height + 1) * rows / height
    lines = np.zeros((height + 1, columns, *image.shape[2:]))
    base = np.zeros((columns, *image.shape[2:]))
    for begin in range(0, rows, step):
        block = image[begin : begin + step]
        table = np.concatenate([base[None], base + np.cumsum(block, axis=0, dtype=np.float64)])
        mine = np.flatnonzero((at >= begin) & ((at < begin + len(block)) | (begin + len(block) >= rows)))
        low = np.minimum((at[mine] - begin).astype(np.int64), len(block) - 1)
        part = (at[mine] - begin - low).reshape(-1, *[1] * (table.ndim - 1))
        lines[mine] = table[low] * (1 - part) + table[low + 1] * part
        base = table[-1]
    table = np.concatenate([np.zeros((height + 1, 1, *image.shape[2:])), np.cumsum(lines, axis=1)], axis=1)
    corners = np.swapaxes(_edges(np.swapaxes(table, 0, 1), width), 0, 1)
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums * (height * width / (rows * columns))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Hex bits of whether each cell of a size x (size + 1) grid is darker than its right neighbour."""
    grey = image.reshape(*image.shape[:2], -1)
    small = np.round(area_resize(grey, size, size + 1).mean(axis=2), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tiles(image: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, column and samples of the tiles; those at the far borders may be smaller."""
    for y in range(0, image.shape[0], size):
        for x in range(0, image.shape[1], size):
            yield y // size, x // size, image[y : y + size, x : x + size]


def image_tiles(images: DataFrame, key: str, content: str, height: int, width: int, tile: int) -> DataFrame:
    """NPY tiles of resized images: key, row, column, npy, dhash, error.

    An image that is null or can't be decoded gives one row with an ``error``
    and null tiles.  Repeated rows give repeated tiles; other columns are ignored.
    """
    src = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))

    def one(data: bytes | None) -> Iterator[tuple]:
        try:
            if data is None:
                raise ValueError("no content")
            image = np.clip(np.round(area_resize(decode(data), height, width)), 0, 255).astype(np.uint8)
        except (ValueError, struct.error, IndexError) as e:
            yield None, None, None, None, str(e)
            return
        for y, x, part in tiles(image, tile):
            yield y, x, to_npy(part), difference_hash(part), None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("row", pa.int32()), ("column", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])
        for b in batches(it):
            rows = [(k, *t) for k, data in zip(b.column("key").to_pylist(), b.column("content").to_pylist()) for t in one(data)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return src.mapInArrow(run, "key string, row int, column int, npy binary, dhash string, error string")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def text_images(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a grey map, read back and described (``SCHEMA``).

    The UTF-8 bytes, with bytes 0 appended up to a positive multiple of 64, are
    the samples.  A null text counts as empty (64 zeros); repeated rows give
    repeated rows; other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))

    def one(text: bytes) -> tuple:
        pad = -len(text) % ROW if text else ROW
        media = encode_pgm(text + bytes(pad))
        image = decode(media)
        payload = image.tobytes()
        small = np.clip(np.round(area_resize(image, 16, 16)), 0, 255).astype(np.uint8)
        return (
            len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]),
            len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(to_npy(small)).hexdigest(),
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches(it):
            rows = zip(*map(one, texts_of(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds))], names=names)

    return src.mapInArrow(run, SCHEMA)
