"""Media columns: Netpbm and BMP images as numpy arrays, tiles and difference hashes.

Images come and go as bytes in a column. They are decoded whole (P1 to P6
Netpbm up to 16 bits; BMP of 1, 4 and 8 bits with a palette and of 16, 24 and 32
bits, with or without bit masks, not run-length coded) to 8-bit samples, resized by exact area averages from an integral image, and written
as NPY tiles. The integral image is walked in strips of rows and kept only at
the rows that cell borders need, so a resize takes memory of one strip.

Defined results
* null or undecodable bytes: null array fields and hash, ``error`` says why; the row stays.
* empty text as payload: one row of fill, 576 bytes of 255.
* samples of other depths are spread over 0 to 255, rounded down; Netpbm's black bit is 0.
* an input column of an output's name (in any letter case) gives way to it.
* equal bytes give equal tiles and hashes; repeated rows repeat; empty table: empty result.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.names import others
from loomwork.session import ship

STRIP = 4096
SIDE = 24  # of the square tile that a payload's rows are made of
UNIT = SIDE * SIDE
_BATCH_BYTES = 8_000_000


class MediaError(ValueError):
    """Bytes that aren't an image this module reads."""


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Binary grey Netpbm of a (height, width) uint8 array."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey BMP (bottom-up, rows padded to four bytes) of a (height, width) uint8 array."""
    h, w = pixels.shape
    stride = -(-w // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + np.array([start + rows.size, 0, start], "<u4").tobytes()
    info = np.array([40, w, h], "<i4").tobytes() + np.array([1, 8], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 256, 0], "<i4").tobytes()
    return head + info + palette.tobytes() + rows.tobytes()


def _bits(rows: np.ndarray, width: int, depth: int) -> np.ndarray:
    """(height, width) values of ``depth`` bits (1, 2 or 4) from packed rows, the high bits first."""
    flat = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return flat @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers and the place after the last of them."""
    at, found = 2, []
    while len(found) < fields:
        if at >= len(data):
            raise MediaError("header ends early")
        c = data[at : at + 1]
        if c == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
        elif c.isspace():
            at += 1
        elif c.isdigit():
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            if end - at > 9:
                raise MediaError("number too large")
            found.append(int(data[at:end]))
            at = end
        else:
            raise MediaError("bad header")
    return found, at


def _bitmap(data: bytes) -> np.ndarray:
    (w, h), at = _header(data, 2)
    if not (w and h):
        raise MediaError("unsupported size or depth")
    if data[:2] == b"P4":
        stride = -(-w // 8)
        if len(data) - at - 1 < stride * h:
            raise MediaError("raster ends early")
        ink = _bits(np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride), w, 1)
    else:
        marks = b"".join(line.split(b"#")[0] for line in data[at:].split(b"\n")).translate(None, b" \t\r\x0b\x0c")[: w * h]
        ink = np.frombuffer(marks, np.uint8) - 48
        if (ink > 1).any():
            raise MediaError("sample out of range")
        if len(ink) < w * h:
            raise MediaError("raster ends early")
        ink = ink.reshape(h, w)
    return (255 * (1 - ink.astype(np.int64))).astype(np.uint8)


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        return _bitmap(data)
    (w, h, top), at = _header(data, 3)
    deep = 3 if kind in (b"P3", b"P6") else 1
    if not (w and h and 0 < top < 65536):
        raise MediaError("unsupported size or depth")
    n = w * h * deep
    if kind in (b"P5", b"P6"):
        sample = np.dtype(">u2" if top > 255 else np.uint8)
        if len(data) - at - 1 < n * sample.itemsize:
            raise MediaError("raster ends early")
        flat = np.frombuffer(data, sample, count=n, offset=at + 1)
    else:
        try:
            flat = np.array(data[at:].split()[:n], dtype=np.int64)
        except OverflowError:
            raise MediaError("sample out of range") from None
        if len(flat) and (flat.min() < 0 or flat.max() > top):
            raise MediaError("sample out of range")
        if len(flat) < n:
            raise MediaError("raster ends early")
    flat = flat.astype(np.uint8) if top == 255 else (flat.astype(np.int64) * 255 // top).clip(0, 255).astype(np.uint8)
    return flat.reshape(h, w, deep) if deep > 1 else flat.reshape(h, w)


def _masked(rows: np.ndarray, masks: list[int]) -> np.ndarray:
    """Red, green and blue of packed pixels, each spread over 0 to 255."""
    out = []
    for m in masks:
        if not m:
            raise MediaError("unsupported BMP")
        low = (m & -m).bit_length() - 1
        out.append(((rows.astype(np.int64) & m) >> low) * 255 // (m >> low))
    return np.stack(out, axis=2).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("header ends early")
    start = int.from_bytes(data[10:14], "little")
    size, w, h = (int(x) for x in np.frombuffer(data, "<i4", 3, 14))
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    fields = packed == 3 and bits in (16, 32)
    if (packed and not fields) or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or h == 0 or size < 40:
        raise MediaError("unsupported BMP")
    stride = -(-w * bits // 32) * 4
    if start + stride * abs(h) > len(data):
        raise MediaError("raster ends early")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits <= 8:
        used = int.from_bytes(data[46:50], "little") or 1 << bits
        if used > 1 << bits or 14 + size + 4 * used > len(data):
            raise MediaError("palette ends early")
        palette = np.zeros((1 << bits, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)
        at = rows[:, :w] if bits == 8 else _bits(np.ascontiguousarray(rows), w, bits)
        if (palette[:, :1] == palette[:, :3]).all():
            return palette[:, 0][at]
        return palette[:, 2::-1][at]
    if fields or bits == 16:
        if fields and len(data) < 66:
            raise MediaError("header ends early")
        masks = [int.from_bytes(data[k : k + 4], "little") for k in (54, 58, 62)] if fields else [0x7C00, 0x3E0, 0x1F]
        return _masked(np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4")[:, :w], masks)
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray:
    """The image as (height, width) or (height, width, 3) uint8."""
    if not data:
        raise MediaError("no bytes")
    if data[:2] in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise MediaError("unknown format")


def area_sums(pixels: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Exact sums over out_h x out_w equal cells, times out_h * out_w (int64).

    The integral image is linear within a pixel, so its values at cell borders
    are whole numbers after this scaling.
    """
    if pixels.ndim == 3:
        return np.stack([area_sums(pixels[:, :, c], out_h, out_w) for c in range(pixels.shape[2])], axis=2)
    h, w = pixels.shape

    def borders(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1, dtype=np.int64) * n
        return at // parts, at % parts

    xq, xr = borders(w, out_w)
    yq, yr = borders(h, out_h)
    wanted = np.unique(np.concatenate([yq, np.minimum(yq + 1, h)]))
    kept = np.zeros((len(wanted), out_w + 1), np.int64)
    above = np.zeros(out_w + 1, np.int64)
    for top in range(0, h, STRIP):
        part = np.zeros((min(STRIP, h - top), w + 1), np.int64)
        np.cumsum(pixels[top : top + STRIP], axis=1, out=part[:, 1:])
        nxt = np.minimum(xq + 1, w)
        part = part[:, xq] * (out_w - xr) + part[:, nxt] * xr
        np.cumsum(part, axis=0, out=part)
        part += above
        inside = (wanted > top) & (wanted <= top + len(part))
        kept[inside] = part[wanted[inside] - top - 1]
        above = part[-1]
    low, high = np.searchsorted(wanted, yq), np.searchsorted(wanted, np.minimum(yq + 1, h))
    whole = kept[low] * (out_h - yr)[:, None] + kept[high] * yr[:, None]
    return np.diff(np.diff(whole, axis=0), axis=1)


def resize(pixels: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Area averages, rounded down, as uint8."""
    h, w = pixels.shape[:2]
    return (area_sums(pixels, out_h, out_w) // (h * w)).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, row by row: is a cell of the 8 x 9 area image brighter than its right neighbour."""
    sums = area_sums(pixels, 8, 9)
    if sums.ndim == 3:
        sums = sums.sum(axis=2)
    return np.packbits(sums[:, :-1] > sums[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    """The array in NPY format 1.0."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def payload_pixels(text: bytes | None) -> np.ndarray:
    """A text's bytes, filled with 255 up to a positive multiple of 576, as rows of 24 samples."""
    data = text or b""
    fill = -len(data) % UNIT or (0 if data else UNIT)
    return np.frombuffer(data + b"\xff" * fill, np.uint8).reshape(-1, SIDE)


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded total of bytes in its last column."""
    column, start, size = batch.column(batch.num_columns - 1), 0, 0
    for i, x in enumerate(column):
        n = 0 if not x.is_valid else len(x.as_buffer())
        if i > start and size + n > _BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(column) or not len(column):
        yield batch.slice(start)


def store_text(docs: DataFrame, text_col: str = "text", media_col: str = "media", *, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and the text's payload stored losslessly as a PGM of width 24."""
    keep = others(docs.columns if keep is None else keep, text_col, media_col, "n_bytes")
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                texts = [x.as_py() or b"" for x in batch.column(len(keep))]
                made = [encode_pgm(payload_pixels(x)) for x in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([len(x) for x in texts], pa.int64()), pa.array(made, pa.binary())], names=schema.names)

    ship(docs.sparkSession)
    return docs.select(*keep, F.col(text_col).cast("binary").alias("__lw_text")).mapInArrow(each, schema)


def features(media: DataFrame, media_col: str = "media", *, side: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Per stored image: size, samples' digest and checksum, stored form's size and digest, NPY tile, hash, error."""
    made = [
        ("height", T.IntegerType(), pa.int32()), ("width", T.IntegerType(), pa.int32()), ("payload_bytes", T.LongType(), pa.int64()),
        ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()),
        ("media_sha256", T.StringType(), pa.string()), ("tile", T.BinaryType(), pa.binary()), ("dhash", T.StringType(), pa.string()), ("error", T.StringType(), pa.string()),
    ]
    keep = others(media.columns if keep is None else keep, media_col, *(n for n, _, _ in made))
    schema = T.StructType([*[media.schema[c] for c in keep], *[T.StructField(n, t) for n, t, _ in made]])

    def one(data: bytes | None) -> tuple:
        stored = (None, None) if data is None else (len(data), sha256(data).hexdigest())
        try:
            pixels = decode(data)
        except ValueError as why:
            return (None, None, None, None, None, *stored, None, None, str(why))
        payload = np.ascontiguousarray(pixels).reshape(-1).data
        return (*pixels.shape[:2], len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, npy(resize(pixels, side, side)), difference_hash(pixels), None)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                rows = [one(x.as_py()) for x in batch.column(len(keep))]
                columns = list(zip(*rows, strict=True)) or [()] * len(made)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, k) for c, (_, _, k) in zip(columns, made, strict=True)]], names=schema.names)

    ship(media.sparkSession)
    return media.select(*keep, F.col(media_col).alias("__lw_media")).mapInArrow(each, schema)


def tiles(media: DataFrame, media_col: str = "media", *, side: int = SIDE, keep: list[str] | None = None) -> DataFrame:
    """One row per ``side`` x ``side`` tile of each image: row, column, NPY bytes and difference hash.

    Tiles at the right and lower borders are as small as what is left. Write
    the result with ``.write.parquet``; images that can't be decoded have no tiles.
    """
    keep = others(media.columns if keep is None else keep, media_col, "tile_row", "tile_col", "npy", "dhash")
    schema = T.StructType([*[media.schema[c] for c in keep], T.StructField("tile_row", T.IntegerType()), T.StructField("tile_col", T.IntegerType()), T.StructField("npy", T.BinaryType()), T.StructField("dhash", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _small(whole):
                for i, x in enumerate(batch.column(len(keep))):
                    try:
                        pixels = decode(x.as_py())
                    except ValueError:
                        continue
                    at = [(r, c) for r in range(0, pixels.shape[0], side) for c in range(0, pixels.shape[1], side)]
                    for k in range(0, len(at), 4096):
                        some = at[k : k + 4096]
                        cut = [pixels[r : r + side, c : c + side] for r, c in some]
                        kept = [pa.repeat(batch.column(j)[i], len(some)) for j in range(len(keep))]
                        yield pa.RecordBatch.from_arrays([*kept, pa.array([r // side for r, _ in some], pa.int32()), pa.array([c // side for _, c in some], pa.int32()), pa.array([npy(y) for y in cut], pa.binary()), pa.array([difference_hash(y) for y in cut])], names=schema.names)

    ship(media.sparkSession)
    return media.select(*keep, F.col(media_col).alias("__lw_media")).mapInArrow(each, schema)
