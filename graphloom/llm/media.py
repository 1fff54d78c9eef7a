"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles, difference hashes.

Images travel as bytes in a binary column. Decoding, resizing and hashing run in Arrow batches
(`mapInArrow`), one image at a time, so memory is bounded by the largest image.

Defined results: a null image decodes to null outputs; an undecodable one raises in `decode` and gives
null outputs plus an `error` text in `media_features`. A null text is stored as the empty text.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from graphloom.llm.common import map_columns

#: Samples of one stored unit; payloads are padded to a positive multiple of it.
UNIT = 576
#: Pixels a row of the stored grey images.
WIDTH = 24
PAD = 255


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """8-bit array (h, w) as binary PGM, (h, w, 3) as binary PPM."""
    if pixels.dtype != np.uint8 or pixels.ndim not in (2, 3) or pixels.ndim == 3 and pixels.shape[2] != 3:
        raise ValueError("uint8 pixels (h, w) or (h, w, 3) are needed")
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 (bitmap, grey, colour; text or binary) as an array scaled to 0..255."""
    kind = data[:2]
    if len(kind) < 2 or kind[:1] != b"P" or kind[1:] not in b"123456":
        raise ValueError("not a Netpbm image")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = *head[:2], head[2] if len(head) > 2 else 1
    if not 0 < top < 65536:
        raise ValueError("broken Netpbm header")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    if kind in (b"P4", b"P5", b"P6"):
        at += 1  # one white space after the header
    if kind == b"P4":
        row = (w + 7) // 8
        if len(data) - at < row * h:
            raise ValueError("image data end early")
        bits = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
        return np.where(np.unpackbits(bits, axis=1)[:, :w] == 1, 0, 255).astype(np.uint8)
    if kind == b"P1":
        bits = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:n]
        if len(bits) < n or bits.strip(b"01"):
            raise ValueError("image data end early or aren't bits")
        flat = np.frombuffer(bits, np.uint8) - 48
        return np.where(flat == 1, 0, 255).astype(np.uint8).reshape(h, w)
    if kind in (b"P2", b"P3"):
        fields = re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n]
        if any(len(x) > 9 or not x.isdigit() for x in fields):
            raise ValueError("a sample isn't a number up to the maximum")
        flat = np.array(fields, dtype=np.int64)
    else:
        size = 1 if top < 256 else 2
        if len(data) - at < n * size:
            raise ValueError("image data end early")
        flat = np.frombuffer(data, np.uint8 if size == 1 else ">u2", n, at)
    if flat.size < n:
        raise ValueError("image data end early")
    if n and int(flat.max()) > top:
        raise ValueError("a sample is above the maximum")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8).reshape((h, w, 3) if depth == 3 else (h, w))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """(h, w) as 8-bit BMP with a grey palette, (h, w, 3) as 24-bit BMP."""
    h, w = pixels.shape[:2]
    bits = 8 if pixels.ndim == 2 else 24
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    row = (w * bits // 8 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * bits // 8] = (pixels if bits == 8 else pixels[:, :, ::-1]).reshape(h, -1)
    start = 54 + len(palette)
    ints = lambda size, *xs: b"".join(x.to_bytes(size, "little", signed=x < 0) for x in xs)
    head = b"BM" + ints(4, start + body.size, 0, start)
    info = ints(4, 40, w, h) + ints(2, 1, bits) + ints(4, 0, body.size, 2835, 2835, 256 if bits == 8 else 0, 0)
    return head + info + palette + body[::-1].tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 24 or 32-bit BMP; grey palettes give (h, w), colours (h, w, 3).

    Of 32-bit images with masks those of whole bytes are read, in the masks' order.
    """
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    num = lambda at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    start, info, w, h, bits = num(10), num(14), num(18, signed=True), num(22, signed=True), num(28, 2)
    if num(30) not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("unsupported BMP")
    row = (w * bits + 31) // 32 * 4
    if len(data) < start + row * abs(h):
        raise ValueError("image data end early")
    raw = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    raw = raw[::-1] if h > 0 else raw
    if bits == 32 and num(30) == 3:
        shifts = [{0xFF << k: k // 8 for k in (0, 8, 16, 24)}.get(num(at)) for at in (54, 58, 62)]
        if None in shifts:
            raise ValueError("unsupported BMP")
        return np.ascontiguousarray(raw[:, : w * 4].reshape(abs(h), w, 4)[:, :, shifts])
    if bits > 8:
        return np.ascontiguousarray(raw[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    colours = num(46) or 1 << bits
    if colours > 1 << bits or len(data) < 14 + info + colours * 4:
        raise ValueError("broken BMP palette")
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + info).reshape(colours, 4)[:, 2::-1]
    if bits == 8:
        index = raw[:, :w]
    else:
        each = np.unpackbits(raw, axis=1).reshape(abs(h), -1, bits)
        index = (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :w]
    if index.size and int(index.max()) >= colours:
        raise ValueError("a pixel is beyond the palette")
    out = palette[index]
    grey = (palette == palette[:, :1]).all()
    return np.ascontiguousarray(out[:, :, 0] if grey else out)


def columns(rows: list[tuple], names: Iterable[str]) -> dict[str, list]:
    return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Integer luma of colour pixels; grey ones as they are."""
    if pixels.ndim == 2:
        return pixels
    r, g, b = (pixels[:, :, i].astype(np.uint32) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, fractional borders included, from an integral image (float64)."""
    h, w = pixels.shape
    if not h or not w:
        return np.zeros((height, width))
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def at(cuts: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(cuts.astype(np.int64), table.shape[0] - 2)
        part = (cuts - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(np.linspace(0, h, height + 1), integral)
    both = at(np.linspace(0, w, width + 1), rows.T).T
    return np.diff(np.diff(both, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray, size: int = 8) -> str:
    """Bits of whether each cell of a size x (size + 1) reduction is darker than its right neighbour, as hex."""
    small = np.round(area_resize(grey(pixels), size, size + 1), 6)
    bits = (small[:, :-1] < small[:, 1:]).ravel()
    return np.packbits(bits).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


FEATURES = "height int, width int, channels int, tile binary, dhash string, error string"


def media_features(df: DataFrame, key: str, media: str, tile: int = 32) -> DataFrame:
    """Decodes the images of column `media`: shape, an area-resized grey NPY tile, the difference hash.

    Returns `key` and the columns of FEATURES; other columns of `df` are not read. Null images give nulls.
    """

    def compute(cols: dict[str, list]) -> dict[str, list]:
        rows = []
        for data in cols["media"]:
            if data is None:
                rows.append((None,) * 6)
                continue
            try:
                pixels = decode(data)
            except ValueError as e:
                rows.append((None, None, None, None, None, str(e)))
                continue
            small = np.round(area_resize(grey(pixels), tile, tile)).astype(np.uint8)
            rows.append((*pixels.shape[:2], 1 if pixels.ndim == 2 else 3, npy_bytes(small), difference_hash(pixels), None))
        return columns(rows, ("height", "width", "channels", "tile", "dhash", "error"))

    picked = df.select(df[key].alias("key"), df[media].alias("media"))
    return map_columns(picked, compute, FEATURES, ("key",)).withColumnRenamed("key", key)


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded by 255 to a positive multiple of UNIT, and their number before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw.ljust(size, bytes((PAD,))), len(raw)


def text_as_image(payload: bytes) -> bytes:
    """Lossless grey Netpbm image, WIDTH pixels a row."""
    return encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))


STORED = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, tile_sha256 string"
)


def store_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = 32) -> DataFrame:
    """Stores every text as an image column, reads the stored bytes back and returns digests of both.

    One row per input row, repeated rows included, none for an empty table; null ids stay null, null texts count as
    empty, equal texts get equal values, other columns aren't read. The payload's digests come from the decoded pixels.
    `feature` is the difference hash; `tile_sha256` names the NPY tile.
    """

    def compute(cols: dict[str, list]) -> dict[str, list]:
        rows = []
        for value in cols["text"]:
            payload, n = text_payload(value)
            stored = text_as_image(payload)
            pixels = decode(stored)
            back = pixels.tobytes()
            small = npy_bytes(np.round(area_resize(pixels, tile, tile)).astype(np.uint8))
            sha = [hashlib.sha256(x).hexdigest() for x in (back, stored, small)]
            rows.append((n, len(back), sha[0], zlib.crc32(back[-32:]), len(stored), sha[1], difference_hash(pixels), sha[2]))
        return columns(rows, [part.split()[0] for part in STORED.split(", ")])

    picked = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return map_columns(picked, compute, STORED, ("doc_id",))


def texts_as_media(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): the stored images themselves, for `media_features` or a sink."""
    picked = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    return map_columns(picked, lambda cols: {"media": [text_as_image(text_payload(t)[0]) for t in cols["text"]]}, "media binary", ("doc_id",))
