"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles in NPY form, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, map_columns, pick, texts

#: An image made from a payload is 64 pixels of three 8-bit samples wide: 192 bytes a row.
WIDTH, ROW = 64, 192
TILE = 16
# ITU-R BT.601 luma weights in thousandths.
LUMA = np.array([299, 587, 114], np.int64)
#: Samples of one strip of an image that is resized.
STRIP = 1 << 20
TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


class MediaError(ValueError):
    """The bytes are no image that this module reads."""


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary PPM (P6) of an (H, W, 3) array, or PGM (P5) of an (H, W) one, of unsigned bytes."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, rows bottom-up in BGR order, of an (H, W, 3) array of unsigned bytes."""
    height, width = pixels.shape[:2]
    stride = -(-width * 3 // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    body = rows.tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode(data: bytes) -> np.ndarray:
    """(H, W, 3) or (H, W) array of a Netpbm (P1 to P6) or an uncompressed 8- or 24-bit BMP image.

    Samples are unsigned bytes, or 16-bit ones where a Netpbm maximum is over 255; other maxima than 255 and 65535 are
    scaled to those, to the nearest. Bitmaps P1 and P4
    give 0 and 255. Anything else raises MediaError, and nothing is allocated that the data can't fill.
    """
    try:
        if data[:2] == b"BM":
            return _decode_bmp(data)
        if re.match(rb"P[1-6]\s", data):
            return _decode_netpbm(data)
    except MediaError:
        raise
    except (ArithmeticError, LookupError, MemoryError, TypeError, ValueError, struct.error) as error:
        raise MediaError(str(error)) from error
    raise MediaError("neither Netpbm nor BMP")


def _number(token: bytes) -> int:
    if not token.isdigit() or len(token) > 9:
        raise MediaError("a number is wrong")
    return int(token)


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        token = TOKEN.match(data, at)
        if not token:
            raise MediaError("the header ends early")
        numbers.append(_number(token[1]))
        at = token.end()
    width, height, top = [*numbers, 1][:3]
    if not 1 <= top <= 65535:
        raise MediaError("the maximum is wrong")
    channels = 3 if kind in (3, 6) else 1
    size = width * height * channels
    per_sample = {4: 1 / 8, 5: 1 + (top > 255), 6: 1 + (top > 255)}.get(kind, 1)
    if size * per_sample > len(data):
        raise MediaError("samples are missing")
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = [c - 48 for c in body if c in b"01"] if kind == 1 else [_number(x) for x in body.split()[:size]]
        samples = np.array(values[:size], np.int64)
    elif kind == 4:
        stride = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        samples = bits[:, :width].ravel()
    else:
        samples = np.frombuffer(data, ">u2" if top > 255 else np.uint8, size, at + 1)
    if len(samples) != size:
        raise MediaError("samples are missing")
    if size and samples.max() > top:
        raise MediaError("a sample is over the maximum")
    full = 65535 if top > 255 else 255
    if kind in (1, 4):
        samples = (1 - samples.astype(np.uint8)) * np.uint8(255)
    elif top != full:
        samples = (samples.astype(np.int64) * (2 * full) + top) // (2 * top)
    samples = samples.astype(np.uint16 if top > 255 else np.uint8)
    return samples.reshape((height, width, 3) if channels == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    offset, header = struct.unpack_from("<II", data, 10)
    width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or depth not in (8, 24) or width <= 0:
        raise MediaError("only uncompressed 8- and 24-bit BMP is read")
    stride, rows = -(-width * depth // 32) * 4, abs(height)
    if offset + stride * rows > len(data):
        raise MediaError("samples are missing")
    body = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if depth == 24:
        return body[:, : width * 3].reshape(rows, width, 3)[:, :, ::-1]
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(colours, 4)[:, 2::-1]
    return palette[body[:, :width]]


def _shrink(table: np.ndarray, size: int) -> np.ndarray:
    """Means over `size` equal parts of the first axis, by a running integral that is made in strips of bounded size."""
    length = len(table)
    edges = np.linspace(0, length, size + 1)
    low = np.minimum(edges.astype(np.int64), length - 1)
    part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
    at = np.zeros((size + 1, *table.shape[1:]))
    step = max(1, STRIP // max(1, table[:1].size))
    before = np.zeros(table.shape[1:])
    for start in range(0, length, step):
        strip = table[start : start + step].astype(np.float64)
        integral = np.concatenate([before[None], before + np.cumsum(strip, 0)])
        here = (low >= start) & (low < start + step)
        at[here] = integral[low[here] - start] + part[here] * strip[low[here] - start]
        before = integral[-1]
    return np.diff(at, axis=0) * (size / length)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each new pixel covers, by an integral image; float64, any ratio in either direction."""
    return _shrink(_shrink(pixels, height).swapaxes(0, 1), width).swapaxes(0, 1)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels @ LUMA / 1000 if pixels.ndim == 3 else pixels.astype(np.float64)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 grey areas is darker than its right neighbour, on a resized 8 x 9 grid."""
    small = grey(area_resize(pixels, 8, 9))
    bits = small[:, :-1] < small[:, 1:] - 1e-9
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    sink = io.BytesIO()
    np.save(sink, array, allow_pickle=False)
    return sink.getvalue()


def tile(pixels: np.ndarray, size: int = TILE) -> bytes:
    """The image area-resized to size x size unsigned bytes, as an NPY file; 16-bit samples are brought to 8 bits."""
    full = 257 if pixels.dtype == np.uint16 else 1
    return npy(np.rint(area_resize(pixels, size, size) / full).astype(np.uint8))


def payload_image(text: str) -> tuple[int, bytes]:
    """The text's size in UTF-8 and the image that holds it: padded by blanks to whole rows, an even number of rows as PPM, else BMP."""
    data = text.encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(data) // ROW))
    pixels = np.frombuffer(data.ljust(rows * ROW, b" "), np.uint8).reshape(rows, WIDTH, 3)
    return len(data), (encode_bmp if rows % 2 else encode_ppm)(pixels)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text stored without loss as an image. Null texts are empty: one row of blanks."""
    bounded_batches(docs.sparkSession)

    def store(batch: dict[str, list]) -> Iterator[dict[str, object]]:
        made = [payload_image(t) for t in batch["text"]]
        yield {"doc_id": batch["doc_id"], "n_bytes": [n for n, _ in made], "media": [m for _, m in made]}

    return map_columns(texts(docs), "doc_id long, n_bytes long, media binary", store)


def media_features(media: DataFrame) -> DataFrame:
    """Decode a table (doc_id, n_bytes, media) and add width, height, tile_npy, dhash and digests of payload and media.

    Null or unreadable media give nulls in all that is decoded, with the reason in `error`; other rows go on.
    Equal media give equal values; repeated rows repeat theirs; no rows give none.
    """

    def read(batch: dict[str, list]) -> Iterator[dict[str, object]]:
        rows = [_features(m) for m in batch["media"]]
        out = {name: [r.get(name) for r in rows] for name in FEATURES}
        yield {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], **out}

    kinds = ", ".join(f"{name} {kind}" for name, kind in FEATURES.items())
    return map_columns(pick(media, "doc_id", "n_bytes", "media"), f"doc_id long, n_bytes long, {kinds}", read)


FEATURES = {
    "width": "int", "height": "int", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long",
    "media_bytes": "long", "media_sha256": "string", "dhash": "string", "tile_npy": "binary", "error": "string",
}


def _features(media: bytes | None) -> dict[str, object]:
    if media is None:
        return {"error": "no media"}
    out: dict[str, object] = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        pixels = decode(media)
    except MediaError as error:
        return out | {"error": str(error) or "unreadable"}
    if not pixels.size:
        return out | {"error": "the image is empty"}
    payload = np.ascontiguousarray(pixels).tobytes()
    return out | {
        "width": pixels.shape[1],
        "height": pixels.shape[0],
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]),
        "dhash": f"{difference_hash(pixels):016x}",
        "tile_npy": tile(pixels),
    }


def digest(features: DataFrame) -> DataFrame:
    """The digest columns of media_features; feature is the difference hash with a checksum of the tile."""
    return features.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", "dhash", F.lower(F.hex(F.crc32("tile_npy")))).alias("feature"),
    )
