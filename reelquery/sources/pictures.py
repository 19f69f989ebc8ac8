"""Pictures of files as arrays of rows, columns and blue, green, red, and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: Values of a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """The rows of a PNG, each of which may be told by its difference from the one above or from itself, step bytes to the left."""
    rows = np.frombuffer(raw, np.uint8)[: h * (stride + 1)].reshape(h, stride + 1)
    out = np.zeros((h + 1, stride), np.uint8)
    for y in range(h):
        kind, row, above = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 1:
            lanes = np.zeros(-(-stride // step) * step, np.uint8)
            lanes[:stride] = row
            out[y + 1] = np.add.accumulate(lanes.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = row + above
        else:
            now = bytearray(row.tobytes())
            up = above.tobytes()
            for i in range(stride):
                left, high, corner = (now[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (left + high) // 2
                else:
                    p = left + high - corner
                    a, b, c = abs(p - left), abs(p - high), abs(p - corner)
                    guess = left if a <= b and a <= c else high if b <= c else corner
                now[i] = (now[i] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(now), np.uint8)
    return out[1:]


def _png(data: bytes) -> np.ndarray:
    at, parts, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if interlaced:
        raise ValueError("interlaced PNG")
    channels = CHANNELS[colour]
    stride = -(-w * channels * depth // 8)
    rows = _unfiltered(zlib.decompress(b"".join(parts)), h, stride, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth)
        rows = bits @ (1 << np.arange(depth - 1, -1, -1))
        rows = (rows * (255 // ((1 << depth) - 1)) if colour == 0 else rows).astype(np.uint8)
    pixels = rows.reshape(h, w, channels)
    if colour == 3:
        return palette[pixels[:, :, 0]][:, :, ::-1]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, 2::-1]


def _bmp(data: bytes) -> np.ndarray:
    begin = struct.unpack("<I", data[10:14])[0]
    head, w, h, _, depth, packed = struct.unpack("<IiiHHI", data[14:34])
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError(f"BMP of {depth} bits, compression {packed}")
    stride = -(-w * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), begin).reshape(abs(h), stride)[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
    if depth == 8:
        palette = np.frombuffer(data, np.uint8, begin - 14 - head, 14 + head).reshape(-1, 4)
        rows = palette[rows[:, :, 0]]
    return rows[::-1, :, :3] if h > 0 else rows[:, :, :3]


def decoded(data: bytes) -> np.ndarray:
    """Rows, columns and blue, green, red of the bytes of a PNG or BMP; of other kinds where the imaging library is installed. Transparency goes. Raises ValueError for what is no picture."""
    try:
        if data[:8] == PNG:
            return np.ascontiguousarray(_png(data))
        if data[:2] == b"BM":
            return np.ascontiguousarray(_bmp(data))
    except (struct.error, zlib.error, KeyError, IndexError, TypeError, UnboundLocalError) as e:
        raise ValueError("broken picture") from e
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("only PNG and BMP can be read without an imaging library") from None
    import io

    return np.ascontiguousarray(np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))[:, :, ::-1])


def encoded(pixels: np.ndarray) -> bytes:
    """A PNG of rows and columns of grey, or of blue, green, red."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = np.zeros((h, 1 + w * (1 if grey else 3)), np.uint8)
    rows[:, 1:] = pixels if grey else pixels[:, :, ::-1].reshape(h, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
