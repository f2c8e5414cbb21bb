"""Pixels as files: PNG, PPM and BMP. Pixels are (height, width, 4) arrays of red, green, blue, alpha."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def over_white(pixels: np.ndarray) -> np.ndarray:
    """Red, green and blue of the pixels on a white page."""
    alpha = pixels[..., 3:].astype(np.uint32)
    return ((pixels[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """Each row by the filter (none, left, up) whose differences are smallest."""
    height, width = pixels.shape[:2]
    rows = pixels.reshape(height, width * 4)
    left, up = rows.copy(), rows.copy()
    left[:, 4:] -= rows[:, :-4]
    up[1:] -= rows[:-1]
    options = np.stack([rows, left, up])
    cost = np.abs(options.astype(np.int8).astype(np.int32)).sum(axis=2)
    best = cost.argmin(axis=0)
    body = np.concatenate([best[:, None].astype(np.uint8), options[best, np.arange(height)]], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit RGB or RGBA PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("only 8-bit true colour is read")
    width, height, channels = head[0], head[1], 3 if head[3] == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        kind, row = int(raw[y, 0]), raw[y, 1:]
        above = out[y - 1] if y else np.zeros(width * channels, np.uint8)
        if kind == 0:
            out[y] = row
        elif kind == 2:
            out[y] = row + above
        elif kind == 1:
            out[y] = np.cumsum(row.reshape(width, channels), axis=0, dtype=np.uint8).ravel()
        else:
            for x in range(width * channels):
                a, b, c = (int(out[y, x - channels]) if x >= channels else 0), int(above[x]), (int(above[x - channels]) if x >= channels else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, x] = (int(row[x]) + guess) & 255
    pixels = out.reshape(height, width, channels)
    return pixels if channels == 4 else np.concatenate([pixels, np.full((height, width, 1), 255, np.uint8)], axis=2)


def to_ppm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return f"P6\n{width} {height}\n255\n".encode() + over_white(pixels).tobytes()


def to_bmp(pixels: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom, each padded to four bytes."""
    height, width = pixels.shape[:2]
    stride = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = over_white(pixels)[::-1, :, ::-1].reshape(height, 3 * width)
    size = 54 + stride * height
    return struct.pack("<2sIHHI", b"BM", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, stride * height, 2835, 2835, 0, 0) + rows.tobytes()
