"""Rules for pictures. PNG and PNM files are read here; other formats need an image library."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Strengths of the enhancement.
DARK = {"brightness": 1.6, "color": 1.3, "sharpness": 1.1}
NORMAL = {"brightness": 1.15, "color": 1.2, "sharpness": 1.1}


def enhance(content: Column, dark: Column) -> Column:
    """JPEG bytes with stretched contrast, brightness, colour and sharpness; null if it can't be read. Needs Pillow."""

    @F.pandas_udf("binary")
    def run(x: pd.Series, d: pd.Series) -> pd.Series:
        import io

        from PIL import Image, ImageEnhance, ImageOps

        def one(data: bytes, is_dark: bool) -> bytes | None:
            try:
                at = ImageOps.autocontrast(Image.open(io.BytesIO(data)).convert("RGB"))
            except OSError:
                return None
            s = DARK if is_dark else NORMAL
            for kind, name in ((ImageEnhance.Brightness, "brightness"), (ImageEnhance.Color, "color"), (ImageEnhance.Sharpness, "sharpness")):
                at = kind(at).enhance(s[name])
            out = io.BytesIO()
            at.save(out, "JPEG")
            return out.getvalue()

        return pd.Series([one(a, bool(b)) for a, b in zip(x, d, strict=True)], dtype=object)

    return run(content, dark)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal 64-bit hashes."""
    return F.bit_count(F.conv(a, 16, -10).cast("bigint").bitwiseXOR(F.conv(b, 16, -10).cast("bigint")))


#: Side of the picture that is hashed, and of the square of low frequencies that the hash holds.
SIDE, LOW = 32, 8
#: Grey values of red, green and blue.
GREY = np.array([0.299, 0.587, 0.114])


def _png(data: bytes) -> np.ndarray | None:
    """Pixels (height, width, channels) of a PNG file of 8 bits without interlacing."""
    at, packed, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[6] or (head[3] == 3 and palette is None):
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    up = np.zeros(width * channels, np.int32)
    for y, row in enumerate(rows):
        kind, line = row[0], row[1:].astype(np.int32)
        if kind == 1:
            line = line.reshape(width, channels).cumsum(axis=0).reshape(-1)
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                b, c = up[x], up[x - channels] if x >= channels else 0
                near = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                line[x] = (line[x] + near) & 255
        out[y] = up = line & 255
    pixels = out.reshape(height, width, channels)
    return palette[pixels[..., 0]] if head[3] == 3 else pixels


def _pnm(data: bytes) -> np.ndarray | None:
    """Pixels of a binary PGM or PPM file of 8 bits."""
    kind, *sizes = data[:64].split(maxsplit=4)[:4]
    width, height, most = map(int, sizes)
    channels = {b"P5": 1, b"P6": 3}[kind]
    return np.frombuffer(data[len(data) - width * height * channels :], np.uint8).reshape(height, width, channels) if most == 255 else None


def grey(data: bytes | None) -> np.ndarray | None:
    """Grey values (height, width) of a picture; null if it can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = _png(data)
        elif data[:2] in (b"P5", b"P6"):
            pixels = _pnm(data)
        else:
            import io

            from PIL import Image

            pixels = np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except (ImportError, TypeError, KeyError, ValueError, OSError, IndexError, struct.error, zlib.error):
        return None
    if pixels is None or not pixels.size:
        return None
    return pixels[..., 0].astype(float) if pixels.shape[2] < 3 else pixels[..., :3] @ GREY


def _shrink(x: np.ndarray, side: int) -> np.ndarray:
    """Mean values of ``side`` equal parts of the rows; parts cut a row in proportion."""
    total = np.concatenate([np.zeros((1, x.shape[1])), x.cumsum(axis=0)])
    edge = np.linspace(0, len(x), side + 1)
    low = np.minimum(edge.astype(int), len(x) - 1)
    upto = total[low] + (edge - low)[:, None] * x[low]
    return np.diff(upto, axis=0) * side / len(x)


def picture_hash(data: bytes | None) -> str | None:
    """A 64-bit perceptual hash as 16 hexadecimal digits; null for what can't be read.

    A bit is set where one of the lowest frequencies (in both directions) of
    the shrunk grey picture is over their median.
    """
    x = grey(data)
    if x is None:
        return None
    x = _shrink(_shrink(x, SIDE).T, SIDE).T
    wave = np.cos(math.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))
    low = np.round(wave @ x @ wave.T, 6)
    return np.packbits(low > np.median(low)).tobytes().hex()


def phash(content: Column) -> Column:
    """``picture_hash`` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([picture_hash(c) for c in x], dtype=object)

    return run(content)
