"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers.

Companded samples are expanded by lookup tables; ADPCM is decoded with numpy
across blocks (all blocks of many rows advance together, one sample position at
a time). The PCM is resampled and stored in pieces, so that the work's memory is
bounded whatever a row's length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bare, slices, texts_of, tidy_task

RATE = 8000

# Fixed values of the IMA ADPCM format: index changes and step sizes.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
IMA_STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    chord, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(chord == 0, low + 8, (low + 0x108) << np.maximum(chord - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
#: name: (WAV format tag, expansion table)
LAWS = {"mulaw": (7, MULAW), "alaw": (6, ALAW)}


#: Format tag of IMA ADPCM, and the bytes of its blocks here.
ADPCM, BLOCK = 17, 64
#: Bytes that are decoded at a time.
PIECE = 256 << 10


def pack_wav(data: bytes, codec: str = "mulaw", rate: int = RATE, block: int = BLOCK) -> bytes:
    """One channel of 8-bit companded samples, or of ADPCM blocks, as a WAV file."""
    if codec == "adpcm":
        per = (block - 4) * 2 + 1
        head, samples = struct.pack("<HHIIHHHH", ADPCM, 1, rate, rate * block // per, block, 4, 2, per), len(data) // block * per
    else:
        head, samples = struct.pack("<HHIIHHH", LAWS[codec][0], 1, rate, rate, 1, 8, 0), len(data)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unpack_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, data) of a WAV file; raises ValueError on damage."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + n > len(media):
            raise ValueError("a chunk is cut off")
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if head is None or head[1] != 1:
                raise ValueError("no format, or more than one channel")
            return head[0], head[2], head[4], media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def expand(samples: bytes | np.ndarray, law: str) -> np.ndarray:
    """16-bit PCM of companded bytes."""
    return LAWS[law][1][np.frombuffer(samples, dtype=np.uint8)]


def compress(pcm: np.ndarray, law: str) -> bytes:
    """The nearest companded byte of each sample (ties: the smaller code)."""
    table = LAWS[law][1].astype(np.int32)
    order = np.lexsort((np.arange(256), table))
    level = table[order]
    at = np.clip(np.searchsorted(level, pcm), 1, 255)
    low, high = level[at - 1], level[at]
    pick = np.where(pcm - low <= high - pcm, at - 1, at)
    return order[pick].astype(np.uint8).tobytes()


def adpcm_decode(data: bytes, block: int) -> np.ndarray:
    """PCM of one-channel IMA ADPCM; every block of ``block`` bytes is a lane.

    A last block that is shorter is decoded as far as it goes.
    """
    full, rest = divmod(len(data), block)
    parts = [_lanes(np.frombuffer(data, dtype=np.uint8, count=full * block).reshape(full, block))] if full else []
    if rest >= 4:
        parts.append(_lanes(np.frombuffer(data, dtype=np.uint8, offset=full * block).reshape(1, rest)))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int16)


def _lanes(blocks: np.ndarray) -> np.ndarray:
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value = np.where(value >= 32768, value - 65536, value)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1)
    out = np.empty((len(blocks), codes.shape[1] + 1), dtype=np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        c, step = codes[:, k].astype(np.int32), IMA_STEP[index]
        d = (step >> 3) + np.where(c & 1, step >> 2, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 4, step, 0)
        value = np.clip(np.where(c & 8, value - d, value + d), -32768, 32767)
        index = np.clip(index + IMA_INDEX[c], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def adpcm_encode(pcm: np.ndarray, block: int = 256) -> bytes:
    """One-channel IMA ADPCM; all blocks advance together. The tail is padded with its last sample."""
    per = (block - 4) * 2 + 1
    n = max(1, -(-len(pcm) // per))
    x = np.full(n * per, pcm[-1] if len(pcm) else 0, dtype=np.int32)
    x[: len(pcm)] = pcm
    x = x.reshape(n, per)
    value = x[:, 0].copy()
    index = np.searchsorted(IMA_STEP[:-1], np.abs(x[:, 1] - x[:, 0])).astype(np.int32)
    start = index.copy()
    codes = np.empty((n, per - 1), dtype=np.uint8)
    for k in range(1, per):
        step, diff = IMA_STEP[index], x[:, k] - value
        left, c, d = np.abs(diff), np.where(diff < 0, 8, 0), step >> 3
        for bit, s in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= s
            c, left, d = c | np.where(hit, bit, 0), left - np.where(hit, s, 0), d + np.where(hit, s, 0)
        value = np.clip(np.where(c & 8, value - d, value + d), -32768, 32767)
        index = np.clip(index + IMA_INDEX[c], 0, 88)
        codes[:, k - 1] = c
    out = np.zeros((n, block), dtype=np.uint8)
    out[:, 0], out[:, 1] = x[:, 0] & 255, x[:, 0] >> 8 & 255
    out[:, 2] = start
    out[:, 4:] = codes[:, 0::2] | codes[:, 1::2] << 4
    return out.tobytes()


@dataclass(frozen=True)
class Format:
    """What a WAV file's data are: a tag and, for ADPCM, the bytes of a block."""

    tag: int
    block: int

    @property
    def unit(self) -> int:
        return self.block if self.tag == ADPCM else 2 if self.tag == 1 else 1

    @property
    def per_unit(self) -> int:
        return (self.block - 4) * 2 + 1 if self.tag == ADPCM else 1

    def pcm(self, data: bytes) -> np.ndarray:
        """16-bit PCM of whole units."""
        if self.tag == ADPCM:
            return adpcm_decode(data, self.block)
        if self.tag == 1:
            return np.frombuffer(data, dtype="<i2")
        return expand(data, next(law for law, (tag, _) in LAWS.items() if tag == self.tag))


def open_media(media: bytes) -> tuple[int, Format, bytes]:
    """(rate, format, data) of a mu-law, A-law, IMA ADPCM or 16-bit PCM WAV file; raises ValueError."""
    tag, rate, block, data = unpack_wav(media)
    if tag not in (1, ADPCM, *(t for t, _ in LAWS.values())) or (tag == ADPCM and block <= 4):
        raise ValueError(f"format {tag} is not known")
    return rate, Format(tag, block), data


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit PCM) of a whole file."""
    rate, form, data = open_media(media)
    return rate, form.pcm(data if form.tag == ADPCM else data[: len(data) // form.unit * form.unit])


def upsample(pcm: np.ndarray, sizes: np.ndarray, after: np.ndarray, up: int) -> np.ndarray:
    """``up`` samples for each sample of several pieces, by straight lines to the next one; ``after`` follows a piece's last."""
    right = np.empty(len(pcm), dtype=np.int32)
    right[:-1] = pcm[1:]
    ends = np.cumsum(sizes)
    right[ends[sizes > 0] - 1] = after[sizes > 0]
    left = pcm.astype(np.int32)
    return np.stack([(left * (up - k) + right * k) // up for k in range(up)], axis=1).astype("<i2").reshape(-1)


class Marks:
    """Features of a signal that comes in pieces, as integers, so that equal signals give equal values."""

    def __init__(self) -> None:
        self.samples = self.peak = self.total = self.energy = self.crossings = 0
        self.last: bool | None = None

    def add(self, samples: int, peak: int, total: int, energy: int, crossings: int, first: bool, last: bool) -> None:
        self.crossings += crossings + (self.last is not None and self.last != first)
        self.samples, self.total, self.energy = self.samples + samples, self.total + total, self.energy + energy
        self.peak, self.last = max(self.peak, peak), last

    def __str__(self) -> str:
        n = max(self.samples, 1)
        return f"samples={self.samples},peak={self.peak},mean={self.total // n},energy={self.energy // n},crossings={self.crossings}"


def _measure(wide: np.ndarray, sizes: np.ndarray) -> list[tuple]:
    """What ``Marks.add`` takes, of pieces that aren't empty."""
    begin = np.cumsum(sizes) - sizes
    x = wide.astype(np.int64)
    sign = wide >= 0
    turn = np.zeros(len(x), dtype=np.int64)
    turn[1:] = sign[1:] != sign[:-1]
    turn[begin] = 0
    sums = [np.add.reduceat(v, begin).tolist() for v in (x, x * x, turn)]
    peak = np.maximum.reduceat(np.abs(x), begin).tolist()
    return list(zip(sizes.tolist(), peak, *sums, sign[begin].tolist(), sign[begin + sizes - 1].tolist(), strict=True))


def decode_rows(media: list[bytes | None], up: int) -> list[dict]:
    """Rate, data, resampled PCM in pieces, and features of each file; damaged or null ones have only an error.

    Files of one format are decoded together, PIECE bytes at a time.
    """
    out, by_format = [], defaultdict(list)
    for i, m in enumerate(media):
        try:
            rate, form, data = open_media(m or b"")
        except ValueError as e:
            out.append({"rate": None, "data": None, "pcm": None, "feature": None, "error": str(e)})
            continue
        out.append({"rate": rate * up, "data": data, "pcm": [], "feature": Marks(), "error": None})
        by_format[form].append(i)
    for form, own in by_format.items():
        step = max(1, PIECE // form.unit) * form.unit
        held: list[tuple[int, int, int]] = []
        size = 0
        for i in own:
            whole = len(out[i]["data"]) // form.unit * form.unit
            for a in range(0, whole, step):
                held.append((i, a, min(whole, a + step)))
                size += held[-1][2] - a
                if size >= step:
                    _decode_pieces(out, form, held, up)
                    held, size = [], 0
            if whole < len(out[i]["data"]) and form.tag == ADPCM and len(out[i]["data"]) - whole >= 4:
                _decode_pieces(out, form, [*held, (i, whole, len(out[i]["data"]))], up)  # a block that is cut off comes last
                held, size = [], 0
        if held:
            _decode_pieces(out, form, held, up)
    for row in out:
        row["feature"] = None if row["feature"] is None else str(row["feature"])
    return out


def _decode_pieces(out: list[dict], form: Format, pieces: list[tuple[int, int, int]], up: int) -> None:
    data = [out[i]["data"][a:b] for i, a, b in pieces]
    pcm = form.pcm(b"".join(data))
    short = form.tag == ADPCM and len(data[-1]) % form.block
    sizes = np.array([len(d) // form.unit * form.per_unit for d in data], dtype=np.int64)
    if short:
        sizes[-1] += (short - 4) * 2 + 1
    ends = np.cumsum(sizes)
    after = pcm[ends - 1].astype(np.int32)
    for k, (i, _, b) in enumerate(pieces):
        if len(nxt := out[i]["data"][b : b + form.unit]) >= (4 if form.tag == ADPCM else form.unit):
            after[k] = form.pcm(nxt)[0]
    wide = upsample(pcm, sizes, after, up)
    for (i, _, _), marks, end, n in zip(pieces, _measure(wide, sizes * up), (ends * up).tolist(), (sizes * up).tolist(), strict=True):
        out[i]["feature"].add(*marks)
        out[i]["pcm"].append(wide[end - n : end].tobytes())


DECODED = [("rate", pa.int32(), "int"), ("pcm", pa.list_(pa.binary()), "array<binary>"), ("feature", pa.string(), "string")]


def decode_media(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", up: int = 2) -> DataFrame:
    """doc_id, rate, pcm, feature and error of a column of WAV files (mu-law, A-law, IMA ADPCM or 16-bit PCM, one channel).

    pcm is 16-bit little-endian and ``up`` times the file's rate, in pieces of
    PIECE bytes of data each; concatenated, they are the signal. A null or
    damaged file has nulls and an error. Ids may be null or repeat; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 1 << 20):
                found = decode_rows(part.column("media").to_pylist(), up)
                cells = [pa.array([r[n] for r in found], t) for n, t, _ in (*DECODED, ("error", pa.string(), ""))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cells], names=["doc_id", *(n for n, _, _ in DECODED), "error"])

    at = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{media_col}`").alias("media"))
    return at.mapInArrow(tidy_task(run), "doc_id long, " + ", ".join(f"{n} {d}" for n, _, d in DECODED) + ", error string")


STORED = [("media", pa.binary(), "binary"), *DECODED, ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long")]
CODECS = ("mulaw", "alaw", "adpcm")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codecs: tuple[str, ...] = CODECS, unit: int = BLOCK, up: int = 2) -> DataFrame:
    """Store each text as telephone audio of several formats, read it back, decode and measure it.

    The UTF-8 bytes, padded with zeros to a positive multiple of ``unit``, are
    the companded samples, or the ADPCM blocks of ``unit`` bytes, of a WAV
    file, so storing is lossless. Returns doc_id, n_bytes and, for each codec, a
    struct of its name: media (the file), rate, pcm (see ``decode_media``),
    feature, payload_bytes, payload_sha256 and tail_crc32 (of the last ``unit``
    bytes) of what is read back. A null text counts as empty; ids may be null
    or repeat; other columns are ignored. An empty table gives an empty result.
    """
    kind = pa.struct([(n, t) for n, t, _ in STORED])
    ddl = "struct<" + ", ".join(f"{n}: {d}" for n, _, d in STORED) + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = texts_of(part, "text")
                cells = [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64())]
                for codec in codecs:
                    media = [pack_wav(t + b"\0" * (-len(t) % unit if t else unit), codec, block=unit) for t in texts]
                    found = decode_rows(media, up)
                    for m, row in zip(media, found, strict=True):
                        back = row["data"]
                        row |= {"media": m, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-unit:])}
                    cells.append(pa.StructArray.from_arrays([pa.array([r[n] for r in found], t) for n, t, _ in STORED], fields=list(kind)))
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "n_bytes", *codecs])

    return bare(docs, id_col, text_col).mapInArrow(tidy_task(run), f"doc_id long, n_bytes long, {', '.join(f'{c} {ddl}' for c in codecs)}")


def pieces_sha256(pieces: Column) -> Column:
    """The digest of the digests of a signal's pieces."""
    return F.sha2(F.array_join(F.transform(pieces, lambda p: F.sha2(p, 256)), "").cast("binary"), 256)
