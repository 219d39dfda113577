"""Media columns: AVI motion-JPEG that carries a payload without loss.

A payload (bytes, zero-padded to a positive multiple of 64) becomes grey 8x8 blocks of a baseline JPEG: byte k of a block is its
k-th quantised coefficient in zigzag order, the format's unit. Every coefficient has size category 8 (values -255 to -128 and
128 to 255), which the one-symbol Huffman tables here write as one 0 bit and the byte itself, so a block is 72 bytes
before stuffing; each block is one restart interval, so the DC prediction is 0. Frames of 64 blocks (64 x 64
pixels; the last frame one block high with what is left, which its own header says and the stream header doesn't) go into a RIFF AVI
with header lists, a movi list and an idx1 index.

Reading back parses the RIFF tree and the index and decodes each intra frame with the frame's own quantisation and Huffman tables,
components, sampling and restart intervals (``decode_frame``, baseline sequential; progressive frames are refused). Frames in the layout above
skip the bit reader: their coefficients are bytes at fixed places, a fast case with the same result. Then it takes the inverse DCT,
compares the luma histograms of neighbouring frames and cuts a shot where the difference passes an adaptive threshold (mean and
deviation of the differences before). Shots are clips with times.

Edge cases: null and empty texts give a payload of 64 zero bytes; equal texts give equal bytes; texts of any length
are handled frame by frame; repeated rows give repeated rows; an empty table gives an empty result; other columns are kept by
to_media and ignored by the queries.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, text_slices, widened

SIDE = 64
FRAME_BLOCKS = (SIDE // 8) ** 2
FPS = 25
BINS = 16
#: A cut needs a histogram difference (0 to 2) over mean + SPREAD deviations of the last WINDOW ones, and over LEAST.
WINDOW, SPREAD, LEAST = 8, 3.0, 0.12


def _zigzag() -> np.ndarray:
    """Row-major place of the k-th zigzag coefficient: along antidiagonals, turning at each."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
_DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
_DCT = _DCT.astype(np.float32)


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 if raw else 64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(blocks: int) -> bytes:
    """JPEG markers up to the scan data of a frame with so many blocks."""
    wide, high = (SIDE, SIDE) if blocks == FRAME_BLOCKS else (8 * blocks, 8)
    one = bytes([1] + [0] * 15)
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([1]) * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, high, wide, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + one + b"\x08")
        + _segment(0xC4, b"\x10" + one + b"\x08")
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


_HEADS = [b"", *map(_head, range(1, FRAME_BLOCKS + 1))]


def _scans(payload: bytes) -> list[tuple[int, bytes]]:
    """(blocks, scan data with EOI) of each frame."""
    b = np.frombuffer(payload, np.uint8).reshape(-1, 8, 8)
    n = len(b)
    row = np.empty((n, 74), np.uint8)
    g = np.zeros((n, 8, 9), np.uint8)
    for j in range(9):
        if j:
            g[:, :, j] |= b[:, :, j - 1] << np.uint8(8 - j) if j < 8 else b[:, :, 7]
        if j < 8:
            g[:, :, j] |= b[:, :, j] >> np.uint8(j + 1) if j < 7 else np.uint8(0)
    row[:, :72] = g.reshape(n, 72)
    row[:, 72] = 0xFF
    inside = np.arange(n) % FRAME_BLOCKS
    row[:, 73] = 0xD0 + inside % 8
    row[FRAME_BLOCKS - 1 :: FRAME_BLOCKS, 73] = 0xD9
    row[-1, 73] = 0xD9
    full = row == 0xFF
    full[:, 72] = False
    extra = full.sum(axis=1)
    flat, twice = row.ravel(), full.ravel()
    if extra.any():
        out = np.repeat(flat, 1 + twice)
        at = np.flatnonzero(twice)
        out[at + np.arange(1, len(at) + 1)] = 0
    else:
        out = flat
    ends = np.concatenate([[0], np.cumsum(74 + extra)])
    whole = out.tobytes()
    return [(min(FRAME_BLOCKS, n - k), whole[ends[k] : ends[min(n, k + FRAME_BLOCKS)]]) for k in range(0, n, FRAME_BLOCKS)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def encode(payload: bytes) -> bytes:
    """AVI bytes of a padded payload."""
    frames = [_HEADS[n] + scan for n, scan in _scans(payload)]
    most = max(map(len, frames))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a chunk runs past its list")
        yield kind, at + 8, at + 8 + size
        at += 8 + size + size % 2


def frames_of(avi: bytes) -> tuple[float, list[bytes]]:
    """Seconds a frame, and the JPEG bytes of every frame that the index lists."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("no AVI")
    second, movi, index = 1 / FPS, None, None
    for kind, a, z in _chunks(avi, 12, 8 + struct.unpack_from("<I", avi, 4)[0]):
        if kind == b"LIST" and avi[a : a + 4] == b"hdrl":
            for k, x, _ in _chunks(avi, a + 4, z):
                if k == b"avih":
                    second = struct.unpack_from("<I", avi, x)[0] / 1e6
        elif kind == b"LIST" and avi[a : a + 4] == b"movi":
            movi = a
        elif kind == b"idx1":
            index = (a, z)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    out = []
    for at in range(index[0], index[1], 16):
        kind, _, offset, size = struct.unpack_from("<4sIII", avi, at)
        if avi[movi + offset : movi + offset + 4] != kind:
            raise ValueError("the index points to no chunk")
        out.append(avi[movi + offset + 8 : movi + offset + 8 + size])
    return second, out


@dataclass
class Component:
    """One component of a decoded frame: quantised coefficients in zigzag order, in raster order of its blocks."""

    wide: int  # blocks in a row, with padding to whole units
    across: int  # sampling factors
    down: int
    quant: np.ndarray  # 64 divisors, zigzag order
    blocks: np.ndarray  # (rows of blocks, wide, 64)


def _codes(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Of every 16-bit prefix: the length of the Huffman code in front (0: none) and its symbol."""
    lengths, values, code, at = [0] * 65536, [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            first, span = code << (16 - length), 1 << (16 - length)
            lengths[first : first + span] = [length] * span
            values[first : first + span] = [symbol] * span
            code += 1
        at += n
        code <<= 1
    return lengths, values


class _Bits:
    """Reader of one restart interval without stuffing."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.held, self.n = raw, 0, 0, 0

    def peek16(self) -> int:
        while self.n < 16:
            self.held = self.held << 8 | (self.raw[self.at] if self.at < len(self.raw) else 0xFF)
            self.at += 1
            self.n += 8
        return self.held >> (self.n - 16) & 0xFFFF

    def skip(self, k: int) -> None:
        self.n -= k
        self.held &= (1 << self.n) - 1
        if self.at - self.n // 8 > len(self.raw):
            raise ValueError("scan data ends early")

    def symbol(self, codes: tuple[list[int], list[int]]) -> int:
        p = self.peek16()
        if not codes[0][p]:
            raise ValueError("no such Huffman code")
        self.skip(codes[0][p])
        return codes[1][p]

    def signed(self, size: int) -> int:
        """A value of a size category."""
        if not size:
            return 0
        v = self.peek16() >> (16 - size)
        self.skip(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def decode_frame(jpeg: bytes) -> tuple[int, int, list[Component]]:
    """(width, height, components) of a baseline JPEG, with whatever tables it carries."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, interval, wide, high = 2, 0, 0, 0
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, tuple[list[int], list[int]]] = {}
    parts: dict[int, list] = {}
    while True:
        if jpeg[at] != 0xFF or at + 4 > len(jpeg):
            raise ValueError("no marker")
        mark = jpeg[at + 1]
        if mark == 0xFF:  # fill byte
            at += 1
            continue
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide_values = body[k] >> 4
                n = 128 if wide_values else 64
                quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide_values else np.uint8).astype(np.int64)
                k += 1 + n
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                codes[body[k]] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif mark in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            high, wide = struct.unpack_from(">HH", body, 1)
            parts = {body[k]: [body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]] for k in range(6, 6 + 3 * body[5], 3)}
        elif 0xC2 <= mark <= 0xCF and mark != 0xCC:
            raise ValueError("no baseline frame")
        elif mark == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            if body[0] != len(parts):
                raise ValueError("one interleaved scan only")
            tables = {body[k]: (codes[body[k + 1] >> 4], codes[16 + (body[k + 1] & 15)]) for k in range(1, 1 + 2 * body[0], 2)}
            break
    # restart intervals: up to a marker other than stuffing
    chunks, begin, k = [], at, at
    while True:
        k = jpeg.find(b"\xff", k)
        if k < 0 or k + 1 >= len(jpeg):
            raise ValueError("no end of image")
        if jpeg[k + 1] == 0:
            k += 2
        elif 0xD0 <= jpeg[k + 1] <= 0xD7:
            chunks.append(jpeg[begin:k])
            begin = k = k + 2
        else:
            chunks.append(jpeg[begin:k])
            break
    most_across, most_down = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    if len(parts) == 1:  # the units of a single component are its blocks
        most_across = most_down = 1
        for p in parts.values():
            p[:2] = 1, 1
    units_wide, units_high = -(-wide // (8 * most_across)), -(-high // (8 * most_down))
    units = units_wide * units_high
    planes = {c: np.zeros((units_high * p[1], units_wide * p[0], 64), np.int64) for c, p in parts.items()}
    unit = 0
    for raw in chunks:
        bits, before = _Bits(raw.replace(b"\xff\0", b"\xff")), dict.fromkeys(parts, 0)
        for unit in range(unit, min(units, unit + (interval or units))):
            row, column = divmod(unit, units_wide)
            for c, (across, down, _) in parts.items():
                dc, ac = tables[c]
                for i in range(across * down):
                    block = planes[c][row * down + i // across, column * across + i % across]
                    before[c] += bits.signed(bits.symbol(dc))
                    block[0] = before[c]
                    k = 1
                    while k < 64:
                        run, size = divmod(bits.symbol(ac), 16)
                        if not size and run != 15:  # end of block
                            break
                        k += run
                        if size:
                            if k > 63:
                                raise ValueError("a run past its block")
                            block[k] = bits.signed(size)
                        k += 1
        unit += 1
    if unit < units:
        raise ValueError("blocks are missing")
    return wide, high, [Component(planes[c].shape[1], p[0], p[1], quant[p[2]], planes[c]) for c, p in parts.items()]


def luma(frame: tuple[int, int, list[Component]]) -> np.ndarray:
    """(height, width) samples of the first component before clamping."""
    wide, high, parts = frame
    p = parts[0]
    coefficient = np.zeros((*p.blocks.shape[:2], 64), np.float32)
    coefficient[:, :, ZIGZAG] = p.blocks * p.quant
    out = _DCT.T @ coefficient.reshape(*p.blocks.shape[:2], 8, 8) @ _DCT + 128
    return out.transpose(0, 2, 1, 3).reshape(8 * p.blocks.shape[0], -1)[:high, :wide]


def _packed(jpeg: bytes) -> int:
    """Blocks of a frame whose head is the one written here, else 0."""
    at = jpeg.find(b"\xff\xda")
    if at < 0 or len(jpeg) < at + 10 or jpeg[-2:] != b"\xff\xd9":
        return 0
    high, wide = struct.unpack_from(">HH", jpeg, _SIZE_AT) if len(jpeg) > _SIZE_AT + 4 else (0, 0)
    n = (high // 8) * (wide // 8)
    return n if n <= FRAME_BLOCKS and jpeg.startswith(_HEADS[n]) else 0


#: Where a head written here has its height and width.
_SIZE_AT = _HEADS[1].index(b"\xff\xc0") + 5


def payload_of(frame: tuple[int, int, list[Component]]) -> np.ndarray:
    """(blocks, 64) payload bytes of a frame: coefficients of size category 8 as the bytes they stand for."""
    v = frame[2][0].blocks.reshape(-1, 64)
    if (np.abs(v) < 128).any() or (np.abs(v) > 255).any():
        raise ValueError("the frame carries no payload")
    return np.where(v < 0, v + 255, v).astype(np.uint8)


def decode(avi: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    """Seconds a frame, payload bytes as (blocks, 64), and the blocks of each frame."""
    second, frames = frames_of(avi)
    counts = np.array([_packed(f) for f in frames])
    if not counts.all():
        blocks = [payload_of(decode_frame(f)) for f in frames]
        return second, np.concatenate(blocks), np.array(list(map(len, blocks)))
    flat = np.frombuffer(b"".join([f[len(_HEADS[n]) :] for f, n in zip(frames, counts.tolist())]), np.uint8)
    stuffed = np.flatnonzero((flat[1:] == 0) & (flat[:-1] == 0xFF)) + 1
    if len(stuffed):
        keep = np.ones(len(flat), bool)
        keep[stuffed] = False
        flat = flat[keep]
    if len(flat) != 74 * counts.sum():
        raise ValueError("broken scan data")
    row = flat.reshape(-1, 74)
    ends = np.cumsum(counts) - 1
    if (row[:, 72] != 0xFF).any() or (row[ends, 73] != 0xD9).any():
        raise ValueError("broken scan data")
    g = row[:, :72].reshape(-1, 8, 9)
    b = np.empty((len(g), 8, 8), np.uint8)
    for k in range(8):
        b[:, :, k] = (g[:, :, k] << np.uint8(k + 1) if k < 7 else np.uint8(0)) | g[:, :, k + 1] >> np.uint8(7 - k)
    return second, b.reshape(-1, 64), counts


def histograms(blocks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Luma histogram (shares of BINS) of each frame, from the inverse DCT of its coefficients before clamping."""
    out = np.zeros((len(counts), BINS))
    frame = np.repeat(np.arange(len(counts)), counts)
    for lo in range(0, len(blocks), 8192):
        part = blocks[lo : lo + 8192].astype(np.float32)
        coefficient = np.empty((len(part), 64), np.float32)
        coefficient[:, ZIGZAG] = np.where(part < 128, part - 255, part)
        luma = _DCT.T @ coefficient.reshape(-1, 8, 8) @ _DCT + 128
        level = np.clip((luma.reshape(len(part), 64) + 384) / (1024 / BINS), 0, BINS - 1).astype(np.int64)
        level += frame[lo : lo + 8192, None] * BINS
        out += np.bincount(level.ravel(), minlength=out.size).reshape(out.shape)
    return out / (64 * counts)[:, None]


def frame_histogram(frame: tuple[int, int, list[Component]]) -> np.ndarray:
    """Luma histogram of any decoded frame, on the scale of histograms()."""
    level = np.clip((luma(frame) + 384) / (1024 / BINS), 0, BINS - 1).astype(np.int64)
    return np.bincount(level.ravel(), minlength=BINS) / level.size


def clips_of_frames(avi: bytes) -> list[dict]:
    """Clips of any motion-JPEG AVI with baseline frames, payload or none."""
    second, frames = frames_of(avi)
    return _clips(np.array([frame_histogram(decode_frame(f)) for f in frames]), second)


def _clips(hist: np.ndarray, second: float) -> list[dict]:
    level = hist @ np.arange(BINS)
    return [{"first_frame": a, "last_frame": z, "start_ms": round(a * second * 1000), "end_ms": round((z + 1) * second * 1000), "level": round(float(level[a : z + 1].mean()), 3)} for a, z in shots(hist)]


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] frames of each shot: a cut where the histogram difference passes the adaptive threshold."""
    cuts, diffs = [0], np.abs(np.diff(hist, axis=0)).sum(axis=1)
    for i, d in enumerate(diffs.tolist()):
        before = diffs[max(0, i - WINDOW) : i]
        bar = max(LEAST, float(before.mean() + SPREAD * before.std())) if len(before) else 2 * LEAST
        if d > bar:
            cuts.append(i + 1)
    return [(a, z - 1) for a, z in zip(cuts, [*cuts[1:], len(hist)])]


def clips_of(avi: bytes) -> tuple[bytes, list[dict]]:
    """The payload read back, and the clips: frames, times in milliseconds, mean luma level of the clip."""
    second, blocks, counts = decode(avi)
    return blocks.tobytes(), _clips(histograms(blocks, counts), second)


def to_media(docs: DataFrame) -> DataFrame:
    """docs with n_bytes (of the text) and media (AVI bytes of its payload), which replace columns of these names."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    at = names.index("text")
    src = docs.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_slices(b.column(at)):
                part = b.slice(lo, hi - lo)
                raws = raw_texts(part.column(at))
                cols = [*part.columns, pa.array([len(r) for r in raws], pa.int64()), pa.array([encode(padded(r)) for r in raws], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*inner, "_n", "_m"])

    out = src.mapInArrow(run, widened(src.schema, "_n long, _m binary"))
    kept = [F.col(i).alias(n) for i, n in zip(inner, names) if n not in ("n_bytes", "media")]
    return out.select(*kept, F.col("_n").alias("n_bytes"), F.col("_m").alias("media"))


CLIPS = "array<struct<first_frame:int,last_frame:int,start_ms:int,end_ms:int,level:double>>"


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, clips) from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for avi in b.column("media"):
                raw = avi.as_py()
                payload, clips = clips_of(raw)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), clips))
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            kind = pa.list_(pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int32()), ("end_ms", pa.int32()), ("level", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols, pa.array([r[5] for r in rows], kind)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
    src = media.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media")
    return src.mapInArrow(run, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIPS}")


def clip_rows(media: DataFrame) -> DataFrame:
    """One row a clip: doc_id, clip (from 0), frames, times and level."""
    return read_media(media).select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
