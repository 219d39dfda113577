import hashlib
import struct
import zlib

import numpy as np
import pytest

from quern.llm import media


def plain_payload(avi):
    """Bit by bit: Huffman code, size, magnitude, as a plain JPEG decoder reads it."""
    out = b""
    for jpeg in media.frames_of(avi)[1]:
        at = jpeg.index(b"\xff\xda")
        data = jpeg[at + 2 + struct.unpack(">H", jpeg[at + 2 : at + 4])[0] :]
        bits, i, segments = [], 0, []
        while True:
            if data[i] == 0xFF and data[i + 1] == 0:
                bits.append(0xFF)
                i += 2
            elif data[i] == 0xFF:
                segments.append(bits)
                bits = []
                if data[i + 1] == 0xD9:
                    break
                assert data[i + 1] == 0xD0 + (len(segments) - 1) % 8
                i += 2
            else:
                bits.append(data[i])
                i += 1
        for seg in segments:
            s = "".join(f"{b:08b}" for b in seg)
            assert len(s) == 576
            for k in range(64):
                assert s[9 * k] == "0"  # the code of size 8
                v = int(s[9 * k + 1 : 9 * k + 9], 2)
                value = v if v >= 128 else v - 255
                out += bytes([value if value > 0 else value + 255])
    return out


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 30001])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for raw in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"\xff" * n, b"\x00" * n):
        payload = media.padded(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == raw
        avi = media.encode(payload)
        assert media.clips_of(avi)[0] == payload
        if n < 5000:
            assert plain_payload(avi) == payload


def test_zigzag_and_shots():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG.tolist()) == list(range(64))
    scene = [bytes([b]) * 4096 for b in (10, 10, 10, 200, 200, 200, 200, 90, 90)]
    _, clips = media.clips_of(media.encode(b"".join(scene)))
    assert [(c["first_frame"], c["last_frame"], c["start_ms"], c["end_ms"]) for c in clips] == [(0, 2, 0, 120), (3, 6, 120, 280), (7, 8, 280, 360)]


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(9001, None), (9002, ""), (None, "x"), (9003, "é" * 70000), (9002, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as media", "2 as n_bytes")
    stored = media.to_media(df)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read_media(stored).collect()), key=str)
    want = []
    for d, t in docs:
        raw = (t or "").encode()
        p = media.padded(raw)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=str)
    assert media.clip_rows(stored).columns == ["doc_id", "clip", "first_frame", "last_frame", "start_ms", "end_ms", "level"]
    assert media.read_media(media.to_media(df.limit(0))).count() == 0


def test_the_bit_reader_gives_what_the_fast_case_gives():
    rng = np.random.default_rng(1)
    for n in (1, 64, 4096, 9000):
        avi = media.encode(media.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes()))
        _, blocks, counts = media.decode(avi)
        frames = [media.decode_frame(f) for f in media.frames_of(avi)[1]]
        assert np.array_equal(np.concatenate([media.payload_of(f) for f in frames]), blocks)
        assert np.allclose([media.frame_histogram(f) for f in frames], media.histograms(blocks, counts), atol=2e-3)
        assert [(c["first_frame"], c["last_frame"]) for c in media.clips_of_frames(avi)] == [(c["first_frame"], c["last_frame"]) for c in media.clips_of(avi)[1]]


def plain_jpeg(planes, sampling, quant, wide, high, interval):
    """A baseline JPEG with 8-bit AC and 5-bit DC codes of its own; planes: (rows, columns, 64) coefficients of each component."""
    across, down = max(s[0] for s in sampling), max(s[1] for s in sampling)
    ac = sorted({r << 4 | s for r in range(16) for s in range(1, 11)} | {0, 0xF0})
    bits, out, units = "", b"", planes[0].shape[1] // sampling[0][0] * (planes[0].shape[0] // sampling[0][1])

    def value(v):
        size = int(abs(v)).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    def flush(last, k):
        raw = bytes(int((bits + "1" * (-len(bits) % 8))[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        return raw + (b"\xff\xd9" if last else bytes([0xFF, 0xD0 + k % 8]))

    before = [0] * len(planes)
    for u in range(units):
        row, column = divmod(u, planes[0].shape[1] // sampling[0][0])
        for c, (plane, (a, d)) in enumerate(zip(planes, sampling)):
            for i in range(a * d):
                b = plane[row * d + i // a, column * a + i % a].tolist()
                size, tail = value(b[0] - before[c])
                before[c] = b[0]
                bits += f"{size:05b}" + tail
                run, left = 0, 63 - max((k for k in range(1, 64) if b[k]), default=0)
                for k in range(1, 64 - left):
                    if not b[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits += f"{ac.index(0xF0):08b}"
                        run -= 16
                    size, tail = value(b[k])
                    bits += f"{ac.index(run << 4 | size):08b}" + tail
                    run = 0
                if left:
                    bits += f"{ac.index(0):08b}"
        if interval and (u + 1) % interval == 0 and u + 1 < units:
            out += flush(False, u // interval)
            bits, before = "", [0] * len(planes)
    out += flush(True, 0)
    seg = media._segment
    head = b"\xff\xd8" + b"".join(seg(0xDB, bytes([k]) + q.astype(np.uint8).tobytes()) for k, q in enumerate(quant))
    head += seg(0xC0, struct.pack(">BHHB", 8, high, wide, len(planes)) + b"".join(bytes([c + 1, a << 4 | d, min(c, len(quant) - 1)]) for c, (a, d) in enumerate(sampling)))
    head += seg(0xC4, b"\x01" + bytes([0] * 4 + [12] + [0] * 11) + bytes(range(12)) + b"\x12" + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac))
    if interval:
        head += seg(0xDD, struct.pack(">H", interval))
    return head + seg(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0x12]) for c in range(len(planes))) + b"\x00\x3f\x00") + out


@pytest.mark.parametrize("sampling, interval", [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 2), ([(2, 1), (1, 1), (1, 1)], 0)])
def test_frames_with_other_tables_sampling_and_intervals(sampling, interval):
    rng = np.random.default_rng(9)
    planes = []
    for a, d in sampling:
        p = rng.integers(-40, 40, (3 * d, 4 * a, 64)) * (rng.random((3 * d, 4 * a, 64)) < 0.2)
        p[:, :, 0] = rng.integers(-300, 300, p.shape[:2])
        planes.append(p)
    quant = [rng.integers(1, 20, 64), rng.integers(1, 20, 64)][: len(planes)]
    wide, high = 8 * 4 * sampling[0][0] - 3, 8 * 3 * sampling[0][1] - 5
    jpeg = plain_jpeg(planes, sampling, quant, wide, high, interval)
    w, h, parts = media.decode_frame(jpeg)
    assert (w, h) == (wide, high) and all(np.array_equal(p.blocks, q) for p, q in zip(parts, planes))
    # samples against the defining sum of the inverse transform
    got = media.luma((w, h, parts))
    assert got.shape == (high, wide)
    y, x = 9, 13
    f = np.zeros(64)
    f[media.ZIGZAG] = planes[0][1, 1] * quant[0]
    c = lambda k: np.sqrt((1 if k == 0 else 2) / 8)
    want = sum(c(u) * c(v) * f[8 * v + u] * np.cos((2 * (x - 8) + 1) * u * np.pi / 16) * np.cos((2 * (y - 8) + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    assert got[y, x] == pytest.approx(want + 128, abs=0.05)
    for broken in (jpeg[: len(jpeg) // 2], jpeg[:-2], b"", b"\xff\xd8\xff\xc2\x00\x04\x00\x00"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.decode_frame(broken)
