import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from compare import SF

from stratafold.llm import gif_media as G
from stratafold.llm import queries


def lzw(pixels, bits):
    """A plain growing-table encoder, as most writers have it."""
    table = {bytes([i]): i for i in range(1 << bits)}
    clear, width, out, held, n = 1 << bits, bits + 1, bytearray(), 0, 0

    def put(code):
        nonlocal held, n
        held, n = held | code << n, n + width
        while n >= 8:
            out.append(held & 255)
            held, n = held >> 8, n - 8

    put(clear)
    following, text = clear + 2, b""
    for p in pixels:
        if text + bytes([p]) in table:
            text += bytes([p])
            continue
        put(table[text])
        table[text + bytes([p])] = following
        following += 1
        if following - 1 == 1 << width and width < 12:
            width += 1
        if following == 4095:
            put(clear)
            table, following, width = {bytes([i]): i for i in range(1 << bits)}, clear + 2, bits + 1
        text = bytes([p])
    put(table[text])
    put(clear + 1)
    if n:
        out.append(held & 255)
    return bytes(out)


def gif(frames, size=(4, 4), palette=bytes(range(12))):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | 1, 0, 0) + palette
    for left, top, w, h, pixels, disposal, clear, delay, interlaced in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear >= 0), delay, max(clear, 0), 0)
        out += struct.pack("<BHHHHB", 0x2C, left, top, w, h, 0x40 * interlaced) + b"\x02" + G._blocks(lzw(pixels, 2))
    return out + b"\x3b"


@pytest.mark.parametrize("n, bits", [(1, 2), (50, 2), (5000, 2), (60_000, 3), (90_000, 8)])
def test_lzw_of_other_writers(n, bits):
    rng = np.random.default_rng(n)
    pixels = rng.integers(0, 1 << bits, n).astype(np.uint8)
    pixels[n // 3 : n // 2] = 1
    assert G.lzw_decode(lzw(pixels.tolist(), bits), bits, n).tolist() == pixels.tolist()


def test_disposal_transparency_interlace_and_times():
    base = (0, 0, 4, 4, [1] * 16, 1, -1, 5, False)
    over = (1, 1, 2, 2, [2, 3, 3, 2], 2, 3, 7, False)
    back = (0, 0, 1, 1, [2], 3, -1, 1, False)
    rows = (0, 0, 4, 4, [0] * 4 + [2] * 4 + [1] * 4 + [3] * 4, 1, -1, 0, True)
    seen = [(f.start_ms, f.delay_ms, (f.canvas[:, :, 0] // 3).tolist()) for f in G.frames(gif([base, over, back, rows]))]
    assert [s[:2] for s in seen] == [(0, 50), (50, 70), (120, 10), (130, 0)]
    assert seen[0][2] == [[1] * 4] * 4
    assert seen[1][2] == [[1] * 4, [1, 2, 1, 1], [1, 1, 2, 1], [1] * 4]
    assert seen[2][2] == [[2, 1, 1, 1], [1, 0, 0, 1], [1, 0, 0, 1], [1] * 4]  # cleared to the background
    assert seen[3][2] == [[0] * 4, [1] * 4, [2] * 4, [3] * 4]


def plain_decode(data, bits, count):
    """Code by code, with a table of strings."""
    clear, held, n, at, out = 1 << bits, 0, 0, 0, b""
    table, width, prev = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
    while len(out) < count:
        while n < width:
            held, n, at = held | data[at] << n, n + 8, at + 1
        code, held, n = held & ((1 << width) - 1), held >> width, n - width
        if code == clear:
            table, width, prev = table[: clear + 2], bits + 1, b""
            continue
        if code == clear + 1:
            break
        text = table[code] if code < len(table) else prev + prev[:1]
        if prev and len(table) < 4096:
            table.append(prev + text[:1])
            width += len(table) == 1 << width and width < 12
        out, prev = out + text, text
    return out[:count]


@pytest.mark.parametrize("n", [1, 2, 300, 5000, 40_000])
def test_codes_of_this_writer(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"a" * n, (b"the same words again and again, " * n)[:n]):
        codes = G.lzw_encode(data)
        assert plain_decode(codes, 8, n) == data == G.lzw_decode(codes, 8, n).tobytes()
    assert n < 5000 or len(G.lzw_encode(b"a" * n)) < n / 20  # the table is used


def test_written_frames_use_palettes_disposal_and_transparency():
    lines = [(f"line {i} " * 90).encode()[:576] for i in range(3)]
    payload = b"".join(lines[i % 3] for i in range(16 * 5 + 3))
    seen = list(zip(*[(f.disposal, f.transparent, f.delay_ms) for f in G.frames(G.encode(payload))]))
    assert seen == [(1, 2, 3, 1, 2, 3), (192, 63, 192, 63, 192, 63), (100,) * 6]
    assert all(f.transparent == -1 for f in G.frames(G.encode(bytes([G.HOLE]) * 576)))
    assert len(G.encode(lines[0] * 160)) < 0.2 * len(lines[0] * 160)


def test_bad_streams():
    with pytest.raises(ValueError):
        G._expand(np.array([65, 300]), 256, 10)
    with pytest.raises(ValueError):
        G.lzw_decode(b"", 8, 1)
    with pytest.raises(ValueError):
        next(G.frames(b"PNG"))


@pytest.mark.parametrize("rows", [1, 2, 16, 17, 443])
def test_round_trip(rows):
    payload = np.random.default_rng(rows).integers(0, 256, rows * G.WIDTH, dtype=np.uint8).tobytes()
    read = io.BytesIO()
    for f in G.frames(G.encode(payload)):
        read.write(f.canvas[: f.height, :, 0].tobytes())
    assert read.getvalue() == payload


def test_digests(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd_docs.selectExpr("doc_id + 1000", "text"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = G.read_back(G.store(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = texts[r["doc_id"]]
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        gif = G.encode(padded)
        pixels = np.frombuffer(padded, np.uint8)
        bins = [np.bincount(x >> 4, minlength=16) for x in (pixels, 255 - pixels, pixels ^ 0x5A)]
        shots = -(-len(padded) // (576 * 16))
        feature = f"frames={shots};ms={100 * shots};hist=" + ",".join(str(n) for x in bins for n in x)
        assert tuple(r) == (r["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(gif), hashlib.sha256(gif).hexdigest(), feature)
    assert G.read_back(G.store(no_docs)).count() == 0
    frames = G.decode_frames(G.store(odd_docs.filter("doc_id = 9")), "doc_id").first()
    assert frames["width"] == 576 and sum(frames["histogram"]) == 3 * 576 * frames["height"] == len(frames["pixels"])


def test_query_of_timed_frames(spark):
    rows = queries.queries()["gif_frames"](spark, SF).collect()
    whole = {r["doc_id"]: r["payload_bytes"] for r in queries.queries()["op3_gif_media"](spark, SF).collect()}
    for doc, n in whole.items():
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["number"])
        assert [(r["number"], r["start_ms"], r["delay_ms"]) for r in mine] == [(i, 100 * i, 100) for i in range(-(-n // (576 * 16)))]
        assert all(sum(r["histogram"]) == 3 * 576 * min(16, n // 576) for r in mine)
