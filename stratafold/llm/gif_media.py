"""Media columns: GIF images as binary columns, decoded to timed frames with colour histograms.

The decoder reads any GIF87a/89a stream: global and local palettes, sub-blocks, LZW codes
of growing width with clear and end codes, interlacing, transparency, and disposal (keep,
restore to background, restore previous). Frames are composed on the logical screen.

The writer stores bytes losslessly as 8-bit indexes, ``WIDTH`` to a row and ``FRAME_ROWS``
rows to a frame, in LZW codes. Byte v has the colour v, 255 - v, v ^ 0x5A, so the red
channel of the composed screen is the payload. Every second frame has a palette of its own,
in the other order; the frames take turns in how they are disposed of; what the screen
shows already is written as the transparent index. That index stands for byte 0xC0, which
no UTF-8 text holds; a frame that does hold it has none.

An entry of the LZW table is a piece of what was decoded before it, so the decoder keeps
only where each code's output starts. Codes are cut out of the bits in bulk, from one clear
code to the next.

Per document memory: the payload, its stored form and one composed frame. Rows are handled
one by one inside Arrow batches, nothing is shuffled.

Defined results: null and empty text is one row of padding; repeated rows give repeated
rows; an empty table gives no rows; columns beside doc_id and text are ignored. A stream
that ends early or holds an impossible code raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 576
FRAME_ROWS = 16
DELAY_CS = 10
#: The byte whose index is transparent.
HOLE = 0xC0
DISPOSALS = (1, 2, 3)  # keep, restore to background, restore previous
OUT_BYTES = 8 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_COLOURS = np.stack([_BYTES, 255 - _BYTES, _BYTES ^ 0x5A], axis=1)


@lru_cache
def _all_widths(bits: int) -> np.ndarray:
    entries = (1 << bits) + 2 + np.maximum(np.arange(4096) - 1, 0)
    return bits + 1 + (entries[:, None] >= 1 << np.arange(bits + 1, 12)).sum(1)


def _widths(bits: int, start: int, count: int) -> np.ndarray:
    """Bits of the codes number ``start`` and on after a clear code: as many as the table so far needs, 12 at most."""
    known = _all_widths(bits)[start : start + count]
    return known if len(known) == count else np.concatenate([known, np.full(count - len(known), 12)])


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The LZW stream of ``bits``-bit symbols; the table is cleared when it is full."""
    clear = 1 << bits
    codes, table, free = [clear], {}, clear + 2
    append = codes.append
    symbols = iter(data)
    now = next(symbols)
    for c in symbols:
        key = now << 8 | c
        if found := table.get(key):
            now = found
        else:
            append(now)
            table[key] = free
            free += 1
            now = c
            if free == 4096:
                append(clear)
                table, free = {}, clear + 2
    codes += [now, clear + 1]
    values = np.array(codes, np.uint16)
    starts = np.flatnonzero(values == clear)
    ends = np.append(starts[1:] + 1, len(values))
    widths = np.concatenate([[bits + 1], *[_widths(bits, 0, b - a - 1) for a, b in zip(starts, ends)]]).astype(np.uint16)
    places = np.arange(12, dtype=np.uint16)
    return np.packbits(((values[:, None] >> places) & 1)[places < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _expand(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """The symbols of the codes between two clear codes, ``most`` at most.

    Table entry j is the output of code j with the first symbol after it, so a code that
    names it repeats the output from where code j began. Lengths, then symbols, follow these
    references to literals; every pass halves the way that is left.
    """
    place = np.arange(len(codes))
    entry = codes >= clear
    of = np.where(entry, codes.astype(np.int64) - clear - 2, place)
    if (of[entry] >= place[entry]).any():
        raise ValueError("impossible code")
    length, up = entry.astype(np.int64), of
    while (more := length[up]).any():
        length, up = length + more, up[up]
    ends = np.cumsum(length + 1)
    kept = int(np.searchsorted(ends, most)) + 1
    length, ends, of = length[:kept] + 1, ends[:kept], of[:kept]
    starts = ends - length
    owner = np.repeat(np.arange(len(starts)), length)
    source = np.arange(len(owner)) - np.repeat(starts - starts[of], length)
    while not np.array_equal(further := source[source], source):
        source = further
    return codes[owner[source]].astype(np.uint8)[:most]


def lzw_decode(data: bytes, bits: int, count: int) -> np.ndarray:
    """``count`` pixel indexes of an LZW stream with ``bits``-bit symbols."""
    clear = 1 << bits
    raw = np.frombuffer(data + b"\0\0", np.uint8).astype(np.uint32)
    out, size, at, ended, held = [], 0, 0, False, []
    while size < count and not ended:
        # The next codes, up to a clear or end code; held are those since the last clear code.
        nth = sum(map(len, held))
        widths = _widths(bits, nth, min(4096, (8 * len(data) - at) // (bits + 1) + 1))
        offsets = at + np.cumsum(widths) - widths
        n = int(np.searchsorted(offsets + widths, 8 * len(data), "right"))
        offsets, widths = offsets[:n], widths[:n]
        byte = offsets >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offsets & 7)) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        taken = int(stops[0]) if len(stops) else n
        held.append(codes[:taken])
        at = int(offsets[n - 1] + widths[n - 1]) if n else at
        if len(stops) or n < 4096:
            part = _expand(np.concatenate(held), clear, count - size)
            out.append(part)
            size, held = size + len(part), []
            ended = not len(stops) or codes[taken] == clear + 1
            at = int(offsets[taken] + widths[taken]) if len(stops) else at
    if size < count:
        raise ValueError("the code stream ends early")
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of 255 bytes at most, each after its length, and the closing zero."""
    full = len(data) // 255
    body = np.empty((full, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8)[: full * 255].reshape(full, 255)
    rest = data[full * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes) -> bytes:
    """The GIF that stores a payload of a multiple of WIDTH bytes."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _COLOURS.tobytes()]
    pixels = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    screen = np.zeros((min(rows, FRAME_ROWS), WIDTH), np.uint8)
    for number, top in enumerate(range(0, rows, FRAME_ROWS)):
        part = pixels[top : top + FRAME_ROWS]
        n, disposal, own = len(part), DISPOSALS[number % len(DISPOSALS)], number % 2 == 1
        holes = not (part == HOLE).any()
        index = np.where(part == screen[:n], HOLE, part).astype(np.uint8) if holes else part
        index = 255 - index if own else index
        hole = 255 - HOLE if own else HOLE
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | holes, DELAY_CS, hole, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, n, 0x87 if own else 0) + (_COLOURS[::-1].tobytes() if own else b"") + b"\x08")
        out.append(_blocks(lzw_encode(index.tobytes())))
        if disposal == 1:
            screen[:n] = part
        elif disposal == 2:
            screen[:n] = 0
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    number: int
    left: int
    top: int
    width: int
    height: int
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int  # palette index, -1 if none
    canvas: np.ndarray  # composed screen, (height, width, 3)


def _gather(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def frames(data: bytes) -> Iterator[Frame]:
    """The composed frames of a GIF, in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
    blank = palette[background] if palette is not None and background < len(palette) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = blank
    disposal, transparent, delay, clock, number = 0, -1, 0, 0, 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _gather(data, at + 1)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette
        if flags & 0x80:
            n = 2 << (flags & 7)
            colours = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
            at += n * 3
        if colours is None:
            raise ValueError("no palette")
        bits = data[at]
        codes, at = _gather(data, at + 1)
        index = lzw_decode(codes, bits, w * h).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(order, kind="stable")]
        kept = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        index = index[: part.shape[0], : part.shape[1]]
        drawn = colours[np.minimum(index, len(colours) - 1)]
        if transparent >= 0:
            shown = index != transparent
            part[shown] = drawn[shown]
        else:
            part[:] = drawn
        yield Frame(number, left, top, w, h, clock, delay * 10, disposal, transparent, canvas)
        clock, number = clock + delay * 10, number + 1
        if disposal == 2:
            canvas[top : top + h, left : left + w] = blank
        elif kept is not None:
            canvas = kept
        disposal, transparent, delay = 0, -1, 0


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts in 16 bins of each colour channel, red first."""
    flat = pixels.reshape(-1, 3)
    return np.concatenate([np.bincount(flat[:, c] >> 4, minlength=16) for c in range(3)])


def _batches(rows: Iterator[tuple], schema: pa.Schema, wide: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about OUT_BYTES, measured by the column ``wide``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[wide])
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a GIF."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_py() or b""
                pad = -len(raw) % WIDTH if raw else WIDTH
                yield doc.as_py(), len(raw), encode(raw + b"\xff" * pad)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    return source.mapInArrow(lambda it: _batches(rows(it), schema, 2), "doc_id long, n_bytes long, media binary")


def decode_frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per frame: key, number, place, times, disposal, transparent index, composed RGB pixels, histogram."""
    fields = ["number", "left", "top", "width", "height", "start_ms", "delay_ms", "disposal", "transparent"]
    schema = pa.schema([("key", pa.int64()), *[(f, pa.int32()) for f in fields], ("histogram", pa.list_(pa.int64())), ("pixels", pa.binary())])

    def rows(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1)):
                for f in frames(data.as_py()) if data.is_valid else ():
                    yield (k.as_py(), *[getattr(f, x) for x in fields], histogram(f.canvas).tolist(), f.canvas.tobytes())

    ints = ", ".join(f"`{f}` int" for f in fields)
    return media.select(F.col(key).cast("long").alias("key"), F.col(column).alias("media")).mapInArrow(
        lambda it: _batches(rows(it), schema, len(schema) - 1), f"key long, {ints}, histogram array<long>, pixels binary"
    ).withColumnRenamed("key", key)


def read_back(media: DataFrame) -> DataFrame:
    """Per stored text: sizes and digests of the payload read back and of the GIF, and its features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string"]
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in zip(names, kinds)])

    def rows(batches):
        for batch in batches:
            for doc, n, data in zip(*batch.columns):
                gif = data.as_py()
                digest, size, tail, counts, number, ms = hashlib.sha256(), 0, b"", np.zeros(48, np.int64), 0, 0
                for f in frames(gif):
                    part = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
                    raw = np.ascontiguousarray(part[:, :, 0]).tobytes()
                    digest.update(raw)
                    size, tail = size + len(raw), (tail + raw[-32:])[-32:]
                    counts += histogram(part)
                    number, ms = number + 1, f.start_ms + f.delay_ms
                feature = f"frames={number};ms={ms};hist=" + ",".join(map(str, counts))
                yield doc.as_py(), n.as_py(), size, digest.hexdigest(), zlib.crc32(tail), len(gif), hashlib.sha256(gif).hexdigest(), feature

    return media.mapInArrow(lambda it: _batches(rows(it), schema, 7), ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
