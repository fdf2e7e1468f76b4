"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms.

``encode`` stores 8-bit samples losslessly as the colour indices of one or more frames; ``parse`` and ``render`` read any GIF87a or
GIF89a, interlaced, local palettes and transparent colours included.
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

from turnloom.functions.arrow import grown, short
from turnloom.llm.common import arrow_types, record, text_bytes

WIDTH = 64
#: Rows of one frame: longer payloads go on in the next frame.
FRAME_ROWS = 1024
#: Hundredths of a second that each frame is shown.
DELAY = 4
TABLE = 4096
#: Bins of each colour's histogram, a power of two.
BINS = 16
GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


class GifError(ValueError):
    """Bytes that are no readable GIF."""


def _widths(first: int, size: int, n: int = TABLE) -> np.ndarray:
    """Bits of the codes after a clear code, by their number; ``first`` is the first free code."""
    free = np.maximum(first - 1 + np.arange(n), first)
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(free)).astype(np.int64) + 1))


_WIDTHS = {s: _widths((1 << s) + 2, s) for s in range(2, 9)}
_STARTS = {s: np.concatenate([[0], np.cumsum(w)]) for s, w in _WIDTHS.items()}


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The code stream of samples below ``1 << size``: a clear code first and whenever the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    codes: list[int] = [clear << 8]  # codes are held shifted by a byte, so that a table key is a code with its next sample
    cuts = [1]  # where segments begin, after their clear code
    put = codes.append
    if samples:
        table: dict[int, int] = {}
        find, free, full, prefix = table.get, (end + 1) << 8, TABLE << 8, samples[0] << 8
        for c in samples[1:]:
            code = find(prefix | c)
            if code is None:
                put(prefix)
                table[prefix | c] = free
                free += 256
                prefix = c << 8
                if free == full:
                    put(clear << 8)
                    cuts.append(len(codes))
                    table.clear()
                    free = (end + 1) << 8
            else:
                prefix = code
        put(prefix)
    put(end << 8)
    number = _numbers(len(codes), cuts)
    width = np.where(number < 0, size + 1, _WIDTHS[size][np.clip(number, 0, TABLE - 1)])
    places = np.arange(12)
    bits = (np.array(codes, np.int32)[:, None] >> (8 + places).astype(np.int32)).astype(np.uint8) & 1
    return np.packbits(bits[places < width[:, None]], bitorder="little").tobytes()


def _numbers(n: int, cuts: list[int]) -> np.ndarray:
    """Each code's number within its segment; the first clear code has -1."""
    start = np.zeros(n, np.int64)
    start[cuts[0] :] = cuts[0]
    for c in cuts[1:]:
        start[c:] = c
    out = np.arange(n) - start
    out[0] = -1
    return out


def lzw_decode(data: bytes, size: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream. A stream that breaks off gives what it has."""
    if not 2 <= size <= 8:
        raise GifError(f"LZW code size {size}")
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int32)
    bits = len(data) * 8
    out: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    done, bit, number = 0, 0, 0
    while done < most:  # codes have one sample at least
        if number < TABLE:
            offset = bit - _STARTS[size][number] + _STARTS[size][number:TABLE]
            width = _WIDTHS[size][number:]
        else:
            offset, width = bit + 12 * np.arange(TABLE), np.full(TABLE, 12)
        fit = int(np.searchsorted(offset + width, bits, "right"))
        if not fit:
            break
        offset, width = offset[:fit], width[:fit]
        byte = offset >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offset & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        parts.append(codes[:n])
        done += n
        if not len(stops):
            bit, number = int(offset[-1] + width[-1]), number + len(codes)
            continue
        out.append(_strings(np.concatenate(parts), clear))
        parts = []
        if codes[n] == end:
            break
        bit, number = int(offset[n] + width[n]), 0
    if parts:
        out.append(_strings(np.concatenate(parts), clear))
    return b"".join(x.tobytes() for x in out)[:most]


def _strings(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes.

    Table entry j is code j's string and the sample after it, which lie side by side in the output: so each code copies from where
    code j begins, and following those copies back by doubling ends at literal samples.
    """
    n = len(codes)
    own = np.arange(n, dtype=np.int32)
    literal = codes < clear
    entry = np.where(literal, own, codes - clear - 2).astype(np.int32)
    if (~literal & (entry >= own)).any():
        raise GifError("a code before its table entry")
    longer, back = np.where(literal, 0, 1).astype(np.int32), entry
    while not literal[back].all():
        longer = longer + longer[back]
        back = back[back]
    length = longer + 1
    start = np.cumsum(length, dtype=np.int32) - length
    source = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(start - start[entry], length)
    samples = np.zeros(len(source), np.uint8)
    samples[start[literal]] = codes[literal]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return samples[source]
        source = further


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x := data[i : i + 255])]) + x for i in range(0, len(data), 255)) + b"\0"


@dataclass(frozen=True)
class Frame:
    """One image as stored: its place, indices by row, palette (n, 3), delay, disposal and transparent index."""

    left: int
    top: int
    width: int
    height: int
    indices: bytes
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


def encode_frames(width: int, height: int, frames: list[Frame], palette: bytes = GRAY, background: int = 0) -> bytes:
    """A GIF89a with a global palette of 256 colours; frames with another palette get a local one."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, background, 0), palette]
    for f in frames:
        own = f.palette.astype(np.uint8).tobytes()
        local = own != palette
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0x87 if local else 0))
        if local:
            out.append(own.ljust(768, b"\0"))
        out += [b"\x08", _blocks(lzw_encode(f.indices))]
    return b"".join([*out, b"\x3b"])


_GRAYS = np.frombuffer(GRAY, np.uint8).reshape(-1, 3)


def encode(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """``payload``, a positive multiple of ``width`` bytes, as grey frames of at most ``rows`` rows."""
    if not payload or len(payload) % width:
        raise GifError("payload is no positive multiple of the width")
    step = width * rows
    frames = [Frame(0, 0, width, len(x) // width, x, _GRAYS, delay, 1) for x in (payload[i : i + step] for i in range(0, len(payload), step))]
    return encode_frames(width, frames[0].height, frames)


def parse(data: bytes) -> tuple[int, int, int, list[Frame]]:
    """Screen width and height, loop extension ignored, background index, and the stored frames."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colours(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        at += 3 * n
        if at > len(data):
            raise GifError("palette breaks off")
        return np.frombuffer(data, np.uint8, 3 * n, at - 3 * n).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    shared = colours(flags) if flags & 0x80 else None
    frames: list[Frame] = []
    control = (0, 0, None)
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                control = (body[1] | body[2] << 8, body[0] >> 2 & 7, body[3] if body[0] & 1 else None)
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = colours(flags) if flags & 0x80 else shared
            if palette is None:
                raise GifError("no palette")
            size = data[at]
            at += 1
            indices = lzw_decode(blocks(), size, w * h).ljust(w * h, b"\0")
            if flags & 0x40:
                rows = np.frombuffer(indices, np.uint8).reshape(h, w)
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                back = np.empty_like(rows)
                back[order] = rows
                indices = back.tobytes()
            frames.append(Frame(left, top, w, h, indices, palette, *control))
            control = (0, 0, None)
        else:
            raise GifError(f"block {kind:#x}")
    return width, height, background, frames


def render(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGBA) as each frame shows it. Disposal 2 clears the frame's place, 3 brings back what was there."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, height - f.top)), max(0, min(f.width, width - f.left))
        index = np.frombuffer(f.indices, np.uint8).reshape(f.height, f.width)[:h, :w]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[:, 3] = 255
        place = canvas[f.top : f.top + h, f.left : f.left + w]
        if f.transparent is None:
            place[:] = colours[index]
        else:
            shown = index != f.transparent
            place[shown] = colours[index[shown]]
        yield canvas
        if f.disposal == 2:
            place[:] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Opaque pixels by equal bins of red, of green and of blue: (3, bins)."""
    seen = canvas[..., :3][canvas[..., 3] > 0] >> (8 - bins.bit_length() + 1)
    return np.stack([np.bincount(seen[:, c], minlength=bins) for c in range(3)])


def padded(text: bytes, unit: int = WIDTH) -> bytes:
    """The text with zero bytes up to a positive multiple of ``unit``."""
    return text + b"\0" * (-len(text) % unit if text else unit)


def timed(w: int, h: int, frames: list[Frame]) -> Iterator[tuple[dict, np.ndarray]]:
    """A parsed GIF's frames in order: when and where each shows, the colour histogram of what is then seen, and the canvas."""
    start = 0
    for i, (f, canvas) in enumerate(zip(frames, render(w, h, frames), strict=True)):
        red, green, blue = histogram(canvas).tolist()
        yield {"frame": i, "start_ms": start, "delay_ms": 10 * f.delay, "disposal": f.disposal, "width": w, "height": h, "red": red, "green": green, "blue": blue}, canvas
        start += 10 * f.delay


FRAME = "frame int, start_ms long, delay_ms long, disposal int, width int, height int, red array<long>, green array<long>, blue array<long>"


def frames_table(media: DataFrame, column: str = "media") -> DataFrame:
    """One row for each frame of each GIF in ``media`` (doc_id, ``column``): when it shows, its colour histogram and the canvas in RGBA.

    Null media has no frames; bytes that are no GIF raise.
    """
    schema = f"doc_id long, {FRAME}, rgba binary"
    types = arrow_types(schema)

    def run(batches):
        for b in short(batches):
            for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if m is None:
                    continue
                w, h, _, frames = parse(m)
                for f, canvas in timed(w, h, frames):
                    yield record({"doc_id": [d], "rgba": [canvas.tobytes()]} | {k: [v] for k, v in f.items()}, types)

    return media.select("doc_id", column).mapInArrow(run, schema)


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's bytes, padded, as a GIF."""
    schema = "doc_id long, n_bytes long, media binary"
    types = arrow_types(schema)

    def run(batches):
        for b in short(batches):
            for part, media in grown(b, (encode(padded(t)) for t in text_bytes(b))):
                yield record({"doc_id": part.column("doc_id"), "n_bytes": [len(t) for t in text_bytes(part)], "media": media}, types)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def stored(media: DataFrame) -> DataFrame:
    """What the stored GIFs hold: digests of the payload read back from their code streams, and ``frames``, the timed frames with their histograms.

    Frames are kept without their pixels, which the media has; ``frames_table`` gives them.
    """
    types = arrow_types(STORED) | {"frames": pa.list_(pa.struct(list(arrow_types(FRAME).items())))}

    def one(n: int, m: bytes) -> tuple:
        w, h, _, frames = parse(m)
        payload = b"".join(f.indices for f in frames)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), [f for f, _ in timed(w, h, frames)]

    def run(batches):
        names = list(types)[1:]
        for b in short(batches):
            cols = zip(*map(one, b.column("n_bytes").to_pylist(), b.column("media").to_pylist()), strict=True)
            yield record({"doc_id": b.column("doc_id")} | dict(zip(names, cols, strict=True)), types)

    fields = ",".join(x.strip().replace(" ", ":", 1) for x in FRAME.split(", "))
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{STORED}, frames array<struct<{fields}>>")


def digests(media: DataFrame) -> DataFrame:
    """``stored`` with ``feature``: from the frames, for each its size, when it shows and its colours."""

    def told(f):
        colours = [F.concat_ws(",", F.transform(f[c], lambda n: n.cast("string"))) for c in ("red", "green", "blue")]
        return F.concat(F.concat_ws("x", f["width"], f["height"]), F.lit("@"), F.concat_ws("+", f["start_ms"], f["delay_ms"]), F.lit(":"), F.concat_ws("/", *colours))

    return stored(media).withColumn("feature", F.concat_ws(";", F.transform("frames", told)))
