"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames.

The reader takes any GIF87a/89a file.  Code streams are cut at clear codes; between two of
them the width of the k-th code depends on k alone, so all codes of a run are read at once
and then expanded as copies of earlier output: the table entry made at code j is the
output from the start of string j to one past the start of string j + 1.  Frames are
composed on the canvas by their palettes, transparent index and disposal, and come with
their time and colour histograms.

The writer stores byte payloads as 8-bit samples of 576-pixel rows under a grey palette.
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

ROW = 576
FRAME_ROWS = 64
DELAY_CS = 4
BINS = 16
_GREY = bytes(v for i in range(256) for v in (i, i, i))


def _widths(minimum: int) -> np.ndarray:
    """Bits of the k-th code after a clear code, for every k until the table is full and one more clear is due."""
    first = (1 << minimum) + 2
    n = 4096 - first + 2
    made = first + np.arange(-1, n - 1)  # the next free entry before the k-th code
    return np.clip(np.floor(np.log2(np.maximum(made, 1))).astype(np.int64) + 1, minimum + 1, 12)


_SCHEDULE = {m: _widths(m) for m in range(2, 9)}
_BITS = {m: np.concatenate([[0], np.cumsum(w)]) for m, w in _SCHEDULE.items()}


# code streams


def lzw_codes(data: bytes) -> list[int]:
    """Codes of 8-bit samples, with clear and end codes; a full table is cleared."""
    codes, table, free = [256], {}, 258
    w, rest = data[0], memoryview(data)[1:]
    get, put = table.get, codes.append
    for b in rest:
        k = w << 8 | b
        found = get(k)
        if found is not None:
            w = found
            continue
        put(w)
        if free < 4096:
            table[k] = free
            free += 1
        else:
            put(256)
            table, free = {}, 258
            get = table.get
        w = b
    put(w)
    put(257)
    return codes


def pack(codes: list[int]) -> bytes:
    """Bits of a code list, least significant first."""
    c = np.array(codes, dtype=np.uint16)
    clears = np.flatnonzero(c == 256)
    since = np.arange(len(c)) - np.repeat(clears, np.diff(np.append(clears, len(c)))) - 1
    schedule = _SCHEDULE[8]
    width = schedule[np.minimum(since, len(schedule) - 1)]
    width[0] = 9
    width[clears[1:]] = schedule[since[clears[1:] - 1] + 1]
    bits = ((c[:, None] >> np.arange(12, dtype=np.uint16)) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def unlzw(stream: bytes, minimum: int, pixels: int) -> bytes:
    """Samples of a code stream; stops at the end code or when the frame is full."""
    clear, end = 1 << minimum, (1 << minimum) + 1
    offsets, widths = _BITS[minimum], _SCHEDULE[minimum]
    b = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    words = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    total, at, out = 8 * len(stream), 0, bytearray()
    full_width, first = 12, (1 << minimum) + 2
    while len(out) < pixels and at + minimum < total:
        n = int(np.searchsorted(offsets, total - at, side="right")) - 1
        if n < 1:
            break
        o = at + offsets[:n]
        codes = (words[o >> 3] >> (o & 7).astype(np.uint32)) & ((np.uint32(1) << widths[:n].astype(np.uint32)) - np.uint32(1))
        stops = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stops[0]) if len(stops) else n
        run = codes[:k].tolist()
        used = at + int(offsets[min(k + 1, n)])
        stop = int(codes[k]) if k < n else None
        if k == n and n == len(widths):  # a full table that is not cleared: the codes stay as wide
            more = (total - used) // full_width
            o = used + full_width * np.arange(more)
            codes = (words[o >> 3] >> (o & 7).astype(np.uint32)) & np.uint32(0xFFF)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            k = int(stops[0]) if len(stops) else more
            run += codes[:k].tolist()
            stop = int(codes[k]) if k < more else None
            used += full_width * min(k + 1, more)
        starts: list[int] = []
        push = starts.append
        for i, c in enumerate(run):
            push(len(out))
            if c < clear:
                out.append(c)
                continue
            j = c - first
            if j + 1 < i:
                out += out[starts[j] : starts[j + 1] + 1]
            elif j + 1 == i:
                s = out[starts[j] :]
                out += s + s[:1]
            else:
                raise ValueError("LZW code before its entry")
        at = used
        if stop == end or stop is None:
            break
    return bytes(out[:pixels])


# files


@dataclass
class Frame:
    """A composed frame: where and when it was drawn, and the canvas, which stays as it is until the next frame is asked for."""

    number: int
    at_ms: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    canvas: np.ndarray  # rows x columns x RGBA

    @property
    def drawn(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while raw[at]:
        parts.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(parts), at + 1


def _palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    table = np.zeros((256, 4), dtype=np.uint8)
    table[:, 3] = 255
    table[:n, :3] = np.frombuffer(raw, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
    return table, at + 3 * n


def read_gif(raw: bytes) -> Iterator[Frame]:
    """The timed, composed frames of a file, one at a time."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    at, palette = 13, None
    if flags & 0x80:
        palette, at = _palette(raw, at, flags)
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    number, clock, delay, disposal, transparent = 0, 0, 0, 0, None
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            label = raw[at + 1]
            body, at = _blocks(raw, at + 2)
            if label == 0xF9:
                flags, cs, index = struct.unpack("<BHB", body[:4])
                disposal, delay, transparent = flags >> 2 & 7, 10 * cs, index if flags & 1 else None
            continue
        if raw[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
        at, colours = at + 10, palette
        if flags & 0x80:
            colours, at = _palette(raw, at, flags)
        if colours is None:
            raise ValueError("no palette")
        minimum = raw[at]
        stream, at = _blocks(raw, at + 1)
        samples = np.frombuffer(unlzw(stream, minimum, w * h).ljust(w * h, b"\0"), dtype=np.uint8).reshape(h, w)
        if flags & 0x40:
            order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        kept = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        samples = samples[: area.shape[0], : area.shape[1]]
        if transparent is None:
            area[:] = colours[samples]
        else:
            seen = samples != transparent
            area[seen] = colours[samples[seen]]
        yield Frame(number, clock, delay, disposal, left, top, area.shape[1], area.shape[0], canvas)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = kept
        number, clock = number + 1, clock + delay
        delay, disposal, transparent = 0, 0, None


def write_gif(payload: bytes) -> bytes:
    """A payload of whole rows as a grey animation of at most ``FRAME_ROWS`` rows a frame."""
    rows = len(payload) // ROW
    if len(payload) % ROW or not rows:
        raise ValueError("the payload must be a positive number of rows")
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * ROW : (top + FRAME_ROWS) * ROW]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, ROW, len(part) // ROW, 0, 8))
        stream = pack(lzw_codes(part))
        out += [bytes((len(s),)) + s for i in range(0, len(stream), 255) for s in (stream[i : i + 255],)]
        out.append(b"\0")
    out.append(b";")
    return b"".join(out)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text filled with bytes 255 to a positive multiple of a row, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % ROW if raw else ROW), len(raw)


def histogram(pixels: np.ndarray, channel: int) -> np.ndarray:
    """Counts of a channel in ``BINS`` equal bins, over visible pixels."""
    values = pixels[..., channel][pixels[..., 3] > 0] if (pixels[..., 3] == 0).any() else pixels[..., channel].ravel()
    return np.bincount(values, minlength=256).reshape(BINS, -1).sum(axis=1)


DIGESTS_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, duration_ms long, luma_histogram array<long>"


def _digests(batches):
    names = [x.split(" ")[0] for x in DIGESTS_SQL.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            payload, n = padded(text.as_py())
            media = write_gif(payload)
            del payload
            sha, size, tail, frames, ms, bins = hashlib.sha256(), 0, b"", 0, 0, np.zeros(BINS, dtype=np.int64)
            for f in read_gif(media):
                samples = np.ascontiguousarray(f.drawn[..., 0]).tobytes()
                sha.update(samples)
                size, tail = size + len(samples), (tail + samples)[-32:]
                frames, ms, bins = frames + 1, f.at_ms + f.delay_ms, bins + histogram(f.drawn, 0)
            feature = f"{frames}f {ms}ms " + " ".join(map(str, bins.tolist()))
            out.append((doc_id, n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, frames, ms, bins.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per input row: the text stored as a GIF, read back, and its digests and features.

    Null text is empty and is stored as one row of bytes 255.  Other columns are ignored;
    an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests, DIGESTS_SQL)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``, the text's GIF file."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write_gif(padded(t.as_py())[0]) for t in batch.column(1)], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


FRAMES_SQL = "doc_id long, frame int, at_ms long, delay_ms long, width int, height int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"


def frames(media: DataFrame) -> DataFrame:
    """One row per frame of the files in ``media`` (doc_id, media): time, canvas and histograms.

    A null file has no frames; one that can't be read has its frames up to the fault and a
    last row with the fault in ``error``.
    """
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
    names = [x.split(" ")[0] for x in FRAMES_SQL.split(", ")]

    def rows(doc_id, raw):
        try:
            for f in read_gif(raw):
                h, w = f.canvas.shape[:2]
                yield (doc_id, f.number, f.at_ms, f.delay_ms, w, h, f.canvas.tobytes(), *[histogram(f.canvas, c).tolist() for c in range(3)], None)
        except (ValueError, IndexError, struct.error, KeyError) as e:
            yield (doc_id, *[None] * 9, f"{type(e).__name__}: {e}")

    def run(batches):
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in rows(doc_id, raw.as_py()) if raw.is_valid else ():
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return media.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")).mapInArrow(run, FRAMES_SQL)
