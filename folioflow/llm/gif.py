"""Media columns of GIF: code streams, palettes, disposal and transparency, timed frames, colour histograms.

:func:`stored` keeps bytes losslessly as GIF files, one sample a pixel, and :func:`read` takes any GIF
column apart: frames with their times, places and disposal, a histogram of the colours that a viewer
sees while each is shown, and the samples as they are stored.

How wide a code is follows from its number after a clear code alone, so a dictionary's codes are cut
out of the bits all at once. A code above the palette's stands for what an earlier code gave, and the
first sample after that, which is what the samples say at that place: so every sample points back to an
earlier one, and pointers are doubled until they end at samples that a code gave itself. The codes of
many frames are followed together.

Files are independent, so nothing is shuffled: a batch of files of bounded bytes at a time.

Defined cases: null bytes store as null media, empty ones as a file without frames; a null medium gives
a null, and a medium that is no GIF, ends early, or has an impossible code gives ``reason`` (``not a gif``,
``truncated``, ``bad code``, ``no palette``, ``too large``) with the frames before it; samples that a code stream lacks
end the reading, surplus ones are left out; colours beyond the palette are black; a file of any length is
read in whole; equal bytes give equal files and equal columns; repeated rows are rows of their own;
an empty table gives an empty result; further columns go unless they are in ``keep``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import bounded_batches

#: Samples of a row, rows and hundredths of a second of a frame, of what is stored here.
WIDTH, ROWS, DELAY = 192, 128, 10
#: Codes go up to 12 bits.
FULL = 4096
#: Two bits of red, green and blue each.
BINS = 64
#: Pixels of a screen or frame that is read; what a file claims to be larger can't be held, and isn't made.
MOST_PIXELS = 1 << 26

# ---- files of samples


@cache
def palette_of_bytes() -> bytes:
    """256 different colours: three bits of red and green, two of blue."""
    b = np.arange(256)
    return np.stack([(b >> 5) * 255 // 7, (b >> 2 & 7) * 255 // 7, (b & 3) * 85], axis=1).astype(np.uint8).tobytes()


def codes_of(samples: bytes) -> list[int]:
    """The codes of 8-bit samples: the longest known string each time. Once all codes are given out they stay as they are."""
    clear, end = 256, 257
    codes = [clear]
    add = codes.append
    longer: list[dict[int, int] | None] = [None] * FULL  # by code: what it is with one more sample
    free = end + 1
    rest = iter(samples)
    now = next(rest, None)
    for s in rest:
        known = longer[now]
        if known is None:
            longer[now] = {s: free}
        elif s in known:
            now = known[s]
            continue
        else:
            known[s] = free
        add(now)
        now = s
        free += 1
        if free == FULL:
            break
    for s in rest:
        known = longer[now]
        if known is not None and s in known:
            now = known[s]
        else:
            add(now)
            now = s
    if now is not None:
        add(now)
    add(end)
    return codes


@cache
def widths(least: int) -> np.ndarray:
    """How many bits the codes after a clear code have, in order, until all are given out; ``least`` is the width of the first."""
    known = (1 << (least - 1)) + 2 + np.maximum(np.arange(FULL) - 1, 0)  # when each is read
    return np.clip(np.floor(np.log2(known)).astype(np.int64) + 1, least, 12)


def packed(codes: list[int]) -> bytes:
    """Codes of 8-bit samples, the first of which alone is a clear code, as bits, least significant first."""
    c = np.array(codes, dtype=np.uint32)
    ends = np.concatenate([[9], 9 + _ends(9)[: len(c) - 1]])
    if len(c) > len(ends):
        ends = np.concatenate([ends, ends[-1] + 12 * np.arange(1, len(c) - len(ends) + 1)])
    start = np.concatenate([[0], ends[:-1]])
    value = c << (start & 7).astype(np.uint32)
    # Bits of different codes never overlap, so they add up.
    byte = start >> 3
    n = -(-int(ends[-1]) // 8)
    out = sum(np.bincount(byte + k, weights=value >> np.uint32(8 * k) & np.uint32(255), minlength=n + 2) for k in range(3))
    return out[:n].astype(np.uint8).tobytes()


def gif_of(raw: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF file whose frames' samples are the bytes of ``raw``: whole rows of ``width``, ``rows`` of them to a frame."""
    if len(raw) % width:
        raise ValueError(f"bytes must fill rows of {width}")
    high = min(rows, len(raw) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, max(1, high), 0xF7, 0, 0), palette_of_bytes()]
    for at in range(0, len(raw), width * rows):
        part = raw[at : at + width * rows]
        data = packed(codes_of(part))
        # Shown for ``delay``, and taken away afterwards.
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        out += [bytes([min(255, len(data) - k)]) + data[k : k + 255] for k in range(0, len(data), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


# ---- reading


class Broken(ValueError):
    """A file that can't be read on."""


@cache
def _ends(least: int) -> np.ndarray:
    """Where each code after a clear code ends, in bits; for a ``least`` of 0, each code once all are given out."""
    return np.cumsum(widths(least) if least else np.full(4 * FULL, 12))


def cut(data: bytes, least: int) -> tuple[np.ndarray, list[int]]:
    """The codes of a stream without clear and end codes, and how many there are after each clear code."""
    clear = 1 << (least - 1)
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    three = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, at, row = len(data) * 8, 0, least
    parts: list[np.ndarray] = []
    many = [0]
    while True:
        ends = _ends(row)
        ends = ends[: np.searchsorted(ends, total - at, side="right")] + at
        if not len(ends):
            break  # without an end code; what was read counts
        starts = np.concatenate([[at], ends[:-1]])
        codes = three[starts >> 3] >> (starts & 7) & ((1 << (ends - starts)) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(marks[0]) if len(marks) else len(codes)
        parts.append(codes[:n])
        many[-1] += n
        if not len(marks):
            at, row = int(ends[-1]), 0
        elif codes[n] == clear:
            at, row = int(ends[n]), least
            many.append(0)
        else:
            break
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), many


def decoded(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray | Broken]:
    """The samples of code streams, each with the width of its first codes and how many samples are due."""
    found = [cut(data, least) for data, least, _ in streams]
    sizes = np.array([len(c) for c, _ in found], dtype=np.int64)
    if not sizes.sum():
        return [Broken("truncated") if wanted else np.zeros(0, dtype=np.uint8) for _, _, wanted in streams]
    c = np.concatenate([c for c, _ in found])
    clear = np.repeat([1 << (least - 1) for _, least, _ in streams], sizes)
    many = np.concatenate([m for _, m in found])
    n = np.arange(len(c))
    base = np.repeat(np.cumsum(many) - many, many)  # the first code with the same dictionary
    own = c < clear
    earlier = base + c - clear - 2  # the code whose samples, and one more, this one stands for
    bad = ~own & (earlier >= n)
    own |= bad
    up = np.where(own, n, earlier)
    length, to = (~own).astype(np.int64), up
    while True:  # distance to the code that gave a sample itself, doubled each time
        length = length + length[to]
        again = to[to]
        if np.array_equal(again, to):
            break
        to = again
    length += 1
    ends = np.cumsum(length)
    start = ends - length
    source = np.arange(int(ends[-1]), dtype=np.int32) + np.repeat((start[up] - start).astype(np.int32), length)
    while True:
        again = source[source]
        if np.array_equal(again, source):
            break
        source = again
    first = np.zeros(len(source), dtype=np.uint8)
    first[start[own]] = c[own] & 255
    samples = first[source]
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    broken = set(np.searchsorted(np.cumsum(sizes), np.flatnonzero(bad), side="right").tolist())
    out: list[np.ndarray | Broken] = []
    for k, (_, _, wanted) in enumerate(streams):
        a, b = edges[k], edges[k + 1]
        out.append(Broken("bad code") if k in broken else Broken("truncated") if b - a < wanted else samples[a : a + wanted])
    return out


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    interlaced: bool
    colours: np.ndarray  # 256 of red, green, blue and 255
    stream: tuple[bytes, int, int]
    samples: np.ndarray | Broken | None = None  # rows from the top down


class File:
    """The frames of one file, in order; ``reason`` tells why there are no more, if that isn't the file's end."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0
        self.width = self.height = 0
        self.reason: str | None = None
        self.frames: list[Frame] = []
        try:
            self._parse()
        except Broken as e:
            self.reason = str(e)

    def take(self, n: int) -> bytes:
        part = self.raw[self.at : self.at + n]
        if len(part) < n:
            raise Broken("truncated")
        self.at += n
        return part

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def palette(self, flags: int) -> np.ndarray | None:
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        colours = np.zeros((256, 4), dtype=np.uint8)
        colours[:, 3] = 255
        colours[:n, :3] = np.frombuffer(self.take(3 * n), dtype=np.uint8).reshape(n, 3)
        return colours

    def _parse(self) -> None:
        if self.raw[:6] not in (b"GIF87a", b"GIF89a"):
            raise Broken("not a gif")
        self.at = 6
        self.width, self.height, flags, _, _ = struct.unpack("<HHBBB", self.take(7))
        if self.width * self.height > MOST_PIXELS:
            raise Broken("too large")
        shared = self.palette(flags)
        disposal, delay, clear, now = 0, 0, None, 0
        while (kind := self.take(1)) != b"\x3b":
            if kind == b"\x21":
                label = self.take(1)
                said = self.blocks()
                if label == b"\xf9" and len(said) >= 4:
                    flags, delay, index = struct.unpack("<BHB", said[:4])
                    disposal, clear = flags >> 2 & 7, index if flags & 1 else None
                continue
            if kind != b"\x2c":
                raise Broken("not a gif")
            left, top, wide, high, flags = struct.unpack("<HHHHB", self.take(9))
            own = self.palette(flags)
            colours = own if own is not None else shared
            if colours is None:
                raise Broken("no palette")
            if wide * high > MOST_PIXELS:
                raise Broken("too large")
            least = self.take(1)[0] + 1
            if not 2 <= least <= 9:
                raise Broken("bad code")
            self.frames.append(Frame(now, delay * 10, left, top, wide, high, disposal, clear, bool(flags & 0x40), colours, (self.blocks(), least, wide * high)))
            now += delay * 10
            disposal, delay, clear = 0, 0, None

    def settle(self) -> None:
        """Frames from the first that can't be decoded on go; the others' samples become rows from the top down."""
        for k, f in enumerate(self.frames):
            if isinstance(f.samples, Broken):
                self.reason = str(f.samples)
                del self.frames[k:]
                break
            f.samples = f.samples.reshape(f.height, f.width)
            if f.interlaced:  # rows come as every eighth, the eighths between, the fourths and the halves between
                rows = np.concatenate([np.arange(a, f.height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                f.samples = f.samples[np.argsort(rows)]

    def shown(self) -> Iterator[np.ndarray]:
        """What a viewer sees of each frame: red, green, blue, and 255 where anything is painted. The array changes with the next frame."""
        screen = np.zeros((self.height, self.width), dtype=np.uint32)
        undo: tuple | None = None
        for f in self.frames:
            if undo is not None:
                screen[undo[0]] = undo[1]
            # Only what lies on the screen is painted.
            area = (slice(f.top, min(f.top + f.height, self.height)), slice(f.left, min(f.left + f.width, self.width)))
            seen = f.samples[: max(0, self.height - f.top), : max(0, self.width - f.left)]
            undo = (area, 0) if f.disposal == 2 else (area, screen[area].copy()) if f.disposal == 3 else None
            painted = f.colours.view(np.uint32)[:, 0][seen]
            if f.transparent is None:
                screen[area] = painted
            else:
                np.copyto(screen[area], painted, where=seen != f.transparent)
            yield screen.view(np.uint8).reshape(self.height, self.width, 4)


def opened(raws: list[bytes | None], group: int = 1 << 17) -> list[File | None]:
    """Files with the samples of their frames; about ``group`` samples are decoded at a time."""
    files = [None if raw is None else File(raw) for raw in raws]
    held: list[Frame] = []
    size = 0

    def decode() -> None:
        for f, samples in zip(held, decoded([f.stream for f in held])):
            f.samples = samples
            f.stream = (b"", 0, 0)

    for f in (f for file in files if file for f in file.frames):
        held.append(f)
        size += f.stream[2]
        if size >= group:
            decode()
            held, size = [], 0
    decode()
    for file in files:
        if file:
            file.settle()
    return files


def histogram(shown: np.ndarray) -> np.ndarray:
    """Pixels by the upper two bits of red, green and blue; those that nothing was painted on don't count."""
    whole = np.ascontiguousarray(shown).view("<u4")[..., 0]
    bins = (whole >> 6 & 3) << 4 | (whole >> 14 & 3) << 2 | whole >> 22 & 3 | (whole >> 31 ^ 1) << 6
    return np.bincount(bins.ravel(), minlength=BINS + 1)[:BINS]


_FRAME = [("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("interlaced", pa.bool_()), ("histogram", pa.list_(pa.int64())), ("unpainted", pa.int64())]
_GIF = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("reason", pa.string()), ("frames", pa.list_(pa.struct(_FRAME))), ("samples", pa.binary())])


def taken_apart(raws: list[bytes | None]) -> list[dict | None]:
    """The columns of files."""
    out: list[dict | None] = []
    for file in opened(raws):
        if file is None:
            out.append(None)
            continue
        frames = []
        for f, shown in zip(file.frames, file.shown()):
            counts = histogram(shown)
            frames.append({name: getattr(f, name) for name, _ in _FRAME[:-2]} | {"histogram": counts, "unpainted": file.height * file.width - int(counts.sum())})
        samples = b"".join(f.samples.tobytes() for f in file.frames)
        out.append({"width": file.width, "height": file.height, "reason": file.reason, "frames": frames, "samples": samples})
    return out


def _kept(df: DataFrame, keep: list[str], new: str) -> tuple[list[Column], list[pa.Field]]:
    if new in keep:
        raise ValueError(f"{new} is a column of the result")
    return [df[c] for c in keep], [pa.field(c, to_arrow_type(df.schema[c].dataType)) for c in keep]


def stored(df: DataFrame, raw: Column, keep: list[str], width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> DataFrame:
    """The columns ``keep``, and ``media``: a GIF file of the bytes ``raw``, which must fill rows of ``width``."""
    bounded_batches(df.sparkSession)
    columns, fields = _kept(df, keep, "media")
    kind = pa.schema([*fields, ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [None if x is None else gif_of(x, width, rows, delay) for x in b["_raw"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(media, pa.binary())], schema=kind)

    return df.select(*columns, raw.alias("_raw")).mapInArrow(run, from_arrow_schema(kind))


def read(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and ``gif``: width, height, reason, samples (of all frames, from the top row down), and frames with their times, places, disposal and histograms."""
    bounded_batches(df.sparkSession)
    columns, fields = _kept(df, keep, "gif")
    kind = pa.schema([*fields, ("gif", _GIF)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(taken_apart(b["_raw"].to_pylist()), _GIF)], schema=kind)

    return df.select(*columns, df[media].alias("_raw")).mapInArrow(run, from_arrow_schema(kind))


def payload(text: Column, multiple: int = WIDTH) -> Column:
    """The bytes of a text, with spaces up to a positive multiple of ``multiple``; a null counts as empty."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / multiple)) * multiple
    return F.rpad(raw, n.cast("int"), F.lit(b" "))


def feature(gif: Column) -> Column:
    """One string of a file: its frames, milliseconds, and pixels by colour times the milliseconds they are shown."""
    shown = F.transform(gif["frames"], lambda f: F.transform(f["histogram"], lambda n: n * f["delay_ms"]))
    sums = F.aggregate(shown, F.array_repeat(F.lit(0).cast("long"), BINS), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    ms = F.aggregate(gif["frames"], F.lit(0).cast("long"), lambda a, f: a + f["delay_ms"])
    return F.concat_ws(" ", F.size(gif["frames"]).cast("string"), ms.cast("string"), F.array_join(sums.cast("array<string>"), ","))
