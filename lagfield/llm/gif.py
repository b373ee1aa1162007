"""GIF: a codec for indexed frames, and the media column made of text payloads.

The encoder writes GIF89a with LZW code streams; the decoder reads any GIF87a or GIF89a: LZW with growing code widths, global and
local palettes, interlacing, transparency and the disposal rules, and returns timed frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Samples in a row of a stored frame, rows in a frame, and a frame's time in hundredths of a second.
WIDTH, FRAME_ROWS, DELAY = 192, 64, 4
#: The identity palette: sample value v is grey level v.
GREYS = bytes(v for v in range(256) for _ in range(3))
MOST_CODES = 4096


@dataclass
class Frame:
    """A frame as stored: palette indices, its place, its palette and how it acts on the canvas."""

    index: np.ndarray
    left: int
    top: int
    palette: np.ndarray
    transparent: int | None
    disposal: int
    delay_cs: int


def _pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of given bit widths, least significant bit first."""
    ends = np.cumsum(widths)
    out = np.zeros(int(ends[-1] + 7) // 8 * 8 if len(ends) else 0, np.uint8)
    starts = ends - widths
    for b in range(int(widths.max(initial=0))):
        has = widths > b
        out[starts[has] + b] = (codes[has] >> b) & 1
    return np.packbits(out, bitorder="little").tobytes()


@lru_cache
def _widths(n: int, root: int) -> np.ndarray:
    """Width of the i-th of n codes after a clear code: the table has 2^root + 2 entries then, and one more after each code but the first."""
    held = (1 << root) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.maximum(np.ceil(np.log2(held + 1)).astype(np.int64), root + 1), 12)


def lzw_encode(samples: bytes, root: int = 8) -> bytes:
    """LZW codes of ``samples``; the table is cleared when it is full."""
    clear, stop = 1 << root, (1 << root) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    known: dict[int, int] = {}
    fresh, prefix = stop + 1, samples[0] if samples else -1
    for c in samples[1:]:
        key = prefix << 8 | c
        if key in known:
            prefix = known[key]
            continue
        codes.append(prefix)
        prefix = c
        if fresh < MOST_CODES:
            known[key] = fresh
            fresh += 1
        else:
            runs.append(codes)
            codes, known, fresh = [], {}, stop + 1
    if prefix >= 0:
        codes.append(prefix)
    runs.append(codes)
    parts, widths = [], []
    for i, run in enumerate(runs):
        last = i + 1 == len(runs)
        parts.append(np.array([*run, stop if last else clear], np.int64))
        widths.append(_widths(MOST_CODES + 2, root)[: len(run) + 1])
    return _pack_codes(np.concatenate([[clear], *parts]), np.concatenate([[root + 1], *widths]))


def lzw_decode(data: bytes, root: int, n: int) -> bytes:
    """At most ``n`` samples out of an LZW code stream; a stream that breaks off gives what it holds, and one with a code that the table does not hold yet, but for the very next one, what comes before it."""
    clear, stop = 1 << root, (1 << root) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    n_bits, at, held = 8 * len(data), 0, 0
    roots = [bytes([v]) for v in range(clear)] + [b"", b""]
    out: list[bytes] = []
    fixed = _widths(MOST_CODES + 2, root)
    while at < n_bits and held < n:
        # the codes up to the next clear code: widths depend on their number alone, and stay at 12 once the table is full
        widths = np.concatenate([fixed, np.full(max(0, (n_bits - at) // 12 - len(fixed) + 2), 12, np.int64)]) if n_bits - at > 12 * len(fixed) else fixed
        ends = at + np.cumsum(widths)
        ends = ends[: np.searchsorted(ends, n_bits, "right")]
        widths = widths[: len(ends)]
        starts = ends - widths
        codes = words[starts >> 3] >> (starts & 7) & ((1 << widths) - 1)
        special = np.flatnonzero((codes == clear) | (codes == stop))
        upto = int(special[0]) if len(special) else len(codes)
        entries, before, growing = list(roots), b"", MOST_CODES - len(roots)
        now = codes[:upto].tolist()
        legal = not now or now[0] < clear
        if now and legal:
            before = entries[now[0]]
            out.append(before)
            for code in now[1 : growing + 1]:
                if code < len(entries):
                    entry = entries[code]
                elif code == len(entries):
                    entry = before + before[:1]
                else:
                    legal = False
                    break
                out.append(entry)
                entries.append(before + entry[:1])
                before = entry
            else:
                out += [entries[code] for code in now[growing + 1 :]]  # the table is full
        held = sum(map(len, out))
        if not legal or not len(special) or codes[upto] == stop:
            break
        at = int(ends[upto])
    return b"".join(out)[:n]


def encode_gif(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY) -> bytes:
    """Rows of ``width`` samples as grey frames of at most ``frame_rows`` rows; each frame is drawn at the canvas's top."""
    rows = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), GREYS]
    for r in range(0, rows, frame_rows):
        part = samples[r * width : (r + frame_rows) * width]
        codes = lzw_encode(part)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0), b"\x08"]
        for i in range(0, len(codes), 255):
            out += [bytes([len(codes[i : i + 255])]), codes[i : i + 255]]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def read_frames(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames as stored. Raises ValueError for what is not a GIF; a cut or damaged file gives the whole frames before the damage."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, frames = 13, []

    def colours(n_bits: int) -> np.ndarray:
        return np.frombuffer(data, np.uint8, 3 << n_bits, at).reshape(-1, 3)

    shared = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        if 13 + (3 << (flags & 7) + 1) > len(data):
            return width, height, frames
        shared = colours((flags & 7) + 1)
        at += 3 << (flags & 7) + 1
    transparent, disposal, delay = None, 0, 0

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay, transparent = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if local & 0x80:
                if at + (3 << (local & 7) + 1) > len(data):
                    break
                palette = colours((local & 7) + 1)
                at += 3 << (local & 7) + 1
            root = data[at] if at < len(data) else 0
            if not 1 <= root <= 8:
                break
            body, at = blocks(at + 1)
            samples = lzw_decode(body, root, w * h)
            if len(samples) < w * h:
                break
            index = np.frombuffer(samples, np.uint8).reshape(h, w)
            if local & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                whole = np.empty_like(index)
                whole[order] = index
                index = whole
            frames.append(Frame(index, left, top, palette, transparent, disposal, delay))
            transparent, disposal, delay = None, 0, 0
        else:
            break
    return width, height, frames


def render(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, np.ndarray]]:
    """The canvas (height, width, RGBA) at each frame with its start in hundredths of a second, under palette, transparency and disposal rules; one canvas at a time."""
    canvas, now = np.zeros((height, width, 4), np.uint8), 0
    for f in frames:
        saved = canvas.copy() if f.disposal == 3 else canvas
        h, w = (max(0, min(n, most - first)) for n, most, first in ((f.index.shape[0], height, f.top), (f.index.shape[1], width, f.left)))
        index = f.index[:h, :w]
        place = canvas[f.top : f.top + h, f.left : f.left + w]
        shown = np.ones(index.shape, bool) if f.transparent is None else index != f.transparent
        rgb = f.palette[np.minimum(index, len(f.palette) - 1)]
        place[..., :3][shown] = rgb[shown]
        place[..., 3][shown] = 255
        yield now, canvas.copy()
        now += f.delay_cs
        if f.disposal == 2:
            place[:] = 0
        elif f.disposal == 3:
            canvas = saved


MEDIA = "n_bytes long, media binary"
FRAMES = "n_frames int, width int, height int, duration_cs long, starts_cs array<long>, samples binary, histogram array<long>, frame_histograms array<array<long>>"
#: Grey levels to a histogram cell, and the largest canvas that is drawn; what claims a larger one counts as damaged.
CELL, MOST_PIXELS = 16, 1 << 26


def _stored(texts: pd.Series) -> pd.DataFrame:
    made: dict[str, tuple[int, bytes]] = {}
    out = []
    for text in texts:
        text = text or ""
        if text not in made:
            raw = text.encode()
            made[text] = len(raw), encode_gif(raw + b" " * (-len(raw) % WIDTH if raw else WIDTH))
        out.append(made[text])
    return pd.DataFrame(out, columns=["n_bytes", "media"])


def _read(media: pd.Series) -> pd.DataFrame:
    out, read = [], {}
    for data in media:
        if data not in read:
            read[data] = _timed(data)
        out.append(read[data])
    return pd.DataFrame(out, columns=[c.split()[0] for c in FRAMES.split(", ")])


def _timed(data: bytes | None) -> tuple:
    """One GIF's row of FRAMES. ``samples`` are the red levels of each rendered frame's own area, in time order."""
    none = (0, 0, 0, 0, [], b"", [0] * (256 // CELL), [])
    if data is None or data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return none
    width, height, frames = read_frames(data)
    if width * height > MOST_PIXELS:
        return none
    samples, cells = [], []
    for f, (_, canvas) in zip(frames, render(width, height, frames), strict=True):
        area = canvas[f.top : f.top + f.index.shape[0], f.left : f.left + f.index.shape[1], 0]
        samples.append(area.tobytes())
        cells.append(np.bincount(area.ravel() // CELL, minlength=256 // CELL))
    starts = np.cumsum([0, *(f.delay_cs for f in frames)])
    total = sum(cells, np.zeros(256 // CELL, np.int64))
    return len(frames), width, height, int(starts[-1]), starts[:-1].tolist(), b"".join(samples), total.tolist(), [c.tolist() for c in cells]


def store_gif(text: Column) -> Column:
    """Struct (n_bytes, media) of a text column: its UTF-8 bytes, padded with spaces to rows of 192, as GIF frames. A null text is an empty one, which fills one row of spaces."""
    return F.pandas_udf(_stored, MEDIA)(text)


def read_gif(media: Column) -> Column:
    """Struct FRAMES of a binary column of GIFs: timed frames, colour histograms and the samples read back. Null media, and bytes that are not a GIF, give a row without frames; a cut or damaged GIF gives the whole frames before the damage; a canvas of more than MOST_PIXELS counts as damaged and gives no frames."""
    return F.pandas_udf(_read, FRAMES)(media)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", store_gif(F.col("text")).alias("s")).select("doc_id", "s.n_bytes", "s.media")
    read = stored.withColumn("f", read_gif(F.col("media")))
    tail = F.expr("substring(f.samples, -16, 16)")
    feature = F.concat_ws(":", F.lit("gif"), "f.n_frames", "f.height", "f.duration_cs", F.concat_ws(",", F.col("f.histogram").cast("array<string>")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("f.samples").cast("long").alias("payload_bytes"),
        F.sha2("f.samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.col("f.n_frames").alias("n_frames"),
        F.col("f.starts_cs").alias("starts_cs"),
        F.col("f.frame_histograms").alias("frame_histograms"),
    )
