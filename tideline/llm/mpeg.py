"""Media columns: payloads in MPEG audio files, and a parser for such files.

Written files are MPEG-2 Layer III, mono, 16 kHz, 144 kbit/s, with checksums: an ID3v2 tag,
an information frame (frame and byte counts, 100-entry seek table) and one frame of 648
bytes (576 samples) for every 576 payload bytes. A frame's side information says that no
audio bits follow, so that players give silence, and the payload lies in its ancillary area.

The parser takes any bytes: it skips ID3v2 tags, seeks the next frame header whose successor
is a header too (or the end), verifies the checksums of all three layers where frames carry
them, reads Xing, Info and VBRI tables with their seek points, and gives each frame's offset,
its samples and the exact duration as a fraction, also where the sampling rate changes. Bytes
between frames are skipped and counted.

Results: one row per row of the input. A null or empty text is one frame of padding; a text of
any length is one file; equal texts give equal values, and repeated rows or ids stay rows of
their own. A null or empty file has no frames and duration 0. An empty table gives an empty
result. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
#: Bit rates (kbit/s) by (version 1, layer) and (version 2 and 2.5, layer); sampling rates by version bits.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}

#: Bits of the allocation of each subband of Layer II, by table (a to d of MPEG-1, e of MPEG-2).
ALLOCATION = {
    "a": [4] * 11 + [3] * 12 + [2] * 4,
    "b": [4] * 11 + [3] * 12 + [2] * 7,
    "c": [4] * 2 + [3] * 6,
    "d": [4] * 2 + [3] * 10,
    "e": [4] * 4 + [3] * 7 + [2] * 19,
}

HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC0])  # MPEG-2 Layer III with checksum, 144 kbit/s, 16 kHz, mono
FRAME = 648
SIDE = 9
DATA = 4 + 2 + SIDE


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = ((x << 1) ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out[i] = x
    return out


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of MPEG audio over each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ CRC[(crc >> np.uint16(8)) ^ column]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum over the first ``bits`` bits of ``data``."""
    crc = int(crc16(np.frombuffer(data[: bits // 8], np.uint8)[None])[0])
    for k in range(bits // 8 * 8, bits):
        bit = data[k // 8] >> 7 - k % 8 & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ bit) & 1 else 0)) & 0xFFFF
    return crc


def _joint_bound(b: bytes, i: int, subbands: int) -> int:
    """Subbands that have an allocation for each of two channels; all but in joint stereo."""
    return min(subbands, 4 * (b[i + 3] >> 4 & 3) + 4) if b[i + 3] >> 6 == 1 else subbands


def checked_bits(b: bytes, i: int, length: int) -> int:
    """How many bits after the checksum of a frame of Layer I or II this one covers: the
    allocation, and in Layer II two bits for each channel of a subband that has samples."""
    channels = 1 if b[i + 3] >> 6 == 3 else 2
    if 4 - (b[i + 1] >> 1 & 3) == 1:
        bound = _joint_bound(b, i, 32)
        return 4 * (channels * bound + 32 - bound)
    first, rate_index, speed = b[i + 1] >> 3 & 3 == 3, b[i + 2] >> 4, b[i + 2] >> 2 & 3
    table = "e"
    if first:
        rate, each = RATES[3][speed], BITRATES[1, 2][rate_index] // channels
        table = "c" if rate != 32000 and each <= 48 else "d" if each <= 48 else "a" if each <= 80 or rate == 48000 else "b"
    widths = ALLOCATION[table]
    bound = _joint_bound(b, i, len(widths))
    data, at, selected = int.from_bytes(b[i + 6 : i + length], "big"), 8 * (length - 6), 0
    for k, width in enumerate(widths):
        for _ in range(channels if k < bound else 1):
            at -= width
            if at < 0:
                return 8 * (length - 6)
            if data >> at & (1 << width) - 1:
                selected += channels if k >= bound else 1
    return min(8 * (length - 6), 8 * (length - 6) - at + 2 * selected)


_SILENT = np.frombuffer(HEADER[2:] + bytes(SIDE), np.uint8)
_START = HEADER + int(crc16(_SILENT[None])[0]).to_bytes(2, "big") + bytes(SIDE)


def encode(payload: bytes) -> bytes:
    """An MPEG file that holds ``payload``, whose length is a multiple of ``UNIT``."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :DATA] = np.frombuffer(_START, np.uint8)
    frames[1:, DATA : DATA + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, 256 * (FRAME + i * n // 100 * FRAME) // ((n + 1) * FRAME)) for i in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * FRAME).to_bytes(4, "big") + toc
    frames[0, DATA : DATA + len(info)] = np.frombuffer(info, np.uint8)
    title = b"TIT2" + (8).to_bytes(4, "big") + b"\0\0\0payload"
    size = len(title)
    tag = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + title
    return tag + frames.tobytes()


@dataclass
class Media:
    """What a file holds. ``offsets``, ``lengths``, ``starts``: bytes and samples, by frame.
    ``rate``: the first frame's; ``duration``: exact seconds over all rates."""

    offsets: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    rate: int = 0
    samples: int = 0
    checked: int = 0
    damaged: int = 0
    skipped: int = 0
    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    duration: Fraction = Fraction(0)


def header(b: bytes, i: int) -> tuple[int, int, int, int, int] | None:
    """(length, samples, rate, bytes of side information, checksum?) of the frame at ``i``."""
    if i + 4 > len(b) or b[i] != 0xFF or b[i + 1] < 0xE0:
        return None
    version, layer = b[i + 1] >> 3 & 3, 4 - (b[i + 1] >> 1 & 3)
    rate_index, speed, pad = b[i + 2] >> 4, b[i + 2] >> 2 & 3, b[i + 2] >> 1 & 1
    if version == 1 or layer == 4 or rate_index in (0, 15) or speed == 3:
        return None
    first = version == 3
    kbits, rate = BITRATES[1 if first else 2, layer][rate_index], RATES[version][speed]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbits // rate + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + pad
    mono = b[i + 3] >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return length, samples, rate, side if layer == 3 else 0, not b[i + 1] & 1


def _tags(b: bytes, i: int) -> tuple[int, dict]:
    """Past an ID3v2 tag at ``i``, and its text frames."""
    if b[i : i + 3] != b"ID3" or len(b) < i + 10:
        return i, {}
    size = sum((b[i + 6 + k] & 127) << 7 * (3 - k) for k in range(4))
    at, end, out = i + 10, min(len(b), i + 10 + size), {}
    while at + 10 <= end and b[at : at + 4].isalnum():
        n = int.from_bytes(b[at + 4 : at + 8], "big")
        if b[at : at + 1] == b"T":
            out[b[at : at + 4].decode("latin-1")] = b[at + 11 : at + 10 + n].decode("latin-1")
        at += 10 + n
    return end, out


def _table(b: bytes, i: int, side: int, length: int) -> dict:
    """A Xing, Info or VBRI table in the frame at ``i``. ``seek``: bytes from the table's frame to
    each of its equal parts of the playing time."""
    for at in (i + 4 + side, i + 6 + side):
        if b[at : at + 4] in (b"Xing", b"Info"):
            flags, at, out = int.from_bytes(b[at + 4 : at + 8], "big"), at + 8, {"kind": b[at : at + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(b[at : at + 4], "big"), at + 4
            if flags & 4 and len(b) >= at + 100:
                out["seek"] = [x * out.get("bytes", 0) // 256 for x in b[at : at + 100]]
            return out
    if b[i + 36 : i + 40] == b"VBRI" and length > 60:
        size, frames, entries, scale, width, each = (int.from_bytes(b[i + a : i + z], "big") for a, z in ((46, 50), (50, 54), (54, 56), (56, 58), (58, 60), (60, 62)))
        steps = [scale * int.from_bytes(b[i + 62 + k * width : i + 62 + (k + 1) * width], "big") for k in range(entries if 1 <= width <= 4 and 62 + entries * width <= length else 0)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "frames_per_entry": each, "seek": np.cumsum([0, *steps])[:-1].tolist() if steps else []}
    return {}


def parse(b: bytes) -> Media:
    """All frames of ``b``; nothing in it makes this fail."""
    at, tags = _tags(b, 0)
    offsets, lengths, counts, data = [], [], [], []
    table: dict = {}
    rate = skipped = 0
    to_check: dict[int, list[int]] = {}
    by_rate: dict[int, int] = {}
    checked = damaged = 0
    n = len(b)
    while at < n:
        h = header(b, at)
        # a lone header may be chance: the next one has to follow, or the end
        if h is None or at + h[0] > n or not (at + h[0] == n or header(b, at + h[0]) or b[at + h[0] : at + h[0] + 3] in (b"TAG", b"ID3")):
            if b[at : at + 3] == b"TAG" and n - at == 128:
                tags["TAG"] = b[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")
                break
            nxt = b.find(b"\xff", at + 1)
            nxt = n if nxt < 0 else nxt
            skipped += nxt - at
            at = nxt
            continue
        length, samples, rate_here, side, protected = h
        rate = rate or rate_here
        if protected and side:
            to_check.setdefault(side, []).append(at)
        elif protected:
            bits = checked_bits(b, at, length)
            checked += 1
            damaged += crc16_bits(b[at + 2 : at + 4] + b[at + 6 : at + length], 16 + bits) != int.from_bytes(b[at + 4 : at + 6], "big")
        if not offsets and not table and (table := _table(b, at, side, length)):
            at += length
            continue
        offsets.append(at)
        lengths.append(length)
        counts.append(samples)
        by_rate[rate_here] = by_rate.get(rate_here, 0) + samples
        data.append(at + 4 + 2 * protected + side)
        at += length
    raw = np.frombuffer(b, np.uint8)
    for side, where in to_check.items():
        rows = np.array(where)[:, None]
        covered = raw[rows + np.array([2, 3, *range(6, 6 + side)])]
        given = raw[rows + np.array([4, 5])].astype(np.uint16)
        damaged += int((crc16(covered) != (given[:, 0] << np.uint16(8) | given[:, 1])).sum())
    counts_ = np.array(counts, np.int64)
    starts = np.cumsum(counts_) - counts_
    checked += sum(map(len, to_check.values()))
    duration = sum((Fraction(k, r) for r, k in by_rate.items()), Fraction(0))
    return Media(np.array(offsets, np.int64), np.array(lengths, np.int64), starts, np.array(data, np.int64), rate, int(counts_.sum()), checked, damaged, skipped, tags, table, duration)


def payload_of(b: bytes, media: Media) -> bytes:
    """The ``UNIT`` bytes of each frame's ancillary area."""
    if not len(media.data):
        return b""
    return np.frombuffer(b, np.uint8)[media.data[:, None] + np.arange(UNIT)].tobytes()


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def feature(media: Media) -> str:
    n = len(media.offsets)
    marks = ",".join(str(media.offsets[k * n // 4]) for k in range(4)) if n else ""
    return f"frames={n};samples={media.samples};rate={media.rate};checked={media.checked};damaged={media.damaged};skipped={media.skipped};table={media.table.get('kind', '')}:{media.table.get('frames', 0)};seek={marks}"


OUT = """doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,
media_sha256 string, feature string, n_frames long, n_samples long, sample_rate long, duration_s double, seek_offsets array<long>"""


def _row(text: bytes) -> tuple:
    stored = encode(padded(text))
    media = parse(stored)
    payload = payload_of(stored, media)
    return (
        len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(),
        feature(media), len(media.offsets), media.samples, media.rate, float(media.duration), media.offsets.tolist(),
    )


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in OUT.replace("\n", " ").split(",")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            rows = [_row(x or b"") for x in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)


def media_columns(docs: DataFrame) -> DataFrame:
    """Each text (null: empty) through an MPEG file and back: one row per row of ``docs``, in
    which equal texts have equal values; doc_id may be null or repeated."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_columns, OUT)


def parsed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Duration, checksums and frame offsets of each media file (``content``: binary, null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(x or b"") for x in batch.column(1).to_pylist()]
            cols = [[m.samples for m in got], [m.rate for m in got], [m.checked for m in got], [m.damaged for m in got], [m.skipped for m in got]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols), pa.array([float(m.duration) for m in got], pa.float64()), pa.array([m.duration.numerator for m in got], pa.int64()), pa.array([m.duration.denominator for m in got], pa.int64()), pa.array([m.offsets.tolist() for m in got], pa.list_(pa.int64())), pa.array([m.starts.tolist() for m in got], pa.list_(pa.int64())), pa.array([m.table.get("kind") for m in got], pa.string()), pa.array([m.table.get("seek") for m in got], pa.list_(pa.int64()))],
                ["path", "samples", "rate", "checked", "damaged", "skipped", "duration_s", "duration_num", "duration_den", "seek_offsets", "seek_samples", "rate_table", "rate_table_seek"],
            )

    return files.select(F.col(path).cast("string").alias("path"), content).mapInArrow(run, "path string, samples long, rate long, checked long, damaged long, skipped long, duration_s double, duration_num long, duration_den long, seek_offsets array<long>, seek_samples array<long>, rate_table string, rate_table_seek array<long>")
