"""Media columns: AVI files of motion JPEG, written, indexed, decoded, and cut into timed clips.

Writing: a payload becomes grey frames of 24 x 24 samples. Each sample fills one 8 x 8 block of a baseline JPEG
image of 192 x 192 pixels, as the block's only coefficient with a quantiser of 8; a constant block decodes to the
sample exactly in any baseline decoder, so storage is lossless. Frames are chunks of a RIFF/AVI file with an idx1 index.

Reading: the RIFF tree and the index are parsed, each frame's tables are read from its JPEG segments, and the
entropy-coded scans of many frames are decoded in step, one block of every frame at a time. Shots end where the
difference of the histograms of two frames stands out from the differences before it; a shot is one timed clip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .hashing import text_blocks

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
#: Histogram bins; a cut's difference exceeds FLOOR and the mean of the last WINDOW differences by SIGMAS deviations.
BINS, FLOOR, SIGMAS, WINDOW = 16, 0.10, 2.5, 12
#: Code lengths 1..16 and categories of the DC table (the common table for luminance), fixed values of the format.
_DC_LENGTHS, _DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
_AC_LENGTHS, _AC_SYMBOLS = (1, *(0,) * 15), (0,)  # the end of a block, in one bit


def _codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits), canonical."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = code, bits
            code += 1
        at += n
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * SIDE, 8 * SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00, *_DC_LENGTHS, *_DC_SYMBOLS]))
    + _segment(0xC4, bytes([0x10, *_AC_LENGTHS, *_AC_SYMBOLS]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of (frames, FRAME) 8-bit samples."""
    n = len(samples)
    v = samples.astype(np.int32) - 128
    diff = np.diff(v, axis=1, prepend=0)
    size = np.zeros(511, np.int64)
    for i in range(1, 9):
        size[np.abs(np.arange(-255, 256)) >= 1 << i - 1] = i
    table = _codes(_DC_LENGTHS, _DC_SYMBOLS)
    # Code, magnitude and the end-of-block bit of every difference from -255 to 255.
    d = np.arange(-255, 256)
    code, bits = (np.array([table[int(s)][i] for s in size], np.int64) for i in (0, 1))
    words = ((code << size) | np.where(d < 0, d + (1 << size) - 1, d)) << 1
    lengths = bits + size + 1
    of = diff + 255
    value, length = words[of], lengths[of]
    ends = np.cumsum(length, axis=1)
    total = ends[:, -1]
    n_words = (total + 15) // 16
    first = np.r_[0, np.cumsum(n_words + 1)]
    start = ends - length + (first[:-1] * 16)[:, None]
    shifted = value << (32 - length - (start & 15))
    out = np.zeros(first[-1] + 1, np.int64)
    at = (start >> 4).ravel()
    # Bits of different symbols never overlap, so sums are unions.
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out[at[edges]] += np.add.reduceat((shifted >> 16).ravel(), edges)
    out[at[edges] + 1] += np.add.reduceat((shifted & 0xFFFF).ravel(), edges)
    tail = total & 7  # the last byte ends in ones
    last = first[:-1] + (total - 1 >> 4)
    pad = np.where(tail > 0, (1 << (8 - tail)) - 1, 0)
    out[last] |= np.where(((total - 1) & 15) < 8, pad << 8, pad)
    data = out.astype(">u2").tobytes()
    return [_HEAD + data[2 * a : 2 * a + (t + 7 >> 3)].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, t in zip(first[:-1].tolist(), total.tolist())]


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], rate: int = RATE) -> bytes:
    side, longest = 8 * SIDE, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // rate, longest * rate, 0, 0x10, len(frames), 0, 1, longest, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), longest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf))) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[bytes], int, int]:
    """(frames in the order of the index, rate, scale) of the first video stream."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi = index = None
    rate, scale = RATE, 1
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif kind == b"LIST":
                todo.append((at + 12, at + 8 + size))
            elif kind == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 28)
            elif kind == b"idx1":
                index = at + 8, size
            at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    frames = []
    for kind, _, offset, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1]]):
        if kind[2:] in (b"dc", b"db"):
            frames.append(data[movi + offset + 8 : movi + offset + 8 + size])
    return frames, rate, scale


_TABLES: dict[bytes, tuple] = {}


def _tables(head: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(category, bits) for each 16-bit prefix of DC codes, the DC quantiser, and the blocks of an image, from its segments."""
    if head not in _TABLES:
        at, dc, quantiser, blocks, ac = 2, None, 0, 0, None
        while at < len(head):
            marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4 : at + 2 + size]
            if marker == 0xDB:
                quantiser = body[1]
            elif marker == 0xC0:
                bits, height, width, parts = struct.unpack_from(">BHHB", body)
                if bits != 8 or parts != 1 or height % 8 or width % 8:
                    raise ValueError("frames must be grey, of whole blocks")
                blocks = height * width // 64
            elif marker == 0xC4 and body[0] == 0:
                dc = _codes(tuple(body[1:17]), tuple(body[17:]))
            elif marker == 0xC4:
                ac = _codes(tuple(body[1:17]), tuple(body[17:]))
            elif marker not in (0xDA, 0xE0):
                raise ValueError(f"not a baseline frame: marker {marker:02x}")
            at += 2 + size
        if ac is None or ac.get(0) != (0, 1):
            raise ValueError("only frames of constant blocks are decoded")
        category, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for symbol, (code, bits) in dc.items():
            category[code << 16 - bits : code + 1 << 16 - bits] = symbol
            length[code << 16 - bits : code + 1 << 16 - bits] = bits
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[head] = category, length, quantiser, blocks
    return _TABLES[head]


def decode_frames(images: list[bytes]) -> np.ndarray:
    """(frames, blocks) samples of JPEG images that share their header segments."""
    if not images:
        return np.zeros((0, FRAME), np.uint8)
    split = images[0].index(b"\xff\xda")
    split += 2 + struct.unpack_from(">H", images[0], split + 2)[0]
    head = images[0][:split]
    if any(not x.startswith(head) or x[-2:] != b"\xff\xd9" for x in images):
        raise ValueError("frames with different headers")
    category, bits, quantiser, blocks = _tables(head)
    scans = [x[split:-2].replace(b"\xff\x00", b"\xff") for x in images]
    sizes = np.array([len(x) for x in scans])
    raw = np.frombuffer(b"".join(scans) + b"\0\0\0\0", np.uint8).astype(np.int64)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = 8 * np.r_[0, np.cumsum(sizes)[:-1]]
    value = np.zeros(len(images), np.int64)
    out = np.empty((blocks, len(images)), np.uint8)
    scale = quantiser // 8
    for i in range(blocks):
        x = window[at >> 3] << (at & 7) & 0xFFFFFFFF
        prefix = x >> 16
        size, n = category[prefix], bits[prefix]
        magnitude = (x << n & 0xFFFFFFFF) >> (32 - size)
        value += np.where(magnitude < (1 << size >> 1), magnitude - (1 << size) + 1, magnitude)
        out[i] = value * scale + 128
        at += n + size + 1  # one bit ends the block
    if (at > 8 * np.cumsum(sizes)).any():
        raise ValueError("a frame is cut short")
    return out.T


def shot_bounds(samples: np.ndarray) -> list[int]:
    """First frames of the shots, and the number of frames."""
    n = len(samples)
    if n < 2:
        return [0, n] if n else [0]
    rows = np.repeat(np.arange(n), samples.shape[1])
    histogram = np.bincount(rows * BINS + (samples.ravel() // (256 // BINS)), minlength=n * BINS).reshape(n, BINS)
    difference = np.abs(np.diff(histogram, axis=0)).sum(1) / (2 * samples.shape[1])
    sums, squares = np.r_[0, np.cumsum(difference)], np.r_[0, np.cumsum(difference**2)]
    at = np.arange(n - 1)
    low = np.maximum(0, at - WINDOW)
    count = np.maximum(1, at - low)
    mean = (sums[at] - sums[low]) / count
    deviation = np.sqrt(np.maximum(0, (squares[at] - squares[low]) / count - mean**2))
    cuts = np.flatnonzero((difference > FLOOR) & (difference > np.round(mean + SIGMAS * deviation, 9))) + 1
    return [0, *cuts.tolist(), n]


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 (null: none), filled up with bytes 255 to whole frames, as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in text_blocks(batch.column(1)):
                size = np.diff(bounds)
                frames = np.maximum(1, -(-size // FRAME))
                first = np.r_[0, np.cumsum(frames)]
                payload = np.full(first[-1] * FRAME, 255, np.uint8)
                payload[np.arange(len(data)) + np.repeat(first[:-1] * FRAME - bounds[:-1], size)] = data
                images = encode_frames(payload.reshape(-1, FRAME))
                media = [write_avi(images[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(size)), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double>>"


def media_features(media: DataFrame) -> DataFrame:
    """Reads AVI files (doc_id, n_bytes, media) back: digests of the payload and of the file, and timed clips.

    A null ``media`` gives null results. Repeated rows give repeated rows, an empty table an empty result.
    """
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                to, held = at, 0
                files = []
                while to < batch.num_rows and (to == at or held < 1 << 20):
                    files.append(batch.column(2)[to].as_py())
                    held += len(files[-1] or b"")
                    to += 1
                read = [read_avi(x) if x is not None else ([], RATE, 1) for x in files]
                samples = decode_frames([f for frames, _, _ in read for f in frames])
                rows = [[] for _ in range(7)]
                first = 0
                for x, (frames, rate, scale) in zip(files, read):
                    mine = samples[first : first + len(frames)]
                    first += len(frames)
                    if x is None:
                        for column in rows:
                            column.append(None)
                        continue
                    payload = np.ascontiguousarray(mine).tobytes()
                    cuts = shot_bounds(mine)
                    clips = [{"clip": i, "first_frame": a, "frames": b - a, "start_s": a * scale / rate, "end_s": b * scale / rate} for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                    feature = f"{len(frames)} frames: " + ", ".join(f"{c['start_s']:.2f}-{c['end_s']:.2f} s" for c in clips)
                    for column, y in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(x), hashlib.sha256(x).hexdigest(), feature, clips)):
                        column.append(y)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, to - at) for c in batch.columns[:2]), *(pa.array(x, t) for x, t in zip(rows, kinds))],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"],
                )
                at = to

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def clip_rows(features: DataFrame) -> DataFrame:
    """One row per clip: doc_id, clip, first_frame, frames, start_s, end_s."""
    return features.select("doc_id", F.inline("clips"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = media_features(to_media(read_table(spark, sf_dir, "documents")))
    return features.select(*features.columns[:-1], F.size("clips").alias("n_clips"))
