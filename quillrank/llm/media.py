"""Media columns: texts as PNG files in a binary column, read back and hashed.

``encode`` writes each text as an 8-bit RGB picture of 64 pixels a row (192 bytes), ``decode`` reads such
files: signature, chunks with their checksums, the zlib stream with its own, then the row filters by numpy.
``features`` takes low-frequency cosine-transform hashes of the decoded samples.

Edge cases: a null or empty text is a payload of 192 spaces; text of any length is one picture (of as many
rows as it needs); repeated rows give equal values; a null or damaged file decodes to nulls with the fault
named in ``fault``; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import steps
from quillrank.shipping import ship

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Bytes of compressed data in one chunk.
CHUNK = 32 << 10
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the picture that the cosine transform sees, and of its low-frequency corner.
SIDE, LOW = 32, 8


def payload(text: bytes | None) -> bytes:
    """The text padded with spaces to a positive multiple of a row."""
    text = text or b""
    return text + b" " * (ROW - len(text) if not text else -len(text) % ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Each row with its filter byte: of none, left and up, the one with the least sum of absolute differences (the first on ties)."""
    left, up = rows.copy(), rows.copy()
    left[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up[1:] -= rows[:-1]
    tries = (rows, left, up)
    cost = np.stack([np.minimum(t, -t).sum(axis=1, dtype=np.int64) for t in tries])
    pick = cost.argmin(axis=0).astype(np.uint8)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0], out[:, 1:] = pick, rows
    for k in (1, 2):
        out[pick == k, 1:] = tries[k][pick == k]
    return out


def to_png(data: bytes) -> bytes:
    """A picture whose samples are exactly data, which is a positive multiple of a row."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    plain = np.pad(rows, ((0, 0), (1, 0)))  # filter 0 throughout
    forms = [x.tobytes() for x in (plain, _filtered(rows))]
    packed = zlib.compress(min(forms, key=lambda x: len(zlib.compress(x, 1))), 6)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    parts = [packed[k : k + CHUNK] for k in range(0, len(packed), CHUNK)]
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", p) for p in parts) + _chunk(b"IEND", b"")


def _unfiltered(kinds: np.ndarray, body: np.ndarray, step: int) -> np.ndarray:
    """Undoes the five row filters; runs of rows with one filter go at once where the filter allows it."""
    out = body.copy()
    left = kinds == 1
    if left.any():
        out[left] = np.cumsum(out[left].reshape(int(left.sum()), -1, step), axis=1, dtype=np.uint8).reshape(-1, out.shape[1])
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)], strict=True):
        kind, above = kinds[a], out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind == 2:
            out[a:b] = np.cumsum(np.vstack([above[None], out[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for r in range(a, b):
                row, over = out[r].astype(np.int64), (out[r - 1] if r else above * 0).astype(np.int64)
                for c in range(0, len(row), step):
                    x = row[c - step : c] if c else np.zeros(step, np.int64)
                    y = over[c : c + step]
                    if kind == 3:
                        guess = (x + y) // 2
                    else:
                        z = over[c - step : c] if c else np.zeros(step, np.int64)
                        p = x + y - z
                        px, py, pz = abs(p - x), abs(p - y), abs(p - z)
                        guess = np.where((px <= py) & (px <= pz), x, np.where(py <= pz, y, z))
                    row[c : c + step] = (row[c : c + step] + guess) % 256
                out[r] = row
        elif kind > 4:
            raise ValueError(f"filter {kind}")
    return out


def from_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit picture that isn't interlaced, as height x (width x channels); raises ValueError on any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("signature")
    at, packed, head, ended = 8, [], None, False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut off")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part, mark = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(mark) < 4 or struct.unpack(">I", mark)[0] != zlib.crc32(kind + part):
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            packed.append(part)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown chunk {kind!r}")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3] if head else -1)
    if not ended or not channels or head[2] != 8 or any(head[4:]):
        raise ValueError("header or end")
    width, height = head[0] * channels, head[1]
    try:
        flat = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"stream: {e}") from e
    if len(flat) != height * (width + 1):
        raise ValueError("size")
    rows = np.frombuffer(flat, np.uint8).reshape(height, width + 1)
    return _unfiltered(rows[:, 0], rows[:, 1:], channels)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


_BASIS = _cosines()


def cosine_hash(samples: np.ndarray, channels: int = CHANNELS) -> bytes:
    """64 bits: which low-frequency coefficients of the grey picture, shrunk or stretched to a square, lie above their median; the constant one counts as not above."""
    grey = samples.reshape(len(samples), -1, channels).mean(axis=2)
    for axis in (0, 1):
        n = grey.shape[axis]
        edge = np.arange(SIDE) * n // SIDE
        # means over equal stretches; a side shorter than the square repeats its samples
        grey = np.add.reduceat(grey, edge, axis=axis) / np.maximum(1, np.diff(np.append(edge, n))).reshape((-1, 1) if axis == 0 else (1, -1))
    low = (_BASIS @ grey @ _BASIS.T).ravel().round(6)
    low[0] = np.median(low[1:])
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the PNG file)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                yield pa.record_batch([part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([to_png(payload(t)) for t in texts], pa.binary())], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (read back), media, cosine (the hash, binary) and fault (null if the file is sound)."""
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("cosine", pa.binary()), ("fault", pa.string())]
    schema = pa.schema(kinds)

    def read(data: bytes | None) -> tuple:
        try:
            samples = from_png(data or b"")
            return samples.tobytes(), cosine_hash(samples) if samples.shape[1] % CHANNELS == 0 and samples.size else None, None
        except ValueError as e:
            return None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "media"):
                found = list(zip(*map(read, part.column("media").to_pylist()), strict=True))
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "n_bytes", "media")), *(pa.array(list(x), t) for x, (_, t) in zip(found, kinds[3:], strict=True))], schema=schema)

    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, cosine binary, fault string")


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns, by JVM functions over what was decoded."""
    size = F.length("payload").cast("long")
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    return decoded.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("cosine")).alias("feature"), "fault")


