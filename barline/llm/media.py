"""Images as binary columns: PNG files made and read by zlib and numpy, and
perceptual hashes from the low frequencies of their cosine transform.

Reading checks the signature, every chunk's CRC, the declared sizes and the
length of the pixel stream, and undoes all five row filters; a file that fails
gives ``None`` (a null row), never wrong samples.  Both directions are narrow
maps over one row at a time.  Null payloads count as empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: FIXED VALUES of the PNG format: signature; channels of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Text payloads become RGB rows of 64 pixels.
ROW_BYTES, PIXELS = 192, 64


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(samples: np.ndarray, channels: int = 3, level: int = 3) -> bytes:
    """An 8-bit PNG of rows x (pixels * channels) samples.

    Each row takes the filter (none, left, up) with the least sum of absolute
    differences.
    """
    height, width = samples.shape
    kind = {v: k for k, v in CHANNELS.items()}[channels]
    left, up = samples.copy(), samples.copy()
    left[:, channels:] -= samples[:, :-channels]
    up[1:] -= samples[:-1]
    ways = (samples, left, up)
    cost = np.stack([np.abs(w.view(np.int8).astype(np.int16)).sum(axis=1) for w in ways])
    best = cost.argmin(axis=0).astype(np.uint8)
    raw = np.empty((height, width + 1), dtype=np.uint8)
    raw[:, 0] = best
    for k, w in enumerate(ways):
        raw[best == k, 1:] = w[best == k]
    head = struct.pack(">IIBBBBB", width // channels, height, 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters; runs of rows with one simple filter at once."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    height, width = rows.shape
    out = np.empty_like(rows)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for i, j in zip(np.r_[0, edges], np.r_[edges, height]):
        kind = kinds[i]
        above = out[i - 1] if i else np.zeros(width, dtype=np.uint8)
        if kind == 0:
            out[i:j] = rows[i:j]
        elif kind == 1:
            out[i:j] = rows[i:j].reshape(j - i, -1, bpp).cumsum(axis=1, dtype=np.uint8).reshape(j - i, width)
        elif kind == 2:
            out[i:j] = np.vstack([above, rows[i:j]]).cumsum(axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for r in range(i, j):
                b = (out[r - 1] if r else np.zeros(width, dtype=np.uint8)).astype(np.int32)
                a, c = np.zeros(bpp, dtype=np.int32), np.zeros(bpp, dtype=np.int32)
                for x in range(0, width, bpp):
                    over = b[x : x + bpp]
                    if kind == 3:
                        guess = (a + over) >> 1
                    else:
                        pa_, pb, pc = np.abs(over - c), np.abs(a - c), np.abs(a + over - 2 * c)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, over, c))
                    a, c = (rows[r, x : x + bpp] + guess) & 255, over
                    out[r, x : x + bpp] = a
        else:
            raise ValueError(f"row filter {kind}")
    return out


def png_decode(media: bytes) -> tuple[np.ndarray, int]:
    """(rows x samples, channels) of an 8-bit PNG; ValueError if it is damaged or of another kind."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut short")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(media) or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            if len(body) != 13:
                raise ValueError("length of the header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0):
        raise ValueError("not an 8-bit PNG without interlacing")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    size = height * (width * channels + 1)
    stream = zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(data), size + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != size:
        raise ValueError("pixel stream of another length")
    return _unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(height, -1), channels), channels


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


_DCT = _cosines(32, 8)


def _shrink(x: np.ndarray, n: int = 32) -> np.ndarray:
    """Area means of ``n`` equal strips along the first axis."""
    size = len(x)
    total = np.vstack([np.zeros_like(x[:1]), x.cumsum(axis=0)])
    edges = np.arange(n + 1) * size / n
    whole = np.minimum(edges.astype(np.int64), size - 1)
    at = total[whole] + (edges - whole)[:, None] * x[whole]
    return np.diff(at, axis=0) * (n / size)


def cosine_hash(samples: np.ndarray, channels: int) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies lie above their median."""
    grey = samples.reshape(samples.shape[0], -1, channels).sum(axis=2, dtype=np.float64)
    low = _DCT @ _shrink(_shrink(grey).T).T @ _DCT.T
    low = np.round(low, 3).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def text_payload(data: bytes) -> bytes:
    """Bytes padded with spaces to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW_BYTES or ROW_BYTES * (not data))


def texts_to_png(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as one PNG."""
    schema = f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, n_bytes long, media binary"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                data = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [png_encode(np.frombuffer(text_payload(d), dtype=np.uint8).reshape(-1, ROW_BYTES)) for d in data]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], names=[doc_id, "n_bytes", "media"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def png_features(images: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media: str = "media") -> DataFrame:
    """``keep`` columns with payload and media figures and the cosine hash (hex);
    nulls where ``media`` is null or damaged."""
    kinds = dict(images.dtypes)
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [added])

    def measure(m: bytes | None):
        if m is None:
            return (None,) * 6
        try:
            samples, channels = png_decode(m)
        except ValueError:
            return None, None, None, len(m), hashlib.sha256(m).hexdigest(), None
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(samples, channels).hex()

    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [measure(m) for m in part.column(len(keep)).to_pylist()]
                columns = [*part.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*made), types))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(x.split()[0] for x in added.split(", "))])

    return images.select(*keep, media).mapInArrow(run, schema)
