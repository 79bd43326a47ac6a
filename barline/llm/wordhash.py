"""Vectorised word splitting and 64-bit word hashes over whole Arrow batches.

One call handles every text of a batch at once on the batch's own byte buffer,
so no Python loop runs per word or per document.  A word is a maximal run of
bytes other than space and the control bytes 0x09-0x0D; A-Z count as a-z.
Null texts have no words.  Equal words have equal hashes in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd multiplier and its inverse modulo 2**64, for position-free window sums.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Texts are handled in slices of about this many bytes; inside, hashes are
#: worked out over a quarter of that at a time, which bounds memory; a longer
#: text is taken in pieces.
SLICE_BYTES = 4 << 20
STEP_BYTES = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift multiply)."""
    x = x + np.uint64(salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, slice) pieces of about ``limit`` bytes, whole texts each."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset :] if len(texts) else np.zeros(1, dtype=np.int64)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, texts.slice(start, end - start)
        start = end


#: Other separators than white space: every ASCII byte that is no letter or digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = 1


def words(texts: pa.Array, separators: np.ndarray | None = None, prefixes: tuple[int, ...] = ()):
    """(row of each word, hash of each word), in text order, for one slice.

    With ``prefixes``, also the number of the sentence each word stands in
    (counted over the slice, cut at line ends and ``.!?``, never across rows)
    and, for each prefix length in bytes, the hash of that prefix.
    """
    n = len(texts)
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if prefixes:
        none = (*none, none[0], [none[1]] * len(prefixes))
    if n == 0:
        return none
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return none
    if hi - lo > STEP_BYTES and n > 1:
        steps = [(at, words(part, separators, prefixes)) for at, part in slices(texts, STEP_BYTES)]
        rows = np.concatenate([w[0] + at for at, w in steps])
        hashes = np.concatenate([w[1] for _, w in steps])
        if not prefixes:
            return rows, hashes
        base = np.cumsum([0] + [int(w[2][-1]) + 1 if len(w[2]) else 0 for _, w in steps])
        return rows, hashes, np.concatenate([w[2] + b for (_, w), b in zip(steps, base)]), [np.concatenate([w[3][k] for _, w in steps]) for k in range(len(prefixes))]
    if hi - lo > STEP_BYTES:
        return _in_pieces(texts, lo, hi, _SPACE if separators is None else separators, prefixes) if texts.null_count == 0 else none
    return _words(texts, lo, hi, offsets - lo, none, separators, prefixes)


def _in_pieces(texts: pa.Array, lo: int, hi: int, separators: np.ndarray, prefixes: tuple[int, ...]):
    """``words`` of one long text, a piece at a time; pieces end at separators."""
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=hi)[lo:]
    at, steps, base = 0, [], 0
    while at < len(data):
        end = at + STEP_BYTES
        while end < len(data) and not separators[data[end]]:
            near = np.flatnonzero(separators[data[end : end + 4096]])
            end = end + int(near[0]) if len(near) else end + 4096
        end = min(end, len(data))
        bounds = np.array([lo + at, lo + end], dtype=np.int64)
        piece = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(bounds), texts.buffers()[2]])
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [np.zeros(0, dtype=np.uint64)] * len(prefixes))
        found = _words(piece, lo + at, lo + end, bounds - bounds[0], none if prefixes else none[:2], separators, prefixes)
        steps.append((*found[:2], *((found[2] + base, found[3]) if prefixes else ())))
        base += int(_STOP[data[at:end]].sum())
        at = end
    rows, hashes = (np.concatenate([s[k] for s in steps]) for k in (0, 1))
    if not prefixes:
        return rows, hashes
    return rows, hashes, np.concatenate([s[2] for s in steps]), [np.concatenate([s[3][k] for s in steps]) for k in range(len(prefixes))]


def _words(texts: pa.Array, lo: int, hi: int, bounds: np.ndarray, none: tuple, separators: np.ndarray | None, prefixes: tuple[int, ...]):
    """``words`` of texts that are few bytes together."""
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=hi)[lo:]
    if texts.null_count:  # a null's bytes, if any, are not text
        data = data.copy()
        for i in np.flatnonzero(~texts.is_valid().to_numpy(zero_copy_only=False)):
            data[bounds[i] : bounds[i + 1]] = 0x20
    inside = ~(_SPACE if separators is None else separators)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return none
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
    ends = np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    value = _BYTE[data]
    value *= _powers("up", _BASE, len(data))
    np.cumsum(value, out=sums[1:])
    del value
    span = (sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(data) + 1)[starts]
    hashes = mix(span + mix((ends - starts).astype(np.uint64), 3))
    rows = np.searchsorted(bounds, starts, side="right") - 1
    if not prefixes:
        return rows, hashes
    stops = np.cumsum(_STOP[data])[starts] + rows  # a new row is a new sentence
    down = _powers("down", _INVERSE, len(data) + 1)[starts]
    heads = [mix((sums[np.minimum(starts + k, ends)] - sums[starts]) * down + np.uint64(k), 5) for k in prefixes]
    return rows, hashes, stops, heads
