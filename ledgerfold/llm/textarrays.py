"""Texts of an Arrow batch as byte arrays, so that work on characters and words is done by NumPy.

A batch is handled in slices of some 100 kB of text (or one longer text), which bounds the memory of a task
by the longest text and keeps the temporary arrays in the processor's cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_TEXTS = 1 << 18, 1 << 12


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and where each text begins and, one further, ends. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, first = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[first : first + n + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of SLICE_TEXTS texts at most that have `most` bytes at most, or are a single longer one."""
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, i + SLICE_TEXTS, max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_place = [np.zeros(0, np.uint64)]


def _places(n: int) -> np.ndarray:
    """A 64-bit number for each of the first n places of a span. Tables for more than a slice are not kept."""
    if n > len(_place[0]):
        table = mix(np.arange(max(n, SLICE_BYTES), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        if n > SLICE_BYTES:
            return table
        _place[0] = table
    return _place[0][:n]


def _spread(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all bytes of the spans, in order: their places in their spans, and in the data."""
    before = np.cumsum(size) - size
    own = np.arange(int(size.sum())) - np.repeat(before, size)
    return own, own + np.repeat(starts, size)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand: the sum of unrelated numbers for
    every (byte, place in the span)."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    own, at = _spread(starts, size)
    with np.errstate(over="ignore"):
        x = _BYTE[data[at]] ^ _places(int(size.max()))[own]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        stop = np.cumsum(size)
        return mix(sums[stop] - sums[stop - size] + size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first span of every distinct content, and which of these each span equals. Spans of one hash are compared
    byte by byte, so the result doesn't rest on hashes."""
    _, first, which = np.unique(span_hashes(data, starts, ends) if hashes is None else hashes, return_index=True, return_inverse=True)
    size, like = ends - starts, first[which]
    if (size == size[like]).all():
        own, at = _spread(starts, size)
        if (data[at] == data[own + np.repeat(starts[like], size)]).all():
            return first, which
    held: dict[bytes, int] = {}  # different contents of one hash
    first, which, raw = [], np.zeros(len(starts), np.int64), data.tobytes()
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        content = raw[a:b]
        if content not in held:
            held[content] = len(held)
            first.append(k)
        which[k] = held[content]
    return np.array(first, np.int64), which


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points in a row, and where each text's begin and, one further, end."""
    raw = data.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:  # not UTF-8: each text alone, wrong bytes replaced
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), count[at]


def gram_slots(points: np.ndarray, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place, the slot (below 2 ** bits) of the n code points from there, and whether they are all of
    one text. Slots of different n are unrelated."""
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        h = np.full(size, n * 0x51ED27, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9FB21C651E98DF25) + points[k : k + size]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.ones(size, bool)
    for k in range(1, n):
        last = at[1:] - k
        whole[last[(last >= 0) & (last < size)]] = False
    return (h >> np.uint64(64 - bits)).astype(np.int64), whole


def sums_by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values at each text's places. values may end earlier than the last text."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.minimum(at, len(values))
    return total[ends[1:]] - total[ends[:-1]]
