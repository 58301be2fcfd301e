"""Vectorised hashing of words, shingles and character n-grams over Arrow string batches, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits parts words here; bytes of longer characters never do.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[:128] = [not chr(i).isalnum() for i in range(128)]

CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P)], dtype=np.uint64)
            _IPOW = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INV)], dtype=np.uint64)
    return _POW, _IPOW


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about size bytes (a longer document is a run of its own): (first, end, bytes, offsets)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _runs(data: np.ndarray, edges: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, unmixed hashes) of the words of one block; edges are the places where documents begin."""
    n = len(data)
    inside = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        return starts, stops, (total[stops] - total[starts]) * inverse[starts]


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE, block: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the offsets of the documents in them.

    Bytes are taken block by block, so that room beyond the result doesn't grow with a text; the hash of a word that
    a block's end cuts is carried on.
    """
    found, places, run = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for low in range(0, len(data), block):
        high = min(len(data), low + block)
        edges = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        starts, stops, part = _runs(data[low:high], edges, parts)
        ahead = int(stops[-1] - starts[-1]) if len(stops) and stops[-1] == high - low else 0
        if run and len(starts) and starts[0] == 0 and not (len(edges) and edges[0] == 0):
            with np.errstate(over="ignore"):
                found[-1][-1] += np.uint64(pow(int(_P), run, 1 << 64)) * part[0]
            ahead += run if ahead and len(starts) == 1 else 0
            starts, part = starts[1:], part[1:]
        run = ahead
        if len(starts):
            found.append(part)
            places.append(starts + low)
    return mix(np.concatenate(found)), np.searchsorted(np.concatenate(places), offsets)


def shingles(found: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words; a document of fewer words is one run, one of none has none."""
    count = np.diff(offsets)
    padded = np.where(count > 0, np.maximum(count, width), 0)
    at = np.r_[0, np.cumsum(padded)]
    row = np.full(at[-1], np.uint64(0x5851F42D4C957F2D))
    row[np.arange(len(found)) + np.repeat(at[:-1] - offsets[:-1], count)] = found
    valid = np.ones(len(row), bool)
    some = at[1:][padded > 0]
    for k in range(1, width):
        valid[some - k] = False
    run = row.copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            run[:-k] = run[:-k] * np.uint64(0xD6E8FEB86659FD93) + row[k:]
            run[len(run) - k :] = 0
    keep = np.where(padded > 0, padded - width + 1, 0)
    return mix(run[valid]), np.r_[0, np.cumsum(keep)]


def distinct(found: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes within each document."""
    found = found.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        found[a:b].sort()
    keep = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    keep[offsets[:-1][offsets[:-1] < len(found)]] = True
    return found[keep], np.r_[0, np.cumsum(keep)][offsets]


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int, block: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document and their offsets; the runs of a long document are taken in blocks."""
    found, word_at = words(data, at, NOT_WORD)
    if len(at) > 2 or len(found) <= block:
        return distinct(*shingles(found, word_at, width))
    sets = np.zeros(0, np.uint64)
    for low in range(0, len(found) - width + 1, block):
        part = found[low : low + block + width - 1]
        sets = np.union1d(sets, shingles(part, np.array([0, len(part)]), width)[0])
    return sets, np.array([0, len(sets)])


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each document's values as one binary value."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())])
