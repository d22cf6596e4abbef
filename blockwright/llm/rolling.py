"""Vectorised text primitives over the UTF-8 bytes of a batch of documents.

No Python object is made per word: a batch is one byte array with document offsets, words are
start/end arrays, and every hash is computed for the whole batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_STEP = U(0xD6E8FEB86659FD93)
_STEP2 = U(0xA0761D6478BD642F)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: White space of the contracts: space and U+0009..U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] of bytes, several times as fast as by index; the result may be written to."""
    return np.frombuffer(bytearray(data).translate(table.view(np.uint8).tobytes()), table.dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijective finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(1 << 16, n + n // 8)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(size, base, U)
            p[0] = U(1)
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def forget_powers() -> None:
    """Free the tables of powers; they are made again in a few milliseconds."""
    _POWERS[:] = [np.ones(1, U), np.ones(1, U)]


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words, and where each document's words begin (n + 1)."""
    inside = ~translated(data, separator)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0] * bool(inside[0]), edges, [n] * bool(inside[-1])]).astype(np.int64)
    starts, ends = edges[0::2], edges[1::2]
    cuts = np.unique(off[(off > 0) & (off < n)])
    cuts = cuts[inside[cuts - 1] & inside[cuts]]  # words that run on across a document border
    if len(cuts):
        at = np.searchsorted(starts, cuts)
        starts, ends = np.insert(starts, at, cuts), np.insert(ends, at - 1, cuts)
    return starts, ends, np.searchsorted(starts, off)


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over bytes from which spans are hashed, for those who hash spans of the same bytes more than once."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. held: prefix(data)."""
    sums, inverse = held or prefix(data)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Spans beyond this many bytes are hashed by running sums over their bytes alone.
_WIDE = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time: for spans that are short and don't overlap."""
    size = ends - starts
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    eight = np.ndarray(len(data) + 1, U, held, strides=(1,))  # the eight bytes from each place
    out = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(U) * _BASE)
    more, at = np.flatnonzero((size > 8) & (size <= _WIDE)), 8
    while len(more):
        rest = size[more] - at
        out[more] = mix((out[more] * _STEP) ^ (eight[starts[more] + at] & _MASKS[np.minimum(rest, 8)]))
        more, at = more[rest > 8], at + 8
    wide = np.flatnonzero(size > _WIDE)
    if len(wide):
        stop = np.cumsum(size[wide])
        out[wide] = span_hashes(data[spans(starts[wide], size[wide])], stop - size[wide], stop)
    return out


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans, one span behind the other."""
    stop = np.cumsum(size)
    out = np.repeat(begin - (stop - size), size)
    out += np.arange(len(out))
    return out


def byte_windows(data: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of all k-byte strings by start, document borders not looked at. held: prefix(data)."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    sums, inverse = held or prefix(data)
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def word_windows(values: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hashes of k consecutive values by start; second: an independent family."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if second:
        values = mix(values + _STEP2)
    step = _STEP2 if second else _STEP
    h = values[:n].copy()
    for j in range(1, k):
        h *= step
        h += values[j : j + n]
    return mix(h)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """For each start of k words of the batch: does one document hold all of them?"""
    doc = doc_of(first)
    return doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def cover(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in a flagged window of k."""
    flags = flags[: max(0, n - k + 1)]
    depth = np.zeros(n + 1, np.int32)
    depth[: len(flags)] += flags
    depth[k : k + len(flags)] -= flags
    return np.cumsum(depth[:n]) > 0


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the maximal runs of mask that don't cross a document border."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    cuts = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(mask))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def keep_words(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each document joined by one space."""
    n, nd = len(data), len(off) - 1
    edge = np.zeros(n + 1, np.int8)
    edge[starts[kept]] += 1
    edge[ends[kept]] -= 1
    take = np.cumsum(edge[:n], dtype=np.int8).view(bool)
    out = data.copy()
    index = np.flatnonzero(kept)
    doc = doc_of(first)[index]
    more = index[:-1][doc[:-1] == doc[1:]] if len(index) > 1 else index[:0]
    glue = ends[more]
    out[glue] = 0x20
    take[glue] = True
    sizes = np.bincount(doc, weights=ends[index] - starts[index], minlength=nd) + np.bincount(doc_of(first)[more], minlength=nd)
    return strings(out[take], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off.astype(np.int32))), pa.py_buffer(np.ascontiguousarray(data)))
