"""Compact payloads: sorted fingerprints and flags of a batch, one row for each shard.

A batch sends each shard one binary value instead of a row per key. Sorted keys go as differences
in byte planes under zstd, which costs two to three bytes a key instead of the 16 or more of a row.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

U = np.uint64
_KINDS = "BHIQq?"
_CODEC = None


def _codec() -> pa.Codec:
    global _CODEC
    _CODEC = _CODEC or pa.Codec("zstd", compression_level=1)
    return _CODEC


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers or flags as one compressed value."""
    head, body = [], []
    for a in arrays:
        if a.dtype == bool:
            head.append(struct.pack("<cI", b"?", len(a)))
            body.append(np.packbits(a).tobytes())
        else:
            head.append(struct.pack("<cI", a.dtype.char.replace("L", "Q").replace("l", "q").encode(), len(a)))
            body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = struct.pack("<B", len(arrays)) + b"".join(head) + b"".join(body)
    return struct.pack("<I", len(raw)) + _codec().compress(raw, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = _codec().decompress(value[4:], struct.unpack_from("<I", value)[0], asbytes=True)
    n, at = raw[0], 1
    kinds = []
    for _ in range(n):
        kinds.append(struct.unpack_from("<cI", raw, at))
        at += 5
    out = []
    for kind, size in kinds:
        if kind == b"?":
            width = (size + 7) // 8
            out.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size).astype(bool))
        else:
            dtype = np.dtype(kind.decode())
            width = size * dtype.itemsize
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, width, at).reshape(dtype.itemsize, size).T).view(dtype).reshape(size))
        at += width
    return out


def differences(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys; sums() is the inverse."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    return out


def sums(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas, dtype=U)


def by_shard(shards: np.ndarray):
    """(shard, slice) for each value of the sorted shards."""
    if len(shards):
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            yield int(shards[a]), slice(a, b)


def shard_of(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Ranges of the key space, so shards of sorted keys are slices."""
    return ((keys >> U(max(0, bits - 32))) * U(n) >> U(min(bits, 32))).astype(np.int64)


def rows(schema: pa.Schema, values: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([v[k] for v in values], f.type) for k, f in enumerate(schema)], schema=schema)
