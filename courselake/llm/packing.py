"""Number blocks that travel as binary values: byte planes, compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.copy()
    return len(a).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = pa.Codec("zstd").decompress(data[8:], n * kind.itemsize, asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted uint64 values, as differences."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def bucket_edges(ordered: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket of hash space begins in ``ordered``, sorted hashes of ``bits`` bits."""
    bounds = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(ordered, bounds), len(ordered)]
