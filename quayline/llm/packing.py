"""Numbers as compressed bytes, for blocks that travel through shuffles."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray, width: int | None = None) -> bytes:
    """Numbers byte plane by byte plane, compressed; of little-endian numbers only the
    lowest ``width`` bytes if that is given."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(-1, raw.dtype.itemsize)[:, :width].T if len(raw) else raw.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind, width: int | None = None) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    if not len(raw):
        return np.zeros(0, kind)
    whole = np.zeros((len(raw) // (width or size), size), np.uint8)
    whole[:, : width or size] = raw.reshape(width or size, -1).T
    return whole.view(kind).reshape(-1)
