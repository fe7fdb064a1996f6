"""Numpy arrays as one compressed value of a column."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def narrow(x: np.ndarray) -> np.ndarray:
    """x, whose numbers aren't negative, in the smallest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays, byte by byte of their items (all lowest bytes first), as high bytes are mostly alike."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        head.append(struct.pack("<3sQ", a.dtype.str.encode(), raw.nbytes))
        body.append(raw.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else raw.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    """What ``pack`` was given."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1 + 11 * raw[0]
    for i in range(raw[0]):
        kind, size = struct.unpack_from("<3sQ", raw, 1 + 11 * i)
        kind = np.dtype(kind.decode())
        part = np.frombuffer(raw, np.uint8, size, at)
        out.append(part.reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1) if kind.itemsize > 1 else part.view(kind))
        at += size
    return out
