"""Numbers of a group in one binary cell."""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray, kind: str) -> bytes:
    """Bytes of equal weight side by side: small numbers leave zeros that the shuffle compresses."""
    a = np.ascontiguousarray(np.asarray(values).astype(kind))
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unplanes(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).ravel()
