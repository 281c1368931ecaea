"""Spans found in texts: the digest of a text's base spans and how spans are written."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the order of ``kinds``."""
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, kinds.index(k), e, k) for s, e, k in spans))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def overlaps(start: int, end: int, spans: list[tuple[int, int, str]]) -> bool:
    return any(start < e and s < end for s, e, _ in spans)
