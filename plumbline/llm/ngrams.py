"""Hashed character n-grams of whole texts, in numpy over bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def blocks(texts: list[str | None], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of about BLOCK characters at a time, over all texts.

    Yields (codes, text numbers, first position by segment, own length by segment). A text longer than a block gives
    several segments; each has ``longest - 1`` more characters than its own, so that no n-gram is lost or counted twice.
    """
    parts: list[str] = []
    who: list[int] = []
    own: list[int] = []
    size = 0

    def emit():
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        return codes, np.array(who, np.int64), np.cumsum(n) - n, np.array(own, np.int64)

    for i, t in enumerate(texts):
        t = (t or "").lower()
        for at in range(0, len(t), BLOCK):
            seg = t[at : at + BLOCK + longest - 1]
            parts.append(seg)
            who.append(i)
            own.append(min(BLOCK, len(t) - at))
            size += len(seg)
            if size >= BLOCK:
                yield emit()
                parts, who, own, size = [], [], [], 0
    if parts:
        yield emit()


def slots(texts: list[str | None], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block and order: (slot of each character position, text numbers, first position by segment).

    Positions where no n-gram of that order begins have slot ``1 << bits``.
    """
    for codes, who, first, own in blocks(texts, max(orders)):
        length = np.diff(np.append(first, len(codes)))
        h = codes.astype(np.uint64)
        for n in range(1, max(orders) + 1):
            if n > 1:
                h = h[:-1] * _MULT + codes[n - 1 :]
            if n not in orders:
                continue
            mixed = (h ^ (h >> np.uint64(31))) * _MULT
            slot = np.full(len(codes), 1 << bits, np.int32)
            slot[: len(h)] = (mixed >> np.uint64(64 - bits)).astype(np.int32)
            for a, m, k in zip(first.tolist(), length.tolist(), own.tolist(), strict=True):
                slot[a + max(0, min(k, m - n + 1)) : a + m] = 1 << bits
            yield slot, who, first
