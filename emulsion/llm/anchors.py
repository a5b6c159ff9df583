"""Content-chosen positions (winnowing): every window of LENGTH bytes is filed under one of its own Q-grams.

A window's anchor is the start of the Q-gram with the least hash inside it, the rightmost on ties, so that equal windows have
equal anchors at equal distances. The windows of an anchor are neighbours.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed, powers

LENGTH, Q = 200, 32
REACH = LENGTH - Q  # the farthest that an anchor lies inside its window
#: Windows worked through at once.
CHUNK = 1 << 21
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places and first windows: anchor i serves the windows first[i] to first[i + 1] - 1."""
    parts = [_chunk(data, at) for at in range(0, len(data) - LENGTH + 1, CHUNK)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, place, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.concatenate([[True], np.diff(place) != 0])
    return key[new], place[new], first[new]


def _chunk(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    windows = min(CHUNK, len(data) - LENGTH + 1 - at)
    raw = np.frombuffer(data, np.uint8, windows + LENGTH - 1, at).astype(np.uint64) + np.uint64(1)
    up, down = powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)])
    gram = mixed((total[Q:] - total[:-Q]) * down[: len(raw) - Q + 1])
    value = (gram & ~_PLACE) | (_PLACE - np.arange(len(gram), dtype=np.uint64))
    span = REACH + 1
    blocks = np.concatenate([value, np.full(-len(value) % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    first = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    place = (_PLACE - (least[first] & _PLACE)).astype(np.int64)
    return gram[place], place + at, first + at


def last_windows(size: int, first: np.ndarray) -> np.ndarray:
    """The last window of each anchor of a text of ``size`` bytes."""
    return np.append(first[1:] - 1, size - LENGTH)[: len(first)]
