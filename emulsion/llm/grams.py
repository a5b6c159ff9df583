"""Byte n-grams of a text as small integers."""

from __future__ import annotations

import numpy as np

BITS = 18
SIZE = 1 << BITS


def trigram_codes(text: str | None) -> np.ndarray:
    """A code below SIZE for each three bytes in a row of the UTF-8 text, with a space before and after."""
    b = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int32)
    whole = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (whole * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32)
