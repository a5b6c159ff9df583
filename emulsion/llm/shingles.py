"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the input sways each bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    one = np.ones(1, np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    return tuple(np.concatenate([one, np.multiply.accumulate(np.full(n, b, np.uint64))]) for b in (_BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(18, int(n).bit_length()))


#: Bytes whose words are hashed at once; the tables of powers are as long.
CHUNK = 1 << 18


def _long_word(data: np.ndarray) -> np.uint64:
    """The hash of one word of any length, a chunk at a time."""
    total, power, base = 0, 1, int(_BASE)
    up, _ = powers(CHUNK)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * power
        power = power * pow(base, len(part), 2**64) % 2**64
    return mixed(np.array([(total + len(data)) % 2**64], np.uint64))[0]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, cut at ASCII white space) and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    if len(end) < len(start):
        end = np.append(end, len(data))
    up, down = powers(CHUNK)
    hashes, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        first = start[at]
        stop = max(at + 1, int(np.searchsorted(end, first + CHUNK, side="right")))
        last = end[stop - 1]
        if last - first > CHUNK:
            hashes[at] = _long_word(data[first:last])
        else:
            raw = data[first:last].astype(np.uint64) + np.uint64(1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)])
            s, e = start[at:stop] - first, end[at:stop] - first
            hashes[at:stop] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return hashes, counts


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``k`` words of each text; of fewer words, all of them as one; without words, none."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    run = hashes[: max(0, n - k + 1)].copy()
    for j in range(1, k):
        run = mixed(run * _MIX2 + hashes[j : n - k + 1 + j])
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(run[at : at + c - k + 1]))
        elif c:
            whole = np.array([c], np.uint64)
            for h in hashes[at : at + c]:
                whole = mixed(whole * _MIX2 + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def min_hashes(sets: list[np.ndarray], n: int, seed: int = 2) -> np.ndarray:
    """(sets, n) minima under ``n`` hash functions; sets must not be empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.stack([np.minimum.reduceat(flat * a[j] + b[j], start) for j in range(n)], axis=1)
