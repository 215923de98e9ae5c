"""Hashes of words in a byte buffer, all words side by side."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _Q
    return h ^ (h >> np.uint64(29))


def hash_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word data[start : start + size]."""
    by_size = np.argsort(-sizes, kind="stable")
    at, left = starts[by_size].astype(np.int64), sizes[by_size]
    h = left.astype(np.uint64) * _Q
    live = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), "right")
    mask = (1 << 64) - 1
    for k, n in enumerate(live.tolist()):
        if n <= 4:  # a few very long words are left
            for i in range(n):
                v = int(h[i])
                for b in data[at[i] + k : at[i] + left[i]].tolist():
                    v = ((v ^ b) * int(_P)) & mask
                    v ^= v >> 32
                h[i] = v
            break
        v = (h[:n] ^ data[at[:n] + k]) * _P
        h[:n] = v ^ (v >> np.uint64(32))
    out = np.empty_like(h)
    out[by_size] = mix(h)
    return out
