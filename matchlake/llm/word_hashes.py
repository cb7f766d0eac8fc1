"""64-bit hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words a task remembers (about 35 MB); then it starts anew.
KEPT_WORDS = 200_000
BASE, OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_known: dict[bytes, int] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def rolling(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``width`` words; document ends are not looked at."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= base
        out += words[k:k + n]
    spare = out >> np.uint64(31)  # as mix does, in place
    out ^= spare
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= np.right_shift(out, np.uint64(29), out=spare)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= np.right_shift(out, np.uint64(32), out=spare)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _known
    new = set(words).difference(known)
    if new:
        if len(known) > KEPT_WORDS:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
