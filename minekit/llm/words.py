"""Words of a text as 64-bit hashes: A-Z lower-cased, parted at the ASCII white space."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD_A, ODD_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words a worker remembers the hash of.
REMEMBERED = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the outcome depends on every bit of the number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * ODD_B
        x = (x ^ (x >> np.uint64(29))) * ODD_A
    return x ^ (x >> np.uint64(32))


_HELD: dict = {}


def held(name: str, make: Callable):
    """What a worker keeps for one operator; a worker outlives a stage, so what was kept for another one goes first."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def word_hashes() -> dict[bytes, int]:
    return held("word hashes", dict)


def hashed_words(text: str) -> np.ndarray:
    import xxhash

    known, words = word_hashes(), text.encode().translate(ASCII_LOWER).split()
    if len(known) > REMEMBERED:
        known.clear()
    out = []
    for word in words:
        h = known.get(word)
        if h is None:
            h = known[word] = xxhash.xxh3_64_intdigest(word)
        out.append(h)
    return np.array(out, dtype=np.uint64)
