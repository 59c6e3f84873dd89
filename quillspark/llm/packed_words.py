"""Words of texts in one flat buffer, each followed by one space."""

from __future__ import annotations

import numpy as np

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def packed_words(flat: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word offsets, words of each text) of texts that lie in ``flat`` between ``offsets``.

    A word is a run of bytes other than the space and 9 to 13; it goes from one
    word offset to the next, the space behind it included. ``lower`` lowers A-Z.
    """
    flat = np.insert(_lower[flat] if lower else flat, offsets[1:], 32)  # no word goes on in the next text
    offsets = offsets + np.arange(len(offsets))
    gap = _space[flat]
    start = ~gap
    start[1:] &= gap[:-1]
    behind = gap.copy()
    behind[1:] &= ~gap[:-1]
    behind[:1] = False
    flat[behind] = 32
    first = np.flatnonzero(start)
    count = np.diff(np.searchsorted(first, offsets))
    keep = ~gap | behind
    size = np.flatnonzero(behind) + 1 - first
    return flat[keep], np.r_[0, np.cumsum(size)], count
