"""Orders by several whole numbers at once.

NumPy sorts plain 64-bit numbers several times faster than it sorts indices, so keys that fit are packed into one number together
with the place, and the sorted numbers hold the order.
"""

from __future__ import annotations

import numpy as np


def packed_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by keys of whole numbers, the first key first; negative or wide ones are sorted as indices."""
    n = len(keys[0])
    place = n.bit_length()
    if not n:
        return np.zeros(0, np.int64)
    widths = [int(k.max()).bit_length() for k in keys]
    if sum(widths) + place > 63 or any(int(k.min()) < 0 for k in keys):
        return np.lexsort(keys[::-1])
    packed = np.zeros(n, np.int64)
    for key, width in zip(keys, widths, strict=True):
        packed <<= width
        packed |= key.astype(np.int64, copy=False)
    packed <<= place
    packed |= np.arange(n)
    packed.sort()
    packed &= (1 << place) - 1
    return packed


def grouped_order(key: np.ndarray) -> np.ndarray:
    """A stable order that brings equal numbers of up to 63 bits together, ascending by their upper bits.

    As many upper bits as there is room for are sorted with the place; if numbers that differ agree in them, it is done by indices.
    """
    n = len(key)
    place = n.bit_length()
    shift = max(int(key.max()).bit_length() + place - 63, 0) if n else 0
    order = packed_order(key >> key.dtype.type(shift))
    if shift:
        sorted_ = key[order]
        new = np.flatnonzero(sorted_[1:] != sorted_[:-1])
        above = sorted_[new] >> key.dtype.type(shift) if len(new) else new
        if (above == sorted_[new + 1] >> key.dtype.type(shift)).any():
            return np.argsort(key, kind="stable")
    return order
