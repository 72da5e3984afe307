"""Keys that order points of a grid along a Hilbert curve, in any dimension."""

from __future__ import annotations

import numpy as np


def keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """One key a row of ``cells`` (rows, dims; integers of ``bits`` bits); keys
    compare as byte strings.

    From the highest bit down, a point's half along each dimension turns the
    coordinates below that bit: in an upper half the first dimension is
    mirrored, in a lower half it changes places with this one.  The halves,
    read as a Gray code over all dimensions, are the place on the curve.
    """
    x = cells.astype(np.uint32).T.copy()
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(len(x)):
            upper = (x[i] >> np.uint32(b)) & np.uint32(1) == 1
            swap = np.where(upper, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(b)) & np.uint32(1) == 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    flags = np.stack([(x[i] >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1) for i in range(len(x))], axis=1)
    return [r.tobytes() for r in np.packbits(flags.astype(np.uint8), axis=1)]
