"""Search for the first value outside a band, many searches at once."""

from __future__ import annotations

import numpy as np


class Extremes:
    """Lowest or highest value of every aligned power-of-two stretch, to skip quiet ones."""

    def __init__(self, values: np.ndarray, pick: np.ufunc, filler: float):
        levels = [values]
        while len(levels[-1]) > 1:
            below = levels[-1]
            if len(below) % 2:
                below = np.append(below, below.dtype.type(filler))
            levels.append(pick(below[0::2], below[1::2]))
        self.top = len(levels) - 1
        self.offset = np.cumsum([0, *(len(level) for level in levels[:-1])])
        self.flat = np.concatenate(levels)

    def first(self, start: np.ndarray, stop: np.ndarray, outside) -> np.ndarray:
        """Per search the first index in [start, stop) where ``outside(value, search)``, else -1.

        All searches move at once: a stretch without a hit is jumped over and the next one
        doubles where it can; a stretch with a hit is halved down to the row.
        """
        found = np.full(len(start), -1)
        at, level = start.copy(), np.zeros(len(start), dtype=np.int64)
        live = np.flatnonzero(at < stop)
        while live.size:
            k, pos = level[live], at[live]
            hit = outside(self.flat[self.offset[k] + (pos >> k)], live)
            row = hit & (k == 0)
            found[live[row]] = pos[row]
            after = np.where(hit, pos, pos + (1 << k))
            wider = ~hit & (k < self.top) & (after & ((2 << k) - 1) == 0)
            at[live], level[live] = after, k + wider - (hit & (k > 0))
            live = live[~row & (after < stop[live])]
        return found
