"""Order statistics of windows in numpy, without an array for each row."""

from __future__ import annotations

import numpy as np


def window_ranks(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place i: how many of values[begin[i] : i] are below values[i], and how many equal it. Values are comparable (no NaN).

    A tree of sorted runs: a window is a union of at most two aligned runs of each length 1, 2, 4, ..., and all places
    look their runs of one length up in a single sorted array. Costs n log(n) ** 2, whatever the windows' lengths.
    """
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    less, equal = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low, high, size, place = begin.astype(np.int64).copy(), np.arange(n), 1, np.arange(n)
    while True:
        open_ = low < high
        if not open_.any():
            return less, equal
        run = place // size
        order = np.sort(run * n + rank)  # runs of this length, each sorted
        for some, at in (
            (open_ & (low // size % 2 == 1), low // size),
            (open_ & (high // size % 2 == 1), high // size - 1),
        ):
            i = np.flatnonzero(some)
            first = np.searchsorted(order, at[i] * n + rank[i])
            less[i] += first - at[i] * size
            equal[i] += np.searchsorted(order, at[i] * n + rank[i], side="right") - first
        low = np.where(open_ & (low // size % 2 == 1), low + size, low)
        high = np.where(open_ & (high // size % 2 == 1), high - size, high)
        size *= 2
