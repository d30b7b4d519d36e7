"""Medians of pools that slide along dates."""

from __future__ import annotations

import numpy as np

#: Pools of up to so many prices are sorted side by side; larger ones are a histogram that slides.
SMALL = 128


def filled(date: np.ndarray, n: np.ndarray, starts: np.ndarray, width: int, least: int) -> np.ndarray:
    """For each group of rows (starts: where they begin), in order of date: whether any pool of width dates holds `least` prices and one of them.

    All groups are looked at side by side, as most of the rare ones have no such pool.
    """
    if not len(starts):
        return np.zeros(0, bool)
    key = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(date)))) * (int(date.max()) + width + 1) + date
    sums = np.concatenate([[0], np.cumsum(n)])
    size = sums[np.searchsorted(key, key + (width - 1), side="right")] - sums[:-1]
    return np.logical_or.reduceat(size >= max(1, least), starts)


def rolling(date: np.ndarray, price: np.ndarray, n: np.ndarray, first: int, last: int, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """date, size and median of the pools of width dates that end at each date from first to last, where they hold `least` prices and one of them.

    Rows are counts n of a price at a date, in order of date and price.
    """
    at = np.arange(first, last + 1)
    low, high = np.searchsorted(date, at - width, side="right"), np.searchsorted(date, at, side="right")
    sums = np.concatenate([[0], np.cumsum(n)])
    size = sums[high] - sums[low]
    told = np.flatnonzero(size >= max(1, least))
    at, low, high, size = at[told], low[told], high[told], size[told]
    if not len(at):
        return at, size, np.zeros(0)
    if size.max() <= SMALL:
        each = np.repeat(price, n)
        place = sums[low][:, None] + np.arange(size.max())
        pool = np.where(place < sums[high][:, None], each[np.minimum(place, len(each) - 1)], np.inf)
        pool.sort(axis=1)
        rows = np.arange(len(at))
        return at, size, (pool[rows, (size - 1) // 2] + pool[rows, size // 2]) / 2
    values, rank = np.unique(price, return_inverse=True)
    counts, median = np.zeros(len(values), np.int64), np.empty(len(at))
    a = b = 0
    for j in range(len(at)):
        if high[j] > b:
            np.add.at(counts, rank[b : high[j]], n[b : high[j]])
            b = high[j]
        if low[j] > a:
            np.subtract.at(counts, rank[a : low[j]], n[a : low[j]])
            a = low[j]
        upto = np.cumsum(counts)
        median[j] = (values[np.searchsorted(upto, (size[j] - 1) // 2, side="right")] + values[np.searchsorted(upto, size[j] // 2, side="right")]) / 2
    return at, size, median
