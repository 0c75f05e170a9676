"""Windows along the rows and columns of a tile of a raster, on flat arrays.

A flag is 0 (no), 2 (yes) or 1 (unknown), so that ``and`` and ``or`` are least and greatest; numbers are NaN where they are
unknown. Pixels may be missing: distances are those of rows and columns, steps go to the next pixel that is there.
"""

from __future__ import annotations

import numpy as np

NO, UNKNOWN, YES = 0, 1, 2


class Lines:
    """The pixels in their order along lines: ``line`` says which one each is on, and ``at`` where."""

    def __init__(self, line: np.ndarray, at: np.ndarray):
        self.order = np.lexsort((at, line))
        line, at = line[self.order], at[self.order]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        n = np.diff(np.append(first, len(line)))
        self.begin, self.end = np.repeat(first, n), np.repeat(first + n, n)
        low = at.min()
        self.place = np.repeat(np.arange(len(first)), n) * (at.max() - low + 1) + at - low
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def along(self, v: np.ndarray, of) -> np.ndarray:
        """What ``of`` makes of the values in order along the lines."""
        out = of(v[self.order])
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def step(self, v: np.ndarray, k: int) -> np.ndarray:
        """Values (in order) of the pixel k before, or -k after."""
        at = np.arange(len(v)) - k
        return np.where((at >= self.begin) & (at < self.end), v[np.clip(at, 0, len(v) - 1)], np.nan)

    def within(self, v: np.ndarray, radius: int) -> np.ndarray:
        """Sums of whole numbers (in order) of the pixels up to ``radius`` before and after."""
        if radius not in self.windows:
            low = np.searchsorted(self.place, self.place - radius, "left")
            high = np.searchsorted(self.place, self.place + radius, "right")
            self.windows[radius] = np.maximum(low, self.begin), np.minimum(high, self.end)
        low, high = self.windows[radius]
        total = np.concatenate([[0], np.cumsum(v, dtype=np.int64)])
        return total[high] - total[low]


class Tile:
    """Windows over rows, then columns."""

    def __init__(self, row: np.ndarray, col: np.ndarray):
        self.rows, self.columns = Lines(row, col), Lines(col, row)

    def blurred(self, v: np.ndarray, weights: list[float]) -> np.ndarray:
        """Mean by weights of distance 0, 1, ... in steps; pixels that are missing don't count."""
        for lines in (self.rows, self.columns):

            def mean(v: np.ndarray) -> np.ndarray:
                total, weight = np.zeros(len(v)), np.zeros(len(v))
                for k in range(1 - len(weights), len(weights)):
                    there = lines.step(v, k) if k else v
                    known = ~np.isnan(there)
                    total, weight = total + np.where(known, there * weights[abs(k)], 0.0), weight + np.where(known, weights[abs(k)], 0.0)
                return total / np.where(weight > 0, weight, np.nan)

            v = lines.along(v, mean)
        return v

    def edges(self, v: np.ndarray) -> np.ndarray:
        """Gradient by 3 x 3 differences, weighted 1, 2, 1 across their direction; mirrored at ends of lines."""
        beside = lambda lines, v, k: np.where(np.isnan(lines.step(v, -k)), lines.step(v, k), lines.step(v, -k))
        smooth = lambda lines, v: lines.along(v, lambda v: beside(lines, v, -1) + 2 * v + beside(lines, v, 1))
        slope = lambda lines, v: lines.along(v, lambda v: beside(lines, v, 1) - beside(lines, v, -1))
        x, y = smooth(self.columns, slope(self.rows, v)), slope(self.columns, smooth(self.rows, v))
        return np.sqrt(x * x + y * y)

    def share(self, flag: np.ndarray, radius: int) -> np.ndarray:
        """Share of yes among the known pixels of a square."""
        yes, known = flag == YES, flag != UNKNOWN
        for lines in (self.rows, self.columns):
            yes, known = (lines.along(x, lambda x: lines.within(x, radius)) for x in (yes, known))
        return yes / np.where(known > 0, known, np.nan)

    def grown(self, flag: np.ndarray, radius: int, shrink: bool = False) -> np.ndarray:
        """Yes where any known pixel of a square is yes (``shrink``: all are)."""
        wins, other = (NO, YES) if shrink else (YES, NO)
        for lines in (self.rows, self.columns):
            known = True if not (flag == UNKNOWN).any() else lines.along(flag != UNKNOWN, lambda x: lines.within(x, radius)) > 0
            any_ = lines.along(flag == wins, lambda x: lines.within(x, radius)) > 0
            flag = np.where(any_, wins, np.where(known, other, UNKNOWN)).astype(np.int8)
        return flag

    def opened(self, flag: np.ndarray, radius: int) -> np.ndarray:
        return self.grown(self.grown(flag, radius, shrink=True), radius)
