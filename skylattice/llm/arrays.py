"""Ranges of flat arrays, gathered side by side."""

from __future__ import annotations

import numpy as np


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


def starts(n: np.ndarray) -> np.ndarray:
    """Where ranges of ``n`` elements begin, and the end of the last one."""
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(n, dtype=np.int64)])
