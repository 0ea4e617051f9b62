"""Helpers for functions that scan sorted partitions batch by batch."""

from __future__ import annotations

import numpy as np


def equal_runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges over which all columns stay equal."""
    size = len(columns[0])
    if size == 0:
        return []
    change = np.zeros(size - 1, dtype=bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), size]
    return list(zip(edges[:-1], edges[1:]))
