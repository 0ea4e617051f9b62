"""Tokens of depth-camera text files."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np

BODY_FIELDS = 9  # body-level tokens after the id (fixed value)
JOINT_FIELDS = 12  # numbers per joint line (fixed value)


def skeleton_rows(words: Iterator[str]) -> Iterator[tuple[int, int, int, str | None, np.ndarray]]:
    """(num_frames, frame, pos, body_id, values) per tracked body; first a header with frame -1."""
    total = int(next(words))
    yield total, -1, -1, None, np.empty(0)
    for frame in range(total):
        for pos in range(int(next(words))):
            head = list(islice(words, 1 + BODY_FIELDS))
            if len(head) <= BODY_FIELDS:
                raise ValueError(f"the file ends inside frame {frame}")
            size = int(next(words)) * JOINT_FIELDS
            values = np.fromiter(map(float, islice(words, size)), np.float64)
            if len(values) < size:
                raise ValueError(f"the file ends inside frame {frame}")
            yield total, frame, pos, head[0], values
