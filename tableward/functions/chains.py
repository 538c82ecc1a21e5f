"""Greedy grouping of sorted times: each group spans at most ``width`` back from its newest time."""

from __future__ import annotations

import numpy as np

END = np.iinfo(np.int64).max


def transfer(times: np.ndarray, chunk_end: int, width: int) -> list[tuple[int, int]]:
    """What a chunk of ascending times does to the greedy scan running from new to old.

    The scan enters with a bound: the next group starts at the largest time below it.  Returns
    (lowest start, bound on leaving) for every start the scan can have, equal exits merged.
    """
    following = np.searchsorted(times, times - width, side="left") - 1
    last = np.where(following < 0, np.arange(len(times)), following)
    while True:
        jumped = last[last]
        if np.array_equal(jumped, last):
            break
        last = jumped
    exits = times[last] - width
    first = max(np.searchsorted(times, chunk_end - width, side="left") - 1, 0)
    steps: list[tuple[int, int]] = []
    for start, leaving in zip(times[first:].tolist(), exits[first:].tolist()):
        if not steps or steps[-1][1] != leaving:
            steps.append((start, leaving))
    return steps


def enter(steps: list[tuple[int, int]], bound: int) -> int:
    """The bound with which the scan leaves a chunk it entered with ``bound``."""
    leaving = bound
    for start, exit_bound in steps:
        if start < bound:
            leaving = exit_bound
    return leaving


def label(times: np.ndarray, bound: int, width: int) -> np.ndarray:
    """The newest time of the group of each time; the scan enters with ``bound``."""
    anchors = np.empty(len(times), dtype=np.int64)
    top = len(times)
    if bound != END:
        below = int(np.searchsorted(times, bound, side="left"))
        anchors[below:top] = bound + width
        top = below
    while top > 0:
        anchor = times[top - 1]
        below = int(np.searchsorted(times, anchor - width, side="left"))
        anchors[below:top] = anchor
        top = below
    return anchors
