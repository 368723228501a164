"""Anchors: a sparse choice of positions that two equal windows always agree on.

Of the q-grams in a window of ``size`` symbols, the anchor is the leftmost one with the smallest hash.  It depends on
the window's content alone, so equal windows have equal anchors at equal places.  Consecutive windows mostly share
their anchor: a *run* is all starts of windows with one anchor, and its *context* is everything that its windows cover.
To find equal windows, it is enough to compare contexts whose anchors have the same q-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from spanloom.llm.textnp import U64

_POSITION = 24


@dataclass
class Runs:
    """start: of the first window; count: of windows; ahead: from the first window's start to the anchor; gram: its hash."""

    start: np.ndarray
    count: np.ndarray
    ahead: np.ndarray
    gram: np.ndarray


def anchor_runs(grams: np.ndarray, starts: np.ndarray, width: int) -> Runs:
    """grams: hash of the q-gram at each position (of any q-gram, also across documents).  starts: positions where
    windows begin, in order; all q-grams of a window lie in its document.  width: q-grams in a window."""
    parts = []
    step = 1 << (_POSITION - 1)
    for lo in range(0, len(grams), step):
        own = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + step)]
        if len(own):
            parts.append(_runs(grams, own, width))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, np.zeros(0, dtype=U64))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _runs(grams: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lo = int(starts[0])
    piece = grams[lo : int(starts[-1]) + width]
    low = U64((1 << _POSITION) - 1)
    smallest = (piece & ~low) | np.arange(len(piece), dtype=U64)
    span = 1
    while span * 2 <= width:
        smallest = np.minimum(smallest[:-span], smallest[span:])
        span *= 2
    if span < width:
        smallest = np.minimum(smallest[: len(piece) - width + 1], smallest[width - span :])
    anchor = (smallest[starts - lo] & low).astype(np.int64) + lo
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    return starts[at], np.diff(np.append(at, len(starts))), anchor[at] - starts[at], grams[anchor[at]]
