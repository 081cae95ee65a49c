"""Word shingles of text batches, hashed in numpy."""

from __future__ import annotations

import numpy as np

from .scan import _mix, joined, slice_hashes

WORDS = 5


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Ascending distinct 63-bit hashes of the runs of ``n`` words of each text; a text of fewer
    words has one shingle, of all its words; a text without words has none.  Words are runs of
    characters other than space and the controls 9 to 13."""
    _, codes, bounds = joined(texts)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    white[bounds[1:] - 1] = True
    edge = np.diff(np.concatenate([[1], white.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = slice_hashes(codes, starts, ends)
    cut = np.searchsorted(starts, bounds)
    out = []
    with np.errstate(over="ignore"):
        total = word[: max(0, len(word) - n + 1)].copy()
        for k in range(1, n):
            total = _mix(total) + word[k : k + len(total)]
        total = _mix(total) >> np.uint64(1)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(total[a : b - n + 1]).astype(np.int64))
            else:
                x = np.full(min(1, b - a), b - a, np.uint64)
                for w in word[a:b]:
                    x = _mix(x) + w
                out.append((_mix(x) >> np.uint64(1)).astype(np.int64))
    return out
