"""Finite-state scanning of text batches in numpy.

A pre-tokenizer is compiled to a small deterministic transducer over character classes.  To run it
on a batch, the characters are cut into chunks; every chunk is mapped from each entry state to its
exit state, all chunks in lockstep; a parallel prefix scan composes these maps, which gives every
chunk its true entry state; a second lockstep pass then emits the token starts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

#: Stand-ins that no text can hold (lone surrogates): end of a text, and an added token in a text.
STOP, ADDED = "\ud801", "\ud800"
#: Characters taken in one go.
BATCH_CHARS = 1 << 21
CHUNK = 512

OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, SINGLE, NEEDS_E, ELL, E, MARK = range(11)
CLASSES = 11
NOW, BEFORE = 1, 2  # a token starts at this character; at the one before it


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            out[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = c
    out[0x1C:0x20] = OTHER  # \s here is White_Space
    for text, c in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", SINGLE), ("rv", NEEDS_E), ("l", ELL), ("e", E), (STOP + ADDED, MARK)):
        for x in text:
            out[ord(x)] = c
    return out


LETTERS = (LETTER, SINGLE, NEEDS_E, ELL, E)
START, LET, NUM, PUN, SP1, WS1, SPN, WSN, APO, APO_E, APO_L = range(11)
STATES = 11


@lru_cache(2)
def compiled(keep_white: bool) -> tuple[np.ndarray, np.ndarray]:
    """(next state, flags), by state * CLASSES + class.

    ``keep_white``: white space belongs to tokens and a space leads the next one, and numbers run
    together.  Else white space stands between tokens and each number character is a token.
    """
    step, flag = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    fresh = {OTHER: PUN, NUMBER: NUM, SPACE: SP1, WHITE: WS1, APOSTROPHE: APO, MARK: START} | dict.fromkeys(LETTERS, LET)
    if not keep_white:
        fresh |= {SPACE: START, WHITE: START}
    for q in range(STATES):
        for c in range(CLASSES):
            to, out = fresh[c], NOW
            if c != MARK:
                if q == LET and c in LETTERS or q == NUM and c == NUMBER and keep_white or q == PUN and c in (OTHER, APOSTROPHE):
                    to, out = q, 0
                elif q == APO and c in (OTHER, APOSTROPHE):
                    to, out = PUN, 0
                elif q == APO and c in (SINGLE, NEEDS_E, ELL):
                    to, out = {SINGLE: START, NEEDS_E: APO_E, ELL: APO_L}[c], 0
                elif q == APO_E and c == E or q == APO_L and c == ELL:
                    to, out = START, 0
                elif keep_white and q in (SP1, WS1, SPN, WSN):
                    if c in (SPACE, WHITE):
                        to, out = SPN if c == SPACE else WSN, 0
                    elif q == SP1:
                        to, out = PUN if c == APOSTROPHE else to, 0
                    elif q == SPN:
                        to, out = PUN if c == APOSTROPHE else to, BEFORE
                    elif q == WSN:
                        out = NOW | BEFORE
            if q in (APO_E, APO_L) and to != START or q in (APO_E, APO_L) and c in (MARK, SPACE, WHITE):
                # no contraction: its letter began a token
                to, out = (LET, BEFORE) if c in LETTERS else (to, NOW | BEFORE)
            step[q, c], flag[q, c] = to, out
    return step.ravel(), flag.ravel()


def entry_states(step: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """State in which each row of ``grid`` (classes, one row a chunk) is entered."""
    n = len(grid)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
    for j in range(grid.shape[1]):
        maps = step[maps * np.uint8(CLASSES) + grid[:, j, None]]
    maps = maps.astype(np.intp)
    d = 1
    while d < n:  # inclusive prefix scan of the maps under composition
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], 1)
        d *= 2
    out = np.zeros(n, np.uint8)
    out[1:] = maps[:-1, START]
    return out


def token_starts(codes: np.ndarray, keep_white: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which tokens start, class of each character).  ``codes`` ends with a STOP."""
    step, flag = compiled(keep_white)
    kind = class_table()[codes]
    n = -(-len(kind) // CHUNK)
    grid = np.full(n * CHUNK, MARK, np.uint8)
    grid[: len(kind)] = kind
    grid = grid.reshape(n, CHUNK)
    state, flags = entry_states(step, grid), np.empty((CHUNK, n), np.uint8)
    for j in range(CHUNK):
        at = state * np.uint8(CLASSES) + grid[:, j]
        flags[j] = flag[at]
        state = step[at]
    flags = flags.T.ravel()[: len(kind)]
    starts = (flags & NOW).astype(bool)
    starts[:-1] |= (flags[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts), kind


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _random() -> np.ndarray:
    return _mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of the batch, from one running sum."""
    with np.errstate(over="ignore"):
        for i, base in enumerate((_BASE, _BACK)):
            while len(_powers[i]) <= len(codes):
                more = _powers[i] * np.uint64(pow(base, len(_powers[i]), 1 << 64))
                _powers[i] = np.concatenate([_powers[i], more])
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_random()[codes] * _powers[0][: len(codes)], out=total[1:])
        return _mix((total[ends] - total[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def batches(texts: list[str], most: int = BATCH_CHARS):
    """Runs of whole texts of about ``most`` characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(the texts, each followed by STOP; its code points; where each text starts, and the end)."""
    whole = STOP.join(texts) + STOP
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


class Memo:
    """Values by 64-bit hash of a slice, forgotten all at once beyond ``most`` entries."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.at, self.values = most, {}, []

    def look(self, hashes: np.ndarray, make) -> tuple[np.ndarray, list]:
        """(number of the distinct hash at each place, the value of each distinct one);
        ``make(places)`` gives the values of unknown ones, for a first place of each."""
        import pandas as pd

        which, distinct = pd.factorize(hashes)
        if len(self.at) + len(distinct) > self.most:
            self.at, self.values = {}, []
        keys = distinct.tolist()
        found = [self.at.get(k, -1) for k in keys]
        new = [i for i, f in enumerate(found) if f < 0]
        if new:
            first = np.empty(len(keys), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            self.values.extend(make(first[new].tolist()))
            base = len(self.at)
            for j, i in enumerate(new):
                self.at[keys[i]] = found[i] = base + j
        return which, [self.values[f] for f in found]
