"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two transducers in a row.  The first cuts a text into pre-tokens (:mod:`.scan`: chunk state maps,
composed by a parallel prefix scan).  The second reads the bytes of a pre-token; each of its
transitions carries the number of tokens by which the encoding grows (which may be negative, when
a byte joins tokens).  Its states are determinised lazily.  A state is what the future can still
depend on: for every suffix of what was read that may begin a token, its place in the trie, the
token that ends right before it, and the count there.  A token may follow another if encoding the
two together gives just these two; of the tokens that end at a place exactly one may follow what
stands before it, so that every prefix's encoding is known at every byte.

Null texts count as empty (no tokens); strings of added tokens inside texts are one token each, as
is the library's default; repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches
from .scan import ADDED, Memo, batches, joined, slice_hashes, token_starts

LIMIT = 1024
#: Transitions kept before the table is built anew.
MOST_TRANSITIONS = 1_500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable
    Latin-1, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of byte strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.born: dict[bytes, int] = {bytes([b]): -1 for b in range(256)}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for i, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank.setdefault((a, b), i)
            if a + b not in self.born:
                self.born[a + b] = i
                self.parts[a + b] = (a, b)
        # a trie of all tokens that encode to themselves: node -> {byte: node}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        for t in sorted(self.born, key=self.born.get):
            if t in self.parts and not self.may_follow(*self.parts[t], self.born[t]):
                continue
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][b]
            self.token[node] = t
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self.begin = self.state(((0, None, 0),))

    def state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def spine(self, t: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at one edge of ``t`` while it is put together: (part, from, until)."""
        out, until = [], 1 << 60
        while True:
            out.append((t, self.born[t], until))
            if t not in self.parts:
                return out
            until, t = self.born[t], self.parts[t][side]

    def may_follow(self, a: bytes, b: bytes, before: int = 1 << 60) -> bool:
        """No merge of rank under ``before`` joins something over the border of a and b.

        Merges go by rank, equal ones from the left: at its own rank a part that is the left half
        of the same merge is still free, one that is the right half is taken.
        """
        for x, x_from, x_until in self.spine(a, 1):
            for y, y_from, y_until in self.spine(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < before and x_from < r < x_until and y_from < r <= y_until:
                    return False
        return True

    def fit(self, a: bytes | None, b: bytes) -> bool:
        if a is None:
            return True
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[(a, b)] = self.may_follow(a, b)
        return known

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        entries, last, delta = [], None, 0
        for node, before, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            entries.append((child, before, count))
            t = self.token[child]
            if t is not None and last is None and self.fit(before, t):
                last, delta = t, count + 1
        found = self.state((*((n, b, c - delta) for n, b, c in entries), (0, last, 0))), delta
        self.steps[state << 8 | byte] = found
        return found

    def count(self, text: bytes) -> int:
        if len(self.steps) > MOST_TRANSITIONS:
            self.reset()
        state, total, steps = self.begin, 0, self.steps
        for b in text:
            step = steps.get(state << 8 | b)
            if step is None:
                step = self.transition(state, b)
            state = step[0]
            total += step[1]
        return total


@lru_cache(2)
def load(path: str) -> tuple[Transducer, tuple[str, ...]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Transducer(spec["model"]["vocab"], merges), tuple(t["content"] for t in spec["added_tokens"])


def count_texts(texts: list[str], transducer: Transducer, added: tuple[str, ...], memo: Memo) -> np.ndarray:
    for a in added:
        texts = [t.replace(a, ADDED) if a in t else t for t in texts]
    whole, codes, bounds = joined(texts)
    starts, _ = token_starts(codes, True)
    ends = np.append(starts[1:], len(codes))

    def make(places: list[int]) -> list[int]:
        return [transducer.count(whole[s:e].encode()) for s, e in zip(starts[places].tolist(), ends[places].tolist())]

    # marks are tokens of their own here: one for an added token, none for the end of a text
    plain = codes[starts] < 0xD800
    plain |= codes[starts] > 0xDFFF
    starts_p, ends_p = starts[plain], ends[plain]
    n = np.zeros(len(codes) + 1, np.int64)
    if len(starts_p):
        index = np.flatnonzero(plain)
        which, values = memo.look(slice_hashes(codes, starts_p, ends_p), lambda places: make(index[places]))
        n[starts_p] = np.array(values, np.int64)[which]
    n[:-1] += codes == ord(ADDED)
    total = np.concatenate([[0], np.cumsum(n)])
    return total[bounds[1:]] - total[bounds[:-1]]


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` in place of the text column."""
    keep = [c for c in df.columns if c not in (text, "n_tokens")]

    small_batches(df.sparkSession)
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer, added = load(path)
        memo = Memo()
        for part in parts:
            texts = part[text].fillna("").tolist()
            counts = [count_texts(run_, transducer, added, memo) for run_ in batches(texts)]
            yield part[keep].assign(n_tokens=np.concatenate(counts) if counts else np.empty(0, np.int64))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.mapInPandas(run, f"{schema}, n_tokens long")


def op3_transducer_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Bytes and tokens of every document.  Null texts are empty, with no token; repeated rows and very long texts
    are counted like others, ties have no part; an empty table gives no rows; other columns are not read."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = token_counts(docs, path)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
