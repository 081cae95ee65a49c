"""Encoding and decoding for merge-type sentence-piece vocabularies.

A segment starts as its characters.  An agenda holds every adjacent pair of symbols that together
is a piece, ordered by the piece's score, then from the left; the best pair is joined and its new
neighbours are entered, until nothing is left to join.  Symbols that are no piece fall back to
bytes.  As no piece goes on past a word mark that follows another character (checked when the model
is loaded), texts fall apart into segments before such marks, and each distinct segment is encoded
once in an Arrow batch.  Every such segment is checked against the library as it is first met; a
difference raises an error.

Null texts count as empty (only the end id); repeated rows and other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import documents, small_batches
from .scan import Memo, batches, joined, slice_hashes

SPACE = "▁"


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = sp.eos_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.shown: dict[int, str] = {}
        self.byte_of: dict[int, int] = {}
        self.unknown = sp.unk_id()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_of[i] = int(p[3:5], 16)
            elif not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i):
                if SPACE in p.lstrip(SPACE):
                    raise ValueError(f"{p!r} goes past a word mark: texts cannot be cut into segments")
                self.id[p], self.score[p] = i, sp.get_score(i)
                self.shown[i] = p.replace(SPACE, " ")
        self.byte_id = {b: i for i, b in self.byte_of.items()}

    def segment(self, text: str) -> list[int]:
        """Ids of a segment whose spaces are word marks."""
        symbols: list[str | None] = list(text)
        n, score = len(symbols), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None:
                agenda.append((-s, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            a = symbols[i]
            if a is None or (j := after[i]) >= n or len(a) + len(symbols[j]) != len(pair) or a + symbols[j] != pair:
                continue  # one of the two has been joined to something else meanwhile
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                s = score.get(pair + symbols[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, pair + symbols[k]))
            h = before[i]
            if h >= 0:
                s = score.get(symbols[h] + pair)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, symbols[h] + pair))
        out = []
        for x in symbols:
            if x is not None:
                found = self.id.get(x)
                if found is not None:
                    out.append(found)
                elif self.byte_id:
                    out.extend(self.byte_id[b] for b in x.encode())
                else:
                    out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with the space that leads every encoded text."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.shown.get(i, " ⁇ " if i == self.unknown else ""))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def checked(self, segments: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, the ids joined by spaces, decoded text) of segments that start with a mark."""
        found = [self.segment(s) for s in segments]
        plain = [s[1:].replace(SPACE, " ") for s in segments]
        for s, own, theirs in zip(segments, found, self.library.encode(plain, num_threads=1)):
            if own != (theirs or [self.library.piece_to_id(s)]):  # the library encodes no empty text
                raise ValueError(f"segment {s!r}: {own} differs from the library's {theirs}")
        shown = self.library.decode(found, num_threads=1) if found else []
        for s, ids, theirs in zip(segments, found, shown):
            if self.decode(ids) != " " + theirs:  # the library drops the space that leads a text
                raise ValueError(f"segment {s!r}: {self.decode(ids)!r} differs from the library's {theirs!r}")
        return [(len(ids), " ".join(map(str, ids)), self.decode(ids)) for ids in found]


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_texts(texts: list[str], pieces: Pieces, memo: Memo) -> list[tuple[int, str, str]]:
    """Per text: (ids without the end id, joined ids, decoded text)."""
    whole, codes, bounds = joined([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])
    mark = codes == ord(SPACE)
    stop = np.zeros(len(codes), bool)
    stop[bounds[1:] - 1] = True
    begins = mark.copy()
    begins[1:] &= ~mark[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return [(0, "", "")] * len(texts)
    cuts = np.flatnonzero(begins | stop)
    ends = cuts[np.searchsorted(cuts, starts, "right")]

    def make(places: list[int]):
        return pieces.checked([whole[s:e] for s, e in zip(starts[places].tolist(), ends[places].tolist())])

    which, values = memo.look(slice_hashes(codes, starts, ends), make)
    lengths, joins, shown = [v[0] for v in values], [v[1] for v in values], [v[2] for v in values]
    sums = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64)[which])])
    cut = np.searchsorted(starts, bounds)
    which_list, out = which.tolist(), []
    for k in range(len(texts)):
        a, b = int(cut[k]), int(cut[k + 1])
        own = which_list[a:b]
        out.append((int(sums[b] - sums[a]), " ".join([joins[w] for w in own]), "".join([shown[w] for w in own])[1:]))
    return out


def encode(df: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of the text; with
    ``ids`` also the ids themselves (array of int) and the decoded text."""
    made = ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if ids else ()))
    keep = [c for c in df.columns if c not in (text, *made)]

    small_batches(df.sparkSession)
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, memo = load(path), Memo(600_000)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in parts:
            n, a, b, listed, shown = [], [], [], [], []
            for texts in batches(part[text].fillna("").tolist()):
                for length, joins, decoded in encode_texts(texts, pieces, memo):
                    joins = f"{joins} {pieces.end}" if joins else str(pieces.end)
                    n.append(length + 1)
                    a.append(sha(joins))
                    b.append(sha(decoded))
                    if ids:
                        listed.append([int(x) for x in joins.split(" ")])
                        shown.append(decoded)
            out = part[keep].assign(n_tokens=n, ids_sha256=a, decoded_sha256=b)
            yield out.assign(ids=listed, decoded=shown) if ids else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.mapInPandas(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids)


def op8_agenda_pieces(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document.  Null texts are empty: an end id alone; pairs of equal score join
    from the left; repeated rows and very long texts are encoded like others; an empty table gives no rows; other columns
    are not read."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return encode(documents(spark, sf_dir).select("doc_id", "text"), path)
