"""Best-fit packing after dominance reduction.

Documents become token pieces of at most the capacity.  How many pieces there are of each length
is all that packing depends on, and it is at most ``capacity`` numbers, however large the corpus.
The plan is made from these counts: first the reduction of Martello and Toth fixes sets that
dominate every other set holding a given length, for each length from the largest down (full pieces;
two lengths that fill a sequence; a length that nothing fits with; a best partner that no set of
others which fit exceeds in sum), then best-fit decreasing places the rest, whole runs of equal
sequences at a time.  A corpus with pieces of one token to spare has only pairs of the first kind,
as such pieces fill any room.  The plan is a list of runs: so many
pieces of a length go to consecutive sequences, each at the same offsets.  Pieces get their rank
within their length from counts by hash bucket, and look their place up in the plan.

Null texts count as empty and are a piece of one token; repeated rows are packed as often as they
come; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions, small_batches, stash
from .scan import ADDED, MARK, SPACE, WHITE, Memo, batches, joined, slice_hashes, token_starts

CAPACITY = 2048
#: Characters and words held at a time: what a Python worker needs beside its Arrow batch.
CHARS, HELD = 1 << 19, 250_000
WORDS_AT_ONCE, RUNS_AT_ONCE = 512, 32


class Words:
    """Ids of word-wise BPE vocabularies, by distinct pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in spec.items() if t.endswith("</w>")]] = True
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}

    def ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids, four bytes each: words go to the library many at a time, parted by spaces,
        and every word's last id is one that ends a word."""
        out: list[bytes] = []
        for lo in range(0, len(words), WORDS_AT_ONCE * RUNS_AT_ONCE):
            some = words[lo : lo + WORDS_AT_ONCE * RUNS_AT_ONCE]
            runs = [some[i : i + WORDS_AT_ONCE] for i in range(0, len(some), WORDS_AT_ONCE)]
            for run, found in zip(runs, self.library.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
                ids = np.array(found.ids, np.uint32)
                cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(cuts) == len(run):
                    flat = ids.tobytes()
                    out.extend(flat[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts))
                else:  # a word without such an end: one by one
                    out.extend(np.array(x.ids, np.uint32).tobytes() for x in self.library.encode_batch_fast(run, add_special_tokens=False))
        return out


@lru_cache(2)
def load(path: str) -> Words:
    return Words(path)


def normal(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma


def token_ids(texts: list[str], words: Words, memo: Memo) -> list[np.ndarray]:
    marks = {}
    for k, (a, i) in enumerate(words.added.items()):
        marks[0xD900 + k] = i
        texts = [t.replace(a, ADDED + chr(0xD900 + k)) if a in t else t for t in texts]
    whole, codes, bounds = joined([normal(t) for t in texts])
    special = np.flatnonzero((codes >= 0xD900) & (codes < 0xD900 + len(marks)))
    if len(special):
        codes = codes.copy()
    for s in special.tolist():
        codes[s] = ord(ADDED)
    starts, kind = token_starts(codes, False)
    ends = np.append(starts[1:], len(codes))
    # a token ends at white space
    white = np.flatnonzero((kind == SPACE) | (kind == WHITE))
    plain = ~np.isin(kind[starts], (MARK, SPACE, WHITE))
    index = np.flatnonzero(plain)
    s, e = starts[index], ends[index]
    which, values = (np.empty(0, np.int64), [])
    if len(s):
        if len(white):
            at = np.searchsorted(white, s)
            e = np.where(at < len(white), np.minimum(e, white[np.minimum(at, len(white) - 1)]), e)
        which, values = memo.look(slice_hashes(codes, s, e), lambda p: words.ids([whole[a:b] for a, b in zip(s[p].tolist(), e[p].tolist())]))
    for p in special.tolist():  # added tokens stand as segments of their own
        which = np.append(which, len(values))
        values = [*values, np.array([marks[ord(whole[p])]], np.uint32).tobytes()]
        s = np.append(s, p)
    if len(special):
        order = np.argsort(s, kind="stable")
        s, which = s[order], which[order]
    lengths = np.array([len(v) // 4 for v in values], np.int64)
    pool = np.frombuffer(b"".join(values), np.uint32)
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(values) else np.empty(0, np.int64)
    n = lengths[which] if len(values) else np.empty(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(n)])
    flat = pool[np.repeat(first[which] - sums[:-1], n) + np.arange(sums[-1])] if len(values) else pool
    cut = sums[np.searchsorted(s, bounds)]
    return [flat[cut[k] : cut[k + 1]] for k in range(len(texts))]


def token_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), with ``ids`` also the ids: a document's ids
    and a closing 0, cut after every ``capacity`` of them."""
    kind = df.schema[doc_id].dataType.simpleString()
    small_batches(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, memo = load(path), Memo(HELD)
        for part in parts:
            names, at = part[doc_id].tolist(), 0
            rows: list[tuple] = []
            for texts in batches(part[text].fillna("").tolist(), CHARS):
                for own in token_ids(texts, words, memo):
                    own = np.append(own, np.uint32(0)).astype("<u4")
                    for k, lo in enumerate(range(0, len(own), capacity)):
                        cut = own[lo : lo + capacity]
                        rows.append((names[at], k, lo, len(cut), zlib.crc32(cut.tobytes()), *((cut.tolist(),) if ids else ())))
                    at += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])
            if kind in ("bigint", "int") and len(out):
                out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return df.select(doc_id, text).mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


class Plan:
    """Runs (length, first rank, count, first sequence, copies in a sequence, offset of the first)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {k: v for k, v in counts.items() if v}
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.used = dict.fromkeys(counts, 0)
        self.reduce()
        self.best_fit()

    def put(self, length: int, sequence: int, bins: int, copies: int, offset: int, last: int | None = None) -> None:
        """``copies`` of a length into each of so many consecutive sequences; ``last``: into the last one."""
        n = bins * copies if last is None else (bins - 1) * copies + last
        self.runs.append((length, self.used[length], n, sequence, copies, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        """Close ``times`` sequences that hold one of each length (or two of the same)."""
        at = 0
        if len(lengths) == 2 and lengths[0] == lengths[1]:
            self.put(lengths[0], self.sequences, times, 2, 0)
        else:
            for x in lengths:
                self.put(x, self.sequences, times, 1, at)
                at += x
        self.sequences += times

    def reduce(self) -> None:
        for x in sorted(self.left, reverse=True):  # what fills a sequence with one partner dominates
            y = self.capacity - x
            if y == 0:
                self.fix((x,), self.left[x])
            elif x > y and x in self.left and y in self.left:
                self.fix((x, y), min(self.left[x], self.left[y]))
            elif x == y and self.left[x] > 1:
                self.fix((x, x), self.left[x] // 2)
        for x in sorted(self.left, reverse=True):
            while x in self.left:
                room = self.capacity - x
                others = {k: n - (k == x) for k, n in self.left.items() if k <= room and n > (k == x)}
                if not others:
                    self.fix((x,), self.left[x] if x > room else 1)
                    continue
                best = max(others)
                if self._most(others, room) > best:
                    break  # several others fill the room better than one: nothing is known to dominate
                # taking pieces away leaves the best partner best, as long as there is one
                self.fix((x, best), self.left[x] // 2 if best == x else min(self.left[x], self.left[best]))

    @staticmethod
    def _most(counts: dict[int, int], room: int) -> int:
        """The largest sum of pieces that is not above the room."""
        reach, within = 1, (1 << room + 1) - 1
        for k, n in sorted(counts.items()):
            n = min(n, room // k)
            step = 1
            while n:  # one piece, then two, then four...: every number of them
                take = min(step, n)
                reach |= reach << take * k & within
                n -= take
                step *= 2
            if reach >> room & 1:
                return room
        return reach.bit_length() - 1

    def best_fit(self) -> None:
        open_: list[tuple[int, int, int]] = []  # (room, first sequence, sequences)
        while self.left:
            x = max(self.left)
            at = bisect_left(open_, (x, -1, -1))
            if at == len(open_):
                copies = self.capacity // x
                n = self.left[x]
                full, rest = divmod(n, copies)
                for bins, each in ((full, copies), (1 if rest else 0, rest)):
                    if bins:
                        self.put(x, self.sequences, bins, each, 0)
                        if self.capacity - each * x:
                            insort(open_, (self.capacity - each * x, self.sequences, bins))
                        self.sequences += bins
                continue
            room, first, bins = open_.pop(at)
            copies, n = room // x, self.left[x]
            full = min(bins, n // copies)
            if full:
                self.put(x, first, full, copies, self.capacity - room)
                if room - copies * x:
                    insort(open_, (room - copies * x, first, full))
            else:
                self.put(x, first, 1, n, self.capacity - room)
                full = 1
                if room - n * x:
                    insort(open_, (room - n * x, first, 1))
            if full < bins:
                insort(open_, (room, first + full, bins - full))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table: it is read more than once) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs) or np.empty((0, 6)), np.int64).reshape(-1, 6)
    buckets = 4 * shuffle_partitions(spark)
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = rows.groupBy("bucket", "length").count().select("bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece"))).join(firsts, ["bucket", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("first") - 1).drop("bucket", "first")
    fields = [(f.name, f.dataType.simpleString()) for f in pieces.schema]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for part in parts:
            length, rank = part["length"].to_numpy(np.int64), part["rank"].to_numpy(np.int64)
            run = runs[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(part) else runs[:0]
            within = rank - run[:, 1]
            yield part[[n for n, _ in fields]].assign(sequence_id=run[:, 3] + within // np.maximum(run[:, 4], 1), offset=run[:, 5] + within % np.maximum(run[:, 4], 1) * length)

    return ranked.mapInPandas(place, ", ".join(f"`{n}` {t}" for n, t in fields) + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(stash(token_pieces(df, path, capacity), "pieces"), capacity)


def op4_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places.  Null texts are empty: one closing token; pieces of equal length
    are placed by hash bucket and id; repeated rows are packed each; long texts are cut as they must; an empty table
    gives no rows; other columns are not read."""
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"))
