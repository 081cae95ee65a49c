"""Collocations of two to five words by counting fixed-width keys.

Words are counted first.  Those that are frequent in their language are numbered; every piece of
text is broken where another word stands, as no candidate phrase can hold one.  The runs of numbers
are written once, and each length of phrase reads them: a phrase of m words is a binary key of m
numbers of four bytes (a number belongs to one language, so the key knows its language).  A task
radix-sorts the keys of a batch by 16-bit digits and counts runs; the counts are range-partitioned
by key, sorted there (Spark sorts fixed prefixes by radix too), and runs of equal keys are summed
as they stream by, so no key is a group in memory.  A phrase is only keyed if both phrases within
it that are one word shorter may be frequent, by a bit map of ``FILTER_BITS`` bits at most: one that
is full, as on very large inputs, lets everything pass and costs time, never a count.

Counts are 64-bit, scores decimals of 38 digits.  Null texts have no words; a null language is
``und``; ties have the order of the contract; repeated rows count again; very long texts are taken
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_limits, broadcast_if_small, documents, forget, longs, shuffle_partitions, stash
from .scan import _mix

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Bytes of a dictionary that is sent to all tasks; beyond, words are joined to their numbers.
DICTIONARY_BYTES = 24 << 20
#: Bits of the map of frequent phrases (a power of two), and bytes of text and numbers of words taken in one go.
FILTER_BITS, BATCH_BYTES, BATCH_IDS = 1 << 26, 2 << 20, 3 << 19

WORD, GAP, CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = GAP
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = CUT
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Words:
    """The words of a batch of (lang, text): distinct "word language" names, the name's number at each
    place, and whether a piece starts there."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        rows = texts.cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # each text ends with a cut, so pieces never run on
        body = np.frombuffer(b"\n".join([*(x or b"" for x in rows.to_pylist()), b""]), np.uint8)
        body, ends_text = _LOWER[body], np.cumsum(sizes + 1)
        kind = _KIND[body]
        inside = np.concatenate([[0], (kind == WORD).view(np.int8), [0]])
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(kind == CUT), start)
        self.breaks = np.ones(len(start), bool)
        self.breaks[1:] = piece[1:] != piece[:-1]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body[kind == WORD].tobytes())])
        del body, kind, inside, edge, end, offsets, piece
        coded, lang = words.dictionary_encode(), langs.dictionary_encode()
        of_row = lang.indices.to_numpy(zero_copy_only=False)[np.searchsorted(ends_text, start, side="right")] if len(start) else np.zeros(0, int)
        many = max(1, len(lang.dictionary))
        pairs, self.at = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + of_row, return_inverse=True)
        self.word = coded.dictionary.take(pa.array(pairs // many))
        self.lang = lang.dictionary.take(pa.array(pairs % many))
        # words hold no space, so the name is cut at the first one
        self.names = pc.binary_join_element_wise(self.word, self.lang.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()))


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    held, size = [], 0
    for part in parts:
        for k in range(0, part.num_rows, 64):
            held.append(part.slice(k, 64))
            size += pc.sum(pc.binary_length(held[-1].column(1))).as_py() or 0
            if size >= BATCH_BYTES:
                t = pa.Table.from_batches(held).combine_chunks()
                yield Words(t.column(0).combine_chunks(), t.column(1).combine_chunks())
                held, size = [], 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield Words(t.column(0).combine_chunks(), t.column(1).combine_chunks())


def _word_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for w in _batches(parts):
        yield pa.RecordBatch.from_arrays([w.names.cast(pa.binary()), pa.array(np.bincount(w.at, minlength=len(w.names)).astype(np.int64))], ["name", "f"])


def _runs(ids: np.ndarray, breaks: np.ndarray) -> bytes:
    """Numbers with a zero at each break; unknown words are zeros themselves."""
    out = np.zeros(len(ids) + int(breaks.sum()), np.uint32)
    out[np.arange(len(ids)) + np.cumsum(breaks)] = ids
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep].tobytes()


def _encoded(names: pa.Array, ids: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _batches(parts):
            found = pc.index_in(w.names, value_set=names)
            number = np.where(pc.is_valid(found).to_numpy(zero_copy_only=False), ids[pc.fill_null(found, 0).to_numpy(zero_copy_only=False)], 0) if len(names) else np.zeros(len(w.names), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([_runs(number[w.at].astype(np.uint32), w.breaks)], pa.binary())], ["ids"])

    return run


def _places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, place, breaks, name of every word: for dictionaries too large to send."""
    import uuid

    for w in _batches(parts):
        block = uuid.uuid4().hex
        for k in range(0, len(w.at), 100_000):
            at = w.at[k : k + 100_000]
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n), pa.array(np.arange(k, k + n)), pa.array(w.breaks[k : k + n]), w.names.take(pa.array(at)).cast(pa.binary())], ["block", "place", "breaks", "name"])


def _joined_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        out = []
        for row in part.column(0):
            t = row.values
            out.append(_runs(t.field(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32), t.field(1).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of ``keys`` (columns of 32-bit numbers): stable passes over 16-bit digits, least first."""
    order = np.arange(len(keys))
    for column in keys.T[::-1]:
        for digit in ((column & 0xFFFF).astype(np.uint16), (column >> 16).astype(np.uint16)):
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where runs of equal rows start, their lengths) of sorted ``keys``."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(1)
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(keys)))


def place_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """Place of each key in the bit map."""
    h = np.zeros(len(keys), np.uint64)
    with np.errstate(over="ignore"):
        for column in keys.T:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
    return (h & np.uint64(bits - 1)).astype(np.int64)


def _binary(keys: np.ndarray) -> pa.Array:
    """Big-endian, so that keys sort as numbers do; of one width."""
    raw, width = keys.astype(">u4").tobytes(), keys.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, len(raw) + 1, width, dtype=np.int32)), pa.py_buffer(raw)])


def _keyed(m: int, allowed: np.ndarray | None, bits: int):
    """Keys of m numbers with their counts in some rows of runs; rows do not run on into each other."""

    def counted(rows: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate([x for row in rows for x in (row, np.zeros(m, np.uint32))])
        grid = np.lib.stride_tricks.sliding_window_view(ids, m)
        whole = (grid != 0).all(1)
        if allowed is not None:
            place = place_bits(np.lib.stride_tricks.sliding_window_view(ids, m - 1), bits)
            may = (allowed[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            whole &= (may[:-1] & may[1:]).astype(bool)
        keys = grid[whole]
        keys = keys[radix_order(keys)]
        at, count = run_lengths(keys)
        return pa.RecordBatch.from_arrays([_binary(keys[at]), pa.array(count.astype(np.int64))], ["key", "f"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for raw in part.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.uint32))
                size += len(held[-1])
                if size >= BATCH_IDS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def _summed(m: int, least: int, bits: int):
    """Sums of runs of equal keys in a sorted partition, of those that are frequent, with their place in the bit map."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_f = np.zeros((0, m), np.uint32), 0

        def out(keys: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            often = f >= least
            return pa.RecordBatch.from_arrays([_binary(keys[often]), pa.array(f[often]), pa.array(place_bits(keys[often], bits))], ["key", "f", "bit"])

        for part in parts:
            keys = np.frombuffer(b"".join(part.column(0).to_pylist()), ">u4").reshape(-1, m).astype(np.uint32)
            f = part.column(1).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            at, _ = run_lengths(keys)
            keys, sums = keys[at], np.add.reduceat(f, at)
            if len(last_key) and (keys[0] == last_key[0]).all():
                sums[0] += last_f
            elif len(last_key):
                yield out(last_key, np.array([last_f]))
            yield out(keys[:-1], sums[:-1])
            last_key, last_f = keys[-1:], int(sums[-1])
        if len(last_key):
            yield out(last_key, np.array([last_f]))

    return run


def _bit_map(frequent: DataFrame, bits: int) -> np.ndarray:
    """The places of ``frequent`` as ``bits`` bits: at most that many reach the driver."""
    rows = frequent.groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(bits // 8 + 8192, np.uint8)
    for r in rows:  # a bucket number n, from 1, holds the places from 32768 (n - 1) + 1 on; place 0 has bucket 0
        got = np.frombuffer(bytes(r.bits), np.uint8)
        for_place = np.flatnonzero(np.unpackbits(got, bitorder="little"))
        places = 32768 * (r.b - 1) + 1 + for_place if r.b > 0 else for_place * 0
        np.bitwise_or.at(out, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return out


def _numbered(names: DataFrame, parts: int) -> DataFrame:
    """``names`` (name, f) with gapless numbers from 1 in the order of names, without one sort of all: ranges of
    names number their own rows from where the range before ends."""
    ranged = stash(names.repartitionByRange(parts, "name").sortWithinPartitions("name").select("name", "f", F.spark_partition_id().alias("part")), "ranged")
    counts = {r.part: r["count"] for r in ranged.groupBy("part").count().collect()}
    starts, at = [], 1
    for p in range(max(counts, default=-1) + 1):
        starts.append(at)
        at += counts.get(p, 0)
    if at >= 1 << 32:
        raise ValueError("more frequent words than 32-bit numbers")
    first = longs(ranged.sparkSession, starts).toDF("part", "first")
    own = F.row_number().over(W.partitionBy("part").orderBy("name"))
    return ranged.withColumn("own", own).join(F.broadcast(first), "part").select("name", "f", (F.col("first") + F.col("own") - 1).alias("id"))


def _word() -> Column:
    return F.substring_index(F.col("name").cast("string"), " ", 1)


def _lang() -> Column:
    """A name is a word, a space and the language; a word holds no space."""
    return F.substring(F.col("name").cast("string"), F.length(_word()) + 2, F.length("name"))


def _key(ids: Column) -> Column:
    return F.unhex(F.lpad(F.hex(ids), 8, "0"))


def _part(key: str, first: Column | int, words: Column | int) -> Column:
    """``words`` numbers of a key, from number ``first`` (from 0) on."""
    return F.expr(f"substring({key}, cast(({first}) * 4 + 1 as int), cast(({words}) * 4 as int))")


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: name, f, id; counts: key, m, a of frequent phrases of 1 to ``longest`` words; totals: lang, n)."""
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    given = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    with arrow_limits(spark):
        found = stash(given.mapInArrow(_word_counts, "name binary, f long").groupBy("name").agg(F.sum("f").alias("f")), "words")
        totals = stash(found.groupBy(_lang().alias("lang")).agg(F.sum("f").alias("n")), "totals")
        words = stash(_numbered(found.filter(F.col("f") >= least), parts), "dictionary")
        size, all_words = words.agg(F.coalesce(F.sum(F.length("name") + 12), F.lit(0))).first()[0], totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if size <= DICTIONARY_BYTES:
            known = words.select("name", "id").toArrow()
            runs = given.mapInArrow(_encoded(known.column(0).combine_chunks().cast(pa.large_binary()), known.column(1).to_numpy().astype(np.uint32)), "ids binary")
        else:
            each = given.mapInArrow(_places, "block string, place long, breaks boolean, name binary").join(words.select("name", "id"), "name", "left")
            blocks = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "breaks", "id"))).alias("t"))
            runs = blocks.select("t").mapInArrow(_joined_runs, "ids binary")
        runs = stash(runs, "runs")
        bits = 1 << 16
        while bits < min(FILTER_BITS, all_words):
            bits *= 2
        levels, allowed = [words.select(_key(F.col("id")).alias("key"), F.lit(1).alias("m"), F.col("f").alias("a"))], None
        for m in range(2, longest + 1):
            keyed = runs.mapInArrow(_keyed(m, allowed, bits), "key binary, f long")
            level = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_summed(m, least, bits), "key binary, f long, bit long")
            level = stash(level, "phrases")
            levels.append(level.select("key", F.lit(m).alias("m"), F.col("f").alias("a")))
            if m < longest:
                allowed = _bit_map(level, bits)
        forget(runs)
    counts = levels[0]
    for x in levels[1:]:
        counts = counts.unionByName(x)
    return words, counts, totals


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", first: int = FIRST) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words, counts, totals = phrases(df, text, lang)
    counts = stash(counts, "counts")
    several = counts.filter("m > 1")
    inner = several.filter("m > 2").select("key", "m", "a", F.explode(F.expr("sequence(2, m - 1)")).alias("w")).select("key", "m", "a", "w", F.explode(F.expr("sequence(0, m - w)")).alias("s"))
    inner = inner.groupBy(_part("key", "s", "w").alias("key")).agg(F.max("a").alias("longer"))
    kept = several.join(inner, "key", "left").filter("longer is null or 100 * longer < 100 * a").select("key", "m", "a")
    cuts = kept.select("key", "m", "a", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    cuts = cuts.withColumn("left", _part("key", 0, "k")).withColumn("right", _part("key", "k", "m - k"))
    of = lambda side, f: counts.select(F.col("key").alias(side), F.col("a").alias(f))
    cuts = cuts.join(of("left", "l"), "left").join(of("right", "r"), "right")
    names = words.select(_key(F.col("id")).alias("first_key"), _lang().alias("lang"))
    named = cuts.withColumn("first_key", _part("key", 0, 1)).join(names, "first_key").join(broadcast_if_small(totals, totals.count(), 64), "lang")
    exact = F.expr("(cast(1000 as decimal(4,0)) * cast(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(34,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long")
    scored = named.withColumn("score", exact).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "m", "lang")).alias("x")).select("key", "x.*")
    spelt = scored.select("key", F.posexplode(F.expr("transform(sequence(0, m - 1), i -> substring(key, i * 4 + 1, 4))")).alias("i", "id_key"))
    word = words.select(_key(F.col("id")).alias("id_key"), _word().alias("word"))
    spelt = spelt.join(word, "id_key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelt = spelt.select("key", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.join(spelt, "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents; the cases as in the module's text."""
    return collocations(documents(spark, sf_dir).select("text", "lang"))
