"""Sharding by histogram sort.

Rows are ordered by a 64-bit key: the upper 40 bits come from the text, the lower 24 from text and
id, so equal texts stand next to each other and yet a group of copies of any size can be cut.
Splitters are found without sorting: each round counts the exact bytes below candidate boundaries
over all partitions, keeps the cells in which a wanted boundary lies and probes these 256 times
finer, until the cell is within tolerance.  Then the rows move once, to the piece of the key range
they belong to, and number themselves there.

Null texts count as no bytes and sort with empty texts; null ids are allowed; rows that repeat
share a key and stay in one shard; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, fresh, longs, place, shuffle_partitions, stash

SHARDS = 40
OVERHEAD = 16
FIRST_BITS, STEP_BITS = 12, 8


def row_size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + OVERHEAD


def sort_key(text: str, doc_id: str) -> Column:
    body = F.coalesce(F.col(text), F.lit(""))
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(body), 24), 24)
    return high.bitwiseOR(F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1)), F.lit(7)).bitwiseAND(F.lit((1 << 24) - 1)))


def find_splitters(rows: DataFrame, pieces: int, tolerance: float) -> list[int]:
    """Ascending keys; piece i holds the keys from splitter i-1 on, below splitter i.

    ``rows`` has key and size.  Of each round the driver gets at most 4096 or (pieces x 256) counts.
    """
    spark, bits, active = rows.sparkSession, FIRST_BITS, None
    total, goals, found = None, [], {}
    below: dict[int, int] = {}
    while True:
        prefix = F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")
        part = rows
        if active is not None:
            had = bits - STEP_BITS
            cells = longs(spark, sorted(active)).select(F.col("value").alias("cell"))
            part = rows.withColumn("cell", F.shiftright("key", 64 - had)).join(F.broadcast(cells), "cell", "left_semi")
        hist = sorted(part.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect())
        if total is None:
            total = sum(r.s for r in hist)
            goals = [total * j / pieces for j in range(1, pieces)]
            sums = [0, *accumulate(r.s for r in hist)]
            below = {r.p: b for r, b in zip(hist, sums)}
        else:  # bytes below the first probe of a cell are known from the round before
            nxt: dict[int, int] = {}
            run: dict[int, int] = {}
            for r in hist:
                cell = r.p >> STEP_BITS
                nxt[r.p] = below[cell] + run.get(cell, 0)
                run[cell] = run.get(cell, 0) + r.s
            below = nxt
        inside = sorted((below[r.p], r.s, r.p, r.n) for r in hist)
        again, i = set(), 0
        for j, goal in enumerate(goals):
            if j in found:
                continue
            while i + 1 < len(inside) and inside[i][0] + inside[i][1] <= goal:
                i += 1
            if not inside:
                found[j] = 0
                continue
            lo, size, p, n = inside[i]
            if size <= tolerance or n == 1 or bits >= 64:
                at = p if goal - lo <= lo + size - goal else p + 1
                found[j] = max(-(1 << 63), min((1 << 63) - 1, at << (64 - bits) if bits < 64 else at))
            else:
                again.add(p)
        if not again:
            out = [found[j] for j in range(len(goals))]
            return [max(out[: k + 1]) for k in range(len(out))]
        active, bits = again, min(64, bits + STEP_BITS)


def histogram_sort(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, tolerance: float = 0.001) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (from 0, gapless): shards of near equal
    bytes, in key order.  ``tolerance``: of a shard's bytes, as far as single rows allow it."""
    spark = df.sparkSession
    key, piece, shard, slot, first, tie = fresh(df, "key", "piece", "shard", "slot", "first_slot", "tie")
    narrow = stash(df.select(sort_key(text, doc_id).alias("key"), row_size(text).alias("size")), "shard-keys")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    each = max(1, -(-4 * shuffle_partitions(spark) // shards))
    cuts = find_splitters(narrow, shards * each, tolerance * total / shards)
    k = len(cuts)
    counts = {r[0]: r[1] for r in narrow.groupBy(place(F.col("key"), cuts, each).alias("p")).count().collect()}
    starts, at = [], 0
    for p in range(k + 1):
        at = 0 if p % each == 0 else at
        starts.append(at)
        at += counts.get(p, 0)
    firsts = longs(spark, starts).toDF(piece, first)
    moved = df.withColumn(key, sort_key(text, doc_id)).withColumn(piece, place(F.col(f"`{key}`"), cuts, each))
    order = W.partitionBy(f"`{piece}`").orderBy(F.col(f"`{key}`"), F.col(f"`{doc_id}`"))
    return (
        moved.withColumn(tie, F.row_number().over(order))
        .join(F.broadcast(firsts), piece)
        .withColumn(shard, F.floor(F.col(f"`{piece}`") / each).cast("int"))
        .withColumn(slot, F.col(f"`{first}`") + F.col(f"`{tie}`") - 1)
        .drop(key, piece, first, tie)
    )


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document.  Null texts have 16 bytes; equal keys are told apart by the low bits of the
    sort key, repeated rows by their place; very long texts only weigh more; an empty table gives no rows; other columns
    are not read."""
    out = histogram_sort(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        row_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
