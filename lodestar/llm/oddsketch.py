"""Near-duplicate documents by MinHash, odd sketches and exact verification.

Every different text is a set of word shingles with ``BANDS * ROWS`` MinHash samples.  The samples
make band keys (texts that share one are candidates) and are folded into an odd sketch: ``BITS``
parities, each flipped by the samples that hash to it.  The exclusive or of two sketches holds the
parities of the samples they do not share, so its population count tells a high similarity to about
0.02, and a candidate pair whose count is ``SIGMAS`` deviations above what a link would have is
dropped unread.  All others are confirmed on the full sets.

Only components are wanted, so pairs within one component need no test.  A few rounds hold each
text against the least text of its buckets (one row a text and band, so they cost the same however
large a bucket is) and join what they confirm.  Buckets that hold several components then have
their remaining pairs looked at, sketch against sketch, in blocks: never pairs within one component,
which leaves little of a large group of near copies.  A bucket of more than ``DENSE`` texts outside
its largest component is first split by further bands; what is still dense then costs the square of
its texts in sketch comparisons, but no pair is dropped, and only pairs that look linked are rows.

A pair of similarity 0.85 shares no band with a chance of 2 in 10^9 and is dropped by its sketches
with one of about 3 in 10^7.  Texts are known by 128 bits of their SHA-256.

Words are runs of characters other than space and the controls 9 to 13, with A-Z in lower case; a
text of fewer words than a shingle is one shingle; a null text and one without words have none and
are linked with nothing, not even with each other.  Rows with null ids take part: the component id
is the least id of the component, null if all are; ``kept`` compares nulls as equal.  Repeated rows
share a component and are kept together; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_limits, documents, forget, shuffle_partitions, stash
from .components import components
from .join import _forest, _shared
from .scan import _mix, batches
from .shingles import shingle_sets

WORDS = 3
#: Links have a Jaccard similarity of at least 85/100.
SHARED, OF = 85, 100
BANDS, ROWS, BITS, SIGMAS = 42, 6, 1024, 5
#: Rounds against one text a bucket, partners a text then verifies; texts of a block of sketches, of one of
#: sets, and of a bucket that is split; bands that split it.
ROUNDS, PARTNERS, BLOCK, SETS, DENSE, SPLITS = 3, 2, 512, 256, 2048, 10
SAMPLES = BANDS * ROWS
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def most_odd(similarity: float = SHARED / OF) -> int:
    """Population count that the exclusive or of two sketches of this similarity does not pass, but by ``SIGMAS`` deviations."""
    apart = 2 * SAMPLES * (1 - similarity)
    fade = math.exp(-2 * apart / BITS)
    drawn = 2 * math.sqrt(SAMPLES * similarity * (1 - similarity)) * fade
    return math.ceil(BITS / 2 * (1 - fade) + SIGMAS * math.sqrt(drawn**2 + 2 * apart**2 / BITS))


def lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")


def word_sets(texts: list[str]) -> list[np.ndarray]:
    return shingle_sets([lowered(t) for t in texts], WORDS)


def _turns() -> np.ndarray:
    return _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches), a row for each set; sets are not empty."""
    flat = np.concatenate(sets).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.intp)
    samples = np.empty((SAMPLES, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for j, turn in enumerate(_turns()):
            samples[j] = np.minimum.reduceat(flat * turn, starts)
        keys = np.zeros((BANDS, len(sets)), np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None]
        for row in range(ROWS):
            keys = _mix(keys * np.uint64(0xD6E8FEB86659FD93) + samples[row::ROWS])
        at = _mix(samples + np.arange(SAMPLES, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BITS)
    cells = at.astype(np.int64) + np.arange(len(sets)) * BITS
    odd = (np.bincount(cells.ravel(), minlength=len(sets) * BITS) & 1).astype(np.uint8)
    return keys.T.view(np.int64), np.packbits(odd.reshape(len(sets), BITS), axis=1).view(np.int64)


def text_key(text: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16)


def _signed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, n, bands, sketch of each row; recent texts are remembered, as copies often stand together."""
    known: OrderedDict[bytes, tuple] = OrderedDict()
    none = np.zeros(0, np.int64)
    for part in parts:
        keys, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
        new = {k: t for k, t in zip(keys, texts) if k not in known}
        here = {k: known[k] for k in set(keys) - set(new)}
        order = list(new)
        at = 0
        for run in batches([new[k] for k in order]):
            sets = word_sets(run)
            full = [i for i, s in enumerate(sets) if len(s)]
            found = {i: (len(sets[i]), b, o) for i, b, o in zip(full, *signatures([sets[i] for i in full]))} if full else {}
            for i in range(len(sets)):
                here[order[at + i]] = found.get(i, (0, none, none))
            at += len(run)
        known.update(here)
        while len(known) > 2000:
            known.popitem(last=False)
        out = [here[k] for k in keys]
        lists = []
        for c in (1, 2):
            edges = np.concatenate([[0], np.cumsum([len(x[c]) for x in out])]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([none, *[x[c] for x in out]]))))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in out], pa.int64()), *lists], ["doc_id", "key", "n", "bands", "sketch"])


def _may_link(a: str, b: str) -> Column:
    """Sizes allow a link and the sketches (columns of 64-bit words) do not speak against it."""
    odd = sum((F.bit_count(F.col(f"{a}_sketch")[i].bitwiseXOR(F.col(f"{b}_sketch")[i])) for i in range(1, BITS // 64)), F.bit_count(F.col(f"{a}_sketch")[0].bitwiseXOR(F.col(f"{b}_sketch")[0])))
    sizes = F.least(f"{a}_n", f"{b}_n") * OF >= F.greatest(f"{a}_n", f"{b}_n") * SHARED
    return F.when(sizes & (odd <= most_odd()), odd)


def _side(sets: DataFrame, name: str) -> DataFrame:
    return sets.select(F.col("key").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))


def _linked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose full sets are linked."""
    last: tuple = (None, None)
    for part in parts:
        out = []
        for a, b, s, t in part[["a", "b", "a_text", "b_text"]].itertuples(index=False):
            if last[0] != b:
                last = (b, word_sets([t])[0])
            x, y = word_sets([s])[0], last[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both * OF >= SHARED * (len(x) + len(y) - both):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"])


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) of text keys that are linked; ``bodies`` has key and text, each key once."""
    side = lambda name: bodies.select(F.col("key").alias(name), F.col("text").alias(f"{name}_text"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return stash(rows.mapInPandas(_linked, "a binary, b binary"), "odd-links")


def _cut(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames of a partition sorted by ``keys``, with the bounds of the runs of equal keys that are whole."""
    rest = None
    for part in parts:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        values = part[keys].to_numpy()
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist()]
        if len(edges) > 1:
            yield part, list(zip(edges, edges[1:]))
        rest = part.iloc[edges[-1] :] if len(part) else None
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True), [(0, len(rest))]


def _sides(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row is in block p, p = q, number of its component, key) of each row."""
    p, same = frame["p"].to_numpy(), (frame["p"] == frame["q"]).to_numpy()
    return (frame["block"].to_numpy() == p) & ~frame["main"].to_numpy(), same, pd.factorize(frame["label"])[0], frame["key"].to_numpy()


def _cross(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each pair of blocks (p, q): edges that connect what pairs of different components that may be linked connect."""
    limit = most_odd()
    for frame, runs in _cut(parts, ["bucket", "p", "q"]):
        own, same, label, keys = _sides(frame)
        n, sketch = frame["n"].to_numpy(), np.stack(frame["sketch"].to_numpy()).view(np.uint64)
        out = []
        for lo, hi in runs:
            left = lo + np.flatnonzero(own[lo:hi])
            right = left if same[lo] else lo + np.flatnonzero(~own[lo:hi])
            a, b = [], []
            for k, x in enumerate(left.tolist()):
                to = right[k + 1 :] if same[lo] else right
                to = to[label[to] != label[x]]
                odd = np.bitwise_count(sketch[to] ^ sketch[x]).sum(1)
                found = to[(odd <= limit) & (np.minimum(n[to], n[x]) * OF >= np.maximum(n[to], n[x]) * SHARED)]
                a.append(np.full(len(found), x - lo))
                b.append(found - lo)
            if sum(map(len, a)):
                out += [(keys[lo + x], keys[lo + y]) for x, y in _forest(np.concatenate(a), np.concatenate(b), hi - lo)]
        yield pd.DataFrame(out, columns=["a", "b"])


def _exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each pair of blocks (p, q): edges that connect what its links on full sets connect."""
    for frame, runs in _cut(parts, ["bucket", "p", "q"]):
        own, same, _, keys = _sides(frame)
        texts, out = frame["text"].tolist(), []
        for lo, hi in runs:
            left = lo + np.flatnonzero(own[lo:hi])
            order = left if same[lo] else np.concatenate([left, lo + np.flatnonzero(~own[lo:hi])])
            sets = [s for run in batches([texts[i] for i in order]) for s in word_sets(run)]
            sizes = np.array([len(s) for s in sets], np.float64)
            both = _shared(sets, len(left))
            link = OF * both >= SHARED * (sizes[: len(left), None] + sizes - both)
            link &= np.arange(len(order)) > np.arange(len(left))[:, None]
            out += [(keys[order[x]], keys[order[y]]) for x, y in _forest(*np.nonzero(link), len(order))]
        yield pd.DataFrame(out, columns=["a", "b"])


def _with_labels(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` (bucket, key) with the component of each key, of buckets with several components."""
    rows = members.select("bucket", "key")
    rows = rows.withColumn("label", F.col("key")) if labels is None else rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    return rows.join(mixed, "bucket")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (bucket, key, label) once for each pair of blocks that they are held against: texts of the
    bucket's largest component (main) against the others only, and these against each other."""
    sizes = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"))
    blocks = lambda c: F.ceil(c / block).cast("int")
    most = most.select("bucket", F.col("m.label").alias("main_label"), blocks(F.col("m.c")).alias("mains"), blocks(F.col("all") - F.col("m.c")).alias("rests"))
    r = rows.join(most, "bucket").withColumn("main", F.col("label") == F.col("main_label"))
    r = r.withColumn("block", F.pmod(F.xxhash64("key", F.lit(5)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    rest = F.sequence(F.lit(0), F.col("rests") - 1)
    pair = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    with_main = F.transform(rest, lambda k: pair(k, -1 - F.col("block")))
    with_rest = F.transform(rest, lambda k: pair(F.least("block", k), F.greatest("block", k)))
    against_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: pair(F.col("block"), -1 - k))
    r = r.withColumn("x", F.explode(F.when(F.col("main"), with_main).otherwise(F.concat(with_rest, against_main))))
    return r.select("bucket", "x.p", "x.q", "block", "main", "key", "label")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    with arrow_limits(spark):
        given = source.filter("text is not null").select("doc_id", text_key("text").alias("key"), "text")
        rows = stash(given.mapInArrow(_signed, "doc_id long, key binary, n long, bands array<long>, sketch array<long>"), "signed")
        sets = stash(rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")]), "sets")
        members = sets.select("key", F.explode("bands").alias("bucket"))
        shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
        members = stash(members.join(shared, "bucket"), "members")
        met = members.select("key").distinct().join(sets.select("key", "rep"), "key")
        bodies = stash(given.join(met, (given["key"] == met["key"]) & given["doc_id"].eqNullSafe(met["rep"])).select(given["key"], "text").dropDuplicates(["key"]), "bodies")
        labels = None

        def joined(new: DataFrame) -> None:
            nonlocal labels
            if labels is not None and new.isEmpty():
                return
            known = new if labels is None else new.unionByName(labels.select(F.col("key").alias("a"), F.col("label").alias("b")))
            old, labels = labels, stash(components(known, "odd-stars").select(F.col("node").alias("key"), F.col("root").alias("label")), "labels")
            forget(new)
            if old is not None:
                forget(old)

        for round_ in range(ROUNDS):
            now = stash(_with_labels(members, labels), "members")
            forget(members)
            members = now
            if now.isEmpty():
                break
            first = F.struct(F.xxhash64("label", F.lit(round_)), F.xxhash64("key", F.lit(round_)), "key") if round_ else F.struct("key")
            pivots = now.groupBy("bucket").agg(F.min(first).alias("f"), F.min_by("label", first).alias("pivot_label")).select("bucket", F.col("f.key").alias("b"), "pivot_label")
            pairs = now.join(pivots, "bucket").filter("label != pivot_label").select(F.col("key").alias("a"), "b").distinct()
            odd = pairs.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b").select("a", "b", _may_link("a", "b").alias("odd")).filter("odd is not null")
            best = odd.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("odd", "b"))).filter(F.col("r") <= PARTNERS)
            joined(verified(best.select("a", "b"), bodies))
        left = stash(_with_labels(members, labels), "members")
        forget(members)
        rest = left.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg((F.sum("c") - F.max("c")).alias("rest"))
        dense = rest.filter(F.col("rest") > DENSE).select("bucket")
        further = left.join(dense, "bucket").join(sets.select("key", "bands"), "key")
        offset = F.array_position("bands", F.col("bucket"))
        again = F.transform(F.sequence(F.lit(0), F.lit(SPLITS - 1)), lambda k: F.xxhash64("bucket", F.element_at("bands", (F.pmod(offset + k, F.lit(BANDS)) + 1).cast("int"))))
        split = further.select("key", F.explode(again).alias("bucket"))
        buckets = left.select("bucket", "key", "label").join(dense, "bucket", "left_anti").unionByName(_with_labels(split, labels).select("bucket", "key", "label"))
        dealt = lambda rows: rows.repartition(parts, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "key")
        blocks = _blocks(stash(buckets, "buckets"), BLOCK).join(sets.select("key", "n", "sketch"), "key")
        near = stash(dealt(blocks).mapInPandas(_cross, "a binary, b binary"), "cross")
        groups = components(near, "near-stars").withColumnsRenamed({"node": "key", "root": "bucket"})
        groups = stash(_with_labels(groups, labels), "groups")
        blocks = _blocks(groups, SETS).join(bodies, "key")
        joined(stash(dealt(blocks).mapInPandas(_exact, "a binary, b binary"), "odd-links"))
    known = sets.select("key", "rep").withColumn("label", F.col("key")) if labels is None else sets.select("key", "rep").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = stash(known.join(least, "label").select("key", "component_id"), "named")
    of = rows.select("doc_id", "key", F.col("n").alias("n_shingles"))
    out = of.filter("n_shingles > 0").join(named, "key").select("doc_id", "n_shingles", "component_id")
    alone = of.filter("n_shingles = 0").select("doc_id", "n_shingles").unionByName(source.filter("text is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles")))
    out = out.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document.  Nulls, texts without words, ties, repeated rows, very long texts, an empty table
    and other columns as in the module's text."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
