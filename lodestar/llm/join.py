"""Similarity join on word 5-grams by chosen paths.

Copies are put together first; every different text is one set of shingles.  A set samples shared
tokens at a rate that depends on its size alone, so two similar sets sample much the same; each
sampled token is a node of a tree and holds the sets that chose it (all runs at once: a run is one
sampled token, and ``RUNS`` of them miss a pair of similarity 0.8 with a probability of e^-10).
A node of few sets is compared by brute force on sketches.  A node of many names a pivot; sets
near the pivot are tied to it and leave (what is similar to them is tied to the pivot as well, by
the triangle inequality of Jaccard distance), the others choose tokens again, at children of the
node, until nodes are small.  What is left at ``DEPTH`` is tied to its pivot untested.

All this only gathers candidates: sets tied together form groups.  Within each group every pair is
then tested exactly, block against block, so links are counted in full and no list of pairs is
ever made.  Tested links give the classes.

Texts of fewer than five words are one shingle.  Null texts, and texts without a word, have no
links; a null text is a class of its own, equal texts are in one class.  Rows with null ids take
part; the class id is the least id in the class, null if all are.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, fresh, shuffle_partitions, small_batches, stash
from .components import components
from .scan import batches
from .shingles import shingle_sets

#: Links have a Jaccard similarity of at least 4/5.
SHARED, OF = 4, 5
RUNS, SKETCH, NODE, BLOCK, DEPTH = 12, 40, 40, 100, 8
#: Estimates from which sets are tied, and from which they leave with the pivot.
TIE, LEAVE = 0.5, 0.85
TOP = float(1 << 63)


def entities(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Stored rows (doc_id, eid, n, sketch): sampled shingles in ascending order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes, sketches = [], []
            for texts in batches(part["text"].tolist()):
                for s in shingle_sets(texts):
                    sizes.append(len(s))
                    sketches.append(s[: np.searchsorted(s, min(TOP - 1, SKETCH * TOP / max(1, len(s))))])
            yield pd.DataFrame({"doc_id": part["doc_id"], "eid": part["eid"], "n": sizes, "sketch": sketches})

    rows = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("eid"), F.col(text).alias("text"))
    return stash(rows.mapInPandas(run, "doc_id long, eid long, n long, sketch array<long>"), "sketches")


def _limit(n: Column, rate: int) -> Column:
    return (F.lit(rate * TOP) / F.greatest(n, F.lit(1))).cast("double")


def estimate(s: Column, n: Column, t: Column, m: Column) -> Column:
    """Similarity of two sets from their sketches, cut to the rate they share."""
    cut = F.least(_limit(n, SKETCH), _limit(m, SKETCH))
    both = F.size(F.array_intersect(s, t))
    return both / F.greatest(F.lit(1), F.size(F.filter(s, lambda x: x < cut)) + F.size(F.filter(t, lambda x: x < cut)) - both)


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the given pairs connect."""
    root, out = list(range(n)), []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = a, b
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _shared(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of the intersections of the first ``rows`` sets with all of them."""
    n = len(sets)
    flat = np.concatenate([*sets, np.empty(0, np.int64)])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count[token] > 1
    token, owner = np.unique(token[often], return_inverse=True)[1] if often.any() else token[:0], owner[often]
    out = np.zeros((rows, n), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    wide = 8192
    top = int(token[-1]) + 1 if len(token) else 0
    for lo in range(0, top, wide):
        a, b = np.searchsorted(token, [lo, lo + wide])
        grid = np.zeros((n, min(wide, top - lo)), np.float32)
        grid[owner[a:b], token[a:b] - lo] = 1
        out += grid[:rows] @ grid.T
    return out


def _groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, of a partition sorted by them."""
    rest = None
    for part in parts:
        if rest is not None:
            part = pd.concat([rest, part], ignore_index=True)
        if not len(part):
            continue
        values = part[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield part.iloc[a:b]
        rest = part.iloc[edges[-1] :]
    if rest is not None and len(rest):
        yield rest


def _brute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ties within small nodes."""
    found: list[tuple[int, int]] = []
    for g in _groups(parts, ["node"]):
        sets, sizes, names = g["sketch"].tolist(), g["n"].to_numpy(np.float64), g["eid"].tolist()
        limits = SKETCH * TOP / np.maximum(sizes, 1)
        both = _shared(sets, len(sets))
        seen = np.array([np.searchsorted(s, limits) for s in sets], np.float64)
        like = both / np.maximum(1, seen + seen.T - both)
        like[np.minimum(sizes[:, None], sizes) * OF < SHARED * np.maximum(sizes[:, None], sizes)] = 0
        a, b = np.nonzero(np.triu(like >= TIE, 1))
        found += [(names[x], names[y]) for x, y in _forest(a, b, len(names))]
        if len(found) > 50_000:
            yield pd.DataFrame(found, columns=["a", "b"])
            found = []
    yield pd.DataFrame(found, columns=["a", "b"])


def candidates(sets: DataFrame) -> DataFrame:
    """Ties (a, b) between the sets (eid, n, sketch), found along chosen paths."""
    spark = sets.sparkSession
    parts = shuffle_partitions(spark)
    ties: list[DataFrame] = []
    rows = sets.select("eid", F.explode(F.filter("sketch", lambda t: t < _limit(F.col("n"), RUNS))).alias("node"))
    for depth in range(1, DEPTH + 1):
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("eid").alias("pivot")).filter("c > 1")
        held = stash(rows.join(nodes, "node"), "nodes")
        n_small, n_big = held.agg(F.count(F.when(F.col("c") <= NODE, 1)), F.count(F.when(F.col("c") > NODE, 1))).first()
        if n_small:
            small = held.filter(F.col("c") <= NODE).select("node", "eid").join(sets, "eid")
            ties.append(stash(small.repartition(parts, "node").sortWithinPartitions("node", "eid").mapInPandas(_brute, "a long, b long"), "ties"))
        if not n_big:
            break
        big = held.filter(F.col("c") > NODE)
        if depth == DEPTH:
            ties.append(stash(big.filter("eid != pivot").select(F.col("eid").alias("a"), F.col("pivot").alias("b")), "ties"))
            break
        # nodes of near copies name the same few pivots: a set meets each of its pivots once, whatever nodes they share
        met = big.filter("eid != pivot").groupBy("eid", "pivot").agg(F.collect_list("node").alias("nodes")).join(sets, "eid")
        pivots = big.select("pivot").distinct().join(sets.select(F.col("eid").alias("pivot"), F.col("n").alias("pn"), F.col("sketch").alias("ps")), "pivot")
        met = met.join(broadcast_if_small(pivots, n_big // NODE, 24 + 16 * SKETCH), "pivot")
        # sizes tell nothing here: what is similar to a set that leaves is tied, be it no link of the pivot's
        near = estimate(F.col("sketch"), F.col("n"), F.col("ps"), F.col("pn"))
        # children: tokens that the node samples again, 1 / (4/5) of them to be expected
        again = lambda node: F.filter("sketch", lambda t: F.shiftrightunsigned(F.xxhash64(node, t), 1) < (F.lit(TOP) * OF / SHARED / F.greatest(F.size("sketch"), F.lit(1))))
        below = F.flatten(F.transform("nodes", lambda node: F.transform(again(node), lambda t: F.xxhash64(node, t, F.lit(depth)))))
        children = F.when(F.col("near") < LEAVE, below).otherwise(F.array().cast("array<bigint>"))
        step = stash(met.withColumn("near", near).select("eid", "pivot", "near", children.alias("children")), "met")
        ties.append(step.filter(F.col("near") >= TIE).select(F.col("eid").alias("a"), F.col("pivot").alias("b")))
        rows = step.select("eid", F.explode("children").alias("node")).distinct()
    out = ties[0] if ties else spark.createDataFrame([], "a long, b long")
    for t in ties[1:]:
        out = out.unionByName(t)
    return out


def _compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact links of block against block: (eid, links) and (eid, 0, other) for connecting links."""
    out: list[tuple] = []
    for g in _groups(parts, ["root", "i", "j"]):
        g = g.drop_duplicates("eid")
        g = pd.concat([g[g["block"] == g["i"]], g[g["block"] != g["i"]]])
        rows = int((g["block"] == g["i"]).sum())
        same = bool((g["i"] == g["j"]).iloc[0])
        names = g["eid"].tolist()
        sets = [s for run in batches(g["text"].tolist()) for s in shingle_sets(run)]
        sizes = np.array([len(s) for s in sets], np.float64)
        both = _shared(sets, rows)
        link = OF * both >= SHARED * (sizes[:rows, None] + sizes - both)
        link &= (sizes[:rows, None] > 0) & (sizes > 0)
        if same:
            np.fill_diagonal(link, False)
        else:
            link[:, :rows] = False
        a, b = np.nonzero(link)
        counts = np.bincount(a, minlength=len(names)) + (0 if same else np.bincount(b, minlength=len(names)))
        out += [(names[k], int(counts[k]), None) for k in np.flatnonzero(counts).tolist()]
        out += [(names[x], 0, names[y]) for x, y in _forest(a, b, len(names))]
        if len(out) > 50_000:
            yield _rows(out)
            out = []
    yield _rows(out)


def _rows(out: list[tuple]) -> pd.DataFrame:
    eid, links, other = zip(*out) if out else ((), (), ())
    return pd.DataFrame({"eid": pd.array(eid, "int64"), "links": pd.array(links, "int64"), "other": pd.array(other, "Int64")})


def links(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, n_links (different texts that are similar),
    n_copies (rows of the same text), text_id (the same for equal texts; null for null)."""
    spark = small_batches(df.sparkSession)
    rows = entities(df, text, doc_id)
    texts = stash(rows.groupBy("eid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "texts")
    groups = stash(components(candidates(texts.filter("n > 0").select("eid", "n", "sketch")), "groups"), "groups")
    n_groups = groups.count() // 2  # a group has two members at least
    sizes = broadcast_if_small(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), n_groups, 16)
    tied = stash(groups.withColumnRenamed("node", "eid").join(sizes, "root").join(texts.select("eid", "rep"), "eid"), "tied")
    n_tied = tied.count()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    tied = tied.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("eid", F.lit(9)), F.col("blocks")).cast("int"))
    bodies = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("rep"), F.xxhash64(text).alias("eid"), F.col(text).alias("text"))
    own = bodies.join(broadcast_if_small(tied, n_tied, 48), [bodies["eid"] == tied["eid"], bodies["rep"].eqNullSafe(tied["rep"])]).select("root", "block", "blocks", tied["eid"], "text")
    pairs = own.select("root", "block", "eid", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    pairs = pairs.select("root", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "eid", "text")
    tested = pairs.repartition(shuffle_partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "eid").mapInPandas(_compare, "eid long, links long, other long")
    tested = stash(tested, "tested")
    classes = components(tested.filter("other is not null").select(F.col("eid").alias("a"), F.col("other").alias("b")), "classes")
    counts = tested.groupBy("eid").agg(F.sum("links").alias("n_links"))
    classed = stash(classes.withColumnRenamed("node", "eid").join(texts.select("eid", "rep"), "eid"), "classed")
    least = broadcast_if_small(classed.groupBy("root").agg(F.min("rep").alias("class_id")), classed.count() // 2, 16)
    named = stash(classed.join(least, "root").join(counts, "eid").select("eid", "class_id", "n_links"), "named")
    n_named = named.count()
    known = texts.select("eid", "rep", "n_copies").join(broadcast_if_small(named, n_named, 24), "eid", "left")
    known = known.select("eid", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = rows.select("doc_id", "eid").join(known, "eid").select("doc_id", "class_id", "n_links", "n_copies", F.col("eid").alias("text_id"))
    none = df.filter(F.col(text).isNull()).select(F.col(doc_id).cast("long").alias("doc_id"))
    return out.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("text_id")))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one document of each class, the one whose id is the class id.  Rows with null ids
    go if their class has an id, and stay otherwise; of repeated rows one stays."""
    found = stash(links(df, text, doc_id), "links")
    lost_id, lost_text = fresh(df, "lost_id", "lost_text")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(lost_id), F.col("text_id").alias(lost_text)).distinct()
    n_gone, copies = found.agg(F.count(F.when(~F.col("doc_id").eqNullSafe(F.col("class_id")), 1)), F.count(F.lit(1)) - F.countDistinct(F.struct("doc_id", "text_id"))).first()
    same = df[doc_id].cast("long").eqNullSafe(F.col(lost_id)) & F.xxhash64(df[text]).eqNullSafe(F.col(lost_text)) & df[text].isNotNull()
    out = df.join(broadcast_if_small(gone, n_gone, 24), same, "left_anti")
    return out.dropDuplicates([doc_id, text]) if copies else out


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document.  Null texts and null ids as in the module's text; ties have no part, as
    links are counted in full; repeated rows share class and links; very long texts are taken whole; an empty table
    gives no rows; other columns are not read."""
    return links(documents(spark, sf_dir).select("doc_id", "text"))
