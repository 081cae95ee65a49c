"""Document fingerprints by consistent weighted sampling (Ioffe 2010).

A document's terms are its runs of five words, weighted by how often they occur.  For each of
``SAMPLES`` draws every term gets r and c from Gamma(2, 1) and b from (0, 1), all from its hash;
with t = floor(ln w / r + b) its rank is ln c - r (t - b + 1), and the term of the least rank, with
its t, is the sample.  Two documents draw the same sample with a probability that is the
generalised Jaccard similarity of their weighted terms, so the share of equal samples estimates it.
The gammas come from a table of ``STEPS`` quantiles, a row that is joined to every document, since
logarithms would take most of the time and repeated constants most of the planning.

Everything is arrays and aggregates: one least number per draw holds the rank in its upper bits and
24 bits of the sample below.

Texts that are null or without a word have no terms; their fingerprint is all zeros, and two such
are alike (1), one and another text not (0).  Texts of fewer than five words are one term.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, let, place, shuffle_partitions, small_table, words

SAMPLES, STEPS, WORDS = 64, 4096, 5
ID_BITS = 24


def terms(text: Column) -> Column:
    """Array of (x: hash, w: weight) of the terms of a text."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[w[i + d] for d in range(WORDS)]))
        few = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= WORDS, F.sort_array(runs)).otherwise(few)

    def runs_of(h: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.coalesce(h[i] != F.get(h, i - 1), F.lit(True)))
        weighed = let(first, lambda s: F.transform(s, lambda p, k: F.struct(h[p].alias("x"), (F.coalesce(F.get(s, k + 1), F.size(h)) - p).alias("w"))))
        return F.when(F.size(h) > 0, weighed)

    return let(let(words(F.coalesce(text, F.lit(""))), hashes), runs_of)


def gamma_quantiles(steps: int = STEPS) -> list[float]:
    """Quantiles of Gamma(2, 1) in the middle of equal steps, by Newton's method."""
    out, x = [], 1e-3
    for i in range(steps):
        p = (i + 0.5) / steps
        for _ in range(60):
            d = (1 - math.exp(-x) * (1 + x) - p) / (x * math.exp(-x))
            x = max(x / 4, x - d)
            if abs(d) < 1e-12 * x:
                break
        out.append(x)
    return out


def gamma_table(spark: SparkSession) -> DataFrame:
    """One row: zero, the quantiles and their logarithms.  They depend on the row, else the optimizer
    would write the constant arrays into each of the draws."""
    nothing = F.replace(F.col("id").cast("string"), F.lit("0"), F.lit(""))
    column = lambda values: F.split(F.concat(F.lit(",".join(map(repr, values))), nothing), ",").cast("array<double>")
    gamma = gamma_quantiles()
    return spark.range(1).select(F.col("id").alias("zero"), column(gamma).alias("gamma"), column([math.log(g) for g in gamma]).alias("log_gamma"))


def draws(count: int = SAMPLES) -> list[Column]:
    """One aggregate a draw over rows (x, lw: log of the weight, gamma, log_gamma)."""
    out, step = [], F.lit(STEPS - 1)
    for k in range(count):
        h = F.xxhash64(F.lit(k), F.col("x"))
        r = F.get("gamma", h.bitwiseAND(step).cast("int"))
        c = F.get("log_gamma", F.shiftright(h, 12).bitwiseAND(step).cast("int"))
        b = (F.shiftright(h, 24).bitwiseAND(F.lit((1 << 20) - 1)).cast("double") + 0.5) * (1.0 / (1 << 20))
        t = F.when(F.col("lw") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("lw") / r + b))
        rank = c - r * (t.cast("double") - b + 1.0)
        own = F.col("x").bitwiseXOR(t * 7919).bitwiseAND(F.lit((1 << ID_BITS) - 1))
        out.append(F.min(F.shiftleft(((rank + 128.0) * float(1 << 30)).cast("long"), ID_BITS).bitwiseOR(own)).alias(f"d{k}"))
    return out


def samples(count: int = SAMPLES) -> Column:
    """The fingerprint, an array of ints, from the columns of ``draws``."""
    own = F.lit((1 << ID_BITS) - 1)
    return F.array(*[F.coalesce(F.col(f"d{k}").bitwiseAND(own).cast("int"), F.lit(0)) for k in range(count)])


def likeness(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def shown(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), ID_BITS // 4, "0")), "")


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, samples) per distinct keys of ``rows`` (keys may not be called body, zero, gamma or
    log_gamma).  If the rows are already dealt out by some of the keys, nothing moves."""
    zero = F.coalesce(F.length(text), F.lit(0)).bitwiseAND(F.lit(0)).cast("long")
    told = rows.select(*keys, F.col(text).alias("body"), zero.alias("zero")).join(F.broadcast(gamma_table(rows.sparkSession)), "zero")  # one row
    single = told.select(*keys, "gamma", "log_gamma", F.explode_outer(terms(F.col("body"))).alias("term"))
    weighed = single.select(*keys, "gamma", "log_gamma", F.col("term")["x"].alias("x"), F.log(F.col("term")["w"].cast("double")).alias("lw"))
    return weighed.groupBy(*keys).agg(*draws()).select(*keys, samples().alias("samples"))


def with_next(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (part, rn, guest, doc_id, text, next): each document in descending order of id, the next
    one's text beside it; after the last comes the first.  The ids are cut into ranges by quantiles,
    a range is one window, and the first row of a range is a guest at the end of the one before.
    Null ids come last; rows of equal ids in the order of their texts' hashes."""
    spark = df.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    rows = rows.withColumn("own", place(F.col("key"), cuts, max(2, math.isqrt(len(cuts) + 1))))
    heads = sorted(([r[0], r[1][0], r[1][1]] for r in rows.groupBy("own").agg(F.max(F.struct("key", "h"))).collect()), reverse=True)
    order = [h[0] for h in heads]
    goes = {b: a for a, b in pairwise(order)} | ({order[0]: order[-1]} if order else {})
    visits = small_table(spark, [[*h, goes[h[0]]] for h in heads], ["own", "head", "head_h", "goes"])
    rows = rows.join(F.broadcast(visits), "own")  # one row a range
    twice = F.when((F.col("key") == F.col("head")) & (F.col("h") == F.col("head_h")), F.array(F.struct(F.col("own").cast("long").alias("part"), F.lit(0).alias("guest")), F.struct(F.col("goes").alias("part"), F.lit(1).alias("guest"))))
    rows = rows.select("doc_id", "text", "key", "h", F.explode(F.coalesce(twice, F.array(F.struct(F.col("own").cast("long").alias("part"), F.lit(0).alias("guest"))))).alias("at"))
    rows = rows.select("doc_id", "text", "key", "h", F.col("at")["part"].alias("part"), F.col("at")["guest"].alias("guest"))
    w = W.partitionBy("part").orderBy("guest", F.desc("key"), F.desc("h"))
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("text").over(w)).drop("key", "h")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half of code points replaced by the first as many of the following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def op1_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms.  Null texts are empty and have a fingerprint of their
    own; equal texts have equal ones, whatever their length; rows of equal or null ids stay as they are, ordered by
    their text among each other; an empty table gives no rows; other columns are not read."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs)
    changed = edited(F.col("text"), F.coalesce("next", F.lit("")))
    rows = rows.select("part", "rn", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", changed.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.when(F.col("guest") == 1, F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("body")))).otherwise(
        F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("body")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("body")))
    )
    rows = rows.select("part", "rn", "guest", "doc_id", "n_chars", "edited_sha256", F.explode(both).alias("b"))
    rows = rows.select("part", "rn", "guest", "doc_id", "n_chars", "edited_sha256", F.col("b")["v"].alias("v"), F.col("b")["body"].alias("body"))
    prints = fingerprints(rows, ["part", "rn", "guest", "doc_id", "n_chars", "edited_sha256", "v"], "body")
    w = W.partitionBy("part").orderBy("rn", "v")
    out = prints.withColumn("changed", F.lead("samples").over(w)).withColumn("following", F.lead("samples", 2).over(w)).filter("guest = 0 and v = 0")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("samples")).alias("fingerprint"),
        shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("changed")).alias("near_edited"),
        likeness(F.col("samples"), F.col("following")).alias("near_next"),
    )
