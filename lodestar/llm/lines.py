"""Fuzzy line deduplication over a corpus.

Lines are cut at newlines; a line's set is its runs of ``SHINGLE`` characters (UTF-16 units).  Each
shingle is hashed once and gives ``BANDS * ROWS`` draws, of which a line keeps the least; copies of
a line meet in the same aggregation.  Lines that agree in all draws of a band share a bucket, and all
pairs of a bucket are candidates.  First, in the order of a further draw, a line is paired with the
first and with the two before it (buckets that hold a large part of all rows are salted, and their
lines are paired with one common line as well): that ties groups of near copies together.  Then the
lines of a bucket that are not tied to its largest group are held against all others of it, block
against block, by sketches of ``CELLS`` cells; pairs that are tied already need no look.  Pairs are verified by the exact Jaccard
similarity of their shingles, and connected components of what holds (and copies) keep one line: the
first in the document of least id.

Lines without a word are layout and stay.  Lines shorter than a shingle are only equal or not.
Null and empty texts have no line to drop and stay as they are.  Rows of equal id count as one
document; null ids come after all others.  Other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, documents, fresh, let, stash
from .components import components

SHINGLE, BANDS, ROWS = 9, 6, 3
SHARED, OF = 4, 5  # similarity of 4/5 or more
#: A draw is the shingle whose hash is nearest to a mask, by exclusive or: as the hashes are random, any
#: shingle of two lines is as likely as another to be it, and masks far apart in their upper bits
#: (multiples of the golden ratio) draw from different parts.
MASKS = tuple((k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(1, BANDS * ROWS + 1))
#: Shingles that are hashed in one row on their way to the draws.
STRIDE = 8
#: Bits of a draw that are compared (nine draws in a long), and draws that must agree before a pair is verified:
#: of 18 draws a pair of similarity 0.8 agrees in 14.4 on average, and in fewer than 9 with a chance of 1 in 10^3.
BITS, PACKED, AGREE = 7, 9, 9
#: Buckets of more than one in HOT of all rows are salted, SALT ways; ids of one in SAMPLE tell.
HOT, SALT, SAMPLE = 200, 64, 64
#: Lines in a block, where all pairs of a bucket are looked at.
LINES = 256
#: Lines outside the largest group of a bucket from which on the bucket's pairs are tested where they meet: at most
#: so many pairs a line and band are listed otherwise.
MANY = 32
#: Cells of a sketch, and how far an estimate may fall short, by the root of the cells that hold several shingles.
CELLS, SLACK = 512, 1.8
#: Differences that an estimate may have, by the number of cells that are filled.
ALLOWED = [int(u * (OF - SHARED) / OF + 1 + SLACK * max(0.0, u + (b := max(CELLS - u, 0.5)) * math.log(b / CELLS)) ** 0.5) for u in range(CELLS + 1)]


def line_id(line: Column) -> Column:
    return F.xxhash64(line)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _count(units: Column) -> Column:
    """Number of shingles, at least one."""
    return F.greatest(F.lit(1), F.octet_length(units) / 2 - (SHINGLE - 1)).cast("int")


def _shingle(units: Column, at: Column) -> Column:
    return F.xxhash64(F.substr(units, at * 2 + 1, F.lit(2 * SHINGLE)))


def signatures(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, n: occurrences, doc: least document, d0...: draws) of the distinct lines with a word."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    rows = df.select(key.alias("doc"), F.explode(F.split(F.col(text), "\n")).alias("line")).filter(_has_word(F.col("line")))
    rows = rows.select("doc", line_id(F.col("line")).alias("id"), _units(F.col("line")).alias("units"))
    rows = rows.select("doc", "id", "units", (_count(F.col("units")) - 1).alias("last"))
    rows = rows.select("doc", "id", "units", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STRIDE))).alias("at"))
    # the last shingle stands in for those beyond it
    rows = rows.select("doc", "id", "at", *[_shingle(F.col("units"), F.least(F.col("at") + j, F.col("last"))).alias(f"h{j}") for j in range(STRIDE)])
    draws = [F.shiftright(F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(STRIDE)])), 32).alias(f"d{k}") for k, m in enumerate(MASKS)]
    return rows.groupBy("id").agg(F.sum((F.col("at") == 0).cast("long")).alias("n"), F.min("doc").alias("doc"), *draws)


def _agreeing(a: Column, b: Column) -> Column:
    """In how many draws two packed signatures agree, by ``BITS`` bits of each."""
    out, field = F.lit(0), F.lit((1 << BITS) - 1).cast("long")
    for k in range(BANDS * ROWS // PACKED):
        differ = a[f"p{k}"].bitwiseXOR(b[f"p{k}"])
        for r in range(PACKED):
            out = out + (F.shiftright(differ, r * BITS).bitwiseAND(field) == 0).cast("int")
    return out


def _packed() -> Column:
    """A line's id and its draws, ``PACKED`` in a long."""

    def pack(k: int) -> Column:
        out = F.lit(0).cast("long")
        for r in range(PACKED):
            out = out.bitwiseOR(F.shiftleft(F.col(f"d{k * PACKED + r}").bitwiseAND(F.lit((1 << BITS) - 1)).cast("long"), r * BITS))
        return out.alias(f"p{k}")

    return F.struct("id", *[pack(k) for k in range(BANDS * ROWS // PACKED)])


def _key(k: int) -> Column:
    return F.xxhash64(F.lit(k), *[f"d{k * ROWS + r}" for r in range(ROWS)])


def _bucket_ids(signed: DataFrame) -> DataFrame:
    """(key: bucket, id) of each line and band."""
    return signed.select("id", F.explode(F.array(*[_key(k) for k in range(BANDS)])).alias("key")).select("key", "id")


def _buckets(signed: DataFrame) -> DataFrame:
    """(me: id and packed draws, key: bucket, next: a further draw), a row for each line and band."""
    band = lambda k: F.struct(_key(k).alias("key"), F.col(f"d{(k * ROWS + ROWS) % (BANDS * ROWS)}").alias("next"))
    rows = signed.select(_packed().alias("me"), F.array(*[band(k) for k in range(BANDS)]).alias("bands")).select("me", F.explode("bands").alias("b"))
    return rows.select("me", F.col("b")["key"].alias("key"), F.col("b")["next"].alias("next"))


def candidate_pairs(signed: DataFrame, n_lines: int) -> DataFrame:
    """(a, b) of lines that share a bucket and agree in enough draws, a few for each line; and
    (bucket, null) of the buckets of which not all pairs were looked at."""
    rows = _buckets(signed)
    seen = rows.filter(F.pmod(F.col("me")["id"], F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("me").alias("common"))
    hot = seen.filter(F.col("c") > max(16, n_lines // (SAMPLE * HOT))).select("key", "common")  # fewer than BANDS * HOT
    salted = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("common").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col("me")["id"]), F.lit(SALT))))
    w = W.partitionBy("key", "salt").orderBy("next", F.col("me")["id"])
    near = salted.select("me", "key", "common", F.row_number().over(w).alias("at"), F.first("me").over(w).alias("first"), F.lag("me").over(w).alias("one"), F.lag("me", 2).over(w).alias("two"))
    # of up to four lines in one salt all pairs are looked at; a line paired with itself tells of more
    more = (F.col("at") == 5) | (F.col("common").isNotNull() & (F.col("at") == 1))
    others = F.array(F.when(F.col("common")["id"] != F.col("me")["id"], F.col("common")), F.when(F.col("at") > 3, F.col("first")), F.col("one"), F.col("two"), F.when(more, F.col("me")))
    pairs = near.select("me", "key", F.explode(others).alias("other")).filter(F.col("other").isNotNull())
    itself = F.col("other")["id"] == F.col("me")["id"]
    pairs = pairs.filter(itself | (_agreeing(F.col("me"), F.col("other")) >= AGREE))
    return pairs.select(F.when(itself, F.col("key")).otherwise(F.greatest(F.col("me")["id"], F.col("other")["id"])).alias("a"), F.when(~itself, F.least(F.col("me")["id"], F.col("other")["id"])).alias("b")).distinct()


def _texts(df: DataFrame, ids: DataFrame, n_ids: int, text: str) -> DataFrame:
    """(id, line) of the lines ``ids``."""
    rows = df.select(F.explode(F.split(F.col(text), "\n")).alias("line")).select(line_id(F.col("line")).alias("id"), "line")
    return rows.join(broadcast_if_small(ids, n_ids, 16), "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))


def _shingles(line: Column) -> Column:
    """The set of a line."""
    return let(_units(line), lambda u: F.array_distinct(F.transform(F.sequence(F.lit(0), _count(u) - 1), lambda i: _shingle(u, i))))


def _sketches(lines: DataFrame) -> DataFrame:
    """(id, b0...: a bit a cell, f0...: cells that are not empty) of lines (id, line).  A shingle falls in a
    cell; a cell keeps one bit of its least shingle (one permutation, hashed once)."""
    rows = lines.select("id", _units(F.col("line")).alias("units")).select("id", "units", F.explode(F.sequence(F.lit(0), _count(F.col("units")) - 1)).alias("at"))
    rows = rows.select("id", _shingle(F.col("units"), F.col("at")).alias("h")).groupBy("id", F.pmod("h", F.lit(CELLS)).cast("int").alias("cell")).agg(F.min("h").alias("h"))
    rows = rows.select("id", F.floor(F.col("cell") / 64).alias("word"), F.expr("shiftleft(1L, cell % 64)").alias("mark"), (F.shiftright("h", 20).bitwiseAND(F.lit(1)) == 1).alias("bit"))
    zero = F.lit(0).cast("long")
    words = [F.coalesce(F.bit_or(F.when((F.col("word") == k) & test, F.col("mark"))), zero).alias(f"{name}{k}") for k in range(CELLS // 64) for name, test in (("b", F.col("bit")), ("f", F.lit(True)))]
    return rows.groupBy("id").agg(*words)


def _near(a: Column, b: Column) -> Column:
    """The sketches of two lines may be of lines that are similar.  Of the cells that either fills, one that only
    one fills tells of different shingles, and so does a differing bit, half the time.  Cells of one shingle tell
    the truth; how many hold several follows from how many are filled, and the estimate varies with their number.
    In simulations, 0.3 % at most of pairs at a similarity of 0.8 fall beyond the slack, and most pairs at 0.7 do."""
    used, lone, differ = F.lit(0), F.lit(0), F.lit(0)
    for k in range(CELLS // 64):
        f, g = a[f"f{k}"], b[f"f{k}"]
        used, lone = used + F.bit_count(f.bitwiseOR(g)), lone + F.bit_count(f.bitwiseXOR(g))
        differ = differ + F.bit_count(a[f"b{k}"].bitwiseXOR(b[f"b{k}"]).bitwiseAND(f.bitwiseAND(g)))
    return lone + 2 * differ <= F.get(F.lit(ALLOWED), used)


def _marks(line: Column) -> Column:
    """The set of a line by 32 bits of each hash."""
    return F.array_distinct(F.transform(_shingles(line), lambda h: F.shiftright(h, 32).cast("int")))


def _alike(key: Column, a: Column, b: Column) -> Column:
    """The lines ``a`` and ``b`` (keys: their buckets, marks) may be similar, asked in the first bucket that they share;
    one shingle more, as two may share a mark.  Within a lambda, as it is not to be inlined in the loop of a join."""
    p, q = a["marks"], b["marks"]
    first = F.array_min(F.array_intersect(a["keys"], b["keys"])) == key
    return F.exists(F.array(F.lit(0)), lambda _: first & ((F.size(F.array_intersect(p, q)) + 1) * (OF + SHARED) >= (F.size(p) + F.size(q)) * SHARED))


def remaining_pairs(df: DataFrame, signed: DataFrame, keys: DataFrame, n_keys: int, tied: DataFrame, n_tied: int, text: str) -> DataFrame:
    """(a, b) of all lines that share one of the buckets ``keys``, are near by their sketches and are not
    in one component (node, root) yet.  One of the two is not in the largest component of the
    bucket, so those lines are held against all, block against block.  Where they are many, near variants that
    are no links would be listed by the square of their number: there, lines bring their marks, and only pairs
    that are similar by these leave the join."""
    of_id = broadcast_if_small(tied.select(F.col("node").alias("id"), "root"), n_tied, 24)
    rows = _bucket_ids(signed).join(broadcast_if_small(keys, n_keys, 16), "key")
    rows = stash(rows.join(of_id, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "line-dense")
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    tops = parts.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "root")).alias("top")).filter(F.col("c") > F.col("top")["c"])
    blocks = lambda n: F.ceil(n / LINES).cast("int")
    tops = stash(tops.select("key", F.col("top")["root"].alias("top"), blocks(F.col("c") - F.col("top")["c"]).alias("rows"), blocks(F.col("c")).alias("columns"), (F.col("c") - F.col("top")["c"] > MANY).alias("many")), "line-tops")
    open_ = stash(rows.join(broadcast_if_small(tops, tops.count(), 32), "key"), "line-open")
    ids = stash(open_.groupBy("id").agg(F.max("many").alias("many"), F.collect_set(F.when(F.col("many"), F.col("key"))).alias("keys")), "line-open-ids")
    n_ids, n_many = ids.agg(F.count(F.lit(1)), F.count(F.when(F.col("many"), 1))).first()
    sketches = stash(_sketches(_texts(df, ids.select("id"), n_ids, text)), "line-sketches")
    open_ = open_.join(broadcast_if_small(sketches, n_ids, 16 + CELLS // 4), "id")
    if n_many:
        marks = stash(_texts(df, ids.filter("many").select("id"), n_many, text).select("id", _marks(F.col("line")).alias("marks")).join(ids.select("id", "keys"), "id"), "line-marks")
        n_marks = marks.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()[0]
        open_ = open_.join(broadcast_if_small(marks, n_marks + 32 * n_many, 4), "id", "left")
    else:
        open_ = open_.withColumns({"marks": F.lit(None).cast("array<int>"), "keys": F.lit(None).cast("array<bigint>")})
    own = F.struct("id", *[f"{name}{k}" for k in range(CELLS // 64) for name in "bf"], *[F.when(F.col("many"), F.col(name)).alias(name) for name in ("marks", "keys")]).alias("me")
    open_ = open_.select("key", "root", "top", "rows", "columns", own)
    block = lambda n: F.pmod(F.xxhash64(F.col("me")["id"], F.lit(7)), F.col(n)).cast("int")
    some = open_.filter("root != top").select("key", "me", "root", block("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    every = open_.select("key", F.col("me").alias("other"), F.col("root").alias("far"), "top", block("columns").alias("j"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"))
    a, b = F.col("me")["id"], F.col("other")["id"]
    differ = (F.col("root") != F.col("far")) & ((F.col("far") == F.col("top")) | (a < b))
    same = (some["key"] == every["key"]) & (some["i"] == every["i"]) & (some["j"] == every["j"])
    alike = F.col("me")["marks"].isNull() | _alike(some["key"], F.col("me"), F.col("other"))
    met = some.join(every, same & differ & _near(F.col("me"), F.col("other")) & alike)
    return met.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def verified(df: DataFrame, pairs: DataFrame, text: str) -> DataFrame:
    """The pairs whose lines are similar."""
    ends = stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line-ends")
    bodies = stash(_texts(df, ends, ends.count(), text), "line-texts")
    # sizes that far apart rule a pair out before any shingle is compared
    near = lambda p, q: (F.size(p) * OF >= F.size(q) * SHARED) & (F.size(q) * OF >= F.size(p) * SHARED)
    like = lambda p, q: near(p, q) & (F.size(F.array_intersect(p, q)) * (OF + SHARED) >= (F.size(p) + F.size(q)) * SHARED)
    n_bytes = bodies.agg(F.coalesce(F.sum(F.octet_length("line")), F.lit(0))).first()[0]
    if n_bytes * 8 <= BROADCAST_BYTES:  # a shingle of eight bytes a character
        sets = bodies.select("id", _shingles(F.col("line")).alias("set"))
        both = pairs.join(F.broadcast(sets.toDF("a", "x")), "a").join(F.broadcast(sets.toDF("b", "y")), "b")
        return both.filter(like(F.col("x"), F.col("y"))).select("a", "b")
    both = pairs.join(bodies.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    both = both.join(bodies.select(F.col("id").alias("b"), _shingles(F.col("line")).alias("y")), "b")
    # an array of one set, exploded: a column that is made once, where a projection would be repeated in the filter
    return both.select("a", "b", "y", F.explode(F.array(_shingles(F.col("x")))).alias("p")).filter(like(F.col("p"), F.col("y"))).select("a", "b")


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, root, home) of the lines that are not the only one of their class: ``home`` is the
    document whose first such line stays."""
    signed = stash(signatures(df, text, doc_id), "line-signatures")
    n_lines = signed.count()
    pairs = stash(candidate_pairs(signed, n_lines), "line-pairs")
    held = stash(verified(df, pairs.filter("b is not null"), text), "line-links")
    keys = pairs.filter("b is null").select(F.col("a").alias("key"))
    n_keys = keys.count()
    tied = components(held, "line-classes")
    n_tied = held.count() * 2
    if n_keys:
        more = stash(remaining_pairs(df, signed, keys, n_keys, tied, n_tied, text), "line-remaining")
        if not more.isEmpty():
            late = stash(verified(df, more, text), "line-late")
            n_late = late.count()
            if n_late:
                stars = tied.select(F.col("node").alias("a"), F.col("root").alias("b"))
                tied, n_tied = components(stars.unionByName(late), "line-classes"), n_tied + n_late * 2
    tied = tied.select(F.col("node").alias("id"), "root")
    lines = signed.select("id", "n", "doc").join(broadcast_if_small(tied, n_tied, 24), "id", "left")
    lines = lines.filter("root is not null or n > 1").select("id", F.coalesce("root", "id").alias("root"), "doc")
    n_shared = signed.filter("n > 1").count()
    homes = lines.groupBy("root").agg(F.min("doc").alias("home"))
    return lines.select("id", "root").join(broadcast_if_small(homes, n_shared + n_tied, 16), "root")


def drop_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with the text without its dropped lines, and ``dropped_lines`` (numbers from 0)."""
    known = stash(classes(df, text, doc_id), "line-homes")
    dropped, doc, body, cut = fresh(df, "dropped_lines", "doc_key", "text_key", "cut")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    rows = df.select(key.alias("doc"), F.xxhash64(text).alias("body"), F.split(F.col(text), "\n").alias("lines"))
    rows = rows.select("doc", "body", F.posexplode("lines").alias("at", "line"))
    met = rows.select("doc", "body", "at", line_id(F.col("line")).alias("id")).join(broadcast_if_small(known, known.count(), 32), "id")
    places = met.groupBy("doc", "body", "root", (F.col("doc") == F.col("home")).alias("at_home")).agg(F.sort_array(F.collect_set("at")).alias("at"))
    places = places.select("doc", "body", F.when(F.col("at_home"), F.slice("at", 2, F.greatest(F.size("at"), F.lit(1)))).otherwise(F.col("at")).alias("at")).filter(F.size("at") > 0)
    gone = stash(places.groupBy("doc", "body").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at")), "line-drops")
    n_gone, n_at = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    gone = broadcast_if_small(gone.select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("at").alias(cut)), n_gone * 64 + n_at * 4, 1)
    out = df.withColumn(doc, key).withColumn(body, F.xxhash64(text)).join(gone, [doc, body], "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(cut), i)), "\n")
    shown = [F.when(F.col(cut).isNull(), F.col(f"`{text}`")).otherwise(left).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns]
    return out.select(*shown, F.coalesce(cut, F.array().cast("array<int>")).alias(dropped))


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document.  Null and empty texts drop none; of equal lines the first in the document
    of least id stays, and of repeated rows each keeps it; very long texts are cut into lines like others; an empty table
    gives no rows; other columns are not read."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = drop_lines(docs)
    kept = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        F.size("dropped_lines").cast("long").alias("n_dropped"),
        "dropped_lines",
        F.length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
